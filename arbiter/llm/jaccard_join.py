"""N-gram Jaccard join of texts with Bayesian candidate pruning.

All pairs of different texts whose sets of five-word shingles have a Jaccard
similarity of at least ``THRESHOLD`` are found, in these steps:

1. Every text gets a MinHash signature; equal texts are one class (an
   aggregation by digest, so a hot copy is one row per task).
2. Bands of the signature give buckets.  With 32 bands of 4 values a pair at the
   threshold shares none with probability 5e-8.
3. Inside the buckets signatures are compared part by part, and a pair is
   dropped as soon as the posterior probability of reaching the threshold, given
   the values equal so far (uniform prior), is below ``TOLERANCE``.  A bucket of
   any size is cut into blocks and each pair of blocks is a task of its own.
   Only a spanning forest of the surviving pairs leaves a block.
4. The forest's connected components hold every surviving pair.  Inside them the
   pairs are pruned again and the rest verified exactly, on the whole shingle
   sets, again block by block.  What leaves is a count per text and again a
   forest; pairs are never written.

Edge cases: null and empty texts, and texts without words, have no shingles and
no links (equal ones still share a class); a text of 1 to 4 words has one
shingle of all its words; repeated rows are copies of one class; an empty table
gives no rows; columns of the input keep their names, packed in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import shuffle_width, slices, small_batches, split_by_keys, written
from arbiter.llm.shingles import connected, mix64, shingle_sets

THRESHOLD = 0.8
HASHES, BANDS = 128, 32
#: Signature values compared before each look at the posterior.
STEP = 32
TOLERANCE = 1e-6
#: Texts in a block, and shingles in a block of very long texts.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Text bytes cut into shingles at once; their words are objects, of many times their size.
PART_BYTES = 1 << 20
#: Texts whose shingles one incidence table holds on a side, and its shingles.
TABLE, COLUMNS = 128, 1 << 12

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signatures(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """MinHash values (texts x HASHES, uint32); texts without shingles keep the largest value."""
    out = np.full((len(lengths), HASHES), np.iinfo(np.uint32).max, np.uint32)
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat(((hashes * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; it also depends on the band's number."""
    rows = HASHES // BANDS
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for k in range(rows):
        key = mix64(key * np.uint64(31) + sig[:, k::rows].astype(np.uint64))
    return key.view(np.int64)


def least_equal(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values the least number of equal ones that keeps a pair.

    With a uniform prior the posterior of the similarity is a Beta distribution,
    and its probability above ``threshold`` is a binomial tail.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out[n] = m
    return out


def surviving(left: np.ndarray, right: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of two blocks of signatures that pruning keeps; ``same``: one block, i < j."""
    need = least_equal(threshold, tolerance)
    equal = np.zeros((len(left), len(right)), np.uint8)
    for k in range(STEP):
        equal += left[:, k, None] == right[None, :, k]
    i, j = np.nonzero(equal >= need[STEP])
    if same:
        i, j = i[i < j], j[i < j]
    n = equal[i, j].astype(np.int64)
    for first in range(STEP, HASHES, STEP):
        part = slice(first, first + STEP)
        for at in range(0, len(i), 1 << 14):
            own = slice(at, at + (1 << 14))
            n[own] += (left[i[own], part] == right[j[own], part]).sum(axis=1)
        keep = n >= need[first + STEP]
        i, j, n = i[keep], j[keep], n[keep]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each of ``n`` places' component under the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections sets[i] and sets[j], through incidence tables of the shingles that several texts of a table hold."""
    out = np.zeros(len(i), np.int64)
    tile = (i // TABLE) * (len(sets) // TABLE + 1) + j // TABLE
    for t in np.unique(tile).tolist():
        pairs = np.flatnonzero(tile == t)
        a, ai = np.unique(i[pairs], return_inverse=True)
        b, bi = np.unique(j[pairs], return_inverse=True)
        if len(pairs) * 4 < len(a) + len(b) or len(pairs) < 8:
            out[pairs] = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i[pairs].tolist(), j[pairs].tolist(), strict=True)]
            continue
        members = np.unique(np.concatenate([a, b]))
        flat = np.concatenate([sets[x] for x in members.tolist()])
        owner = np.repeat(np.arange(len(members)), [len(sets[x]) for x in members.tolist()])
        shared, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        several = count[code] > 1
        column = (np.cumsum(count > 1) - 1)[code[several]]
        width = int((count > 1).sum())
        total = np.zeros((len(a), len(b)), np.float32)
        of_a, of_b = np.searchsorted(members, a), np.searchsorted(members, b)
        for first in range(0, width, COLUMNS):
            inside = (column >= first) & (column < first + COLUMNS)
            table = np.zeros((len(members), min(COLUMNS, width - first)), np.float32)
            table[owner[several][inside], column[inside] - first] = 1
            total += table[of_a] @ table[of_b].T
        out[pairs] = total[ai, bi].astype(np.int64)
    return out


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def classes_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, class_id, n_docs, n_shingles, sig, bands): one row per different text; the class id is its least id."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(text, F.lit("")).alias("text"), _key(text).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                hashes, lengths = shingle_sets(part.column("text").to_pylist())
                sig = signatures(hashes, lengths)
                bands = pa.ListArray.from_arrays(np.arange(0, (len(sig) + 1) * BANDS, BANDS, dtype=np.int32), pa.array(band_keys(sig).ravel()))
                packed = pa.array([x.tobytes() for x in sig], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), pa.array(lengths, pa.int64()), packed, bands], ["id", "key", "n_shingles", "sig", "bands"]
                )

    id_type = rows.schema["id"].dataType.simpleString()
    signed = rows.mapInArrow(run, f"id {id_type}, key binary, n_shingles long, sig binary, bands array<long>")
    return signed.groupBy("key").agg(
        F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )


def in_blocks(members: DataFrame, group: str, weight: Column, size: int = BLOCK, most: int = BLOCK_SHINGLES) -> DataFrame:
    """Deal the members of each group to pairs of blocks: adds (block, left, right), and sorts each partition by them.

    A group of any size is cut into blocks by key, and each row goes once to
    every pair that holds its block.
    """
    spark = members.sparkSession
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / size), F.ceil(F.col("w") / most), F.lit(1)).cast("int")
    dealt = members.join(sizes.where("n > 1").select(group, blocks.alias("blocks")), group)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other", "blocks")
    return dealt.repartition(shuffle_width(spark), group, "left", "right").sortWithinPartitions(group, "left", "right", "block", "key")


def block_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows with equal ``names`` from sorted batches; only one group is held across batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and not all(rest[-1].column(c)[rest[-1].num_rows - 1] == batch.column(c)[0] for c in names):
            yield pa.Table.from_batches(rest)
            rest = []
        change = np.zeros(batch.num_rows, bool)
        for c in names:
            v = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _signature_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def candidate_forest(classes: DataFrame, threshold: float, tolerance: float, block: int = BLOCK) -> DataFrame:
    """(u, v): keys linked through pairs that pruning keeps inside some bucket; a forest per block, not the pairs."""
    banded = classes.where("n_shingles > 0").select("key", F.explode("bands").alias("bucket"))
    # Buckets with the same members are one: similar texts share most of their bands.
    same = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
    live = banded.groupBy("bucket").agg(*same).where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = banded.join(live, "bucket").groupBy("key").agg(F.collect_list("bucket").alias("buckets"))
    members = members.join(classes.select("key", "sig"), "key").select("key", "sig", F.explode("buckets").alias("bucket"))
    dealt = in_blocks(members, "bucket", F.lit(1), block).select("bucket", "left", "right", "block", "key", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in block_groups(batches, ["bucket", "left", "right"]):
            same = group["left"][0] == group["right"][0]
            sig, block, keys = _signature_rows(group["sig"]), group["block"].to_numpy(), group["key"].to_pylist()
            cut = 0 if same else int(np.searchsorted(block, group["right"][0].as_py()))
            i, j = surviving(sig if same else sig[:cut], sig[cut:], same, threshold, tolerance)
            root = forest(len(keys), i, j + cut)
            own = np.flatnonzero(root != np.arange(len(keys))).tolist()
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in own], pa.binary()), pa.array([keys[root[k]] for k in own], pa.binary())], ["u", "v"])

    return dealt.mapInArrow(run, "u binary, v binary").distinct()


def verified_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, text_col: str, threshold: float, tolerance: float, block: int = BLOCK) -> DataFrame:
    """(key, root, links, texts): per text the linked documents and texts found by exact comparison, and a tree edge of each block's links."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(text.alias("text"), _key(text).alias("key"))
    members = clusters.select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    some = split_by_keys(rows, members, "key")[0].join(members, "key")
    texts = some.groupBy("key").agg(F.first("cluster").alias("cluster"), F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                hashes, lengths = shingle_sets(part.column("text").to_pylist())
                ends = np.cumsum(lengths)
                packed = [hashes[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("cluster"), pa.array([s.tobytes() for s in signatures(hashes, lengths)], pa.binary()), pa.array(packed, pa.binary())],
                    ["key", "cluster", "sig", "shingles"],
                )

    found = texts.mapInArrow(sets, "key binary, cluster binary, sig binary, shingles binary")
    members = written(found.join(classes.select("key", "n_docs"), "key"), "jaccard-sets")
    dealt = in_blocks(members, "cluster", F.length("shingles") / 8, block).select("cluster", "left", "right", "block", "key", "sig", "shingles", "n_docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in block_groups(batches, ["cluster", "left", "right"]):
            same = group["left"][0] == group["right"][0]
            sig, block, keys = _signature_rows(group["sig"]), group["block"].to_numpy(), group["key"].to_pylist()
            own_sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
            n_docs, size = group["n_docs"].to_numpy(), np.array([len(x) for x in own_sets], np.int64)
            cut = 0 if same else int(np.searchsorted(block, group["right"][0].as_py()))
            i, j = surviving(sig if same else sig[:cut], sig[cut:], same, threshold, tolerance)
            j = j + cut
            both = overlaps(own_sets, i, j)
            keep = both >= threshold * (size[i] + size[j] - both)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            texts, links = np.bincount(np.concatenate([i, j]), minlength=len(keys)), np.bincount(np.concatenate([i, j]), np.concatenate([n_docs[j], n_docs[i]]), len(keys))
            root = forest(len(keys), i, j)
            own = np.flatnonzero(texts).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[k] for k in own], pa.binary()), pa.array([keys[root[k]] for k in own], pa.binary()), pa.array(links[own].astype(np.int64)), pa.array(texts[own].astype(np.int64))],
                ["key", "root", "links", "texts"],
            )

    return dealt.mapInArrow(run, "key binary, root binary, links long, texts long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK
) -> DataFrame:
    """One row per different text: (key, class_id, n_docs, n_links, n_linked_texts, group_key, group_id).

    ``key`` is the MD5 of the text (null as empty).  ``n_links`` counts the other
    documents that each document of the class is linked with, copies included;
    ``group_key`` is the least key of the connected group, ``group_id`` its
    least id.
    """
    small_batches(docs.sparkSession)
    classes = written(classes_of(docs, id_col, text_col), "jaccard-classes")
    clusters = written(connected(candidate_forest(classes, threshold, tolerance, block), "jaccard-candidates"), "jaccard-clusters")
    links = written(verified_links(docs, classes, clusters, text_col, threshold, tolerance, block), "jaccard-links")
    groups = connected(links.select(F.col("key").alias("u"), F.col("root").alias("v")), "jaccard-groups")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    out = (
        classes.select("key", "class_id", "n_docs", "n_shingles")
        .join(counts, "key", "left")
        .join(groups.select(F.col("node").alias("key"), F.col("root")), "key", "left")
        .withColumn("group_key", F.coalesce("root", "key"))
    )
    least = out.groupBy("group_key").agg(F.min("class_id").alias("group_id"))
    copies = F.when(F.col("n_shingles") > 0, F.col("n_docs") - 1).otherwise(F.lit(0))
    return out.join(least, "group_key").select(
        "key", "class_id", "n_docs", (F.coalesce("links", F.lit(0)) + copies).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"), "group_key", "group_id",
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the first by id, of the text with the least id in its group.

    Rows whose text has no words belong to no group and all stay.  Texts that
    occur once and stay for their group are not shuffled.
    """
    found = written(near_duplicates(docs, id_col, text_col, threshold), "jaccard-found")
    # The text that stays for a group is the one with the least (class id, key).
    chosen = found.groupBy("group_key").agg(F.min(F.struct("class_id", "key")).alias("c")).select(F.col("c.key").alias("__key"))
    several = found.where("n_docs > 1").select(F.col("key").alias("__key")).union(found.select(F.col("key").alias("__key")).join(chosen, "__key", "left_anti"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), _key(text).alias("__key"), F.col(f"`{id_col}`").alias("__id"), text.rlike(r"[^\x20\x09-\x0D]").alias("__has"))
    wordless = rows.where("not __has").select("row.*")
    first = F.struct(F.col("__id").isNull(), F.col("__id"), F.xxhash64("row"))
    maybe, single = split_by_keys(rows.where("__has"), several, "__key")
    kept = maybe.join(chosen, "__key", "left_semi").groupBy("__key").agg(F.min_by("row", first).alias("row")).select("row.*")
    return single.select("row.*").union(kept).union(wordless)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Per document its class (the least id of its group of linked documents), its links, and the least id of its equal texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return (
        docs.select("doc_id", _key(F.col("text")).alias("key"))
        .join(found, "key")
        .select("doc_id", F.col("group_id").alias("class_id"), "n_links", F.col("class_id").alias("text_id"), "n_docs", "n_linked_texts")
    )
