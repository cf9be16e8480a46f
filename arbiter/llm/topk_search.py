"""Exact top-k inner products by block-at-a-time pruning.

Every dimension is a term, every entry (scaled to an integer) its weight.
Vectors are numbered in the order of their strongest terms and cut into blocks
of consecutive numbers; a block keeps, per term, the largest and the least
weight, and its vectors as a forward index (a packed matrix).  For a query the
sum over terms of the larger of weight times largest and weight times least is
a bound of every score in the block.  Blocks are taken in falling order of
their bounds and scored whole, until the next bound is below the k-th score so
far (or equals it and the block has no smaller id): no later block can matter.

On Spark, blocks lie in shards of bounded size and queries in packs of bounded
size, and a task gets one shard and one pack, whatever the data:

1. packs meet only the blocks' maxima, which gives every query its best shard;
2. every query searches its best shard, which gives it a k-th score;
3. every query searches the other shards from that score on; a shard whose
   bounds are all below it costs the bounds only.

The grid of packs and shards is the stated query set against all rows in
blocks; rows that come out are the few best per query and shard.

Edge cases: vectors that are null, or hold nulls, entries that are not finite or
too large for a long, take no part; shorter vectors count as padded with zeros;
rows with the query's own id are no candidates of it, so repeated rows find
each other never, but each repeated query row gets its answer; a candidate with
a null id ranks after others of its score; an empty table gives no rows; other
columns are not read, so their names may clash; a score beyond a long is null.
Scores are exact: products go through doubles only where these hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.llm.common import written
from arbiter.llm.vectors import product, scaled, size_of

SCALE = 256
#: Vectors in a block, blocks in a shard, and queries in a pack.
BLOCK, SHARD_BLOCKS, PACK = 256, 256, 16_384
#: Queries searched at once in a task.
SLICE = 2048
#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max


def padded(lengths: np.ndarray, values: np.ndarray, d: int) -> np.ndarray:
    """Vectors end to end as rows of ``d`` entries."""
    if (lengths == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d) < lengths[:, None]] = values
    return out


def pack(x: np.ndarray) -> bytes:
    """An integer matrix in as few bytes an entry as hold it."""
    most = size_of(x)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def unpack(data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).reshape(-1, d).astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest score that a vector of each block (columns) can have with each query (rows)."""
    return product(np.maximum(queries, 0), high.T) + product(np.minimum(queries, 0), low.T)


class Best:
    """The k best (score, id) of each query, highest score first, then least id; missing places have the id -1."""

    def __init__(self, n: int, k: int, kind: type = np.int64):
        self.scores = np.full((n, k), np.iinfo(np.int64).min, kind)
        self.ids = np.full((n, k), -1, np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Candidates ``ids`` (columns) of the queries ``rows`` with their ``scores``; only where ``allowed``."""
        k = self.scores.shape[1]
        held = self.ids[rows, -1] >= 0
        enough = allowed & (~held[:, None] | (scores >= self.scores[rows, -1][:, None]))
        if scores.shape[1] > k and scores.dtype != object:
            # Only what reaches the k-th best of the block itself; ties stay.
            masked = np.where(enough, scores, np.iinfo(np.int64).min)
            enough &= scores >= np.partition(masked, scores.shape[1] - k, axis=1)[:, -k][:, None]
        r, c = np.nonzero(enough)
        if not len(r):
            return
        touched, r = np.unique(r, return_inverse=True)
        own = rows[touched]
        at, place = np.nonzero(self.ids[own] >= 0)
        who = np.concatenate([at, r])
        score = np.concatenate([self.scores[own][at, place], scores[touched[r], c]])
        ident = np.concatenate([self.ids[own][at, place], ids[c]])
        order = np.lexsort((ident, -score, who)) if score.dtype != object else np.array(sorted(range(len(who)), key=lambda i: (who[i], -score[i], ident[i])))
        who, score, ident = who[order], score[order], ident[order]
        first = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(first, np.diff(first, append=len(who)))
        top = rank < k
        self.ids[own] = -1
        self.scores[own[who[top]], rank[top]] = score[top]
        self.ids[own[who[top]], rank[top]] = ident[top]


def search(queries: np.ndarray, own: np.ndarray, kth: tuple[np.ndarray, np.ndarray] | None, blocks: list[tuple[np.ndarray, np.ndarray]], high: np.ndarray, low: np.ndarray, k: int) -> tuple[Best, int]:
    """(the best of these blocks, blocks scored) for queries with ids ``own``.

    ``blocks`` are (ids, vectors), ``kth`` the k-th (score, id) that queries
    already have elsewhere (id -1: fewer), beyond which nothing is returned.
    """
    bound = bounds(queries, high, low)
    best = Best(len(queries), k, bound.dtype.type if bound.dtype != object else object)
    order = np.argsort(-bound, axis=1, kind="stable")
    least = np.array([ids.min() for ids, _ in blocks])
    have = np.full(len(queries), -1, np.int64) if kth is None else kth[1]
    floor = np.zeros(len(queries), np.int64) if kth is None else kth[0]
    alive, scored = np.arange(len(queries)), 0
    for step in range(len(blocks)):
        block = order[alive, step]
        top = bound[alive, block]
        # The next bound is the highest of those left: below a k-th score ends the query, a tie without a smaller id skips the block.
        end, skip = np.zeros(len(alive), bool), np.zeros(len(alive), bool)
        for score, ident in ((floor[alive], have[alive]), (best.scores[alive, -1], best.ids[alive, -1])):
            end |= (ident >= 0) & (top < score)
            skip |= (ident >= 0) & (top == score) & (least[block] > ident)
        go = ~end & ~skip
        rows, block = alive[go], block[go]
        by = np.argsort(block, kind="stable")
        rows, block = rows[by], block[by]
        first = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(first.tolist(), [*first.tolist(), len(block)][1:], strict=True):
            ids, vectors = blocks[block[a]]
            some = rows[a:b]
            scores = product(queries[some], vectors.T)
            allowed = ids != own[some][:, None]
            if kth is not None:
                score, ident = floor[some][:, None], have[some][:, None]
                allowed &= (ident < 0) | (scores > score) | ((scores == score) & (ids < ident))
            best.offer(some, scores, ids, allowed)
            scored += b - a
        alive = alive[~end]
        if not len(alive):
            break
    return best, scored


def _vectors(rows: DataFrame, id_col: str, vector_col: str, query: Column | None) -> DataFrame:
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), (F.coalesce(query, F.lit(False)) if query is not None else F.lit(False)).alias("query"))


def _measured(table: DataFrame) -> tuple[int, int, int]:
    """(rows, queries, longest vector) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, q, d = 0, 0, 0
        for batch in batches:
            row, lengths, _ = scaled(batch.column("v"), SCALE)
            n, d = n + len(row), max(d, int(lengths.max(initial=0)))
            q += int(batch.column("query").to_numpy(zero_copy_only=False)[row].sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, q, d)], ["n", "q", "d"])

    r = table.mapInArrow(run, "n long, q long, d long").agg(F.sum("n"), F.sum("q"), F.max("d")).first()
    return r[0] or 0, r[1] or 0, r[2] or 0


def _taking_part(table: DataFrame, d: int) -> DataFrame:
    """(term, id, x, query): integer vectors as packed longs and the number of their two strongest terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lengths, values = scaled(batch.column("v"), SCALE)
            x = padded(lengths, values, d)
            size = np.abs(x)
            term = np.zeros(len(x), np.int64)
            for _ in range(min(2, d)):
                at = size.argmax(axis=1)
                term = term * 2 * d + 2 * at + (x[np.arange(len(x)), at] < 0)
                size[np.arange(len(x)), at] = -1
            raw = x.tobytes()
            packed = [raw[a : a + 8 * d] for a in range(0, len(raw), 8 * d)]
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(term), batch.column("id").take(taken), pa.array(packed, pa.binary()), batch.column("query").take(taken)], ["term", "id", "x", "query"])

    return table.mapInArrow(run, "term long, id long, x binary, query boolean")


def _gathered(batches: Iterator[pa.RecordBatch], d: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of up to ``most`` consecutive rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == most:
                yield _joined(held, d)
                held, n = [], 0
    if held:
        yield _joined(held, d)


def _joined(held: list[pa.RecordBatch], d: int) -> tuple[np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(held)
    ids = t.column("id").combine_chunks().fill_null(NO_ID).to_numpy()
    return ids, np.frombuffer(b"".join(t.column("x").to_pylist()), np.int64).reshape(-1, d)


def _block_rows(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for ids, x in _gathered(batches, d, BLOCK):
            shard = (part << 32) + number // SHARD_BLOCKS
            values = [part, shard, ids.tobytes(), pack(x), x.max(axis=0).tobytes(), x.min(axis=0).tobytes()]
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "shard", "ids", "x", "high", "low"])
            number += 1

    return run


def _pack_rows(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))
        for ids, x in _gathered(batches, d, PACK):
            yield pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([pack(x)], pa.binary())], ["pack", "ids", "x"])

    return run


def _best_shards(d: int):
    """Of (pack, x, shard, high, low) rows the highest bound of each query in the shard, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                queries = unpack(batch.column("x")[r].as_py(), d)
                high, low = (np.frombuffer(batch.column(c)[r].as_py(), np.int64).reshape(-1, d) for c in ("high", "low"))
                top = np.concatenate([bounds(queries[a : a + SLICE], high, low).max(axis=1).astype(np.float64) for a in range(0, len(queries), SLICE)])
                n = len(top)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column("pack")[r].as_py())), pa.array(np.arange(n, dtype=np.int32)), pa.array(top), pa.array(np.full(n, batch.column("shard")[r].as_py()))],
                    ["pack", "pos", "bound", "shard"],
                )

    return run


def _search_cell(d: int, k: int):
    """One pack against one shard: rows (pack, pos, query_id, score, id) of the best of each query that is searched here."""
    names = ["pack", "pos", "query_id", "score", "id"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        if left.num_rows and right.num_rows:
            blocks = [(np.frombuffer(i, np.int64), unpack(x, d)) for i, x in zip(left.column("ids").to_pylist(), left.column("x").to_pylist(), strict=True)]
            high, low = (np.frombuffer(b"".join(left.column(c).to_pylist()), np.int64).reshape(-1, d) for c in ("high", "low"))
            number, shard = (x.as_py() for x in key)
            ids, queries = np.frombuffer(right.column("ids")[0].as_py(), np.int64), unpack(right.column("x")[0].as_py(), d)
            asked = right.column("asked").combine_chunks()[0].values
            pos = asked.field("pos").to_numpy()
            kth = None
            if "kth" in [f.name for f in asked.type]:
                # A query's best shard has been searched; its k-th there bounds what the others may give.
                other = asked.field("shard").to_numpy() != shard
                last = asked.field("kth")
                score = last.field("score").fill_null(0)
                fits = pc.all(pc.less(pc.abs(score), 1 << 62)).as_py() is not False
                score = score.cast(pa.int64()).to_numpy() if fits else np.array([int(v) for v in score.to_pylist()], object)
                kth = score[other], last.field("id").fill_null(-1).to_numpy()[other]
                pos = pos[other]
            for a in range(0, len(pos), SLICE):
                some = pos[a : a + SLICE]
                best, _ = search(queries[some], ids[some], None if kth is None else tuple(x[a : a + SLICE] for x in kth), blocks, high, low, k)
                r, c = np.nonzero(best.ids >= 0)
                out.append([np.full(len(r), number), some[r], ids[some[r]], best.scores[r, c], best.ids[r, c]])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        number, pos, own, score, ident = columns
        exact = pa.array([Decimal(int(s)) for s in score], pa.decimal128(38, 0)) if score.dtype == object else pa.array(score.astype(np.int64)).cast(pa.decimal128(38, 0))
        return pa.Table.from_arrays([pa.array(number.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(own.astype(np.int64)), exact, pa.array(ident.astype(np.int64))], names)

    return run


def top_k(rows: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row where ``query`` holds the ``k`` rows of other ids with the highest inner products."""
    table = _vectors(rows, id_col, vector_col, query)
    n, n_queries, longest = _measured(table)
    d = max(longest, 1)
    out = "pack long, pos int, query_id long, score decimal(38,0), id long"
    if not n_queries:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    taking = written(_taking_part(table, d), "topk-vectors")
    # Equal vectors lie side by side in the order of their ids, and of their places where ids repeat, so no key holds back the cut into ranges.
    dealt = taking.withColumn("place", F.monotonically_increasing_id())
    n_parts = -(-n // (BLOCK * SHARD_BLOCKS))
    ranged = dealt.repartitionByRange(n_parts, "term", "id", "place").sortWithinPartitions("term", "id", "place").select("id", "x")
    blocks = written(ranged.mapInArrow(_block_rows(d), "part int, shard long, ids binary, x binary, high binary, low binary"), "topk-blocks")
    asked = taking.where("query").select("id", "x").repartition(-(-n_queries // PACK))
    packs = written(asked.mapInArrow(_pack_rows(d), "pack long, ids binary, x binary"), "topk-packs")
    # Blocks of a shard are few, so their maxima fit one row.
    maxima = blocks.groupBy("part", "shard").agg(F.expr("collect_list(struct(high, low))").alias("b"))
    maxima = maxima.select("part", "shard", *(F.expr(f"aggregate(b.{c}, X'', (a, x) -> concat(a, x))").alias(c) for c in ("high", "low")))
    every = packs.select("pack", F.explode(F.sequence(F.lit(0), F.lit(max(n_parts, _parts(blocks)) - 1))).alias("part"))
    grid = written(every.join(maxima.select("part", "shard"), "part").select("pack", "shard"), "topk-grid")
    bounded = grid.join(packs.select("pack", "x"), "pack").join(maxima.select("shard", "high", "low"), "shard").mapInArrow(_best_shards(d), "pack long, pos int, bound double, shard long")
    first = written(bounded.groupBy("pack", "pos").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")), "topk-first")
    cells = first.groupBy("pack", "shard").agg(F.collect_list(F.struct("pos")).alias("asked")).join(packs, "pack")
    near = written(_searched(blocks, cells, d, k, out), "topk-near")
    # The worst of k found: the lowest score, of equal ones the largest id.
    worst = near.groupBy("pack", "pos").agg(F.count(F.lit(1)).alias("c"), F.max_by(F.struct("score", F.coalesce("id", F.lit(int(NO_ID))).alias("id")), F.struct((-F.col("score")).alias("s"), F.coalesce("id", F.lit(int(NO_ID))).alias("i"))).alias("kth"))
    known = first.join(worst.where(F.col("c") >= k).select("pack", "pos", "kth"), ["pack", "pos"], "left")
    rest = known.groupBy("pack").agg(F.collect_list(F.struct("pos", "shard", "kth")).alias("asked")).join(packs, "pack").join(grid, "pack")
    far = _searched(blocks, rest, d, k, out)
    order = Window.partitionBy("pack", "pos").orderBy(F.desc("score"), F.asc("id"))
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("id") != int(NO_ID), F.col("id")).alias("id"), F.col("score").try_cast("long").alias("score"))


def _parts(blocks: DataFrame) -> int:
    """Range partitions in use (a cluster may deal more than asked for)."""
    return (blocks.agg(F.max("part")).first()[0] or 0) + 1


def _searched(blocks: DataFrame, cells: DataFrame, d: int, k: int, out: str) -> DataFrame:
    """Every (pack, shard) of ``cells`` searched in a task of its own; it gets one pack and one shard."""
    pairs = cells.select(F.col("pack").alias("of_pack"), F.col("shard").alias("of_shard"))
    left = blocks.join(pairs, F.col("shard") == F.col("of_shard")).select("of_pack", "of_shard", "ids", "x", "high", "low")
    return left.groupBy("of_pack", "of_shard").cogroup(cells.groupBy("pack", "shard")).applyInArrow(_search_cell(d, k), out)


def op13_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = top_k(rows, F.col("vec_id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
