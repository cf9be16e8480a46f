"""Suffix-array dedup: remove every byte that a repeated string of ``LENGTH`` bytes covers.

A window is a string of ``LENGTH`` bytes.  Equal windows hold the same least
hash of their k-byte substrings, so this hash deals the windows to groups that
can be sorted apart.  Consecutive windows of a text with the same least hash
form a segment; only groups that occur more than once go on, and equal segments
are counted first and sorted once.

Within a task the suffixes that begin a window are sorted in two stages: only
suffixes smaller than their successor are sorted directly, by their first
``LENGTH`` bytes; the others are induced from them by scanning the buckets of
first bytes from low to high.  Neighbours with a common prefix of ``LENGTH``
bytes are repeats.

A group with too many different segments (a passage shared by very many texts,
each with other surroundings) is dealt out anew by the least hash of longer
substrings, at last of whole windows, where a group is one string; so no task
gets an unbounded group.

Edge cases: a null text is empty; texts below ``LENGTH`` bytes lose nothing;
long texts are cut into overlapping pieces for hashing, so every window is
seen; copies of a text are repeats of each other; repeated rows too; an empty
table gives no rows; columns of the input keep their names, packed in one
struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import shuffle_width, written
from arbiter.llm.shingles import mix64

LENGTH = 400
#: Lengths of the substrings whose least hash deals out windows; a group that stays too large goes to the next.
LEVELS = (128, 300, 400)
#: Bytes of the different segments of a group that one task may sort together; a larger group goes to the next level.
HOT_BYTES = 8 << 20
#: Bytes hashed, and bytes sorted, at once (or one group, if that has more); and windows in one segment.
PIECE_BYTES, SORT_BYTES, RUN = 1 << 20, 1 << 20, 1024
_BASE = 0x9E3779B97F4A7C55


def _powers(base: int) -> np.ndarray:
    factors = np.full(PIECE_BYTES + LENGTH + 1, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def segments(body: np.ndarray, owner_start: np.ndarray, n_windows: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(owner, start, windows, group, content, twice) of the segments of several byte strings laid end to end.

    ``twice``: the substring with the least hash stands twice inside the
    segment, without which no window of it can repeat in the segment itself.
    """
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((body.astype(np.uint64) + np.uint64(1)) * _POWER[: len(body)])])
    hashes = mix64((prefix[k:] - prefix[:-k]) * _INVERSE[: len(body) - k + 1])
    width = length - k + 1
    least = sliding_least(hashes, width)
    owner = np.repeat(np.arange(len(n_windows)), n_windows)
    at = np.repeat(owner_start - np.cumsum(n_windows) + n_windows, n_windows) + np.arange(n_windows.sum())
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    since = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    first = np.flatnonzero(new | (since % RUN == 0))
    count = np.diff(first, append=len(at))
    start = at[first]
    content = mix64((prefix[start + count - 1 + length] - prefix[start]) * _INVERSE[start]) + count.astype(np.uint64)
    # Substrings that are the least of some window; there are few of them in a segment.
    most = ~sliding_least(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
    chosen = np.flatnonzero(most == hashes)
    low, high = np.searchsorted(chosen, start), np.searchsorted(chosen, start + count + width - 1)
    hits = np.zeros(len(start), np.int32)
    active = np.flatnonzero(low < high)
    while len(active):
        hits[active] += hashes[chosen[low[active]]] == value[first[active]]
        low[active] += 1
        active = active[(low[active] < high[active]) & (hits[active] < 2)]
    return owner[first], start - owner_start[owner[first]], count, value[first], content, hits > 1


def pieces(bodies: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in lists of about ``PIECE_BYTES``; windows of long texts are shared out, none is lost."""
    out: list[tuple[int, int, bytes]] = []
    size = 0
    step = PIECE_BYTES - LENGTH
    for i, body in enumerate(bodies):
        for a in range(0, max(len(body) - LENGTH + 1, 0), step):
            part = body[a : a + step + LENGTH - 1]
            if size + len(part) > PIECE_BYTES and out:
                yield out
                out, size = [], 0
            out.append((i, a, part))
            size += len(part)
    if out:
        yield out


def sorted_suffixes(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The places ``at`` ordered by the ``length`` bytes that begin there, eight bytes a round; only ties go on."""
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    out, own = at.astype(np.int32), np.arange(len(at), dtype=np.int32)
    group = np.zeros(len(at), np.int32)
    for first in range(0, length, 8):
        word = np.zeros(len(own), np.uint64)
        for k in range(first, first + 8):
            word <<= np.uint64(8)
            if k < length:
                word |= padded[out[own] + k]
        order = np.lexsort((word, group)).astype(np.int32)
        word = word[order]
        out[own] = out[own[order]]
        # Places of equal groups and words stay together; those that are alone are done.
        new = np.ones(len(own), bool)
        new[1:] = (np.diff(group) != 0) | (word[1:] != word[:-1])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new, dtype=np.int32)[~alone]
        own = own[~alone]
        if not len(group):
            break
    return out


def repeated_windows(bodies: list[bytes], copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment (bytes of at least ``length``) the places of windows that occur again in any of them; ``copies``: its own number."""
    n = np.array([len(b) for b in bodies], np.int64)
    # Bytes are raised by one (UTF-8 never has 255), so that 0 ends a segment and is least.
    text = np.zeros(int(n.sum()) + len(bodies), np.uint8)
    start = np.cumsum(n + 1) - (n + 1)
    inner = np.ones(len(text), bool)
    inner[start + n] = False
    text[inner] = np.frombuffer(b"".join(bodies), np.uint8) + np.uint8(1)
    place = np.arange(len(text), dtype=np.int32)
    # Stage types: smaller than the successor (or the end of a segment), by the next differing byte.
    step = np.zeros(len(text), np.int16)
    step[:-1] = np.diff(text.astype(np.int16))
    step[-1] = -1
    differs = np.where(step != 0, place, np.int32(len(text)))
    small = (step > 0)[np.minimum(np.minimum.accumulate(differs[::-1])[::-1], len(text) - 1)] | ~inner
    del step, differs, inner
    # Wanted: the windows, and what follows the last of them up to the next directly sorted suffix.
    windows = np.zeros(len(text) + 1, np.int32)
    np.add.at(windows, start, 1)
    np.add.at(windows, start + n - length + 1, -1)
    windows = np.cumsum(windows[:-1]) > 0
    last_window = np.maximum.accumulate(np.where(windows, place, np.int32(-1)))
    next_small = np.minimum.accumulate(np.where(small, place, np.int32(len(text)))[::-1])[::-1]
    wanted = windows | ((last_window >= 0) & (place <= next_small[np.maximum(last_window, 0)]))
    del place, last_window, next_small
    direct = sorted_suffixes(text, np.flatnonzero(wanted & small), length)
    of_byte = np.searchsorted(text[direct], np.arange(257))
    arrived: list[list[np.ndarray]] = [[] for _ in range(257)]
    order: list[np.ndarray] = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Deal the larger predecessors of scanned suffixes to their buckets; those of this bucket are returned."""
        before = scanned[scanned > 0] - 1
        before = before[wanted[before] & ~small[before]]
        if not len(before):
            return before
        first = text[before].astype(np.int16)
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        edges = np.flatnonzero(np.diff(first, prepend=-1))
        own = before[:0]
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(first)], strict=True):
            if first[a] == byte:
                own = before[a:b]
            else:
                arrived[first[a]].append(before[a:b])
        return own

    for byte in range(256):
        now = np.concatenate(arrived[byte]) if arrived[byte] else direct[:0]
        while len(now):
            order.append(now)
            now = induce(now, byte)
        own = direct[of_byte[byte] : of_byte[byte + 1]]
        if len(own):
            order.append(own)
            induce(own, byte)
    ranked = np.concatenate(order) if order else direct
    ranked = ranked[windows[ranked]]
    repeated = np.zeros(len(text), bool)
    view = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else None
    for a in range(0, len(ranked) - 1, 4096):
        left, right = ranked[a : a + 4096], ranked[a + 1 : a + 4097]
        # The common prefix of neighbours reaches the length if no byte differs.
        whole = (view[left[: len(right)]] == view[right]).all(axis=1)
        repeated[left[: len(right)][whole]] = True
        repeated[right[whole]] = True
    out = []
    for s, m, c in zip(start.tolist(), (n - length + 1).tolist(), copies.tolist(), strict=True):
        out.append(np.arange(m) if c > 1 else np.flatnonzero(repeated[s : s + m]))
    return out


def runs_of(places: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last place of each run of consecutive places."""
    if not len(places):
        return [], []
    gap = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate([[0], gap + 1])].tolist(), places[np.concatenate([gap, [len(places) - 1]])].tolist()


def _segment_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "piece", "start", "windows", "grp", "content", "twice"]
        for batch in batches:
            keys, column = batch.column("key"), batch.column("body")
            bodies = (column[i].as_py() or b"" for i in range(batch.num_rows))
            for part in pieces(bodies):
                n = np.array([len(b) for _, _, b in part], np.int64)
                owner, start, count, group, content, twice = segments(np.frombuffer(b"".join(b for _, _, b in part), np.uint8), np.cumsum(n) - n, n - LENGTH + 1, k)
                offsets = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32())
                start = start + np.array([a for _, a, _ in part], np.int64)[owner]
                lists = [pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(group.view(np.int64)), pa.array(content.view(np.int64)), pa.array(twice)]
                columns = [keys.take(pa.array([i for i, _, _ in part])), pa.array([a for _, a, _ in part], pa.int32()), *(pa.ListArray.from_arrays(offsets, x) for x in lists)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole groups of segments, several groups at once up to ``SORT_BYTES``."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[2] for r in rows], np.array([r[3] for r in rows]))
        runs = [runs_of(f) for f in found]
        some = [i for i, r in enumerate(runs) if r[0]]
        columns = [pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64())]
        columns += [pa.array([runs[i][side] for i in some], pa.list_(pa.int32())) for side in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["grp", "content", "first", "last"])

    held: list[tuple] = []
    size, whole, whole_size = 0, 0, 0  # of held rows; the rows and bytes of the groups that are complete
    for batch in batches:
        columns = [batch.column(c) for c in ("grp", "content", "body", "copies")]
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in columns)
            if held and held[-1][0] != row[0]:
                whole, whole_size = len(held), size
            if whole and size + len(row[2]) > SORT_BYTES:
                yield flush(held[:whole])
                held, size, whole, whole_size = held[whole:], size - whole_size, 0, 0
            held.append(row)
            size += len(row[2])
    if held:
        yield flush(held)


def repeated_runs(texts: DataFrame, levels: tuple[int, ...] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """((key, runs), (key, body)): per different text the runs (first, last) of repeated windows, and the bodies of these texts.

    ``texts`` has (key, body) with one row per document; equal keys are copies.
    """
    spark = texts.sparkSession
    k, last_level = levels[0], len(levels) == 1
    schema = "key binary, piece int, start array<int>, windows array<int>, grp array<long>, content array<long>, twice array<boolean>"
    rows = texts.where(F.length("body") >= LENGTH).select("key", "body").mapInArrow(_segment_rows(k), schema)
    lists = ("start", "windows", "grp", "content", "twice")
    found = written(rows.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in lists)), "suffix-segments")
    flat = found.select("key", "copies", F.inline(F.arrays_zip(*lists)))
    live = flat.groupBy("grp").agg(F.sum("copies").alias("n"), F.bool_or("twice").alias("twice")).where("n > 1 or twice").select("grp")
    seen = written(flat.join(live, "grp"), "suffix-live")
    different = seen.groupBy("grp", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "start")).alias("at"), F.first("windows").alias("windows"), F.first("twice").alias("twice"))
    sizes = different.groupBy("grp").agg(F.count(F.lit(1)).alias("n_different"), F.sum(F.col("windows") + (LENGTH - 1)).alias("n_bytes"))
    different = written(different.join(sizes, "grp"), "suffix-different")
    bodies = written(texts.join(seen.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("body").alias("body")), "suffix-bodies")
    hot = F.lit(False) if last_level else F.col("n_bytes") > HOT_BYTES
    # A group of one segment without repeats inside is decided by its count; of the others each different segment is cut out of one text.
    spots = different.where("n_different > 1 or twice").select(
        F.col("at.key").alias("key"), F.struct("grp", "content", "copies", F.col("at.start").alias("start"), "windows", hot.alias("hot")).alias("s")
    )
    cut = (
        bodies.join(spots.groupBy("key").agg(F.collect_list("s").alias("spots")), "key")
        .select("body", F.explode("spots").alias("s"))
        .select("s.grp", "s.content", "s.copies", "s.hot", F.substring("body", F.col("s.start") + 1, F.col("s.windows") + (LENGTH - 1)).alias("body"))
    )
    cut = written(cut, "suffix-cut")
    by_segment = "grp long, content long, first array<int>, last array<int>"
    sorted_runs = cut.where("not hot").select("grp", "content", "body", "copies").repartition(shuffle_width(spark), "grp").sortWithinPartitions("grp").mapInArrow(_sort_groups, by_segment)
    whole = different.where("copies > 1").select("grp", "content", F.array(F.lit(0)).alias("first"), F.array(F.col("windows") - 1).alias("last"))
    parts = sorted_runs.union(whole)
    crowded = cut.where("hot")
    if not last_level and not crowded.isEmpty():
        both = F.unhex(F.concat(F.lpad(F.hex("grp"), 16, "0"), F.lpad(F.hex("content"), 16, "0")))
        deeper, _ = repeated_runs(crowded.select(both.alias("key"), "body"), levels[1:])
        parts = parts.union(
            crowded.select(both.alias("key"), "grp", "content").join(deeper, "key")
            .select("grp", "content", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"))
        )
    runs = (
        seen.join(parts, ["grp", "content"])
        .select("key", "start", F.inline(F.arrays_zip("first", "last")))
        .groupBy("key")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))).alias("runs"))
    )
    return written(runs, "suffix-runs"), bodies


def removed_spans(runs: list[dict]) -> list[tuple[int, int]]:
    """Maximal byte spans [a, b) that windows covered by ``runs`` remove."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["first"], r["last"] + LENGTH) for r in runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_texts(docs: DataFrame, text_col: str = "text", payload: Column | None = None) -> DataFrame:
    """(row, n_bytes, n_removed, spans, kept): ``kept`` holds the remaining bytes where something was removed, else null."""
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    body = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    rows = docs.select(payload.alias("row"), F.unhex(F.md5(body)).alias("key"), body.alias("body"))
    runs, bodies = repeated_runs(rows.select("key", "body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, found in zip(batch.column("body").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                own = removed_spans(found)
                edges = [0, *(x for span in own for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"first": a, "end": b} for a, b in own])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["key", "kept", "spans"])

    changed = bodies.join(runs, "key").mapInArrow(cut, "key binary, kept binary, spans array<struct<first:int,end:int>>")
    none = F.array().cast("array<struct<first:int,end:int>>")
    slim = rows.select("row", "key", F.length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha"))
    return slim.join(changed, "key", "left").select(
        "row", "n_bytes", F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.coalesce("spans", none).alias("spans"), "kept", F.coalesce(F.sha2("kept", 256), F.col("sha")).alias("kept_sha256"),
    )


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_texts(docs, payload=F.col("doc_id")).select(
        F.col("row").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
