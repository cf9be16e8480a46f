"""Benchmark decontamination by latent semantic retrieval.

Words are compared without case and outer punctuation.  Passages are windows of
``SIZES`` words at every ``STRIDE`` words of every document, weighted by TF-IDF
over the benchmark's vocabulary with document frequencies counted over all
documents.  Words that weigh little in every benchmark passage that has them
are left out; this is relative, so a passage that very many documents hold, and
whose words are common therefore, is searched for like any other.

0. Texts are cut into words once: every word of the benchmark's vocabulary is
   written as its place there, any other word as one place beyond it.
1. A randomised SVD, summed over tasks, of the benchmark's passages and those of
   all documents gives ``RANK`` latent directions.
2. Every window of every document is projected: blocks of ``STRIDE`` words are
   summed once and windows are sums of blocks.  A benchmark passage whose latent
   cosine reaches a share of its cosine with itself is a candidate.  So is one
   whose window holds enough of the passage's rarest words: whatever step 3
   accepts holds them, so that no leak is lost to the latent bound.  The
   benchmark is a stated query set, compared in blocks.
3. A candidate is a leak if the longest common subsequence covers most of the
   passage, or less of it if the words of its last sentence (its answer) are
   there too.

Edge cases: null and empty texts have no passages and are clean; documents
shorter than a window are one passage; long documents are read whole; equal
texts are judged once and all their rows share the verdict; benchmark items
under ``MIN_ITEM_WORDS`` words occur by chance and are not searched for, null
items neither; items longer than a window are searched for by their parts; an
empty benchmark leaves all documents clean, an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from arbiter.llm.common import shuffle_width, slices, small_batches, without, written
from arbiter.llm.shingles import mix64

SIZES, STRIDE, MARGIN = (32, 64), 16, 24
#: Words that are read about a window at most.
TILE = SIZES[-1] + 2 * MARGIN
#: Items up to so many words are searched in the short windows.
SHORT_ITEM = 24
MIN_ITEM_WORDS = 8
#: A word is left out where its squared weight is below this share of the mean in every benchmark passage that has it.
LIGHT = 0.25
RANK, OVERSAMPLE = 128, 10
#: Tasks of a product of the fit at most, each of which makes one partial sum (terms x RANK), and rows of it that travel together.
FIT_TASKS, SUM_ROWS = 32, 64
#: Windows of the fit that are multiplied at once: few, as the terms that they hold among them are the columns of a dense matrix.
FIT_WINDOWS = 64
#: Text bytes, and words, handled at once: their arrays fit a processor's cache.
PART_BYTES, PART_WORDS = 1 << 19, 1 << 16
#: Scores computed at once.
SCORES = 1 << 20
#: Least cosine of a candidate, as a share of the passage's latent cosine with itself.
MIN_COSINE = 0.3
#: A passage is also sought by its rarest words, which make up this share of the words a leak must hold.
RARE_SHARE = 0.7
ITEM_BLOCK = 20_000
#: Share of a passage in common order: enough alone, or with the answer's words.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER_SHARE = 0.75, 0.6, 0.8
_WIDE = "…“”‘’„«»¡¿—–"
#: Kinds of bytes: 0 blank, 1 punctuation (no part of a word at its ends), 2 part of a word.
_KIND = np.full(256, 2, np.uint8)
_KIND[np.frombuffer(b".,;:!?\"'()[]{}<>|*#&%$-_`~", np.uint8)] = 1
_KIND[np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)] = 0
_KINDS = _KIND.tobytes()
_LETTERS = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C55


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    out = np.empty((2, n), np.uint64)
    out[:] = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
    out[:, 0] = 1
    return tuple(np.multiply.accumulate(out, axis=1, out=out))


_POWERS = _powers(PART_BYTES + (PART_BYTES >> 2))


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, lengths): the 64-bit hashes of the normal words of each text, end to end.

    A hash is a polynomial of a random number for each byte, the difference of two sums over all bytes.
    """
    bodies = []
    for text in texts:
        low = (text or "").lower()
        if not low.isascii():
            for c in _WIDE:
                if c in low:
                    low = low.replace(c, " ")
        bodies.append(low.encode() + b" ")
    body = b"".join(bodies)
    raw, kind = np.frombuffer(body, np.uint8), np.frombuffer(body.translate(_KINDS), np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    np.equal(kind, 2, out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edge):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first, end = edge[::2], edge[1::2]
    # Punctuation inside a word: what stands on both sides of it is one word if no blank is between.
    apart = kind[end[:-1]] == 0
    near = np.flatnonzero(~apart)
    if len(near):
        apart[near] = np.minimum.reduceat(kind, np.stack([end[near], first[near + 1]], axis=1).ravel())[::2] == 0
        first, end = first[np.append(True, apart)], end[np.append(apart, True)]
    power, inverse = _POWERS if len(raw) <= len(_POWERS[0]) else _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.take(_LETTERS, raw, out=total[1:], mode="clip")
    total[1:] *= power[: len(raw)]
    np.cumsum(total, out=total)
    terms = mix64((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64))
    ends = np.cumsum([len(b) for b in bodies])
    return terms, np.diff(np.searchsorted(first, ends), prepend=0)


def places(vocabulary: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The place of each term in the sorted vocabulary, -1 outside."""
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    return np.where(vocabulary[at] == terms, at, -1)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def place_kind(vocabulary: np.ndarray) -> np.dtype:
    """The integers that places in the vocabulary are written as; its length stands for other words."""
    return np.min_scalar_type(len(vocabulary))


def word_places(rows: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``rows`` with the places of the text's words, in order, instead of ``text``."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)
    others = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        kind = place_kind(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                terms, n = coded(part.column("text").to_pylist())
                place = places(vocabulary, terms)
                place[place < 0] = len(vocabulary)
                held, ends = place.astype(kind).tobytes(), (np.cumsum(n) * kind.itemsize).tolist()
                held = pa.array([held[a:b] for a, b in zip([0, *ends], ends)], pa.binary())  # noqa: B905
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), held], [*(f.name for f in others), "place"])

    return rows.mapInArrow(run, StructType([*others, StructField("place", BinaryType())]))


def held_places(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(part, places, lengths): parts of about ``PART_WORDS`` words, with the places of their texts' words, end to end."""
    for part in slices(batch, "place", PART_WORDS * kind.itemsize):
        held = part.column("place").to_pylist()
        yield part, np.frombuffer(b"".join(held), kind), np.array([len(x) for x in held], np.int64) // kind.itemsize


def document_frequencies(words: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each term of the vocabulary, over all rows of (place), and documents with words."""
    size, kind = len(vocabulary), place_kind(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, count = 0, np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, place, n in held_places(batch, kind):
                pairs = np.repeat(np.arange(len(n)) * (size + 1), n) + place
                count += np.bincount(pd.unique(pairs) % (size + 1), minlength=size + 1)
                docs += int((n > 0).sum())
        count[size] = docs
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["place", "n"])

    total = words.select("place").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, np.int64)
    out[total.column("place").to_numpy()] = total.column("n").to_numpy()
    return out[:size], int(out[size])


class Items:
    """Benchmark passages: their terms, answers and TF-IDF rows."""

    def __init__(self, ids: list, texts: list[str]):
        self.item, self.terms, self.answer = [], [], []
        for i, text in zip(ids, texts, strict=True):
            terms, _ = coded([text])
            if len(terms) < MIN_ITEM_WORDS:
                continue
            sentences = [s for s in (text or "").replace("?", ".").replace("!", ".").split(".") if len(coded([s])[0])]
            answer = np.unique(coded([sentences[-1]])[0]) if sentences else terms[:0]
            for a in range(0, max(len(terms) - SHORT_ITEM, 1), SIZES[-1]):
                self.item.append(i)
                self.terms.append(terms[a : a + SIZES[-1]] if len(terms) - a - SIZES[-1] > SHORT_ITEM else terms[a : a + SIZES[-1] + SHORT_ITEM])
                self.answer.append(answer)
        self.vocabulary = np.unique(np.concatenate(self.terms)) if self.terms else np.zeros(0, np.uint64)
        self.size = np.array([SIZES[0] if len(t) <= SHORT_ITEM else SIZES[-1] for t in self.terms])

    def weigh(self, vocabulary: np.ndarray, idf: np.ndarray) -> None:
        """Set the terms' weights, and leave out those that are light in every passage."""
        weight = idf[places(vocabulary, self.vocabulary)]
        self.seek(weight)
        heavy = np.zeros(len(weight), bool)
        for terms in self.terms:
            at = places(self.vocabulary, np.unique(terms))
            square = weight[at] ** 2
            heavy[at[square >= LIGHT * square.mean()]] = True
        self.vocabulary, self.weight = self.vocabulary[heavy], weight[heavy]
        # Of each place in the whole vocabulary; the last is for other words.
        self.whole = vocabulary
        self.as_heavy, self.as_sought = (np.append(places(v, vocabulary), -1) for v in (self.vocabulary, self.sought))

    def seek(self, weight: np.ndarray) -> None:
        """Choose the rarest words of each passage: what ``verdict`` accepts holds ``least`` of their places or more.

        ``verdict`` asks for a share of the passage's places; those of the words not chosen fall short of it by ``least``.
        """
        query, word, often, self.least = [], [], [], np.zeros(len(self.terms), np.int64)
        for q, terms in enumerate(self.terms):
            at, count = np.unique(places(self.vocabulary, terms), return_counts=True)
            rarest = np.lexsort((at, -weight[at]))
            others = len(terms) - np.cumsum(count[rarest])
            enough = math.ceil(LCS_WITH_ANSWER * len(terms))
            chosen = rarest[: np.flatnonzero(others <= (1 - RARE_SHARE) * enough)[0] + 1]
            self.least[q] = enough - others[len(chosen) - 1]
            word.append(at[chosen])
            often.append(count[chosen])
            query.append(np.full(len(chosen), q))
        word, often, query = np.concatenate(word), np.concatenate(often), np.concatenate(query)
        self.n_chosen, self.times = np.bincount(query, minlength=len(self.terms)), often
        by = np.argsort(word, kind="stable")
        some, self.first, self.held = np.unique(word[by], return_index=True, return_counts=True)
        self.sought, self.holders, self.often, self.chosen = self.vocabulary[some], query[by], often[by].astype(float), np.searchsorted(some, word)

    def rows(self, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, weight) of the nonzero weights and the norm of each window."""
        owner = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        place = places(self.vocabulary, np.concatenate(windows)) if windows else np.zeros(0, np.int64)
        pair, count = np.unique((owner * len(self.vocabulary) + place)[place >= 0], return_counts=True)
        row, place = pair // len(self.vocabulary), pair % len(self.vocabulary)
        weight = count * self.weight[place]
        return row, place, weight, np.sqrt(np.bincount(row, weight * weight, len(windows)))

    def project(self, windows: list[np.ndarray], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, place, weight, norm = self.rows(windows)
        out = np.zeros((len(windows), basis.shape[1]), np.float32)
        if len(row):
            some, first = np.unique(row, return_index=True)
            out[some] = np.add.reduceat(basis[place] * weight[:, None].astype(np.float32), first, axis=0)
        return out, norm


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := places.get(x):
            low = row & m
            row = ((row + low) | (row - low)) & full
    return len(a) - row.bit_count()


def fit_windows(rows: DataFrame, items: Items) -> DataFrame:
    """(n, row, place, times): the windows that the latent directions are fitted on, all of every document.

    ``rows`` has texts, or the places of their words.  Up to ``FIT_WINDOWS``
    windows are one row: each word of the vocabulary that a window holds as the
    window's number, the word's place and how often, as 16, 32 and 16 bit
    integers in order of the windows.
    """
    words = rows if "place" in rows.columns else word_places(rows, items.whole)
    sent, size, kind = rows.sparkSession.sparkContext.broadcast(items.as_heavy), len(items.vocabulary), place_kind(items.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_heavy = sent.value
        for batch in batches:
            for _, place, n in held_places(batch, kind):
                place = as_heavy[place]
                spot = np.flatnonzero(place >= 0)
                per_text = -(-n // SIZES[-1])
                first = np.cumsum(per_text) - per_text
                text = np.searchsorted(np.cumsum(n), spot, "right")
                window = first[text] + (spot - (np.cumsum(n) - n)[text]) // SIZES[-1]
                pair, times = np.unique(window * size + place[spot], return_counts=True)
                window, place = pair // size, pair % size
                starts = np.arange(0, int(per_text.sum()), FIT_WINDOWS)
                cut = np.append(np.searchsorted(window, starts), len(window)).tolist()
                sizes = np.minimum(FIT_WINDOWS, int(per_text.sum()) - starts)
                parts = (window % FIT_WINDOWS).astype(np.uint16), place.astype(np.int32), times.astype(np.uint16)
                columns = [pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), *columns], ["n", "row", "place", "times"])

    return words.select("place").mapInArrow(run, "n long, row binary, place binary, times binary")


def multiplied(row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, block: np.ndarray, back: np.ndarray | None) -> np.ndarray:
    """Gram matrix of X @ block, for the sparse X (n windows; each of its entries once); X.T @ X @ block is added to ``back``, if that is wanted.

    A few windows hold few of the terms, so that X is multiplied as a dense matrix of those.
    """
    some, column = np.unique(place, return_inverse=True)
    dense = np.zeros((n, len(some)), block.dtype)
    dense[row, column] = value
    image = dense @ block[some]
    if back is not None:
        back[some] += dense.T @ image
    return image.T @ image


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, value): the sum of the doubles of each piece, from rows sorted by piece."""
    piece, total = None, None
    for batch in batches:
        for p, value in zip(batch.column("piece"), batch.column("value"), strict=True):
            now = np.frombuffer(value.as_buffer())
            if p.as_py() == piece:
                total += now
                continue
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "value"])
            piece, total = p.as_py(), now.copy()
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["piece", "value"])


def latent_basis(words: DataFrame, items: Items, seed: int = 0) -> np.ndarray:
    """Terms x RANK: leading right singular vectors of the passages of the benchmark and of all documents.

    Randomised: a random block is multiplied by the Gram matrix, part by part,
    orthonormalised, and the small matrix in its range is decomposed.
    """
    windows = written(fit_windows(words, items), "fit-windows")  # read three times
    windows = windows.coalesce(FIT_TASKS)  # bounds what reaches the driver
    width = min(RANK + OVERSAMPLE, len(items.vocabulary))
    context = words.sparkSession.sparkContext
    sent = context.broadcast(items.weight)

    def total(block: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The Gram matrix of all windows times the block (left out at last), and the block's image's own."""
        now, shape = context.broadcast(block.astype(np.float32)), (0 if last else len(block), width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            back, gram, n = np.zeros(shape), np.zeros((width, width)), 0
            for batch in batches:
                for size, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row, place, times = (np.frombuffer(x, kind) for x, kind in zip(parts, (np.uint16, np.int32, np.uint16), strict=True))
                    value = times * sent.value[place]
                    norm = np.sqrt(np.bincount(row, value * value, size))
                    gram += multiplied(row, place, value / np.maximum(norm[row], 1e-9), size, now.value, None if last else back)
                    n += size
            pieces = [np.append(gram, n), *(back[a : a + SUM_ROWS] for a in range(0, shape[0], SUM_ROWS))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "value"])

        sums = "piece int, value binary"
        parts = windows.mapInArrow(run, sums).repartition(shuffle_width(words.sparkSession), "piece").sortWithinPartitions("piece").mapInArrow(added, sums).toArrow()
        parts = dict(zip(parts.column("piece").to_pylist(), (np.frombuffer(x) for x in parts.column("value").to_pylist()), strict=True))
        gram = parts.pop(0, np.zeros(width * width + 1))
        back = np.concatenate([parts[k] for k in sorted(parts)]).reshape(shape) if parts else np.zeros(shape)
        far = back, gram[:-1].reshape(width, width), gram[-1]
        near, near_gram = np.zeros(shape), np.zeros((width, width))
        for a in range(0, len(items.terms), FIT_WINDOWS):
            row, place, weight, norm = items.rows(items.terms[a : a + FIT_WINDOWS])
            near_gram += multiplied(row, place, weight / np.maximum(norm[row], 1e-9), len(norm), block, None if last else near)
        # The benchmark's rows weigh as much as the documents', since its directions are searched for.
        weight = max(1.0, far[2] / max(len(items.terms), 1))
        return far[0] + weight * near, far[1] + weight * near_gram

    block = np.random.default_rng(seed).standard_normal((len(items.vocabulary), width))
    for _ in range(2):
        block = np.linalg.qr(total(block)[0])[0]
    values, vectors = np.linalg.eigh(total(block, last=True)[1])
    return (block @ vectors[:, np.argsort(values)[::-1][:RANK]]).astype(np.float32)


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, share): texts (by MD5, null as empty) that hold a benchmark item, and the share of it in common order."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    known = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null").orderBy("i", "t").collect()
    id_type = benchmark.schema[item_id].dataType.simpleString()
    empty = spark.createDataFrame([], f"key binary, item_id {id_type}, share double")
    blocks = [Items([r.i for r in known[at : at + ITEM_BLOCK]], [r.t for r in known[at : at + ITEM_BLOCK]]) for at in range(0, len(known), ITEM_BLOCK)]
    blocks = [b for b in blocks if b.terms]
    found = empty
    if blocks:
        # An answer may be cut into other words than the passage that it ends.
        vocabulary = np.unique(np.concatenate([x for b in blocks for x in (b.vocabulary, *b.answer)]))
        words = written(word_places(rows, vocabulary), "word-places")  # read by all that follows
        frequency, n_docs = document_frequencies(words, vocabulary)
        idf = np.log((1 + n_docs) / (1 + frequency)) + 0.1
        for items in blocks:
            items.weigh(vocabulary, idf)
            found = found.union(_search(words, items, id_type))
    return found.groupBy("key", "item_id").agg(F.max("share").alias("share"))


def enough_words(items: Items, place: np.ndarray, query: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each stretch of terms, given by their places in ``sought``, holds the query's ``least`` rarest words."""
    spot = np.flatnonzero(place >= 0)
    at = np.sort(place[spot] * len(place) + spot)
    begin, out = np.cumsum(items.n_chosen) - items.n_chosen, np.zeros(len(query), bool)
    for a in range(0, len(query), 1 << 15):
        q = query[a : a + (1 << 15)]
        n = items.n_chosen[q]
        of = np.repeat(np.arange(len(q)), n)
        chosen = np.repeat(begin[q] - np.cumsum(n) + n, n) + np.arange(n.sum())
        low = items.chosen[chosen] * len(place)
        next_at = np.append(at, np.iinfo(np.int64).max)[np.searchsorted(at, low + first[a + of])]
        total = np.bincount(of, np.where(next_at < low + end[a + of], items.times[chosen], 0), len(q))
        out[a : a + len(q)] = total >= items.least[q]
    return out


def holding(items: Items, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, tile, query): pairs of tiles, a tile and the next of a text, that hold a query's ``least`` rarest words.

    The terms are given by their places in ``sought``.  A tile is as long as what ``verdict`` reads, so that all of it lies in the pair of the tile it begins in.
    """
    tiles = -(-n // TILE)
    last = np.cumsum(tiles)
    spot = np.flatnonzero(place >= 0)
    text = np.repeat(np.arange(len(n)), n)[spot]
    tile = (last - tiles)[text] + (spot - (np.cumsum(n) - n)[text]) // TILE
    here = distinct(tile * len(items.sought) + place[spot])
    before = here[(here // len(items.sought)) > (last - tiles)[np.searchsorted(last, here // len(items.sought), "right")]] - len(items.sought)
    both = distinct(np.concatenate([here, before]))
    tile, word = both // len(items.sought), both % len(items.sought)
    found, step = [], max(1, SCORES // len(items.terms))
    for a in range(0, int(last[-1]), step):
        some = slice(*np.searchsorted(tile, (a, a + step)))
        held = items.held[word[some]]
        at = np.repeat(items.first[word[some]] - np.cumsum(held) + held, held) + np.arange(held.sum())
        pair = np.repeat((tile[some] - a) * len(items.terms), held) + items.holders[at]
        total = np.bincount(pair, items.often[at], min(step, int(last[-1]) - a) * len(items.terms)).reshape(-1, len(items.terms))
        t, q = np.divmod(np.flatnonzero(total >= items.least), len(items.terms))  # ``least`` is 1 at least
        found.append((t + a, q))
    tile, query = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(last, tile, "right")
    return text, tile - (last - tiles)[text], query


def candidates(items: Items, basis: np.ndarray, queries: np.ndarray, need: np.ndarray, words: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, query, first, end): windows, as stretches of ``words`` (places in the whole vocabulary), whose latent cosine with a query reaches its need, or that hold its rarest words."""
    start = np.cumsum(n) - n
    blocks = -(-n // STRIDE)
    first_block = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(n)), blocks)
    begin = start[owner] + (np.arange(len(owner)) - first_block[owner]) * STRIDE
    place = items.as_heavy[words]
    known = np.flatnonzero(place >= 0)
    text = np.searchsorted(start + n, known, "right")
    block_of, place = first_block[text] + (known - start[text]) // STRIDE, place[known]
    weight = items.weight[place]
    square = np.bincount(block_of, weight * weight, len(owner)).astype(np.float32)
    sums = np.zeros((len(owner), basis.shape[1]), np.float32)
    if len(known):
        scaled = basis * items.weight[:, None].astype(np.float32)
        some, edge = np.unique(block_of, return_index=True)
        held = np.diff(edge, append=len(known))
        for k in range(int(held.max())):  # the k-th known word of each block, STRIDE at most
            more = held > k
            sums[some[more]] += scaled[place[edge[more] + k]]
    last = (first_block + blocks)[owner]
    pairs, long = [], 1
    for size in sorted(set(items.size.tolist())):
        while long < size // STRIDE:  # sums of twice as many blocks, as far as the text goes
            inside = np.flatnonzero(np.arange(len(owner)) + long < last)
            sums[inside], square[inside] = sums[inside] + sums[inside + long], square[inside] + square[inside + long]
            long *= 2
        of = np.flatnonzero(items.size == size)
        # A text of fewer blocks is one window.
        at = np.flatnonzero(np.arange(len(owner)) <= np.maximum(last - long, first_block[owner]))
        step = max(1, SCORES // max(len(of), basis.shape[1]))
        for a in range(0, len(at), step):
            here = at[a : a + step]
            good = sums[here] @ queries[of].T >= need[of][None, :] * np.sqrt(np.maximum(square[here], 1e-9))[:, None]
            w, q = np.divmod(np.flatnonzero(good), len(of))
            pairs.append(here[w] * len(items.size) + of[q])
    # Every window of which ``verdict`` reads from that tile on.
    place = items.as_sought[words]
    text, tile, query = holding(items, place, n)
    final = np.maximum(blocks[text] - items.size[query] // STRIDE, 0)
    a = first_block[text] + np.where(tile > 0, -(-(tile * TILE + MARGIN) // STRIDE), 0)
    b = first_block[text] + np.minimum(((tile + 1) * TILE - 1 + MARGIN) // STRIDE, final)
    for k in range(int((b - a).max(initial=-1)) + 1):
        more = a + k <= b
        pairs.append((a[more] + k) * len(items.size) + query[more])
    pairs = pd.unique(np.concatenate(pairs))
    window, query = pairs // len(items.size), pairs % len(items.size)
    text = owner[window]
    low = np.maximum(begin[window] - MARGIN, start[text])
    high = np.minimum(begin[window] + items.size[query] + MARGIN, (start + n)[text])
    enough = enough_words(items, place, query, low, high)
    yield from zip(*(x[enough].tolist() for x in (text, query, low, high)), strict=True)


def verdict(items: Items, query: int, text: np.ndarray) -> float:
    """The share of a benchmark passage that ``text`` holds in order, 0 if it is no leak."""
    terms, words = items.terms[query].tolist(), text.tolist()
    there = set(words)
    if sum(map(there.__contains__, terms)) < LCS_WITH_ANSWER * len(terms):
        return 0.0
    share = common_subsequence(terms, words) / len(terms)
    answer = items.answer[query].tolist()
    answered = len(answer) > 0 and sum(t in there for t in answer) >= ANSWER_SHARE * len(answer)
    return share if share >= LCS_ALONE or (share >= LCS_WITH_ANSWER and answered) else 0.0


def _search(words: DataFrame, items: Items, id_type: str) -> DataFrame:
    basis = latent_basis(words, items)
    queries, norm = items.project(items.terms, basis)
    queries = queries / norm[:, None].astype(np.float32)
    need = MIN_COSINE * (queries**2).sum(axis=1)
    sent, kind = words.sparkSession.sparkContext.broadcast((items, basis, queries, need)), place_kind(items.whole)
    schema = f"key binary, item_id {id_type}, share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, basis, queries, need = sent.value
        # Any other word is the least hash that no term of the vocabulary has.
        other = np.setdiff1d(np.arange(len(items.whole) + 1, dtype=np.uint64), items.whole)[:1]
        terms = np.append(items.whole, other)
        for batch in batches:
            for part, place, n in held_places(batch, kind):
                best: dict[tuple[int, object], float] = {}
                if len(place):
                    for i, q, first, end in candidates(items, basis, queries, need, place, n):
                        if share := verdict(items, q, terms[place[first:end]]):
                            best[i, items.item[q]] = max(share, best.get((i, items.item[q]), 0.0))
                if best:
                    keys = part.column("key").take(pa.array([i for i, _ in best]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([q for _, q in best]), pa.array(list(best.values()))], ["key", "item_id", "share"])

    return words.mapInArrow(run, schema)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per document that holds benchmark items; documents that are not listed hold none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    per_text = found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"))
    return (
        docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
        .join(per_text, "key")
        .select("doc_id", F.lit(True).alias("contaminated"), "item_ids", "share")
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = written(leaks(docs, benchmark, text_col).select(F.col("key").alias("__key")).distinct(), "leaking-texts")
    key = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return without(docs.withColumn("__key", key), found, "__key").drop("__key")
