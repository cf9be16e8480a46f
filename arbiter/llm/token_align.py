"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Texts are encoded by a byte-level vocabulary (A) and a sentencepiece model (B).
A cut is a byte offset where a token of either side ends; the tokens between
two cuts are a group, and every A-B pair of a group is a link.

Groups are found by diagonal run skipping.  While tokens are one to one, B's
index is A's index plus a constant shift, so the two arrays of token ends are
compared at that shift in windows that double as long as they agree
(exponential probing).  Where they part, the group is irregular: the first
common end after it is looked up locally, and the difference of the two indices
there is the new shift.  All texts of a batch advance at once, long ones from
several common ends (lanes).

Corpus-wide counts of linked pairs: a batch of documents holds its pairs as a
dictionary and its links as codes of it.  Only the dictionaries are shuffled
by pair; their counts come back to the batch, which sums them per document.  So
a pair that is in every document costs one row per batch, not one per link.

Edge cases: null and empty texts, and texts whose tokens do not spell
space+text, have no tokens: zeros and empty arrays; long texts are aligned
whole; every repeated row is a document of its own; an empty table stays empty;
columns of the input keep their names, packed in one struct.  Memory in a task
follows its batch of ``GROUP_BYTES`` or its longest text, and a group's distinct
pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.llm.common import slices, written
from arbiter.llm.token_count import SPACE, ragged

#: Text bytes encoded at once, and text bytes that share a dictionary of pairs.
PART_BYTES, GROUP_BYTES = 1 << 20, 8 << 20
#: Tokens of A after which a new lane may start; the largest window of a probe.
STRIDE, WIDEST = 40, 64
#: Words whose tokens a task remembers; longer words are encoded each time.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64
#: Strings without a space of more characters go to the library that merges by a queue.
LONG_WORD = 1000
#: Groups with more links are counted by their distinct tokens.
LARGE_GROUP = 4096
_WORD = re.compile(" +[^ ]+")
#: White space other than a space, before a space.
_MIXED = re.compile(r"[^\S ] ")


def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes end to end, starts, lengths) of a vocabulary's entries."""
    lengths = np.array([len(e) for e in entries], np.int64)
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(lengths) - lengths, lengths


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def longest_word(text: str) -> int:
    """Characters of the longest string between spaces, or of the longest run of spaces."""
    return max(map(len, re.findall("[^ ]+| +", text)), default=0)


class ByteLevel:
    """Side A: the text of a byte-level vocabulary file of the ``tokenizers`` library.

    Where ids are merge ranks and the file asks for nothing else (as in the
    given one), the faster rank encoder gives the same ids; otherwise, and for
    very long words, the library itself encodes.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        file = json.loads(text)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = file["model"]["vocab"]
        entries = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in file["added_tokens"])]))
        for piece, i in vocab.items():
            entries[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for piece, i in special.items():
            entries[i] = piece.encode()
        self.bytes = _table(entries)
        self.ranked = None
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        pre = file["pre_tokenizer"] or {}
        asked = [file["normalizer"], file["post_processor"], pre.get("add_prefix_space"), *(file["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
        by_rank = [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
        if by_rank and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not any(asked):
            import public_tokenizers
            import tiktoken

            ranks = {entries[i]: i for i in vocab.values() if i not in special.values()}
            self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def by_word(self) -> bool:
        return self.ranked is not None

    def encode(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, tokens of each) of strings that begin with a space."""
        if self.ranked is None:
            return _flat([e.ids for e in self.library.encode_batch_fast(spaced, add_special_tokens=False)])
        long = [len(t) > LONG_WORD and longest_word(t) > LONG_WORD for t in spaced]
        # No token goes on from a string's last character over the space of the next, unless that character is white space.
        joined = [not n and not t[-1].isspace() for t, n in zip(spaced, long, strict=True)]
        ids = self.ranked.encode_to_numpy("".join(t for t, j in zip(spaced, joined, strict=True) if j)).astype(np.int64)
        sizes = np.cumsum([len(t.encode()) for t, j in zip(spaced, joined, strict=True) if j])
        counts = np.diff(np.searchsorted(np.cumsum(self.bytes[2][ids]), sizes) + 1, prepend=0)
        if all(joined):
            return ids, counts
        together = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        return _flat([
            next(together) if j else self.library.encode_batch_fast([t], add_special_tokens=False)[0].ids if n else self.ranked.encode_ordinary(t)
            for t, n, j in zip(spaced, long, joined, strict=True)
        ])


class Pieces:
    """Side B: a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = _table([bytes([int(byte.fullmatch(p)[1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)])
        # Words can be encoded alone if the model changes no character and no piece goes on over a space.
        self.by_word = self.model.normalize("ﬁ ①  x ") == SPACE.join(["", "ﬁ", "①", "", "x", ""]) and not any(SPACE in p.lstrip(SPACE) for p in names)

    def encode(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, tokens of each) of strings that begin with a space, which the model adds itself."""
        return _flat(self.model.encode([t[1:] for t in spaced], num_threads=1) if spaced else [])


class Encoder:
    """Both sides; the tokens of a word are asked of the libraries once and remembered.

    A word is a run of non-spaces with the spaces before it.  No pre-token of A
    and no piece of B goes on from a character over a space, so a text's
    tokens are those of its words, but where other white space or U+2581
    stands before a space, or a space ends the text: such texts are encoded whole.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.sides = (a, b)
        self.by_word = a.by_word and b.by_word
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.stores = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.sides]

    def words_of(self, spaced: str) -> list[str]:
        if not self.by_word or SPACE in spaced or spaced.endswith(" ") or _MIXED.search(spaced):
            return [spaced]
        return _WORD.findall(spaced)

    def encode(self, spaced: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side (ids end to end, tokens of each text); the texts begin with a space."""
        if len(self.known) > REMEMBERED:
            self.forget()
        words = [self.words_of(t) for t in spaced]
        missing = list(set(chain.from_iterable(words)) - self.known.keys())
        kept = [w for w in missing if len(w) <= REMEMBERED_CHARS]
        once = [w for w in missing if len(w) > REMEMBERED_CHARS]
        n_known = len(self.known)
        self.known.update(zip(kept, range(n_known, n_known + len(kept)), strict=True))
        stay = n_known + len(kept)
        code_of = self.known | dict(zip(once, range(stay, stay + len(once)), strict=True)) if once else self.known
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        of = np.fromiter(map(code_of.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
        edges = np.concatenate([[0], np.cumsum(n_words)])
        out = []
        for k, side in enumerate(self.sides):
            ids, lengths = (np.concatenate(x) for x in zip(self.stores[k], side.encode(kept + once), strict=True))
            self.stores[k] = ids[: int(lengths[:stay].sum())], lengths[:stay]
            own = lengths[of]
            ends = np.concatenate([[0], np.cumsum(own)])
            out.append((ids[ragged((np.cumsum(lengths) - lengths)[of], own)], np.diff(ends[edges])))
        return out


def cut_groups(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cut_a, cut_b): whether a token of A, of B, ends a group.

    Both sides hold the same texts end to end, so that the ends of tokens grow
    over the whole batch; ``last_a`` are the last tokens of the texts.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    if not len(ends_a):
        return cut_a, cut_b
    # Lanes end with a text, or at one of the places a stride apart where B has an end as well.
    tried = np.union1d(np.arange(STRIDE - 1, len(ends_a), STRIDE), last_a)
    at = np.searchsorted(ends_b, ends_a[tried])
    common = ends_b[at] == ends_a[tried]
    stop_a, stop_b = tried[common] + 1, at[common] + 1
    i, j = np.concatenate([[0], stop_a[:-1]]), np.concatenate([[0], stop_b[:-1]])
    width, scan = np.ones(len(i), np.int64), np.full(len(i), -1)  # scan: where an irregular group is searched on, else -1
    while len(i):
        from_ = np.where(scan >= 0, scan, i)
        m = np.minimum(width, stop_a - from_)
        running = scan < 0
        m = np.where(running, np.minimum(m, stop_b - j), m)
        k = ragged(from_, m)
        lane = np.repeat(np.arange(len(i)), m)
        other = k + (j - i)[lane]
        searched = ~running[lane]
        if searched.any():
            other[searched] = np.searchsorted(ends_b, ends_a[k[searched]])
        same = ends_a[k] == ends_b[other]
        # Runs want the first difference, irregular groups the first common end.
        first = np.cumsum(m) - m
        wanted = np.where(same == searched, np.arange(len(k)), len(k))
        hit = np.minimum(np.minimum.reduceat(wanted, first) - first, m)
        keep = (np.arange(len(k)) - first[lane] < hit[lane]) & ~searched
        cut_a[k[keep]] = True
        cut_b[other[keep]] = True
        found = ~running & (hit < m)
        ended = first[found] + hit[found]
        cut_a[k[ended]] = True
        cut_b[other[ended]] = True
        ran = np.where(running, hit, 0)
        i, j = i + ran, j + ran
        i[found], j[found] = k[ended] + 1, other[ended] + 1
        parted = running & (hit < m)
        scan = np.where(parted, i, np.where(~running & ~found, from_ + m, -1))
        width = np.where(parted, 4, np.where(found, 1, np.where(running, np.minimum(width * 2, WIDEST), width * 2)))
        left = i < stop_a
        i, j, stop_a, stop_b, width, scan = (x[left] for x in (i, j, stop_a, stop_b, width, scan))
    return cut_a, cut_b


class Aligned:
    """Aligned texts: ``a``, ``b`` ids end to end, ``n_a``, ``n_b`` tokens of each text, ``cut_a``, ``cut_b`` ends of groups."""

    def __init__(self, encoder: Encoder, texts: list[str | None]):
        side_a, side_b = encoder.sides
        some = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in some]
        (a, n_a), (b, n_b) = encoder.encode(spaced)
        bodies = [t.encode() for t in spaced]
        size = np.array([len(x) for x in bodies], np.int64)
        body = np.frombuffer(b"".join(bodies), np.uint8)
        good = np.ones(len(some), bool)
        for (flat, starts, lengths), ids, counts in ((side_a.bytes, a, n_a), (side_b.bytes, b, n_b)):
            total = np.concatenate([[0], np.cumsum(lengths[ids])])
            edges = np.concatenate([[0], np.cumsum(counts)])
            fits = np.diff(total[edges]) == size
            good &= fits
            if fits.any():
                of = np.repeat(fits, counts)
                spelled = flat[ragged(starts[ids[of]], lengths[ids[of]])]
                own = np.flatnonzero(fits)
                wrong = np.flatnonzero(spelled != body[np.repeat(fits, size)])
                good[own[np.searchsorted(np.cumsum(size[own]), wrong, side="right")]] = False
        self.a, self.b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        self.n_a, self.n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        at = np.array(some, np.int64)[good]
        self.n_a[at], self.n_b[at] = n_a[good], n_b[good]
        ends_a, ends_b = np.cumsum(side_a.bytes[2][self.a]), np.cumsum(side_b.bytes[2][self.b])
        self.cut_a, self.cut_b = cut_groups(ends_a, ends_b, np.cumsum(n_a[good]) - 1)
        self.group_a, self.group_b = np.diff(np.flatnonzero(self.cut_a), prepend=-1), np.diff(np.flatnonzero(self.cut_b), prepend=-1)
        cuts = np.concatenate([[0], np.cumsum(self.cut_a)])
        self.n_groups = np.diff(cuts[np.concatenate([[0], np.cumsum(self.n_a)])])
        links = np.concatenate([[0], np.cumsum(self.group_a * self.group_b)])
        edges = np.concatenate([[0], np.cumsum(self.n_groups)])
        self.n_links = np.diff(links[edges])

    def pairs(self, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links): the distinct pairs of each text, as A id * ``n_ids`` + B id, ordered."""
        of = np.repeat(np.arange(len(self.n_a)), self.n_groups)
        start_a, start_b = np.cumsum(self.group_a) - self.group_a, np.cumsum(self.group_b) - self.group_b
        large = self.group_a * self.group_b > LARGE_GROUP
        own = np.repeat(np.arange(len(of)), self.group_a)
        tokens = np.flatnonzero(~large[own])
        g = own[tokens]
        left = np.repeat(tokens, self.group_b[g])
        right = ragged(start_b[g], self.group_b[g])
        text, pair, many = [of[own[left]]], [self.a[left] * n_ids + self.b[right]], [np.ones(len(left), np.int64)]
        for x in np.flatnonzero(large).tolist():
            ia, ca = np.unique(self.a[start_a[x] : start_a[x] + self.group_a[x]], return_counts=True)
            ib, cb = np.unique(self.b[start_b[x] : start_b[x] + self.group_b[x]], return_counts=True)
            text.append(np.full(len(ia) * len(ib), of[x]))
            pair.append((ia[:, None] * n_ids + ib).ravel())
            many.append((ca[:, None] * cb).ravel())
        text, pair, many = (np.concatenate(x) for x in (text, pair, many))
        order = np.lexsort((pair, text)) if len(of) > 1 << 20 else np.argsort(text * (int(pair.max(initial=0)) + 1) + pair, kind="stable")
        text, pair = text[order], pair[order]
        first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
        return text[first], pair[first], np.add.reduceat(many[order], first) if len(first) else many

    def written_groups(self) -> Iterator[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3`` in decimal ids; empty without tokens."""
        ids = np.concatenate([self.a, self.b])
        before_b, before_a = np.cumsum(self.group_b) - self.group_b, np.cumsum(self.group_a)
        place = np.concatenate([np.arange(len(self.a)) + np.repeat(before_b, self.group_a), np.arange(len(self.b)) + np.repeat(before_a, self.group_b)])
        mark = np.concatenate([np.where(self.cut_a, ord("|"), ord(",")), np.where(self.cut_b, ord(";"), ord(","))]).astype(np.uint8)
        ordered, marks = np.empty(len(ids), np.int64), np.empty(len(ids), np.uint8)
        ordered[place], marks[place] = ids, mark
        shown, count = decimals(int(ids.max(initial=0)))
        digits, count = shown[ordered], count[ordered]
        digits[np.arange(len(ids)), count] = marks
        out = digits[np.arange(shown.shape[1]) <= count[:, None]].tobytes()
        total = np.concatenate([[0], np.cumsum(count + 1)])
        edges = total[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        for x, y in zip(edges, edges[1:], strict=False):
            yield out[x : max(y - 1, x)]


@lru_cache(maxsize=1)
def _decimals(width: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.arange(10**width)
    count = np.ones(len(numbers), np.int64)
    for p in range(1, width):
        count += numbers >= 10**p
    digits = np.zeros((len(numbers), width + 1), np.uint8)
    for p in range(width):
        shown = count > p
        digits[shown, p] = ord("0") + numbers[shown] // 10 ** (count[shown] - 1 - p) % 10
    return digits, count


def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(digits, number of digits) of 0 .. ``most`` and on, as rows of text with room for a mark."""
    return _decimals(len(str(most)))


def _sides(docs: DataFrame, a_path: str, b_path: str) -> Callable[[], Encoder]:
    """Loads the encoder in a task; the two vocabulary files travel as a broadcast (their size does not depend on the data)."""
    with open(a_path, encoding="utf-8") as fa, open(b_path, "rb") as fb:
        sent = docs.sparkSession.sparkContext.broadcast((fa.read(), fb.read()))

    def load() -> Encoder:
        a, b = sent.value
        return Encoder(ByteLevel(a), Pieces(b))

    return load


def align_tokens(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", payload: Column | None = None) -> DataFrame:
    """(row, a, b, ends_a, ends_b): the token ids of both sides and, per group, the number of tokens up to its end."""
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(payload.alias("row"), F.col(f"`{text_col}`").alias("text"))
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, ids) for c in ("a", "b", "ends_a", "ends_b"))])
    load = _sides(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                encoder = encoder or load()
                found = Aligned(encoder, part.column("text").to_pylist())
                lists = []
                for values, counts in ((found.a, found.n_a), (found.b, found.n_b)):
                    lists.append(_lists(values, counts))
                for cut, counts in ((found.cut_a, found.n_a), (found.cut_b, found.n_b)):
                    place = np.arange(1, len(cut) + 1) - np.repeat(np.cumsum(counts) - counts, counts)
                    lists.append(_lists(place[cut], found.n_groups))
                yield pa.RecordBatch.from_arrays([part.column("row"), *lists], ["row", "a", "b", "ends_a", "ends_b"])

    return rows.mapInArrow(run, schema)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, np.int32).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32)


def count_links(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", payload: Column | None = None) -> DataFrame:
    """(row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A pair's count is the number of documents that hold it linked; ``n_best``
    are the links whose count is the highest of their A id, ``count_sum`` sums
    the counts over links.
    """
    spark = docs.sparkSession
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(payload.alias("row"), F.col(f"`{text_col}`").alias("text"))
    load = _sides(docs, a_path, b_path)
    with open(b_path, "rb") as f:
        n_ids = len(Pieces(f.read()).bytes[2])
    per_doc = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]
    own = T.StructType([rows.schema["row"], *(T.StructField(n, t) for n, t in per_doc)])
    lists = [T.StructField("docs", T.ArrayType(own)), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("n_docs", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField("batch", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("held", "codes", "links")), *lists])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size, parts = None, 0, []
        numbers = iter(range(TaskContext.get().partitionId() << 33, 1 << 62))

        def flush() -> pa.RecordBatch:
            pair, many, held = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
            values, codes, n_docs = np.unique(pair, return_inverse=True, return_counts=True)
            first = np.cumsum(held) - held
            steps = np.diff(codes, prepend=0)
            steps[first[held > 0]] = codes[first[held > 0]]  # ordered codes of a document as differences
            found = pa.concat_arrays([p[0] for p in parts])
            arrays = [pa.array([next(numbers)], pa.int64()), *(pa.array([_pack(x)], pa.binary()) for x in (held, steps, many))]
            arrays += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (found, pa.array(values, pa.int64()), pa.array(n_docs, pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                encoder = encoder or load()
                found = Aligned(encoder, part.column("text").to_pylist())
                text, pair, many = found.pairs(n_ids)
                sha = [hashlib.sha256(x).hexdigest() if x else "" for x in found.written_groups()]
                columns = [part.column("row"), *(pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(sha, pa.string())]
                parts.append((pa.StructArray.from_arrays(columns, own.names), pair, many.astype(np.int32), np.bincount(text, minlength=part.num_rows)))
                size += part.column("text").nbytes
                if size >= GROUP_BYTES:
                    yield flush()
                    size, parts = 0, []
        if parts:
            yield flush()

    held = written(rows.mapInArrow(gather, schema), "align-batches")
    flat = held.select("batch", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("code", "p")).select("batch", "code", F.col("p.pairs").alias("pair"), "p.n_docs")
    counts = flat.groupBy("pair").agg(F.sum("n_docs").alias("count"))
    # One row per id of A at most: the vocabulary bounds the broadcast.
    counts = written(counts.withColumn("a", F.expr(f"pair div {n_ids}")), "align-counts")
    best = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("highest")))
    counts = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    looked = flat.join(counts, "pair").groupBy("batch").agg(F.collect_list(F.struct("code", "count", "best")).alias("looked"))
    out = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                held, steps, many = (_unpack(batch.column(c)[r].as_py()).astype(np.int64) for c in ("held", "codes", "links"))
                docs = batch.column("docs")[r].values
                counted = batch.column("looked")[r].values
                count, best = np.zeros(0, np.int64), np.zeros(0, bool)
                if counted is not None and len(counted):
                    at = counted.field("code").to_numpy()
                    count, best = np.empty(len(at), np.int64), np.empty(len(at), bool)
                    count[at] = counted.field("count").to_numpy()
                    best[at] = counted.field("best").to_numpy(zero_copy_only=False)
                total = np.cumsum(steps)
                first = np.cumsum(held) - held
                some = held > 0
                back = np.zeros(len(held), np.int64)
                back[some] = total[first[some]] - steps[first[some]]
                codes = total - np.repeat(back, held)
                edges = np.concatenate([[0], np.cumsum(held)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(many * v[codes])])[edges]) for v in (best, count)]
                columns = [docs.field(n) for n in ("row", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(s, pa.int64()) for s in sums] + [docs.field("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return held.select("batch", "held", "codes", "links", "docs").join(looked, "batch", "left").drop("batch").mapInArrow(settle, out)


def op11_token_align(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = count_links(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), payload=F.struct("doc_id"))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
