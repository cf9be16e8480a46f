"""Token counts by rank-synchronous array merging of byte-pair pieces.

Texts are cut between two characters that no piece of the vocabulary holds side
by side: no merge can cross such a cut.  The distinct strings between cuts of a
batch are held as one ragged array of symbols, and in each round every sequence
applies its lowest-rank pair at once, until none is left; the surviving symbols
are counted.  Where a merged piece could take part in a still better merge, a
sequence applies only its leftmost pair of that rank, as one merge after the
other would.  Characters outside the vocabulary count as their UTF-8 bytes.

Only the vocabulary travels, as a broadcast of pieces and scores (its size does
not depend on the data).

Edge cases: a null or empty text has 0 tokens; texts are counted whole,
whatever their length; sequences longer than ``LONG`` symbols go through the
same merges by a priority queue; repeated rows get equal counts; an empty table
stays empty; input columns are packed in one struct and keep their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.llm.common import slices

SPACE = "▁"
TOKEN_LIMIT = 4096
#: Sequences of more symbols are merged one by one, since rounds over them would cost the square of their length.
LONG = 2000
#: Strings whose counts a task remembers between batches.
REMEMBERED = 400_000
#: Strings are compared as up to so many packed 63-bit words, longer ones as text.
PACKED = 4
NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Merge tables of a byte-pair vocabulary with byte fallback: ``scores[piece]``, the highest merges first."""

    def __init__(self, pieces: list[str], scores: list[float]):
        self.pieces, self.scores = pieces, scores

    @cached_property
    def tables(self) -> dict:
        ids = {p: i for i, p in enumerate(self.pieces)}
        levels = {s: r for r, s in enumerate(sorted(set(self.scores), reverse=True))}
        rank = np.array([levels[s] for s in self.scores], np.int32)
        left, right, made = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        # A piece is calm if no merge that it takes part in ranks as high as itself.
        calm = np.ones(len(ids), bool)
        for part in (left, right):
            calm[part[rank[made] <= rank[part]]] = False
        calm &= np.bincount(rank)[rank] == 1
        keys = left * len(ids) + right
        order = np.argsort(keys)
        linked = sorted({c for p in ids if len(p) > 1 for c in p})
        kind = np.zeros(0x110000, np.int32)  # 0: stands alone
        kind[[ord(c) for c in linked]] = np.arange(1, len(linked) + 1)
        beside = np.zeros((len(linked) + 1, len(linked) + 1), bool)
        for p in ids:
            at = [kind[ord(c)] for c in p]
            beside[at[:-1], at[1:]] = True
        alone = np.ones(0x110000, np.int8)
        alone[0x80:], alone[0x800:], alone[0x10000:] = 2, 3, 4
        symbol = np.full(0x110000, -1, np.int32)
        for c in (p for p in ids if len(p) == 1):
            alone[ord(c)], symbol[ord(c)] = 1, ids[c]
        return {
            "n": len(ids), "rank": rank, "calm": calm, "keys": keys[order], "made": made[order].astype(np.int32),
            "kind": kind, "beside": beside, "alone": alone, "symbol": symbol,
        }

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that pairs make, -1 where none."""
        t = self.tables
        key = a.astype(np.int64) * t["n"] + b
        at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        return np.where((t["keys"][at] == key) & (a >= 0) & (b >= 0), t["made"][at], -1)


def merge_all(vocab: Vocabulary, sym: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Surviving symbols of each sequence, merged in rounds; ``sym`` holds the sequences end to end."""
    t = vocab.tables
    out = lengths.astype(np.int64)
    seq = np.repeat(np.arange(len(out)), out)

    def ranked(sym: np.ndarray, seq: np.ndarray, at: np.ndarray, made: np.ndarray, rank: np.ndarray) -> None:
        at = at[(at >= 0) & (at < len(sym))]
        nxt = np.minimum(at + 1, len(sym) - 1)
        m = np.where((at + 1 < len(sym)) & (seq[at] == seq[nxt]), vocab.merged(sym[at], sym[nxt]), -1)
        made[at] = m
        rank[at] = np.where(m >= 0, t["rank"][m], NONE)

    made, rank = np.empty(len(sym), np.int32), np.empty(len(sym), np.int32)
    ranked(sym, seq, np.arange(len(sym)), made, rank)
    while len(sym):
        starts = np.flatnonzero(np.diff(seq, prepend=-1))
        lengths = np.diff(starts, append=len(seq))
        least = np.minimum.reduceat(rank, starts)
        done = least == NONE
        out[seq[starts[done]]] = lengths[done]
        if done.any():
            stay = np.repeat(~done, lengths)
            sym, seq, made, rank = sym[stay], seq[stay], made[stay], rank[stay]
            lengths, least = lengths[~done], least[~done]
        if not len(sym):
            break
        hit = np.flatnonzero(rank == np.repeat(least, lengths))
        # Of neighbouring hits the left one; of pieces that are not calm, and of ties between pieces, the leftmost.
        first = np.diff(seq[hit], prepend=-1) != 0
        lead = made[hit[first]]
        single = np.repeat(~t["calm"][lead], np.diff(np.flatnonzero(first), append=len(hit)))
        take = hit[first | (~single & (np.diff(hit, prepend=-2) > 1))]
        sym[take] = made[take]
        gone = np.zeros(len(sym), bool)
        gone[take + 1] = True
        place = np.cumsum(~gone) - 1
        stay = ~gone
        sym, seq, made, rank = sym[stay], seq[stay], made[stay], rank[stay]
        ranked(sym, seq, np.concatenate([place[take], place[take] - 1]), made, rank)
    return out


def merge_one(vocab: Vocabulary, symbols: np.ndarray) -> int:
    """Surviving symbols of one long sequence by a priority queue: highest rank first, then leftmost."""
    t = vocab.tables
    sym, n = symbols.tolist(), len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    made = vocab.merged(symbols[:-1], symbols[1:])
    heap = [(int(t["rank"][m]), i, sym[i], sym[i + 1], int(m)) for i, m in enumerate(made.tolist()) if m >= 0]
    heapq.heapify(heap)
    left = n
    table = t.setdefault("pairs", {int(k): int(m) for k, m in zip(t["keys"], t["made"], strict=True)})

    def push(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (m := table.get(sym[i] * t["n"] + sym[after[i]])) is not None:
            heapq.heappush(heap, (int(t["rank"][m]), i, sym[i], sym[after[i]], m))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j] = m, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        left -= 1
        push(before[i])
        push(i)
    return left


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1, end to end."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def distinct(kind: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Codes that are equal for equal strings of kinds; all strings need the same number of 63-bit words."""
    per = 63 // bits
    code, n = np.zeros(len(starts), np.int64), 1
    for first in range(0, int(lengths.max()), per):
        key = np.zeros(len(starts), np.int64)
        for k in range(first, first + per):
            at = np.minimum(starts + k, len(kind) - 1)
            key = (key << bits) | np.where(k < lengths, kind[at], 0)
        word, kinds = pd.factorize(key)
        code, kinds = pd.factorize(code * len(kinds) + word) if n > 1 else (word, kinds)
        code, n = code.astype(np.int64), len(kinds)
    return code


def count_batch(vocab: Vocabulary, texts: list[str], known: dict[str, int]) -> np.ndarray:
    """Tokens of each text; ``known``: counts of strings between cuts."""
    t = vocab.tables
    normal = [SPACE + x.replace(" ", SPACE) if x else "" for x in texts]
    whole = "".join(normal)
    if not whole:
        return np.zeros(len(texts), np.int64)
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(x) for x in normal])
    kind = t["kind"][code]
    cut = np.ones(len(code) + 1, bool)
    cut[1:-1] = ~t["beside"][kind[:-1], kind[1:]]
    cut[ends] = True
    edges = np.flatnonzero(cut)
    starts, lengths = edges[:-1], np.diff(edges)
    tokens = t["alone"][code[starts]].astype(np.int64)
    # Strings of two or more characters are told apart by their packed kinds; equal ones are counted once.
    bits = int(len(t["beside"])).bit_length()
    longer = np.flatnonzero(lengths > 1)
    words = -(-lengths[longer] // (63 // bits))
    groups = []
    for w in np.unique(np.minimum(words, PACKED + 1)).tolist():
        of = longer[np.minimum(words, PACKED + 1) == w]
        if w <= PACKED:
            own = distinct(kind, starts[of], lengths[of], bits)
        else:
            own = pd.factorize(np.array([whole[a : a + n] for a, n in zip(starts[of].tolist(), lengths[of].tolist(), strict=True)], object))[0]
        sample = np.empty(own.max() + 1, np.int64)
        sample[own] = of
        groups.append((of, own, sample))
    if groups:
        sample = np.concatenate([g[2] for g in groups])
        strings = [whole[a : a + n] for a, n in zip(starts[sample].tolist(), lengths[sample].tolist(), strict=True)]
        if len(known) > REMEMBERED:
            known.clear()
        new = np.flatnonzero([s not in known for s in strings])
        short = new[lengths[sample[new]] <= LONG]
        if len(short):
            n = lengths[sample[short]]
            for k, c in zip(short.tolist(), merge_all(vocab, t["symbol"][code[ragged(starts[sample[short]], n)]], n).tolist(), strict=True):
                known[strings[k]] = c
        for k in new[lengths[sample[new]] > LONG].tolist():
            known[strings[k]] = merge_one(vocab, t["symbol"][code[starts[sample[k]] : starts[sample[k]] + lengths[sample[k]]]])
        counts = np.fromiter(map(known.__getitem__, strings), np.int64, len(strings))
        for of, own, part in groups:
            tokens[of], counts = counts[: len(part)][own], counts[len(part) :]
    total = np.concatenate([[0], np.cumsum(tokens)])
    at = total[np.searchsorted(starts, ends)]
    return np.diff(at, prepend=0)


def load_pieces(model_path: str) -> tuple[list[str], list[float]]:
    """Ordinary pieces of a sentencepiece model with their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids]


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", payload: Column | None = None) -> DataFrame:
    """(row, n_tokens); ``row`` is ``payload``, by default all columns."""
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(payload.alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType())])
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, known = Vocabulary(*sent.value), {}
        for batch in batches:
            for part in slices(batch, "text"):
                n = count_batch(vocab, [x or "" for x in part.column("text").to_pylist()], known)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n, pa.int64())], ["row", "n_tokens"])

    return rows.mapInArrow(run, schema)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), payload=F.struct("doc_id", n_bytes.alias("n_bytes")))
    return found.select("row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
