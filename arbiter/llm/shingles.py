"""Hashed word shingles of a batch of texts, and groups of linked keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import written

WIDTH = 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lengths): the distinct shingles of each text, sorted, end to end.

    A text of fewer words than ``width`` has one shingle, of all its words; a
    text without words has none.
    """
    words = [(t or "").encode().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    flat = np.empty(int(n.sum()), object)
    flat[:] = [w for one in words for w in one]
    code, distinct = pd.factorize(flat)
    value = pd.util.hash_array(np.array([w.decode() for w in distinct], object), categorize=False)[code]
    doc = np.repeat(np.arange(len(texts)), n)
    # Windows begin at every word that has the rest of its window in the same text; short texts have one, at their first word.
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    have = np.maximum(n - width + 1, np.minimum(n, 1))
    begin = np.repeat(first - np.cumsum(have) + have, have) + np.arange(have.sum())
    owner = np.repeat(np.arange(len(texts)), have)
    h = np.full(len(begin), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(width):
        at = np.minimum(begin + k, len(doc) - 1)
        inside = (begin + k < len(doc)) & (doc[at] == owner)
        h = np.where(inside, mix64(h * np.uint64(31) + value[at]), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))


def connected(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the least node of each connected component of ``edges`` (u, v), by alternating large and small stars.

    Each round is two aggregations of minima by node, pre-aggregated before the
    shuffle, so a node with very many neighbours is one row per task.  The
    rounds grow with the logarithm of a component's size.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, f"{label}-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
