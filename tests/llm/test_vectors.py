from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiter.llm import topk_search, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, x string, row int, n long, term string"
NAN, INF = float("nan"), float("inf")


def messy(n=160, d=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.array([3, 1, 1, 0.5, 0.2, 0.1])[:d]
    out = [(i, [float(v) for v in x], "x", i, 1, None) for i, x in enumerate(base)]
    out += [(500 + i, out[7][1], "copy", 0, 0, "t") for i in range(40)] + [(1000, out[7][1], None, None, None, None)] * 3
    out += [(2000, None, "", 0, 0, ""), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0][:d], "", 0, 0, ""), (2100, [NAN] * d, "", 0, 0, ""), (2150, [INF] * d, "", 0, 0, ""), (2200, [1e300] * d, "", 0, 0, "")]
    return [*out, (None, out[3][1], "null id", 0, 0, "")]


def whole(v):
    return v is not None and all(x is not None and abs(x) < 1e14 for x in v)


def integers(v, scale, shift=0):
    return tuple(int(np.floor(scale * x)) + shift for x in v)


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for size in (100, 1 << 24, 1 << 40, 1 << 61):
        a, b = rng.integers(-size, size, (5, 7)), rng.integers(-size, size, (7, 4))
        assert vectors.product(a, b).tolist() == (a.astype(object) @ b.astype(object)).tolist()


def test_eigen_of_ill_conditioned_and_singular_covariances():
    rng = np.random.default_rng(2)
    for d, r in ((1, 1), (2, 2), (5, 5), (16, 9), (33, 33)):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :r]
        e = np.logspace(0, -6, r)
        values, components = whitening.eigen(q * e @ q.T)
        assert len(values) == r
        np.testing.assert_allclose(values, e, rtol=1e-8)
        np.testing.assert_allclose(np.abs((components * q).sum(axis=0)), 1, atol=1e-8)
        np.testing.assert_allclose(components.T @ components, np.eye(r), atol=1e-12)
    assert len(whitening.eigen(np.zeros((3, 3)))[0]) == 0
    # A graded matrix keeps its small eigenvalues relative to themselves.
    scale = np.diag([1.0, 1e-3, 1e-6])
    near = np.array([[1, 0.3, 0.2], [0.3, 1, 0.1], [0.2, 0.1, 1]])
    values, _ = whitening.eigen(scale @ near @ scale)
    assert values[2] == pytest.approx(1e-12 * np.linalg.det(near) / np.linalg.det(near[:2, :2]), rel=1e-5)


def test_cholesky_pivots_on_the_largest_rest():
    v = np.cov(np.random.default_rng(4).normal(size=(7, 40)))
    factor, order = whitening.pivoted_cholesky(v)
    np.testing.assert_allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12)
    assert (np.diff(np.diag(factor)) <= 0).all()


def test_whitening_against_exact_arithmetic(spark):
    rows = messy()
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    kept = [r for r in rows if whole(r[1])]
    fit = sorted({integers(r[1], 64, 1_000_000) for r in kept})
    n, d = len(fit), 6
    s = [sum(x[i] for x in fit) for i in range(d)]
    centred = np.array([[(n * x[i] - s[i]) / n for i in range(d)] for x in fit])
    e, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    e, vectors_ = e[::-1], vectors_[:, ::-1]
    assert Counter(r.row.vec_id for r in got) == Counter(r[0] for r in kept)
    assert got[0].row.asDict().keys() == {"vec_id", "embedding", "x", "row", "n", "term"}
    sign = None
    for r in got:
        x = integers(r.row.embedding, 64, 1_000_000)
        deviation = sum((n * x[i] - s[i]) ** 2 for i in range(d))
        assert (r.n, r.deviation, r.deviation_exact) == (n, deviation, Decimal(deviation))
        np.testing.assert_allclose(r.explained, e / e.sum(), rtol=1e-10)
        expected = np.array([(n * x[i] - s[i]) / n for i in range(d)]) @ vectors_ / np.sqrt(e)
        sign = np.sign(expected * np.array(r.whitened)) if sign is None else sign
        np.testing.assert_allclose(np.array(r.whitened) * sign, expected, rtol=1e-7, atol=1e-7)
        assert r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    def of(rows):
        return whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")).collect()

    assert of([]) == [] and of([None, [], []]) == [] and of([[1.0, 2.0]] * 4) == []
    assert [len(r.whitened) for r in of([[0.0, 1.0], [1.0, 0.0], [1.0, 0.0]])] == [1, 1, 1]  # one direction varies
    assert [r.row.vec_id for r in of([[1.0], [0.0, 1.0], [3.0, 0.0], [2.0, 2.0]])] == [1, 2, 3]  # the common length
    big = [[1e12, 0.0], [-1e12, 5.0], [3e11, 1.0]]
    fit = [integers(np.float32(v).astype(float), 64, 1_000_000) for v in big]
    s = [sum(x[i] for x in fit) for i in range(2)]
    exact = [sum((3 * x[i] - s[i]) ** 2 for i in range(2)) for x in fit]
    found = of(big)
    assert [r.deviation_exact for r in found] == [Decimal(v) for v in exact] and all(r.deviation is None for r in found)


def test_whitening_query(spark):
    found = whitening.op12_whiten(spark, SF)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    r = found.agg(F.count("*"), F.max("identity_error"), F.min("component"), F.max("component"), F.countDistinct("identity_error")).first()
    assert (r[0], r[2], r[3], r[4]) == (16 * n, 1, 16, 1) and r[1] < 1e-9


def best_of(rows, k, is_query):
    kept = [(r[0], integers(r[1], 256)) for r in rows if whole(r[1])]
    d = max((len(v) for _, v in kept), default=0)
    kept = [(i, v + (0,) * (d - len(v))) for i, v in kept]
    out = []
    for q, v in kept:
        if q is not None and is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i) if i is not None else (-sum(a * b for a, b in zip(v, w, strict=True)), True, 0) for i, w in kept if i != q)
            out += [(q, rank + 1, None if none else i, -s if abs(s) < 1 << 63 else None) for rank, (s, none, i) in enumerate(scores[:k])]
    return Counter(out)


@pytest.mark.parametrize(("block", "shard", "pack"), [(256, 256, 16_384), (8, 3, 5), (1, 1, 1)])
def test_search_against_all_pairs(spark, monkeypatch, block, shard, pack):
    for name, value in (("BLOCK", block), ("SHARD_BLOCKS", shard), ("PACK", pack), ("SLICE", 4)):
        monkeypatch.setattr(topk_search, name, value)
    rows = messy(40 if block == 1 else 160)
    found = topk_search.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % (20 if block == 1 else 10) == 0)
    assert Counter(map(tuple, found.collect())) == best_of(rows, 5, lambda i: i % (20 if block == 1 else 10) == 0)


def test_search_of_odd_tables(spark):
    def of(rows, k=3):
        found = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, k)
        assert Counter(map(tuple, found.collect())) == best_of(rows, k, lambda i: i % 2 == 0)

    of([]), of([(0, None)]), of([(0, [1.0])]), of([(0, []), (1, [])])
    of([(0, [1.0, 2.0]), (1, [3.0]), (2, [-1.0, -1.0, 5.0]), (3, [])])
    of([(i, [1e7 * (i % 3), -1e7]) for i in range(9)])
    of([(i, [1.0]) for i in range(9)])


def test_blocks_below_the_kth_score_are_not_scored():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (40, 16))
    x = np.repeat(centres, 50, axis=0) + rng.integers(-3, 4, (2000, 16))
    blocks = [(np.arange(a, a + 50), x[a : a + 50]) for a in range(0, 2000, 50)]
    high, low = (np.array([f(b, axis=0) for _, b in blocks]) for f in (np.max, np.min))
    queries, own = x[::40], np.arange(0, 2000, 40)
    best, scored = topk_search.search(queries, own, None, blocks, high, low, 5)
    scores = queries @ x.T
    scores[np.arange(len(own)), own] = -(1 << 50)
    order = np.lexsort((np.broadcast_to(np.arange(2000), scores.shape), -scores), axis=1)[:, :5]
    assert best.ids.tolist() == order.tolist()
    assert scored < 0.2 * len(queries) * len(blocks)


def test_search_query_against_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(table.embedding.to_numpy()).astype(float)).astype(np.int64)
    ids = table.vec_id.to_numpy()
    expected = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:5]
        expected += [(ids[q], r + 1, ids[i], s[i]) for r, i in enumerate(order)]
    found = topk_search.op13_topk_search(spark, SF)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, found.collect())) == Counter(expected)
