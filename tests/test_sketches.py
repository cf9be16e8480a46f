"""Sketches against exact counts: bounds that never fall short, parts that are read once."""

import random
from collections import Counter

import numpy as np

from arbiter.operators import audit as G
from arbiter.operators import sketches as SK


def test_a_store_merges_parts(spark, tmp_path):
    store = SK.SketchStore(spark, str(tmp_path / "s"))
    for part, (a, b) in {"p1": (0, 3000), "p2": (2000, 6000)}.items():
        store.add("t", part, spark.range(a, b).selectExpr("id", "CAST(id % 7 AS STRING) AS s", "CAST(NULL AS INT) AS none", "CAST(id / 4 AS DOUBLE) AS x", "array(id) AS v"))
    got = {r.column_name: r for r in store.profile().collect()}
    assert set(got) == {"id", "s", "none", "x"}
    for name, exact in (("id", 6000), ("s", 7), ("none", 0), ("x", 6000)):
        assert got[name].row_count == 7000 and abs(got[name].approx_distinct - exact) <= SK.relative_error() * exact
    assert got["none"].non_null_count == 0
    store.add("t", "p2", spark.range(2000, 2500).selectExpr("id"))  # the part is replaced
    now = {r.column_name: r for r in store.profile().collect()}
    assert now["id"].row_count == 3500 and abs(now["id"].approx_distinct - 3000) <= SK.relative_error() * 3000


def test_bounds_are_never_under_the_exact_join(spark):
    rng = random.Random(6)
    frames, counts = {}, {}
    for t, n, keys in (("a", 4000, 50), ("b", 3000, 3000), ("c", 500, 1), ("empty", 0, 1)):
        rows = [(rng.randrange(keys) if rng.random() < 0.95 else None, str(rng.randrange(20))) for _ in range(n)]
        frames[t] = spark.createDataFrame(rows, "k int, s string" if t != "b" else "k long, s string")
        counts[t] = {"k": Counter(r[0] for r in rows if r[0] is not None), "s": Counter(r[1] for r in rows)}
    joins = [(f"{x}-{y}-{c}", x, c, y, c) for x in frames for y in frames for c in ("k", "s")]
    for budget in (0, 5000, 10**9):
        for r in SK.join_budgets(frames, joins, budget).collect():
            x, y, c = r.join_name.split("-")
            exact = sum(n * counts[y][c][v] for v, n in counts[x][c].items())
            assert r.bound >= exact and r.over_budget == (exact > budget)
            assert r.join_rows == (exact if r.bound > budget else None)


def test_inner_products_of_huge_counters_are_exact():
    a = np.array([[3_000_000_000, 1], [2, 0]])
    assert SK.inner_product(a, a * 2) == 8


def test_failure_records_keep_everything(spark):
    results = spark.createDataFrame([(1, "d", "easy", False, "wrong", "SELECT 1", "row counts differ"), (2, "d", None, True, "ok", "SELECT 2", None), (3, "d", None, False, "error", None, "timeout")],
                                    "question_id long, db_id string, difficulty string, correct boolean, terminal_state string, candidate_sql string, note string")
    cases = spark.createDataFrame([(i, f"q{i}", f"g{i}") for i in (1, 2, 3)], "question_id long, question string, gold_sql string")
    tags = spark.createDataFrame([(1, ["join_mismatch"])], "question_id long, tags array<string>")
    got = [tuple(r) for r in G.failure_records(results, cases, tags).orderBy("question_id").collect()]
    assert got == [(1, "d", "easy", "wrong", "q1", "g1", "SELECT 1", "row counts differ", ["join_mismatch"]), (3, "d", None, "error", "q3", "g3", None, "timeout", [])]


def test_missed_recall(spark):
    side = spark.createDataFrame([(True, None, 1.0), (False, ["join_mismatch"], 0.5), (True, None, None)], "correct boolean, tags array<string>, recall double")
    r = G.ab_lift(side, side).first()
    assert (r.n_with_recall, r.recall, r.missed_recall) == (2, 0.75, 0.25)
    assert G.ab_lift(side, side.drop("recall")).first().missed_recall is None
