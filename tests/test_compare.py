"""Comparator verdicts: golden-style cases, metamorphic checks, partition invariance."""

import pytest
from pyspark.sql import functions as F

from arbiter.operators import compare as R


def result(spark, qid, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.select(F.lit(qid).cast("long").alias("question_id"), *df.columns)


def verdict(spark, gold_rows, cand_rows, gschema, cschema, rules=R.DEFAULT_RULES, ordered=False):
    g = spark.createDataFrame(gold_rows, gschema)
    c = spark.createDataFrame(cand_rows, cschema)
    go = [g.columns[0]] if ordered else None
    co = [c.columns[0]] if ordered else None
    row = R.compare_frames(g, c, rules, order_significant=ordered, gold_order=go, cand_order=co).collect()[0]
    return row["correct"], row["reason"]


def test_rename_passes(spark):
    assert verdict(spark, [(1, "a")], [(1, "a")], "x long, y string", "p long, q string")[0]


def test_transposed_fails(spark):
    assert not verdict(spark, [(1, "a")], [("a", 1)], "x long, y string", "q string, p long")[0]


def test_null_equals_null_not_zero(spark):
    assert verdict(spark, [(None,)], [(None,)], "x long", "x long")[0]
    assert not verdict(spark, [(None,)], [(0,)], "x long", "x long")[0]


def test_ninth_decimal_noise_passes_strict_fails_lenient(spark):
    assert verdict(spark, [(1.0000000001,)], [(1.0000000002,)], "x double", "x double")[0]
    assert not verdict(spark, [(1.0000000001,)], [(1.0000000002,)], "x double", "x double", R.LENIENT_RULES)[0]


def test_int_equals_whole_double(spark):
    assert verdict(spark, [(1,)], [(1.0,)], "x long", "x double")[0]


def test_duplicate_loss(spark):
    g, c = [(1,), (1,)], [(1,)]
    assert not verdict(spark, g, c, "x long", "x long")[0]
    assert verdict(spark, g, c, "x long", "x long", R.LENIENT_RULES)[0]


def test_order_only_matters_when_significant(spark):
    g, c = [(1, "a"), (2, "b")], [(1, "b"), (2, "a")]
    # positions by first column: gold a,b vs cand b,a
    gs, cs = "pos long, v string", "pos long, v string"
    gd = spark.createDataFrame(g, gs).select("v", "pos")
    cd = spark.createDataFrame(c, cs).select("v", "pos")
    un = R.compare_frames(gd.select("v"), cd.select("v")).collect()[0]
    assert un["correct"]
    o = R.compare_frames(gd, cd, order_significant=True, gold_order=["pos"], cand_order=["pos"]).collect()[0]
    assert not o["correct"]


def test_empty_cases(spark):
    ok, reason = verdict(spark, [], [], "x long", "a long, b long")
    assert ok and reason == R.REASON_EMPTY
    assert not verdict(spark, [], [(1,)], "x long", "x long")[0]


def test_width_mismatch_is_a_verdict(spark):
    ok, reason = verdict(spark, [(1, 2)], [(1,)], "a long, b long", "a long")
    assert not ok and reason == R.REASON_DIFFER


def test_unknown_rule_raises(spark):
    g = spark.createDataFrame([(1,)], "x long")
    with pytest.raises(ValueError):
        R.compare_frames(g, g, ("nope",))


def test_batch_symmetric_idempotent_and_self_equal(spark):
    rows = [(q, i, i % 3, float(i) / 7) for q in range(4) for i in range(20)]
    g = spark.createDataFrame(rows, "question_id long, row_pos long, a long, b double")
    c = g.withColumn("b", F.when(F.col("question_id") == 1, F.col("b") + 1).otherwise(F.col("b")))
    q = g.select("question_id").distinct().withColumn("order_significant", F.col("question_id") == 2)
    ab = {r["question_id"]: r["correct"] for r in R.compare_results(g, c, q).collect()}
    ba = {r["question_id"]: r["correct"] for r in R.compare_results(c, g, q).collect()}
    aa = {r["question_id"]: r["correct"] for r in R.compare_results(g, g, q).collect()}
    assert ab == ba == {0: True, 1: False, 2: True, 3: True}
    assert all(aa.values())


def test_row_shuffle_never_changes_multiset_verdict(spark):
    rows = [(0, i, i % 5) for i in range(50)]
    g = spark.createDataFrame(rows, "question_id long, row_pos long, a long")
    shuffled = spark.createDataFrame([(0, 50 - i, a) for _, i, a in rows], "question_id long, row_pos long, a long")
    q = spark.createDataFrame([(0, False)], "question_id long, order_significant boolean")
    assert R.compare_results(g, shuffled, q).collect()[0]["correct"]


def test_partition_count_invariance(spark):
    rows = [(q, i, (i * 7) % 11) for q in range(6) for i in range(30)]
    g = spark.createDataFrame(rows, "question_id long, row_pos long, a long")
    c = g.filter(~((F.col("question_id") == 3) & (F.col("row_pos") == 0)))
    q = g.select("question_id").distinct()
    out = []
    for n in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out.append(sorted((r["question_id"], r["correct"]) for r in R.compare_results(g.repartition(n), c, q).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_text_never_equals_number(spark):
    assert not verdict(spark, [("1",)], [(1,)], "x string", "x long")[0]
    assert verdict(spark, [(None,)], [(None,)], "x string", "x long")[0]


def test_both_rule_sets_in_one_pass(spark):
    """Strict and lenient verdicts together equal the two comparisons apart."""
    import random

    rng = random.Random(8)
    rows = [(q, p, rng.choice([0.1, 0.1 + 1e-9, 2.0, None]), rng.choice("ab")) for q in range(30) for p in range(rng.randrange(4))]
    schema = "question_id long, row_pos long, x double, s string"
    gold = spark.createDataFrame(rows, schema)
    cand = spark.createDataFrame([(q, p, x if rng.random() < 0.8 else 0.1, s) for q, p, x, s in rows if rng.random() < 0.9] + rows[:5], schema)
    q = spark.range(32).select(F.col("id").alias("question_id"), (F.col("id") % 3 == 0).alias("order_significant"))
    strict, lenient = R.compare_strict_and_lenient(gold, cand, q)
    for got, rules in ((strict, R.DEFAULT_RULES), (lenient, R.LENIENT_RULES)):
        assert sorted(got.collect()) == sorted(R.compare_results(gold, cand, q, rules).collect())
    narrow = gold.drop("s")
    for got, rules in zip(R.compare_strict_and_lenient(gold, narrow, q), (R.DEFAULT_RULES, R.LENIENT_RULES), strict=True):
        assert sorted(got.collect()) == sorted(R.compare_results(gold, narrow, q, rules).collect())
