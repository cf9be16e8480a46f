"""Guard cascade, slices and text extraction."""

from pyspark.sql import functions as F

from arbiter.operators import audit as G
from arbiter.operators import slices as K
from arbiter.operators import text as X

FEAT = ("query_id long, sql_empty boolean, parsed boolean, write_kind string, write_command string, n_statements int, "
        "meta_command string, unknown_command string, unconstrained_join boolean, has_where boolean, n_joins int, "
        "bare_star_scan boolean")


def test_guard_first_rule_wins(spark):
    rows = [
        (1, True, False, "DELETE", None, 2, None, None, False, True, 0, False),
        (2, False, False, None, None, 1, None, None, False, True, 0, False),
        (3, False, True, "DELETE", None, 2, None, None, False, True, 0, False),
        (4, False, True, None, None, 2, "PRAGMA", None, False, True, 0, False),
        (5, False, True, None, None, 1, None, None, True, False, 9, False),
        (6, False, True, None, None, 1, None, None, False, True, 5, True),
        (7, False, True, None, None, 1, None, None, False, True, 1, False),
    ]
    got = {r["query_id"]: (r["decision"], r["rule"]) for r in G.guard(spark.createDataFrame(rows, FEAT)).collect()}
    assert got == {1: ("allow", None), 2: ("reject", "parse_error"), 3: ("reject", "read_only"), 4: ("reject", "dangerous_op"),
                   5: ("reject", "cost"), 6: ("reject", "cost"), 7: ("allow", None)}


def test_join_fanout_is_exact(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    right = spark.createDataFrame([(1,), (1,), (1,), (3,)], "k long")
    assert G.join_fanout(left, right, "k", "k").collect()[0]["join_rows"] == left.join(right, "k").count()


def test_largest_remainder_is_exact(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "stratum string, size long")
    got = {r["stratum"]: r["alloc"] for r in K.largest_remainder(sizes, 7).collect()}
    assert got == {"a": 4, "b": 2, "c": 1} and sum(got.values()) == 7


def test_stratified_draw_is_deterministic_and_exact(spark):
    pool = spark.range(1000).select(F.col("id").alias("question_id"), (F.col("id") % 3).cast("string").alias("difficulty"))
    a = sorted(r["question_id"] for r in K.stratified_draw(pool, 50, 7).collect())
    b = sorted(r["question_id"] for r in K.stratified_draw(pool.repartition(7), 50, 7).collect())
    assert a == b and len(a) == 50


def test_extract_sql(spark):
    texts = ["Reasoning\n```sql\nSELECT 1\n```\nmore\n```\nSELECT 2\n```", "I will select it.\n  SELECT a FROM t",
             "  nothing here  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["s"] for r in df.select(X.extract_sql(F.col("t")).alias("s")).collect()]
    assert got == ["SELECT 2", "SELECT a FROM t", "nothing here"]


def test_missing_identifier(spark):
    df = spark.createDataFrame([('no such table: ghost, relation "x" does not exist, no such table: ghost',), (None,)], "e string")
    got = [(r["m"], r["nf"]) for r in df.select(X.missing_identifier(F.col("e")).alias("m"),
                                                   X.is_not_found_error(F.col("e")).alias("nf")).collect()]
    assert got == [("ghost x", True), ("", False)]
