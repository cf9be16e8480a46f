"""Exact numbers, cells of any width, NULL places in votes, databases that share table names."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from arbiter.functions.cells import result_cells
from arbiter.operators import audit as G
from arbiter.operators import catalog as C
from arbiter.operators import compare as R
from arbiter.operators import profile as P
from arbiter.operators import retrieval as RT
from arbiter.operators import slices as K
from arbiter.operators import values as L
from arbiter.operators import voting as V


def _one(spark, value, kind):
    return spark.createDataFrame([(0, None, value)], f"question_id long, row_pos long, v {kind}")


@pytest.mark.parametrize("a, ka, b, kb, same", [
    (Decimal("12345678901234567890.12"), "decimal(22,2)", Decimal("12345678901234567999.12"), "decimal(22,2)", False),
    (9007199254740993, "long", 9007199254740992.0, "double", False),
    (9007199254740992, "long", 9007199254740992.0, "double", True),
    (9007199254740993, "long", Decimal("9007199254740993.00"), "decimal(20,2)", True),
    (1, "long", Decimal("1.000"), "decimal(5,3)", True),
    (0.1 + 0.2, "double", 0.3, "double", True),
    (0.3, "double", Decimal("0.30"), "decimal(3,2)", True),
    (1234.5, "double", Decimal("1234.500001"), "decimal(10,6)", False),
    (-0.0, "double", 0, "int", True),
    (Decimal("20000000000000000000"), "decimal(38,0)", 2e19, "double", True),
    (Decimal("20000000000000000001"), "decimal(38,0)", 2e19, "double", False),
    (Decimal("123456789000000000000000000000"), "decimal(38,0)", 1.23456789e29, "double", True),
    ("1", "string", 1, "long", False),
    ([0.1 + 0.2], "array<double>", [0.3], "array<double>", True),
])
def test_numbers_compare_by_exact_value(spark, a, ka, b, kb, same):
    q = spark.createDataFrame([(0,)], "question_id long")
    left, right = _one(spark, a, ka), _one(spark, b, kb)
    assert R.compare_results(left, right, q).first().correct is same
    if not ka.startswith("array"):
        cells = [d.select("question_id", "row_pos", result_cells(d, ["v"]).alias("cells")) for d in (left, right)]
        assert R.compare_results(*cells, q, gold_values=["cells"], cand_values=["cells"]).first().correct is same


def test_votes_see_where_the_null_stands(spark):
    rows = spark.createDataFrame([(0, 0, None, 1, None), (0, 1, None, None, 1), (0, 2, None, 1, None)], "question_id long, idx long, row_pos long, a int, b int")
    cands = spark.createDataFrame([(0, i, False) for i in range(3)], "question_id long, idx long, errored boolean")
    got = V.majority_vote(V.candidate_fingerprints(rows, cands, ["a", "b"])).first()
    assert (got.selected_index, got.agreement, got.n_groups) == (0, 2, 2)


def test_literals_beyond_any_sample_are_on_column(spark, tmp_path):
    orders = spark.range(9500).select(F.col("id").alias("k"))
    part = spark.range(9000, 9003).select(F.col("id").alias("p"))
    index = L.ValueIndex(spark, str(tmp_path)).add({"orders": orders, "part": part})
    b = spark.createDataFrame([(1, 1, None, "k", "9001"), (2, 1, None, "k", "9600"), (3, 1, None, "p", "17")], "query_id long, binding_id int, qualifier string, column_name string, literal string")
    tables = spark.createDataFrame([(1, "orders"), (2, "orders"), (3, "part")], "query_id long, table_name string")
    none = spark.createDataFrame([], "query_id long, alias string, table_name string")
    found = L.check_literals(L.resolve_bindings(b, none, tables, index.columns()), index).collect()
    assert [(r.query_id, r.candidate_columns) for r in found] == [(3, ["orders.k"])]


def test_databases_that_share_table_names_stay_apart(spark):
    blocks = spark.createDataFrame(
        [("a", "t", 1, "x" * 40, 10), ("b", "t", 1, "x" * 400, 100), ("b", "u", 2, "x" * 40, 10)], "db_id string, table_name string, table_ordinal int, block string, cost long"
    )
    catalog = blocks.selectExpr("db_id", "table_name", "table_ordinal", "'c' AS column_name", "1 AS column_ordinal")
    fks = spark.createDataFrame([], "db_id string, table_name string, fk_ordinal int, local_col string, referred_table string")
    postings = spark.createDataFrame([("a", "t", [(1, 3)]), ("b", "t", [(1, 3)])], "db_id string, token string, postings array<struct<ord:int,w:long>>")
    q = spark.createDataFrame([(1, "a", "the t"), (2, "b", "the t")], "question_id long, db_id string, question string")
    hits = RT.question_hits(q, postings, RT.schemas(catalog, fks, blocks))
    assert RT.fit_budget(hits, 50).count() == 2
    got = {r.question_id: (r.mode, r.n_tables, r.tokens) for r in RT.gate(hits, 50).collect()}
    assert got == {1: ("full", 1, 10), 2: ("rag", 1, 100)}
    refs = spark.createDataFrame([(1, "a", "u"), (2, "b", "u")], "query_id long, db_id string, table_name string")
    assert [r.query_id for r in G.table_scope(refs, blocks).collect()] == [1]


def test_fanout_beyond_a_long(spark):
    many = spark.range(1).select(F.lit(1).alias("k"))
    got = G.join_fanout(many, many, "k", "k").first()
    assert got.join_rows == Decimal(1)
    big = spark.createDataFrame([(4_000_000_000,)], "n long").select((F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).alias("x"))
    assert big.first().x == Decimal(16_000_000_000_000_000_000)


def test_ties_of_long_integers_keep_native_order(spark):
    df = spark.createDataFrame([(-9007199254740992,), (-9007199254740993,)], "k long")
    assert [r.value for r in P.profile_top_values(df, "t").orderBy("rank").collect()] == ["-9007199254740993", "-9007199254740992"]


def test_profile_of_arrays_only(spark):
    got = P.profile_table(spark.createDataFrame([([1.0],)], "v array<double>"), "t").first()
    assert got.distinct_count is None and got.char_class is None and got.non_null_count == 1


def test_ineligible_base_fails(spark):
    q = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "question_id long, db_id string, difficulty string")
    counts = spark.createDataFrame([("a", 3), ("b", 9)], "db_id string, table_count long")
    assert K.require_eligible(q.where("question_id = 1"), q, counts, 0, 5).first().n_base == 1
    with pytest.raises(Exception, match="not eligible"):
        K.require_eligible(q, q, counts, 0, 5).collect()


@pytest.mark.parametrize("a, ka, b, same", [
    (Decimal("0.0000005"), "decimal(10,7)", 5e-7, True),
    (Decimal("0.0000005"), "decimal(10,7)", 5.0000001e-7, False),
    (Decimal("0.000000000000000005"), "decimal(18,18)", 5e-18, True),
    (Decimal("0.000000000000000000"), "decimal(18,18)", 4e-19, False),
    (Decimal("0.001234567890123457"), "decimal(18,18)", 0.0012345678901234567, False),
])
def test_small_fractions_compare_by_exact_value(spark, a, ka, b, same):
    q = spark.createDataFrame([(0,)], "question_id long")
    assert R.compare_results(_one(spark, a, ka), _one(spark, b, "double"), q, ("column_position", "exact")).first().correct is same
