"""Profiler, catalog retrieval, value index and redaction on small tables."""

from pyspark.sql import functions as F

from arbiter.operators import catalog as C
from arbiter.operators import profile as P
from arbiter.operators import redact as D
from arbiter.operators import retrieval as RT
from arbiter.operators import values as L


def schools(spark):
    return spark.createDataFrame(
        [("01100170109835", "2014", "Active", 120, None), ("01100170112607", "2015", "Closed", None, "x"),
         ("01100170118489", "2015", "Active", 80, "ab")],
        "cds string, year string, status string, enrollment int, note string")


def test_profile_columns(spark):
    p = {r["column_name"]: r for r in P.profile_table(schools(spark), "schools").collect()}
    assert p["cds"]["is_unique"] and p["cds"]["is_constant_length"] and p["cds"]["char_class"] == "digits"
    assert p["cds"]["common_prefix"] == "011001701"
    assert p["status"]["char_class"] == "alpha" and p["status"]["distinct_count"] == 2
    assert p["enrollment"]["null_count"] == 1 and abs(p["enrollment"]["null_fraction"] - 1 / 3) < 1e-12
    assert p["enrollment"]["min_value"] == "80" and p["enrollment"]["max_value"] == "120"


def test_top_values_tie_break_native_order(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (9,), (100,)], "v int")
    top = [(r["value"], r["n"]) for r in P.profile_top_values(df, "t").orderBy("rank").collect()]
    assert top == [("9", 2), ("10", 2), ("100", 1)]


def test_redacted_profile_hides_values(spark):
    p = {r["column_name"]: r for r in P.profile_table(schools(spark), "schools", ["schools.status"]).collect()}
    assert p["status"]["min_value"] is None and p["status"]["common_prefix"] == "" and p["status"]["max_len"] == 6


def test_tokens_split_camel_case(spark):
    row = spark.range(1).select(C.tokens(F.lit("customerId and order_total")).alias("t")).collect()[0]
    assert sorted(row["t"]) == ["and", "customer", "id", "order", "total"]


def store(spark):
    frames = {
        "customers": spark.createDataFrame([(1, "Ann")], "id long, name string"),
        "orders": spark.createDataFrame([(1, 1, 9.5)], "id long, customer_id long, total double"),
        "payments": spark.createDataFrame([(1, "settled")], "id long, status string"),
        "products": spark.createDataFrame([(1, "lamp")], "id long, title string"),
    }
    cat = C.catalog_from_frames(spark, "store", frames)
    fks = spark.createDataFrame([("store", "orders", 1, "customer_id", "customers")],
                                "db_id string, table_name string, fk_ordinal int, local_col string, referred_table string")
    return cat, C.sample_values("store", frames), fks


def test_relevant_tables_expand_fks_and_fallback(spark):
    cat, samples, fks = store(spark)
    q = spark.createDataFrame([(1, "store", "total of orders"), (2, "store", "nothing matches here"),
                               (3, "store", "settled ones")], "question_id long, db_id string, question string")
    hits = RT.question_hits(q, RT.posting_lists(cat, samples), RT.schemas(cat, fks, C.render_blocks(cat, fks, samples)))
    sel = RT.relevant_tables(hits, max_tables=8)
    got = {}
    for r in sel.collect():
        got.setdefault(r["question_id"], set()).add(r["table_name"])
    assert got[1] == {"orders", "customers"}
    assert got[2] == {"customers", "orders", "payments", "products"}
    assert got[3] == {"payments"}


def test_fit_budget_keeps_first_table(spark):
    cat, samples, fks = store(spark)
    q = spark.createDataFrame([(1, "store", "orders of customer id")], "question_id long, db_id string, question string")
    hits = RT.question_hits(q, RT.posting_lists(cat, samples), RT.schemas(cat, fks, C.render_blocks(cat, fks, samples)))
    kept = [r["table_name"] for r in RT.fit_budget(hits, 1).collect()]
    assert kept == ["orders"]


def test_literal_steering(spark, tmp_path):
    frames = {"schools": spark.createDataFrame([(1, "Fresno", "Clovis"), (2, "Kern", "Delano")],
                                               "id long, CountyName string, District string")}
    idx = L.ValueIndex(spark, str(tmp_path)).add(frames)
    b = spark.createDataFrame([(1, 1, None, "District", "fresno "), (2, 1, None, "CountyName", "Fresno"),
                               (3, 1, None, "Nowhere", "Fresno")],
                              "query_id long, binding_id int, qualifier string, column_name string, literal string")
    a = spark.createDataFrame([], "query_id long, alias string, table_name string")
    qt = spark.createDataFrame([(1, "schools"), (2, "schools"), (3, "schools")], "query_id long, table_name string")
    f = L.check_literals(L.resolve_bindings(b, a, qt, idx.columns()), idx).collect()
    assert [(r["query_id"], r["candidate_columns"]) for r in f] == [(1, ["schools.countyname"])]


def test_redact_masks_non_null_only(spark):
    df = spark.createDataFrame([("a@b", 1), (None, 2)], "Email string, id int")
    got = [r["Email"] for r in D.redact(df, {"email"}).orderBy("id").collect()]
    assert got == [D.MASK, None]
    pol = spark.createDataFrame([("db", "  email TEXT, -- PII"), ("db", "  brand TEXT, -- PII-adjacent")], "db_id string, line string")
    assert [r["pii_column"] for r in D.policy_from_ddl(pol).collect()] == ["email"]


def test_prefix_when_one_extreme_prefixes_the_other(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("",)], "v string")
    p = P.profile_table(df.filter("v <> ''"), "t").collect()[0]
    assert p["common_prefix"] == "ab" and p["char_class"] == "alpha"
    q = P.profile_table(df, "t").collect()[0]
    assert q["common_prefix"] == "" and q["char_class"] == "mixed"
