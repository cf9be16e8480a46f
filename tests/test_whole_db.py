"""Whole-database profiles and the kept value index against plain Python."""

import random
from collections import Counter
from decimal import Decimal

from arbiter.operators import profile as P
from arbiter.operators import values as L

LONG = "the same long beginning of every text in this column, over sixty-four characters "


def people(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "ann", "Bob", "ann "]), rng.choice([-0.0, 0.0, 1.5, 2e7, 1e-5, None]), rng.choice([Decimal("1.50"), Decimal("20.00"), None]),
             LONG + rng.choice("abcde") * rng.randrange(1, 3) if i % 4 else rng.choice([None, "short"]), i % 3 == 0, [1.0]) for i in range(80)]
    return rows, "id long, name string, x double, e decimal(6,2), note string, flag boolean, v array<double>"


def text(v):
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return {2e7: "20000000.0", 1e-5: "0.00001"}.get(v, str(v + 0.0))
    return str(v)


def test_profiles_against_plain_python(spark):
    rows, schema = people(spark)
    df = spark.createDataFrame(rows, schema).repartition(5)
    both = P.Profiles({"people": df, "nothing": spark.createDataFrame([], "a int, b string")})
    got = {(r.table_name, r.column_name): r for r in both.columns().collect()}
    top = {}
    for r in both.top(3).collect():
        top.setdefault(r.column_name, []).append((r["rank"], r.value, r.n))
    for i, name in enumerate(df.columns[:-1]):
        values = [r[i] for r in rows if r[i] is not None]
        counts = Counter(values)
        p = got["people", name]
        assert (p.row_count, p.non_null_count, p.distinct_count, p.null_count) == (80, len(values), len(counts), 80 - len(values)), name
        assert (p.min_value, p.max_value) == (text(min(values)), text(max(values))), name
        sizes = [len(text(v)) for v in values]
        assert (p.min_len, p.max_len) == (min(sizes), max(sizes))
        best = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        assert sorted(top[name]) == [(k + 1, text(v), n) for k, (v, n) in enumerate(best)], name
    assert got["people", "v"].distinct_count is None and got["people", "v"].non_null_count == 80 and "v" not in top
    assert got["people", "id"].char_class == "digits" and got["people", "flag"].char_class == "alpha" and got["people", "note"].common_prefix == ""
    for name in ("a", "b"):
        p = got["nothing", name]
        assert (p.row_count, p.non_null_count, p.distinct_count, p.null_fraction, p.char_class, p.min_value) == (0, 0, 0, 0.0, "empty", None)


def test_long_texts_that_begin_alike_are_ranked_by_their_whole_text(spark):
    texts = [LONG + c for c in "gfedcba"] + [LONG + "z"] * 2 + [LONG[:64]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    assert [r.value for r in P.profile_top_values(df, "t", 4).orderBy("rank").collect()] == [LONG + "z", LONG[:64], LONG + "a", LONG + "b"]
    assert P.profile_table(df, "t").first().common_prefix == LONG[:64]


def test_table_english(spark):
    both = P.Profiles({"t": spark.createDataFrame([(1, None), (2, "x")], "id int, c string"), "none": spark.createDataFrame([], "a int")})
    got = {r.table_name: r.english for r in P.render_table_english(both.columns(), both.top(6)).collect()}
    assert got["none"] == 'Table "none" (0 rows):\n- Column "a" (declared type int). The table is empty.'
    lines = got["t"].split("\n")
    assert lines[0] == 'Table "t" (2 rows):' and len(lines) == 3 and "1 of 2 rows are NULL (50%)." in lines[2]
    many = P.Profiles({"m": spark.createDataFrame([(i % 7, ) for i in range(20)], "k int")})
    assert P.render_column_english(many.columns(), many.top(6)).first().english.endswith(", ….")
    untyped = many.columns().withColumn("declared_type", P.F.lit(""))
    assert "(declared type ?)" in P.render_column_english(untyped).first().english


def test_value_index_by_table(spark, tmp_path):
    a = spark.createDataFrame([(1, " Ann "), (2, LONG + "x"), (3, None)], "id long, name string")
    b = spark.createDataFrame([("ann", 1.0), ("bob", 2.5)], "who string, n double")
    index = L.ValueIndex(spark, str(tmp_path)).add({"A": a}).add({"b": b}, redact=["B.who"])

    def held(*values):
        look = spark.createDataFrame([(v,) for v in values], "value string")
        return {r.value: r.holders for r in L.columns_containing(index, look).collect()}

    assert held("ANN", LONG + "X", "2.5", "zoe", None) == {"ANN": ["a.name"], LONG + "X": ["a.name"], "2.5": ["b.n"], "zoe": [], None: []}
    assert {r.column_key for r in index.columns().collect()} == {"a.id", "a.name", "b.n"}
    index.add({"b": b})  # replaced, now with the names
    assert held("ann", "bob", "1.0") == {"ann": ["a.name", "b.who"], "bob": ["b.who"], "1.0": ["b.n"]}
    assert index.rows().where("table_name = 'b'").count() == 4


def test_a_lookup_reads_its_partitions_only(spark, tmp_path):
    index = L.ValueIndex(spark, str(tmp_path)).add({"t": spark.range(500)})
    one = spark.createDataFrame([("17",)], "value_norm string")
    plan = index.holders(one)._jdf.queryExecution().executedPlan().toString()
    part = one.select(L.ValueIndex._part()).first()[0]
    assert "PartitionFilters: [" in plan and f"(part" in plan and str(part) in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [r.holders for r in index.holders(one).collect()] == [["t.id"]]
