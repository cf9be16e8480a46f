"""src_*: sources and sinks -- JSON round trips, keys, sample rows, schema text, seed checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.operators import catalog as C
from arbiter.operators import compare as R
from arbiter.operators import keys as K
from arbiter.operators import runs as M
from arbiter.operators.order import dense_position
from arbiter.plans import schema as S
from arbiter.plans import slices as KS
from arbiter.plans.sql import SQL, _register
from arbiter.plans.sqlviews import V_RUNS, with_views
from arbiter.sources import catalogio as IO
from arbiter.sources import files as FS
from arbiter.sources import fixtures as fx
from arbiter.sources.tables import TABLES, Tables

DB = S.DB
# The verified questions, with the order that their ORDER BY gives the rows (none: a multiset).
VERIFIED = {
    "sql_pq01_filtered_count": (), "sql_pq02_filter_project_order": ("s_name",), "sql_pq03_top1": ("o_totalprice DESC", "o_orderkey"),
    "sql_pq04_sum_two_filters": (), "sql_pq05_error_events": (), "sql_pq06_point_lookup_join": (), "sql_pq07_group_sum_order": ("total DESC",),
    "sql_pq08_group_top1": ("total DESC", "o_custkey"), "sql_pq09_filtered_sum": (), "sql_pq10_latest_by_id": (),
}


def _frames(spark, sf_dir, names=TABLES):
    t = Tables(spark, sf_dir)
    return {n: getattr(t, n) for n in names}


def src_questions(spark, sf_dir):
    """Questions written as JSON lines and read back with an explicit schema."""
    q = S.questions(spark, sf_dir).select("question_id", "db_id", "question", F.lit(None).cast("string").alias("SQL"),
                                          F.lit(None).cast("string").alias("difficulty"))
    path = FS.write_json(q, FS.scratch_path(spark, "questions"))
    return FS.load_questions(spark, path, multi_line=False).select("question_id", "db_id", "question", "evidence")


def src_slice_filter(spark, sf_dir):
    """S3: a frozen slice file (ids of the small slice, at most n of them) filters the questions."""
    small = KS.slice_small(spark, sf_dir)
    doc = small.agg(F.sort_array(F.collect_list("question_id")).alias("question_ids")).select(
        F.struct(F.lit("small").alias("slice"), F.lit("dev").alias("purpose"), F.lit(20260611).cast("long").alias("seed")).alias("_meta"),
        "question_ids")
    path = FS.write_json(doc, FS.scratch_path(spark, "slice"))
    return FS.slice_filter(spark, path, KS.questions(spark, sf_dir))


def src_foreign_keys(spark, sf_dir):
    """The foreign keys, found in the data."""
    return S.found_keys(spark, sf_dir).select("child", "child_col", "parent", "parent_col")


def src_key_inclusions(spark, sf_dir):
    """Every column whose values all stand in a key column, of any table."""
    return K.inclusions(_frames(spark, sf_dir))


def src_fk_validation(spark, sf_dir):
    """The found edges, confirmed by anti-joins on the values themselves (as many as the schema has edges)."""
    edges = [tuple(r) for r in src_foreign_keys(spark, sf_dir).collect()]
    return IO.validate_foreign_keys(edges, _frames(spark, sf_dir))


def src_sample_rows(spark, sf_dir):
    return IO.sample_rows(_frames(spark, sf_dir)).select("table_name", "row_no", "row_text")


def src_join_paths(spark, sf_dir):
    fks = src_foreign_keys(spark, sf_dir)
    return IO.join_path_text(DB, fks, IO.sample_rows(_frames(spark, sf_dir)))


def src_schema_text(spark, sf_dir):
    """Every table block of the db, declaration order, blank-line joined."""
    catalog, samples, fks = S._index(spark, sf_dir)
    blocks = C.render_blocks(catalog, fks, samples)
    return blocks.groupBy("db_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_ordinal", "block"))), lambda s: s["block"]),
                     "\n\n").alias("schema_text"))


def _supplied(spark, sf_dir):
    from arbiter.plans.redact import ddl_lines
    d = ddl_lines(spark, sf_dir).withColumn("comment", F.regexp_extract("line", r"--\s*(.*)$", 1)).filter(F.col("comment") != "")
    return d.select("db_id", F.concat(F.col("table_name"), F.lit("."), F.regexp_extract("line", r"^\s*(\S+)", 1)).alias("column_key"),
                    F.col("comment").alias("short"), F.concat(F.col("comment"), F.lit(" column")).alias("long"))


def _profiled_descriptions(spark, sf_dir):
    """Descriptions drawn from the column profiles: short = char class, long = distinct count."""
    return S.whole_profile(spark, sf_dir).select(F.lit(DB).alias("db_id"), F.concat(F.col("table_name"), F.lit("."), F.col("column_name")).alias("column_key"),
                       F.col("char_class").alias("short"),
                       F.concat(F.col("distinct_count").cast("string"), F.lit(" distinct values")).alias("long")).where(F.col("long").isNotNull())


def src_descriptions_roundtrip(spark, sf_dir):
    """Profile descriptions saved per db (keys sorted) and loaded back."""
    path = FS.save_field_descriptions(_profiled_descriptions(spark, sf_dir), FS.scratch_path(spark, "fields"), "profiling")
    return FS.load_field_descriptions(spark, path)


def src_descriptions_fused(spark, sf_dir):
    """Supplied (DDL comments) fused with the profiling English of every column."""
    from arbiter.operators import profile as P
    from arbiter.plans.profile import whole_db
    both = whole_db(spark, sf_dir)
    eng = P.render_column_english(both.columns(), both.top(P.MAX_LISTED + 1))
    prof = eng.select(F.concat(F.col("table_name"), F.lit("."), F.col("column_name")).alias("column_key"), F.col("english").alias("text"))
    sup = _supplied(spark, sf_dir).select("column_key", F.col("long").alias("text"))
    return IO.merge_descriptions(sup, prof, "fused")


def _merged(source):
    def q(spark, sf_dir):
        prof = _profiled_descriptions(spark, sf_dir).select("column_key", F.col("long").alias("text"))
        return IO.merge_descriptions(_supplied(spark, sf_dir).select("column_key", F.col("long").alias("text")), prof, source)
    return q


def src_descriptions_supplied(spark, sf_dir):
    """S10, supplied only, for the columns that hold more than one value."""
    varied = S.whole_profile(spark, sf_dir).where(F.col("distinct_count") > 1).select(F.concat_ws(".", "table_name", "column_name").alias("column_key"))
    sup = _supplied(spark, sf_dir).select("column_key", F.col("long").alias("text")).join(varied, "column_key", "left_semi")
    return IO.merge_descriptions(sup, sup.limit(0), "supplied")


def src_row_counts(spark, sf_dir):
    """Row count of every table."""
    t = Tables(spark, sf_dir)
    parts = [getattr(t, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).cast("long").alias("n_rows")) for n in TABLES]
    return reduce(DataFrame.unionByName, parts)


def src_seed_join(spark, sf_dir):
    """A three-table join of captured rows (PII column left out), first five by id."""
    t = Tables(spark, sf_dir)
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_mktsegment", "l_extendedprice").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").limit(5)


def src_fixture_cases(spark, sf_dir):
    """Fixture files (cases grouped a hundred per record) read back and exploded."""
    from arbiter.plans.audit import _features
    f = _features(spark, sf_dir).select(
        "query_id", F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), F.col("query_id").cast("string")).alias("sql"),
        "expected_verdict", "expected_rule")
    grouped = f.groupBy(F.coalesce("expected_rule", F.lit("none")).alias("cat"), (F.col("query_id") / 100).cast("long").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("query_id").cast("string").alias("id"), "sql", "expected_verdict",
                                             "expected_rule"))).alias("cases"))
    path = FS.write_json(grouped.select("cases"), FS.scratch_path(spark, "fixtures"))
    return FS.load_fixture_cases(spark, path).select("id", "sql", "expected_verdict", "expected_rule")


def src_report_roundtrip(spark, sf_dir):
    """A run report written with an extra field and read back with the report schema."""
    rep = M.run_report(M.case_results(fx.v_runs(Tables(spark, sf_dir))), F.lit("v3"), F.lit("fp-base"), "orders", 3)
    path = FS.write_json(rep.withColumn("unknown_field", F.lit("ignored")), FS.scratch_path(spark, "report"))
    return FS.read_json(spark, path, FS.REPORT_SCHEMA)


def _answer(spark, name):
    """The rows of a verified question with their positions, where its order counts."""
    res = spark.sql(SQL[name][0])
    order = [F.col(c.split()[0]).desc() if c.endswith(" DESC") else F.col(c).asc() for c in VERIFIED[name]]
    return dense_position(res, [], order) if order else res.withColumn("row_pos", F.lit(None).cast("long"))


def src_verified_questions(spark, sf_dir):
    """S14 + R12: gold results stored row by row with order and types, run again and verified; a spoilt copy must not verify.

    The spoilt copy has its rows in reverse order where order counts and there
    are several, else one row twice.
    """
    _register(spark, sf_dir)
    path = FS.scratch_path(spark, "verified")
    out = []
    for name, order in VERIFIED.items():
        FS.save_gold_rows(name, _answer(spark, name), path)
        again = _answer(spark, name)
        values = [c for c in again.columns if c != "row_pos"]
        ddl = ", ".join(f"`{c}` {again.schema[c].dataType.simpleString()}" for c in values)
        gold = FS.load_gold_rows(spark, path, name, ddl)
        n = gold.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
        turned = gold.withColumn("row_pos", n + 1 - F.col("row_pos"))
        twice = gold.unionByName(gold.limit(1))
        spoilt = turned.where(n > 1).unionByName(twice.where(n <= 1)) if order else twice
        asked = spark.range(1).select(F.lit(name).alias("question_id"), F.lit(bool(order)).alias("order_significant"))
        sides = [d.withColumn("question_id", F.lit(name)).select("question_id", "row_pos", *values) for d in (gold, spoilt, again)]
        true, false = (R.compare_results(g, sides[2], asked, R.DEFAULT_RULES) for g in sides[:2])
        out.append(true.select("question_id", F.col("n_gold_rows").alias("n_rows"), F.col("correct").alias("verified")).join(
            false.select("question_id", F.col("correct").alias("spoilt_verified")), "question_id"))
    return reduce(DataFrame.unionByName, out)


QUERIES = {
    "src_questions": src_questions,
    "src_slice_filter": src_slice_filter,
    "src_foreign_keys": src_foreign_keys,
    "src_fk_validation": src_fk_validation,
    "src_key_inclusions": src_key_inclusions,
    "src_sample_rows": src_sample_rows,
    "src_join_paths": src_join_paths,
    "src_schema_text": src_schema_text,
    "src_descriptions_roundtrip": src_descriptions_roundtrip,
    "src_descriptions_fused": src_descriptions_fused,
    "src_descriptions_supplied": src_descriptions_supplied,
    "src_descriptions_profiling": _merged("profiling"),
    "src_descriptions_merged": _merged("fused"),
    "src_row_counts": src_row_counts,
    "src_seed_join": src_seed_join,
    "src_fixture_cases": src_fixture_cases,
    "src_report_roundtrip": src_report_roundtrip,
    "src_verified_questions": src_verified_questions,
}

# ---------------------------------------------------------------- oracle SQL


def _inclusion_ctes() -> str:
    """Every column against every key column of its family by an anti-join of their values."""
    kinds = {"BIGINT": "integer", "INT": "integer", "STRING": "text", "TIMESTAMP_NTZ": "timestamp_ntz"}
    columns = [(t, c, i, kinds[k]) for t in sorted(S.STAR_SCHEMA) for i, (c, k) in enumerate(S.STAR_SCHEMA[t], start=1) if k in kinds]
    vals = " UNION ALL ".join(f"SELECT DISTINCT {n} AS id, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for n, (t, c, _, _) in enumerate(columns))
    facts = " UNION ALL ".join(
        f"SELECT {n} AS id, '{t}' AS t, '{c}' AS c, {i} AS o, '{fam}' AS fam, count(DISTINCT {c})::BIGINT AS d, "
        f"count(*) = count(DISTINCT {c}) AS is_key FROM {t}" for n, (t, c, i, fam) in enumerate(columns))
    return f"""vals AS MATERIALIZED ({vals}), facts AS MATERIALIZED ({facts}),
pairs AS (SELECT a.id AS a, b.id AS b FROM facts a JOIN facts b ON a.fam = b.fam AND a.id <> b.id WHERE b.is_key AND a.d > 0 AND a.d <= b.d),
missing AS (SELECT DISTINCT p.a, p.b FROM pairs p JOIN vals x ON x.id = p.a
            WHERE NOT EXISTS (SELECT 1 FROM vals y WHERE y.id = p.b AND y.v = x.v)),
inc AS (SELECT ca.t AS child, ca.c AS child_col, ca.o::INT AS child_ordinal, pa.t AS parent, pa.c AS parent_col, ca.d AS n_values, pa.d AS n_parent_values
        FROM pairs p JOIN facts ca ON ca.id = p.a JOIN facts pa ON pa.id = p.b
        WHERE NOT EXISTS (SELECT 1 FROM missing m WHERE m.a = p.a AND m.b = p.b)),
named AS (SELECT *, EXISTS (SELECT 1 FROM inc r WHERE r.child = i.parent AND r.child_col = i.parent_col AND r.parent = i.child AND r.parent_col = i.child_col) AS back
          FROM inc i WHERE child <> parent AND regexp_replace(lower(child_col), '^[a-z]{{1,2}}_', '') = regexp_replace(lower(parent_col), '^[a-z]{{1,2}}_', '')),
fks AS (SELECT child, child_col, parent, parent_col FROM named WHERE NOT back OR child > parent)"""


def _fk_sql() -> str:
    return f"WITH {_inclusion_ctes()} SELECT * FROM fks"


def _fkv_sql() -> str:
    parts = []
    for c, _, col, p in S.EXPECTED_FKS:
        pc = S.STAR_SCHEMA[p][0][0]
        parts.append(f"SELECT '{c}' AS child, '{col}' AS child_col, '{p}' AS parent, '{pc}' AS parent_col, "
                     f"count(*)::BIGINT AS orphans, count(*) = 0 AS holds FROM {c} WHERE {col} IS NOT NULL "
                     f"AND {col} NOT IN (SELECT {pc} FROM {p} WHERE {pc} IS NOT NULL)")
    return " UNION ALL ".join(parts)


def _sample_sql() -> str:
    parts = []
    from arbiter.plans.profile import _txt

    def shown(c, kind):
        if kind.startswith("ARRAY"):
            return f"'[' || array_to_string(list_transform({c}, lambda x: {_txt('x', kind[6:-1].lower())}), ', ') || ']'"
        return _txt(c, kind.lower())

    for t in TABLES:
        cols = [c for c, _ in S.STAR_SCHEMA[t]]
        cells = " || ', ' || ".join(
            f"coalesce(CASE WHEN length({x}) <= 40 THEN {x} ELSE substr({x}, 1, 40) || '…' END, 'None')" for x in (shown(c, k) for c, k in S.STAR_SCHEMA[t]))
        order = ", ".join(f"{c} ASC NULLS FIRST" for c in cols)
        parts.append(f"(SELECT '{t}' AS table_name, '{', '.join(cols)}' AS columns, "
                     f"row_number() OVER (ORDER BY {order}) AS row_no, '(' || {cells} || ')' AS row_text "
                     f"FROM {t} ORDER BY {order} LIMIT 3)")
    return " UNION ALL ".join(parts)


_REPORT = with_views(V_RUNS) + """SELECT 'v3' AS prompt_version, 'fp-base' AS prompt_fingerprint, min(model) AS model,
  'orders' AS slice_name, 3::BIGINT AS k, count(*)::BIGINT AS total,
  count(*) FILTER (WHERE NOT guard_rejected AND error IS NULL AND matches_gold AND attempts = 1)::BIGINT AS n_correct_1,
  count(*) FILTER (WHERE NOT guard_rejected AND error IS NULL AND matches_gold)::BIGINT AS n_correct_k
FROM v_runs"""

def _supplied_sql() -> str:
    rows = []
    for table, cols in sorted(S.STAR_SCHEMA.items()):
        for col, _ in cols:
            name = "PII" if table in ("customer", "supplier") and col.endswith("_name") else "PII-adjacent" if col.endswith("_acctbal") else "identifier" if col.endswith("key") else None
            if name:
                rows.append(f"('{table}.{col}', '{name} column')")
    return "WITH sup(column_key, s) AS (VALUES " + ", ".join(rows) + ") "


def _descriptions_sql() -> str:
    from arbiter.plans.profile import PROFILED, _profile_sql
    prof = "\nUNION ALL".join(_profile_sql(t) for t in PROFILED)
    # The same columns that have a long description have a short one.
    return (f"SELECT '{DB}' AS db_id, table_name || '.' || column_name AS column_key, char_class AS short, "
            f"CAST(distinct_count AS VARCHAR) || ' distinct values' AS long FROM ({prof}) WHERE distinct_count IS NOT NULL")


def _fused_sql() -> str:
    from arbiter.plans.profile import PROFILED, _english_sql
    return _english_sql(PROFILED).replace("WITH p AS", _supplied_sql().strip() + ", p AS", 1) + """SELECT coalesce(sup.column_key, e.column_key) AS column_key,
  CASE WHEN s IS NOT NULL AND english IS NOT NULL THEN s || ' ' || english ELSE coalesce(s, english) END AS description
FROM sup FULL OUTER JOIN (SELECT table_name || '.' || column_name AS column_key, english FROM english) e ON e.column_key = sup.column_key"""


ORACLES = {
    "src_questions": f"WITH {S.QUESTIONS_SQL} SELECT question_id, db_id, question, '' AS evidence FROM v_questions",
    "src_slice_filter": "WITH " + KS._Q + ", " + KS._TC + ",\n" + KS._slice_sql("small")
    + "\nSELECT q.question_id, q.db_id, q.difficulty FROM q WHERE q.question_id IN (SELECT question_id FROM small)",
    "src_foreign_keys": _fk_sql(),
    "src_fk_validation": _fkv_sql(),
    "src_key_inclusions": f"WITH {_inclusion_ctes()} SELECT * FROM inc",
    "src_sample_rows": "SELECT table_name, row_no, row_text FROM (" + _sample_sql() + ")",
    "src_join_paths": f"""WITH s AS ({_sample_sql()}), fk AS ({_fk_sql()}),
pt AS (SELECT table_name, '  ' || table_name || ' (' || columns || '):' || chr(10)
              || string_agg('    ' || row_text, chr(10) ORDER BY row_no) AS t FROM s GROUP BY table_name, columns)
SELECT '{DB}' AS db_id, '-- Foreign-key relationships (join paths):' || chr(10)
  || (SELECT string_agg('  ' || child || '.' || child_col || ' -> ' || parent || '.' || parent_col, chr(10)
             ORDER BY '  ' || child || '.' || child_col || ' -> ' || parent || '.' || parent_col) FROM fk)
  || chr(10) || chr(10) || '-- Sample rows (value formats):' || chr(10)
  || (SELECT string_agg(t, chr(10) ORDER BY table_name) FROM pt) AS text""",
    "src_schema_text": S._BASE + "SELECT db_id, string_agg(block, chr(10) || chr(10) ORDER BY table_ordinal) AS schema_text FROM blocks GROUP BY db_id",
    "src_descriptions_roundtrip": _descriptions_sql(),
    "src_descriptions_fused": _fused_sql(),
    "src_descriptions_supplied": _supplied_sql() + f"SELECT column_key, s AS description FROM sup WHERE column_key IN (SELECT column_key FROM ({_descriptions_sql()}) WHERE NOT starts_with(long, '1 ') AND NOT starts_with(long, '0 '))",
    "src_descriptions_profiling": f"SELECT column_key, long AS description FROM ({_descriptions_sql()})",
    "src_descriptions_merged": _supplied_sql() + f"""SELECT coalesce(sup.column_key, p.column_key) AS column_key,
  CASE WHEN s IS NOT NULL AND long IS NOT NULL THEN s || ' ' || long ELSE coalesce(s, long) END AS description
FROM sup FULL OUTER JOIN ({_descriptions_sql()}) p ON p.column_key = sup.column_key""",
    "src_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n_rows FROM {t}" for t in TABLES),
    "src_seed_join": """SELECT l_orderkey, l_linenumber, o_orderstatus, c_mktsegment, l_extendedprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 5""",
    "src_fixture_cases": """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'SELECT * FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS VARCHAR) AS sql,
  CASE WHEN o_orderkey % 97 <> 0 AND (o_orderkey % 23 IN (0, 1) OR o_orderkey % 19 = 0 OR o_orderkey % 89 = 0)
       THEN 'reject' ELSE 'allow' END AS expected_verdict,
  CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AND o_orderkey % 23 IN (0, 1) THEN 'read_only' END AS expected_rule
FROM orders""",
    "src_report_roundtrip": _REPORT,
    "src_verified_questions": " UNION ALL ".join(
        f"SELECT '{n}' AS question_id, c.n_rows, true AS verified, c.n_rows = 0 AS spoilt_verified "
        f"FROM (SELECT count(*)::BIGINT AS n_rows FROM ({SQL[n][1] or SQL[n][0]}) x) c" for n in VERIFIED),
}
