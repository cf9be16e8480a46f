"""audit_*: guard and soundness cascades, failure taxonomy, fan-out, detector scoring.

Per-query features are derived from orders by fixed rules written once as SQL
expressions valid in both Spark SQL and DuckDB (the oracle reuses them).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import audit as G
from arbiter.operators import catalog as C
from arbiter.operators import runs as M
from arbiter.operators import sketches as SK
from arbiter.plans.schema import DB, EXPECTED_FKS, STAR_SCHEMA, found_keys
from arbiter.plans.sqlviews import V_RESULTS, V_RUNS, with_views
from arbiter.sources import fixtures as fx
from arbiter.sources.tables import TABLES, Tables

N_DBS = 7
# Fixed derivation rules: (column, SQL expression over orders).
FEATURES = [
    ("query_id", "o_orderkey"),
    ("sql_empty", "o_orderkey % 97 = 0"),
    ("parsed", "o_orderkey % 89 <> 0"),
    ("write_kind", "CASE WHEN o_orderkey % 23 = 0 THEN 'DELETE' WHEN o_orderkey % 23 = 1 THEN 'INSERT' END"),
    ("write_command", "CASE WHEN o_orderkey % 31 = 0 THEN 'REPLACE' END"),
    ("n_statements", "CAST(CASE WHEN o_orderkey % 19 = 0 THEN 2 ELSE 1 END AS INT)"),
    ("meta_command", "CASE WHEN o_orderkey % 29 = 0 THEN 'PRAGMA' WHEN o_orderkey % 29 = 1 THEN 'ATTACH' END"),
    ("unknown_command", "CASE WHEN o_orderkey % 37 = 0 THEN 'VACUUM' END"),
    ("unconstrained_join", "o_orderkey % 13 = 0"),
    ("has_where", "o_orderstatus <> 'P'"),
    ("n_joins", "CAST(o_orderkey % 7 AS INT)"),
    ("bare_star_scan", "o_orderkey % 11 = 0"),
    ("min_col", "CASE WHEN o_orderkey % 6 = 0 THEN 'o_totalprice' END"),
    ("min_guarded", "o_orderkey % 12 = 0"),
    ("asc_limit_col", "CASE WHEN o_orderkey % 8 = 0 THEN 'o_orderdate' END"),
    ("asc_limit_guarded", "o_orderstatus = 'F'"),
    ("eq_subquery_agg", "CASE WHEN o_orderkey % 10 = 0 THEN 'MAX' WHEN o_orderkey % 10 = 5 THEN 'MIN' END"),
    ("concat_cols", "CASE WHEN o_orderkey % 9 = 0 THEN 'c_name, c_phone' WHEN o_orderkey % 9 = 1 THEN 'c_name' END"),
    ("n_concat_cols", "CAST(CASE WHEN o_orderkey % 9 = 0 THEN 2 WHEN o_orderkey % 9 = 1 THEN 1 ELSE 0 END AS INT)"),
    ("expected_verdict", "CASE WHEN o_orderkey % 97 <> 0 AND (o_orderkey % 23 IN (0, 1) OR o_orderkey % 19 = 0 "
                         "OR o_orderkey % 89 = 0) THEN 'reject' ELSE 'allow' END"),
    ("expected_rule", "CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 AND o_orderkey % 23 IN (0, 1) "
                      "THEN 'read_only' END"),
    ("expected_sound", "CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 10 = 5 THEN 'flag' ELSE 'pass' END"),
]
# Referenced tables (name as written) and CTE names per query.
REFS = [
    ("'orders'", "true"),
    ("'Customer'", "o_orderkey % 2 = 0"),
    ("'ghost'", "o_orderkey % 43 = 0"),
    ("'recent'", "o_orderkey % 3 = 0"),
]
CTES = [("'RECENT'", "o_orderkey % 3 = 0")]
# Gold vs candidate shapes per question (tables as a comma list).
SHAPES = {
    "g": [("tables", "'customer,orders'"), ("n_joins", "CAST(1 AS INT)"), ("aggs", "'sum'"), ("group_by", "'c_mktsegment'"),
          ("distinct", "false"), ("where", "true"), ("limit", "CAST(NULL AS INT)"), ("n_select", "CAST(2 AS INT)"),
          ("parsed", "o_orderkey % 1009 <> 0")],
    "c": [("tables", "CASE o_orderkey % 4 WHEN 0 THEN 'customer,orders' WHEN 1 THEN 'orders' "
                     "WHEN 2 THEN 'customer,nation,orders' ELSE 'lineitem,orders' END"),
          ("n_joins", "CAST(CASE o_orderkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INT)"),
          ("aggs", "CASE WHEN o_orderkey % 5 = 0 THEN 'count' ELSE 'sum' END"),
          ("group_by", "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'c_mktsegment' END"),
          ("distinct", "o_orderkey % 9 = 0"), ("where", "o_orderkey % 10 <> 0"),
          ("limit", "CAST(CASE WHEN o_orderkey % 12 = 0 THEN 1 END AS INT)"),
          ("n_select", "CAST(CASE WHEN o_orderkey % 14 = 0 THEN 3 ELSE 2 END AS INT)"),
          ("parsed", "o_orderkey % 89 <> 0")],
}
PAIRS = [("'orders'", "'customer'", "o_orderkey % 4 IN (0, 2)"), ("'orders'", "'nation'", "o_orderkey % 4 = 2"),
         ("'orders'", "'lineitem'", "o_orderkey % 4 = 3")]


def _features(spark, sf_dir):
    return Tables(spark, sf_dir).orders.selectExpr(*[f"{e} AS {n}" for n, e in FEATURES])


def _union(spark, sf_dir, items, out_col):
    """One scan of orders: every rule that holds contributes one (query_id, value) row."""
    o = Tables(spark, sf_dir).orders
    vals = F.array(*[F.when(F.expr(cond), F.expr(e)) for e, cond in items])
    return o.select(F.col("o_orderkey").alias("query_id"), _db().alias("db_id"), F.explode(F.filter(vals, lambda x: x.isNotNull())).alias(out_col))


def _db():
    """The query's db comes from the data: seven databases that share table names."""
    return F.concat(F.lit("db"), (F.col("o_custkey") % N_DBS).cast("string"))


def _allowed(spark, sf_dir):
    """Every db has the catalog's tables, but the odd ones lack ``customer``."""
    t = Tables(spark, sf_dir)
    tables = C.catalog_tables(C.catalog_from_frames(spark, DB, {n: getattr(t, n) for n in TABLES})).select("table_name")
    dbs = F.explode(F.array(*[F.struct(F.lit(f"db{k}").alias("db_id"), F.lit(k % 2 == 1).alias("odd")) for k in range(N_DBS)]))
    return tables.select("table_name", dbs.alias("d")).where("NOT (d.odd AND table_name = 'customer')").select("d.db_id", "table_name")


def _refs(spark, sf_dir):
    return G.references_minus_ctes(_union(spark, sf_dir, REFS, "table_name"), _union(spark, sf_dir, CTES, "cte_name"))


def audit_guard(spark, sf_dir):
    return G.guard(_features(spark, sf_dir))


def audit_refs(spark, sf_dir):
    return _refs(spark, sf_dir).select("query_id", "table_name")


def audit_scope(spark, sf_dir):
    return G.table_scope(_refs(spark, sf_dir), _allowed(spark, sf_dir))


def audit_guard_scoped(spark, sf_dir):
    return G.guard_with_scope(_features(spark, sf_dir), G.table_scope(_refs(spark, sf_dir), _allowed(spark, sf_dir)))


def audit_soundness(spark, sf_dir):
    return G.soundness(_features(spark, sf_dir))


NULLABLE_CUSTOMER = [
    ("c_custkey", "c_custkey"),
    ("c_acctbal", "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END"),
    ("c_mktsegment", "nullif(c_mktsegment, 'BUILDING')"),
    ("c_nationkey", "c_nationkey"),
]


def _customer_nullable(spark, sf_dir):
    return Tables(spark, sf_dir).customer.selectExpr(*[f"{e} AS {n}" for n, e in NULLABLE_CUSTOMER])


def audit_null_hazard(spark, sf_dir):
    return G.null_order_hazard(_customer_nullable(spark, sf_dir), "customer")


def audit_safe_topk(spark, sf_dir):
    return G.safe_top_k(_customer_nullable(spark, sf_dir), "c_acctbal", 5, ["c_custkey"]).select("c_custkey", "c_acctbal")


def audit_extreme_per_nation(spark, sf_dir):
    return G.extreme_rows(_customer_nullable(spark, sf_dir), "c_acctbal", "max", ["c_nationkey"]).select(
        "c_nationkey", "c_custkey", "c_acctbal")


def audit_extreme_min(spark, sf_dir):
    return G.extreme_rows(Tables(spark, sf_dir).part, "p_size", "min").select("p_partkey", "p_size")


def audit_first_extreme(spark, sf_dir):
    return G.first_extreme_row(Tables(spark, sf_dir).part.select("p_partkey", "p_size"), "p_size", "p_partkey", "max")


def _shapes(spark, sf_dir, side):
    o = Tables(spark, sf_dir).orders
    df = o.selectExpr("o_orderkey AS question_id", *[f"{e} AS {n}" for n, e in SHAPES[side]])
    return df.withColumn("tables", F.split("tables", ","))


def _tags(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    # Every db has the FK edges that are found in the data.
    pair_vals = F.array(*[F.when(F.expr(cond), F.struct(F.expr(a).alias("a"), F.expr(b).alias("b"))) for a, b, cond in PAIRS])
    pairs = o.select(
        F.col("o_orderkey").alias("query_id"), _db().alias("db_id"),
        F.inline(F.filter(pair_vals, lambda x: x.isNotNull())),
    )
    edges = found_keys(spark, sf_dir).select(F.explode(F.array(*[F.lit(f"db{k}") for k in range(N_DBS)])).alias("db_id"), F.col("child").alias("a"), F.col("parent").alias("b"))
    spurious = G.spurious_joins(pairs, edges)
    return G.categorize(_shapes(spark, sf_dir, "g"), _shapes(spark, sf_dir, "c"), spurious)


def _failures(spark, sf_dir):
    results = M.case_results(fx.v_runs(Tables(spark, sf_dir)))
    failed = results.filter(~F.col("correct")).select(
        F.col("case_id").alias("question_id"), "db_id", "difficulty", "terminal_state", "error")
    return failed.join(_tags(spark, sf_dir), "question_id")


def audit_taxonomy(spark, sf_dir):
    return _tags(spark, sf_dir).select("question_id", F.array_join("tags", ",").alias("tags"))


def _cases(t):
    """One question and gold query per order."""
    o = t.orders
    k = F.col("o_orderkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("question_id"), F.concat(F.lit("What does customer "), F.col("o_custkey").cast("string"), F.lit(" owe for order "), k, F.lit("?")).alias("question"),
        F.concat(F.lit("SELECT sum(o_totalprice) FROM orders WHERE o_orderkey = "), k).alias("gold_sql"),
    )


def _answers(t):
    """The candidate query of every run, and what the comparator said of it."""
    runs = fx.v_runs(t)
    results = M.case_results(runs).withColumnRenamed("case_id", "question_id")
    asked = t.orders.select(
        F.col("o_orderkey").alias("question_id"),
        F.when(F.col("o_orderkey") % 17 != 0, F.concat(F.lit("SELECT o_totalprice FROM orders WHERE o_custkey = "), F.col("o_custkey").cast("string"))).alias("candidate_sql"))
    said = F.when(F.col("guard_rejected"), F.lit("rejected by the guard")).when(F.col("error").isNotNull(), F.col("error")).when(~F.col("correct"), F.lit("result sets differ"))
    return results.join(asked, "question_id").withColumn("note", said)


def audit_failure_records(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = G.failure_records(_answers(t), _cases(t), _tags(spark, sf_dir))
    return found.withColumn("tags", F.array_join("tags", ","))


def audit_tag_counts(spark, sf_dir):
    genuine = _failures(spark, sf_dir).filter(F.col("error").isNull())
    return G.tag_counts(genuine)


def audit_top_tags(spark, sf_dir):
    genuine = _failures(spark, sf_dir).filter(F.col("error").isNull())
    return G.tag_counts(genuine, 5)


def audit_fanout(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = G.join_fanout(t.lineitem, t.orders, "l_orderkey", "o_orderkey").withColumn("join_name", F.lit("lineitem-orders"))
    b = G.join_fanout(t.orders, t.customer, "o_custkey", "c_custkey").withColumn("join_name", F.lit("orders-customer"))
    c = G.join_fanout(t.lineitem, t.lineitem, "l_partkey", "l_partkey").withColumn("join_name", F.lit("lineitem-self-part"))
    u = a.unionByName(b).unionByName(c)
    return u.select("join_name", "join_rows", (F.col("join_rows") > 1_000_000).alias("over_budget"))


# Joins whose size is bounded by sketches before any is counted.
BUDGETED = (
    ("lineitem-orders", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("orders-customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("customer-nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier-customer", "supplier", "s_nationkey", "customer", "c_nationkey"),
    ("lineitem-self-part", "lineitem", "l_partkey", "lineitem", "l_partkey"),
    ("orders-self-status", "orders", "o_orderstatus", "orders", "o_orderstatus"),
)
ROWS_BUDGET = 1_000_000


def audit_join_budgets(spark, sf_dir):
    """G11 over many joins: which are over the budget, counted exactly only where a sketch cannot rule it out."""
    t = Tables(spark, sf_dir)
    names = {x for _, a, _, c, _ in BUDGETED for x in (a, c)}
    found = SK.join_budgets({n: getattr(t, n) for n in names}, BUDGETED, ROWS_BUDGET)
    return found.select("join_name", F.when(F.col("over_budget"), F.col("join_rows")).alias("join_rows"), "over_budget")


def _detected(spark, sf_dir):
    return G.guard(_features(spark, sf_dir), ["expected_verdict", "expected_rule"]).select(
        "query_id", "expected_verdict", "expected_rule", F.col("decision").alias("actual_verdict"),
        F.col("rule").alias("actual_rule"))


def audit_redteam(spark, sf_dir):
    return G.detector_report(_detected(spark, sf_dir))


def audit_redteam_mismatches(spark, sf_dir):
    return G.detector_mismatches(_detected(spark, sf_dir))


def audit_false_positive(spark, sf_dir):
    s = G.soundness(_features(spark, sf_dir), ["expected_sound"])
    return s.agg(
        F.count_if((F.col("expected_sound") == "flag") & F.col("flagged")).cast("long").alias("caught"),
        F.count_if(F.col("expected_sound") == "flag").cast("long").alias("n_flag"),
        F.count_if((F.col("expected_sound") == "pass") & F.col("flagged")).cast("long").alias("false_positives"),
        F.count_if(F.col("expected_sound") == "pass").cast("long").alias("n_pass"),
    ).withColumn("fp_rate", F.when(F.col("n_pass") > 0, F.col("false_positives") / F.col("n_pass")).otherwise(F.lit(0.0)))


def _lift_sides(spark, sf_dir):
    runs = fx.v_runs(Tables(spark, sf_dir))
    tags = _tags(spark, sf_dir)

    def side(r):
        return r.select(F.col("case_id").alias("question_id"), "correct", F.col("retrieval_recall").alias("recall")).join(tags, "question_id", "left")

    return side(M.case_results(runs)), side(M.case_results(fx.v_head(runs)))


def audit_ab_lift(spark, sf_dir):
    return G.ab_lift(*_lift_sides(spark, sf_dir))


def audit_ab_lift_uneven(spark, sf_dir):
    """The second batch lacks every tenth case: totals differ."""
    base, head = _lift_sides(spark, sf_dir)
    return G.ab_lift(base, head.where("question_id % 10 <> 0"))


QUERIES = {
    "audit_guard": audit_guard,
    "audit_refs": audit_refs,
    "audit_scope": audit_scope,
    "audit_guard_scoped": audit_guard_scoped,
    "audit_soundness": audit_soundness,
    "audit_null_hazard": audit_null_hazard,
    "audit_safe_topk": audit_safe_topk,
    "audit_extreme_per_nation": audit_extreme_per_nation,
    "audit_extreme_min": audit_extreme_min,
    "audit_first_extreme": audit_first_extreme,
    "audit_taxonomy": audit_taxonomy,
    "audit_failure_records": audit_failure_records,
    "audit_tag_counts": audit_tag_counts,
    "audit_top_tags": audit_top_tags,
    "audit_fanout": audit_fanout,
    "audit_join_budgets": audit_join_budgets,
    "audit_redteam": audit_redteam,
    "audit_redteam_mismatches": audit_redteam_mismatches,
    "audit_ab_lift_uneven": audit_ab_lift_uneven,
    "audit_false_positive": audit_false_positive,
    "audit_ab_lift": audit_ab_lift,
}

# ---------------------------------------------------------------- oracle SQL
_F = "f AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FEATURES) + " FROM orders)"

_GUARD = """g AS (SELECT query_id,
  CASE WHEN sql_empty THEN 'allow' WHEN NOT parsed THEN 'reject' WHEN write_kind IS NOT NULL THEN 'reject'
       WHEN write_command IS NOT NULL THEN 'reject' WHEN n_statements > 1 THEN 'reject' WHEN meta_command IS NOT NULL THEN 'reject'
       WHEN unknown_command IS NOT NULL THEN 'reject' WHEN unconstrained_join AND NOT has_where THEN 'reject'
       WHEN n_joins > 4 THEN 'reject' WHEN bare_star_scan THEN 'reject' ELSE 'allow' END AS decision,
  CASE WHEN sql_empty THEN NULL WHEN NOT parsed THEN 'parse_error' WHEN write_kind IS NOT NULL THEN 'read_only'
       WHEN write_command IS NOT NULL THEN 'read_only' WHEN n_statements > 1 THEN 'dangerous_op'
       WHEN meta_command IS NOT NULL THEN 'dangerous_op' WHEN unknown_command IS NOT NULL THEN 'dangerous_op'
       WHEN unconstrained_join AND NOT has_where THEN 'cost' WHEN n_joins > 4 THEN 'cost' WHEN bare_star_scan THEN 'cost' END AS rule,
  CASE WHEN sql_empty THEN NULL
       WHEN NOT parsed THEN 'candidate did not parse under the named or generic dialect'
       WHEN write_kind IS NOT NULL THEN write_kind || ' mutates data or schema; the gate is read-only'
       WHEN write_command IS NOT NULL THEN write_command || ' writes data; the gate is read-only'
       WHEN n_statements > 1 THEN n_statements || ' statements in one candidate; stacked queries are not permitted'
       WHEN meta_command IS NOT NULL THEN meta_command || ' is a side-effecting meta-command; not permitted'
       WHEN unknown_command IS NOT NULL THEN unknown_command || ' is an unsupported/side-effecting command; not permitted'
       WHEN unconstrained_join AND NOT has_where THEN 'join with no ON/USING predicate and no WHERE; this is a cartesian product'
       WHEN n_joins > 4 THEN n_joins || ' joins exceeds the complexity budget of 4'
       WHEN bare_star_scan THEN 'SELECT * with no WHERE or LIMIT; this is an unbounded full scan' END AS reason
FROM f)"""

_REFS_SQL = "refs AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS query_id, lower({e}) AS table_name FROM orders WHERE {c}" for e, c in REFS
) + ") r WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = r.query_id AND " + " AND ".join(
    f"({c}) AND lower({e}) = r.table_name" for e, c in CTES) + "))"

_ALLOWED = "allowed(db_id, table_name) AS (VALUES " + ", ".join(
    f"('db{k}', '{t}')" for k in range(N_DBS) for t in sorted(STAR_SCHEMA) if not (k % 2 == 1 and t == "customer")) + ")"

_SCOPE = f"""scope AS (SELECT query_id, string_agg(DISTINCT table_name, ', ' ORDER BY table_name) AS out_of_scope
  FROM refs JOIN orders ON o_orderkey = query_id
  WHERE ('db' || (o_custkey % {N_DBS}), table_name) NOT IN (SELECT db_id, table_name FROM allowed) GROUP BY query_id)"""

_SOUND = """s AS (SELECT query_id,
  CASE WHEN min_col IS NOT NULL AND NOT min_guarded THEN 'null_ordering'
       WHEN asc_limit_col IS NOT NULL AND NOT asc_limit_guarded THEN 'null_ordering'
       WHEN eq_subquery_agg IS NOT NULL THEN 'minmax_subquery' WHEN n_concat_cols >= 2 THEN 'field_catenation' END AS rule,
  CASE WHEN min_col IS NOT NULL AND NOT min_guarded THEN 'min(' || min_col || ') without a NOT NULL guard on ' || min_col
            || ': a NULL sorts first, so the minimum can be NULL-driven and wrong'
       WHEN asc_limit_col IS NOT NULL AND NOT asc_limit_guarded THEN 'ORDER BY ' || asc_limit_col
            || ' ASC with LIMIT and no NOT NULL guard on ' || asc_limit_col
            || ': a NULL sorts first, so the top row can be NULL-driven and wrong'
       WHEN eq_subquery_agg IS NOT NULL THEN '= (SELECT ' || eq_subquery_agg || '(…) …) selects a row by matching a scalar '
            || eq_subquery_agg || ' subquery; ORDER BY … LIMIT 1 is the idiomatic form'
       WHEN n_concat_cols >= 2 THEN 'projection concatenates distinct fields (' || concat_cols
            || '); the question likely wants them returned as separate columns' END AS reason,
  expected_sound
FROM f)"""

_CN = "cn AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in NULLABLE_CUSTOMER) + " FROM customer)"


def _shape_sql(side: str) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in SHAPES[side])
    return f"{side}s AS (SELECT o_orderkey AS question_id, {cols} FROM orders)"


_EDGES = "edges(a, b) AS (VALUES " + ", ".join(f"('{a}', '{d}')" for a, _, _, d in EXPECTED_FKS) + ")"
_PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS query_id, {a} AS a, {b} AS b FROM orders WHERE {c}" for a, b, c in PAIRS) + ")"
_SPUR = """spur AS (SELECT DISTINCT query_id FROM pairs p WHERE NOT EXISTS (
  SELECT 1 FROM edges e WHERE least(e.a, e.b) = least(p.a, p.b) AND greatest(e.a, e.b) = greatest(p.a, p.b)))"""
_TAGS = """tg AS (
  SELECT g.question_id,
    list_filter([
      CASE WHEN g.tables <> c.tables THEN 'table_mismatch' END,
      CASE WHEN len(list_filter(string_split(g.tables, ','), lambda x: NOT list_contains(string_split(c.tables, ','), x))) > 0
           THEN 'missing_table' END,
      CASE WHEN len(list_filter(string_split(c.tables, ','), lambda x: NOT list_contains(string_split(g.tables, ','), x))) > 0
           THEN 'extra_table' END,
      CASE WHEN g.n_joins IS DISTINCT FROM c.n_joins THEN 'join_mismatch' END,
      CASE WHEN sp.query_id IS NOT NULL THEN 'spurious_join' END,
      CASE WHEN g.aggs IS DISTINCT FROM c.aggs THEN 'aggregate_mismatch' END,
      CASE WHEN g.group_by IS DISTINCT FROM c.group_by THEN 'group_by_mismatch' END,
      CASE WHEN g.distinct IS DISTINCT FROM c.distinct THEN 'distinct_mismatch' END,
      CASE WHEN g."where" IS DISTINCT FROM c."where" THEN 'where_mismatch' END,
      CASE WHEN g."limit" IS DISTINCT FROM c."limit" THEN 'limit_mismatch' END,
      CASE WHEN g.n_select IS DISTINCT FROM c.n_select THEN 'projection_count_mismatch' END], lambda x: x IS NOT NULL) AS found,
    g.parsed AS gp, c.parsed AS cp
  FROM gs g JOIN cs c ON c.question_id = g.question_id LEFT JOIN spur sp ON sp.query_id = g.question_id),
tags AS (SELECT question_id, CASE WHEN NOT cp THEN 'candidate_unparseable' WHEN NOT gp THEN 'gold_unparseable'
                                  WHEN len(found) = 0 THEN 'shape_matches_value_level' ELSE array_to_string(found, ',') END AS tags
         FROM tg)"""
_TAX = ",\n".join([_shape_sql("g"), _shape_sql("c"), _EDGES, _PAIRS, _SPUR, _TAGS])
_FAIL = with_views(V_RUNS, V_RESULTS).rstrip() + ",\n" + _TAX + """,
fails AS (SELECT r.case_id AS question_id, r.db_id, r.difficulty, r.terminal_state, r.error, t.tags
          FROM v_results r JOIN tags t ON t.question_id = r.case_id WHERE NOT r.correct)
"""

_FANOUT = """SELECT join_name, join_rows, join_rows > 1000000 AS over_budget FROM (SELECT join_name, join_rows::DECIMAL(38,0) AS join_rows FROM (
  SELECT 'lineitem-orders' AS join_name, (SELECT sum(a.n * b.n) FROM (SELECT l_orderkey k, count(*) n FROM lineitem GROUP BY 1) a
     JOIN (SELECT o_orderkey k, count(*) n FROM orders GROUP BY 1) b ON a.k = b.k)::BIGINT AS join_rows
  UNION ALL SELECT 'orders-customer', (SELECT sum(a.n * b.n) FROM (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1) a
     JOIN (SELECT c_custkey k, count(*) n FROM customer GROUP BY 1) b ON a.k = b.k)::BIGINT
  UNION ALL SELECT 'lineitem-self-part', (SELECT sum(a.n * a.n) FROM (SELECT l_partkey k, count(*) n FROM lineitem GROUP BY 1) a)::BIGINT))"""

_LIFT_SIDE = """(SELECT count(*) AS total, count(*) FILTER (WHERE correct) AS correct,
   count(*) FILTER (WHERE NOT correct AND (contains(',' || t.tags || ',', ',table_mismatch,')
                                          OR contains(',' || t.tags || ',', ',join_mismatch,'))) AS jb
 FROM (SELECT case_id, NOT guard_rejected AND error IS NULL AND {mg} AS correct FROM v_runs WHERE {of}) r
 LEFT JOIN tags t ON t.question_id = r.case_id)"""

def _lift_sql(head: str) -> str:
    return with_views(V_RUNS, V_RESULTS).rstrip() + ",\n" + _TAX + f""",
a AS {_LIFT_SIDE.format(mg="matches_gold", of="true")},
b AS {_LIFT_SIDE.format(mg="CASE WHEN case_id % 29 = 0 THEN NOT matches_gold ELSE matches_gold END", of=head)}
SELECT a.correct::BIGINT AS a_correct, b.correct::BIGINT AS b_correct,
       round(b.correct / b.total - a.correct / a.total, 9) AS lift,
       CASE WHEN b.correct / b.total - a.correct / a.total > 0 THEN 'lift'
            WHEN b.correct / b.total - a.correct / a.total >= -0.02 THEN 'flat' ELSE 'regression' END AS verdict,
       a.jb::BIGINT AS a_join_bucket, b.jb::BIGINT AS b_join_bucket,
       CASE WHEN b.jb < a.jb THEN 'shrank' WHEN b.jb > a.jb THEN 'grew' ELSE 'held' END AS bucket,
       n_with_recall, round(mr, 9) AS recall, round(1 - mr, 9) AS missed_recall
FROM a, b, (SELECT count(retrieval_recall)::BIGINT AS n_with_recall, avg(retrieval_recall) AS mr FROM v_results WHERE {head})"""


ORACLES = {
    "audit_guard": f"WITH {_F}, {_GUARD} SELECT * FROM g",
    "audit_refs": f"WITH {_REFS_SQL} SELECT query_id, table_name FROM refs",
    "audit_scope": f"WITH {_REFS_SQL}, {_ALLOWED}, {_SCOPE} SELECT query_id, out_of_scope, "
                   "'references table(s) outside this db''s scope: ' || out_of_scope AS reason FROM scope",
    "audit_guard_scoped": f"""WITH {_F}, {_GUARD}, {_REFS_SQL}, {_ALLOWED}, {_SCOPE}
SELECT g.query_id,
  CASE WHEN g.decision = 'allow' AND s.out_of_scope IS NOT NULL AND NOT f.sql_empty THEN 'reject' ELSE g.decision END AS decision,
  CASE WHEN g.decision = 'allow' AND s.out_of_scope IS NOT NULL AND NOT f.sql_empty THEN 'table_scope' ELSE g.rule END AS rule,
  CASE WHEN g.decision = 'allow' AND s.out_of_scope IS NOT NULL AND NOT f.sql_empty
       THEN 'references table(s) outside this db''s scope: ' || s.out_of_scope ELSE g.reason END AS reason
FROM g JOIN f ON f.query_id = g.query_id LEFT JOIN scope s ON s.query_id = g.query_id""",
    "audit_soundness": f"WITH {_F}, {_SOUND} SELECT query_id, rule IS NOT NULL AS flagged, rule, reason FROM s",
    "audit_null_hazard": f"WITH {_CN} " + " UNION ALL ".join(
        f"SELECT 'customer' AS table_name, '{n}' AS column_name, count(*) FILTER (WHERE {n} IS NULL)::BIGINT AS n_null, "
        f"count(*) FILTER (WHERE {n} IS NULL) > 0 AS first_asc_is_null FROM cn" for n, _ in NULLABLE_CUSTOMER),
    "audit_safe_topk": f"WITH {_CN} SELECT c_custkey, c_acctbal FROM cn ORDER BY c_acctbal ASC NULLS LAST, c_custkey LIMIT 5",
    "audit_extreme_per_nation": f"""WITH {_CN}
SELECT c.c_nationkey, c.c_custkey, c.c_acctbal FROM cn c
JOIN (SELECT c_nationkey, max(c_acctbal) AS m FROM cn GROUP BY 1) x ON x.c_nationkey = c.c_nationkey AND c.c_acctbal = x.m""",
    "audit_extreme_min": "SELECT p_partkey, p_size FROM part WHERE p_size = (SELECT min(p_size) FROM part)",
    "audit_first_extreme": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey ASC LIMIT 1",
    "audit_taxonomy": f"WITH {_TAX} SELECT question_id, tags FROM tags",
    "audit_failure_records": _FAIL.rstrip() + """,
given AS (SELECT case_id, guard_rejected FROM v_runs)
SELECT f.question_id, f.db_id, f.difficulty, f.terminal_state, f.tags,
  'What does customer ' || o.o_custkey || ' owe for order ' || o.o_orderkey || '?' AS question,
  'SELECT sum(o_totalprice) FROM orders WHERE o_orderkey = ' || o.o_orderkey AS gold_sql,
  CASE WHEN o.o_orderkey % 17 <> 0 THEN 'SELECT o_totalprice FROM orders WHERE o_custkey = ' || o.o_custkey END AS candidate_sql,
  CASE WHEN g.guard_rejected THEN 'rejected by the guard' WHEN f.error IS NOT NULL THEN f.error ELSE 'result sets differ' END AS comparator_reason
FROM fails f JOIN orders o ON o.o_orderkey = f.question_id JOIN given g ON g.case_id = f.question_id""",
    "audit_tag_counts": _FAIL + """SELECT tag, count(*)::BIGINT AS n FROM (
  SELECT unnest(string_split(tags, ',')) AS tag FROM fails WHERE error IS NULL) GROUP BY tag""",
    "audit_top_tags": _FAIL + """SELECT tag, count(*)::BIGINT AS n FROM (
  SELECT unnest(string_split(tags, ',')) AS tag FROM fails WHERE error IS NULL) GROUP BY tag ORDER BY n DESC, tag LIMIT 5""",
    "audit_fanout": _FANOUT,
    "audit_join_budgets": "SELECT join_name, CASE WHEN n > 1000000 THEN n END AS join_rows, n > 1000000 AS over_budget FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS join_name, (SELECT sum(a.n::HUGEINT * b.n) FROM (SELECT {b} k, count(*) n FROM {a} GROUP BY 1) a "
        f"JOIN (SELECT {d} k, count(*) n FROM {c} GROUP BY 1) b ON a.k = b.k)::DECIMAL(38,0) AS n" for name, a, b, c, d in BUDGETED) + ")",
    "audit_redteam": f"""WITH {_F}, {_GUARD}
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE expected_verdict = 'reject')::BIGINT AS n_dangerous,
       count(*) FILTER (WHERE expected_verdict = 'reject' AND decision = 'reject')::BIGINT AS n_caught,
       CASE WHEN count(*) FILTER (WHERE expected_verdict = 'reject') > 0
            THEN count(*) FILTER (WHERE expected_verdict = 'reject' AND decision = 'reject')
                 / count(*) FILTER (WHERE expected_verdict = 'reject') ELSE 0.0 END AS catch_rate,
       count(*) FILTER (WHERE decision = expected_verdict AND (expected_rule IS NULL OR expected_rule IS NOT DISTINCT FROM rule))::BIGINT
         AS n_agree,
       bool_and(decision = expected_verdict) AS all_verdicts_match,
       bool_and(expected_rule IS NULL OR expected_rule IS NOT DISTINCT FROM rule) AS all_rules_match
FROM g JOIN f ON f.query_id = g.query_id""",
    "audit_redteam_mismatches": f"""WITH {_F}, {_GUARD}
SELECT query_id, expected_verdict, expected_rule, decision AS actual_verdict, rule AS actual_rule,
       CASE WHEN decision <> expected_verdict THEN 'verdict' ELSE 'rule' END AS mismatch
FROM g JOIN f USING (query_id)
WHERE NOT (decision = expected_verdict AND (expected_rule IS NULL OR expected_rule IS NOT DISTINCT FROM rule))""",
    "audit_false_positive": f"""WITH {_F}, {_SOUND}
SELECT count(*) FILTER (WHERE expected_sound = 'flag' AND rule IS NOT NULL)::BIGINT AS caught,
       count(*) FILTER (WHERE expected_sound = 'flag')::BIGINT AS n_flag,
       count(*) FILTER (WHERE expected_sound = 'pass' AND rule IS NOT NULL)::BIGINT AS false_positives,
       count(*) FILTER (WHERE expected_sound = 'pass')::BIGINT AS n_pass,
       CASE WHEN count(*) FILTER (WHERE expected_sound = 'pass') > 0
            THEN count(*) FILTER (WHERE expected_sound = 'pass' AND rule IS NOT NULL) / count(*) FILTER (WHERE expected_sound = 'pass')
            ELSE 0.0 END AS fp_rate
FROM s""",
    "audit_ab_lift": _lift_sql("true"),
    "audit_ab_lift_uneven": _lift_sql("case_id % 10 <> 0"),
}
