"""value_*: value index over every table, and literal steering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arbiter.operators import values as L
from arbiter.sources import fixtures as fx
from arbiter.plans.profile import PROFILED, _txt
from arbiter.session import ensure_checkpoint_dir
from arbiter.sources.tables import TABLES, Tables

PII = ("customer.c_name",)


_INDEX: dict = {}


def _index(spark, sf_dir, redact=()):
    """The value index of every table, built once per (application, data folder, policy) in the checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir, tuple(redact))
    if key not in _INDEX:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/value-index-{uuid.uuid4().hex}"
        t = Tables(spark, sf_dir)
        _INDEX[key] = L.ValueIndex(spark, path).add({n: getattr(t, n) for n in TABLES}, redact)
    return _INDEX[key]


def value_index(spark, sf_dir):
    return _index(spark, sf_dir).pairs()


def value_index_redacted(spark, sf_dir):
    return _index(spark, sf_dir, PII).pairs().groupBy("column_key").agg(F.count(F.lit(1)).cast("long").alias("n_values"))


def value_indexed_columns(spark, sf_dir):
    """Every indexed column key with the number of normalized values it contributed."""
    index = _index(spark, sf_dir)
    n = index.pairs().groupBy("column_key").agg(F.count(F.lit(1)).alias("n_values"))
    return index.columns().join(n, "column_key", "left").select("column_key", F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"))


def value_lookup(spark, sf_dir):
    idx = _index(spark, sf_dir)
    look = Tables(spark, sf_dir).nation.select("n_nationkey", F.col("n_name").alias("value"))
    return L.columns_containing(idx, look).select("n_nationkey", "value", F.array_join("holders", ",").alias("holders"))


def _resolved(spark, sf_dir):
    idx = _index(spark, sf_dir)
    b, a, qt = fx.v_bindings(Tables(spark, sf_dir))
    return L.resolve_bindings(b, a, qt, idx.columns()), idx


def value_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("query_id", "written", "literal", "key")


def value_findings(spark, sf_dir):
    r, idx = _resolved(spark, sf_dir)
    return L.check_literals(r, idx).select(
        "query_id", "literal", "constrained_column", F.array_join("candidate_columns", ",").alias("candidate_columns")
    )


def value_steering(spark, sf_dir):
    r, idx = _resolved(spark, sf_dir)
    return L.steering_message(L.check_literals(r, idx))


QUERIES = {
    "value_index": value_index,
    "value_index_redacted": value_index_redacted,
    "value_indexed_columns": value_indexed_columns,
    "value_lookup": value_lookup,
    "value_resolve": value_resolve,
    "value_findings": value_findings,
    "value_steering": value_steering,
}


def _vals_sql(redact=()) -> str:
    hidden = {r.casefold() for r in redact}
    parts = []
    for t, cols in PROFILED.items():
        for c, kind in cols:
            if f"{t}.{c}" not in hidden and not kind.startswith("array"):
                parts.append(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {_txt(c, kind)} AS v FROM {t} WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


_NORM = "lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g'))"


def _idx_sql(redact=()) -> str:
    return f"""idx AS (
  SELECT DISTINCT CASE WHEN length({_NORM}) > 64 THEN 'sha256:' || sha256({_NORM}) ELSE {_NORM} END AS value_norm, lower(t) || '.' || lower(c) AS column_key
  FROM ({_vals_sql(redact)}))"""


def _keys_sql(redact=()) -> str:
    hidden = {r.casefold() for r in redact}
    rows = [f"('{t}.{c}')" for t, cols in sorted(PROFILED.items()) for c, _ in cols if f"{t}.{c}" not in hidden]
    return "indexed(column_key) AS (VALUES " + ", ".join(rows) + ")"


_BINDINGS = """b AS (
  SELECT c_custkey AS query_id, 1 AS binding_id, CASE WHEN c_custkey % 2 = 0 THEN 'c' END AS qualifier,
         CASE WHEN c_custkey % 3 = 0 THEN 'c_name' ELSE 'c_mktsegment' END AS column_name,
         CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment)
              ELSE c_mktsegment END AS literal
  FROM customer
  UNION ALL SELECT c_custkey, 2, 'orders', 'o_custkey', CAST(c_custkey AS VARCHAR) FROM customer),
qt AS (SELECT c_custkey AS query_id, 'customer' AS table_name FROM customer
       UNION ALL SELECT c_custkey, 'orders' FROM customer WHERE c_custkey % 5 = 0),
res0 AS (
  SELECT query_id, binding_id, qualifier || '.' || column_name AS written, literal,
         CASE qualifier WHEN 'c' THEN 'customer' ELSE qualifier END || '.' || lower(column_name) AS key FROM b WHERE qualifier IS NOT NULL
  UNION ALL
  SELECT b.query_id, b.binding_id, b.column_name, b.literal, qt.table_name || '.' || lower(b.column_name)
  FROM b JOIN qt ON qt.query_id = b.query_id WHERE b.qualifier IS NULL),
res AS (SELECT * FROM res0 WHERE key IN (SELECT column_key FROM indexed)),
holders AS (SELECT value_norm, list_sort(list(DISTINCT column_key)) AS holders FROM idx GROUP BY 1),
keys AS (SELECT query_id, binding_id, written, literal, lower(regexp_replace(literal, '^\\s+|\\s+$', '', 'g')) AS v,
                list(DISTINCT key) AS keys,
                bool_or(EXISTS (SELECT 1 FROM idx i WHERE i.value_norm = lower(regexp_replace(literal, '^\\s+|\\s+$', '', 'g'))
                                AND i.column_key = key)) AS on_key
         FROM res GROUP BY ALL),
found AS (
  SELECT k.query_id, k.binding_id, k.literal, k.written AS constrained_column,
         list_sort(list_filter(h.holders, lambda x: NOT list_contains(k.keys, x))) AS cands
  FROM keys k JOIN holders h ON h.value_norm = k.v WHERE NOT k.on_key),
findings AS (
  SELECT query_id, constrained_column, literal, min(binding_id) AS binding_id, array_to_string(min(cands), ',') AS candidate_columns
  FROM found WHERE len(cands) > 0 GROUP BY ALL)"""

_W = "WITH " + _keys_sql() + ",\n" + _idx_sql() + ",\n"

ORACLES = {
    "value_index": _W.rstrip().rstrip(",") + "\nSELECT value_norm, column_key FROM idx",
    "value_index_redacted": "WITH " + _idx_sql(PII) + "\nSELECT column_key, count(*)::BIGINT AS n_values FROM idx GROUP BY 1",
    "value_indexed_columns": _W + """n AS (SELECT column_key, count(*) AS n FROM idx GROUP BY 1)
SELECT i.column_key, coalesce(n.n, 0)::BIGINT AS n_values FROM indexed i LEFT JOIN n ON n.column_key = i.column_key""",
    "value_lookup": _W + """holders AS (SELECT value_norm, list_sort(list(DISTINCT column_key)) AS holders FROM idx GROUP BY 1)
SELECT n.n_nationkey, n.n_name AS value, array_to_string(coalesce(h.holders, []), ',') AS holders
FROM nation n LEFT JOIN holders h ON h.value_norm = lower(regexp_replace(n.n_name, '^\\s+|\\s+$', '', 'g'))""",
    "value_resolve": _W + _BINDINGS + "\nSELECT query_id, written, literal, key FROM res",
    "value_findings": _W + _BINDINGS + "\nSELECT query_id, literal, constrained_column, candidate_columns FROM findings",
    "value_steering": _W + _BINDINGS + """
SELECT query_id, string_agg('The value ''' || literal || ''' does not occur in ' || constrained_column || '; it occurs in '
       || replace(candidate_columns, ',', ', ') || '. Revise the query to constrain one of those columns instead.', ' '
       ORDER BY binding_id) AS message
FROM findings GROUP BY query_id""",
}
