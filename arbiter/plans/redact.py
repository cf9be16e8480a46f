"""redact_*: PII policy from annotated DDL lines and masking of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import catalog as C
from arbiter.operators import redact as D
from arbiter.plans.schema import STAR_SCHEMA
from arbiter.sources.tables import TABLES, Tables

DB = "tpch"


def ddl_lines(spark, sf_dir):
    """Annotated DDL, one line per column, from the tables' own schemas.

    Customer and supplier names are marked PII, account balances PII-adjacent,
    keys are commented as identifiers.
    """
    t = Tables(spark, sf_dir)
    cat = C.catalog_from_frames(spark, DB, {n: getattr(t, n) for n in TABLES})
    comment = (
        F.when(F.col("table_name").isin("customer", "supplier") & F.col("column_name").endswith("_name"), F.lit("  -- PII"))
        .when(F.col("column_name").endswith("_acctbal"), F.lit("  -- PII-adjacent"))
        .when(F.col("column_name").endswith("key"), F.lit("  -- identifier"))
        .otherwise(F.lit(""))
    )
    return cat.select("db_id", "table_name", "column_ordinal",
                      F.concat(F.lit("  "), F.col("column_name"), F.lit(" "), F.col("type"), F.lit(","), comment).alias("line"))


def redact_policy(spark, sf_dir):
    """D1 + D3: PII columns from the annotated DDL, with how many values masking covers in each."""
    pol = D.policy_from_ddl(ddl_lines(spark, sf_dir))
    t = Tables(spark, sf_dir)
    counts = []
    for name in TABLES:
        df = getattr(t, name)
        # One aggregate per table counts every column; the row is then stacked per column.
        agg = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
        counts.append(agg.select(F.inline(F.array(*[
            F.struct(F.lit(c.lower()).alias("pii_column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(df.columns)]))))
    from functools import reduce
    from pyspark.sql import DataFrame
    n = reduce(DataFrame.unionByName, counts).groupBy("pii_column").agg(F.sum("n").cast("long").alias("n_masked"))
    return pol.join(n, "pii_column", "left").select("db_id", "pii_column", F.coalesce("n_masked", F.lit(0)).cast("long").alias("n_masked"))


def _policy(spark, sf_dir) -> set[str]:
    # Schema metadata alone: at most one row per column comes to the driver, and no table is read.
    return {r["pii_column"] for r in D.policy_from_ddl(ddl_lines(spark, sf_dir)).collect()}


def redact_customer(spark, sf_dir):
    return D.redact(Tables(spark, sf_dir).customer, _policy(spark, sf_dir))


def redact_supplier(spark, sf_dir):
    return D.redact(Tables(spark, sf_dir).supplier, _policy(spark, sf_dir))


QUERIES = {
    "redact_policy": redact_policy,
    "redact_customer": redact_customer,
    "redact_supplier": redact_supplier,
}


def _ddl_sql() -> str:
    rows = []
    for name in sorted(STAR_SCHEMA):
        for col, typ in STAR_SCHEMA[name]:
            if name in ("customer", "supplier") and col.endswith("_name"):
                c = "  -- PII"
            elif col.endswith("_acctbal"):
                c = "  -- PII-adjacent"
            elif col.endswith("key"):
                c = "  -- identifier"
            else:
                c = ""
            rows.append(f"('{DB}', '  {col} {typ},{c}')")
    return "ddl(db_id, line) AS (VALUES " + ", ".join(rows) + ")"


ORACLES = {
    "redact_policy": "WITH " + _ddl_sql() + """,
pol AS (SELECT DISTINCT db_id, lower(regexp_extract(split_part(line, '--', 1), '^\\s*(\\S+)', 1)) AS pii_column
        FROM ddl WHERE contains(line, '--')
          AND regexp_matches(substr(line, strpos(line, '--') + 2), '(?i)\\bPII\\b([^-]|$)'))
SELECT db_id, pii_column, (CASE pii_column WHEN 'c_name' THEN (SELECT count(c_name) FROM customer)
                                          WHEN 's_name' THEN (SELECT count(s_name) FROM supplier) ELSE 0 END)::BIGINT AS n_masked
FROM pol""",
    "redact_customer": """SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '‹redacted›' END AS c_name, c_nationkey,
       c_acctbal, c_mktsegment FROM customer""",
    "redact_supplier": """SELECT s_suppkey, CASE WHEN s_name IS NOT NULL THEN '‹redacted›' END AS s_name, s_nationkey,
       s_acctbal FROM supplier""",
}
