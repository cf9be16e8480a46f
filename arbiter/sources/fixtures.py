"""Test-data bindings: question/answer/run tables derived from the star schema.

The test data has no answer tables, so these views derive them by fixed rules
from the given tables (every rule uses every row: modulo arithmetic only picks
a variant, never drops rows).  ``arbiter.plans.sqlviews`` repeats the same
derivations as SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.operators.order import dense_position
from arbiter.session import stable
from arbiter.sources.tables import Tables

# Fixed values of the derivations.
N_GOLD_QUESTIONS = 50
MODELS = ("p/alpha", "beta", "openrouter/x/gamma")


def v_gold(t: Tables) -> DataFrame:
    """Gold result rows: 50 questions over lineitem, positioned by a total order."""
    li = t.lineitem.select(
        (F.col("l_orderkey") % N_GOLD_QUESTIONS).alias("question_id"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("c0"),
        F.col("l_returnflag").alias("c1"),
        F.col("l_extendedprice").alias("c2"),
        "l_suppkey",
    )
    pos = dense_position(li, ["question_id"], ["l_orderkey", "l_linenumber", "c0", "l_suppkey", "c2"])
    return pos.select("question_id", "row_pos", "c0", "c1", "c2")


_GOLD: dict = {}


def v_gold_stable(t: Tables) -> DataFrame:
    """``v_gold`` materialized once per (application, data folder) in the checkpoint folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _GOLD:
        _GOLD[key] = stable(v_gold(t))
    return _GOLD[key]


def v_gold_questions(gold: DataFrame) -> DataFrame:
    """One row per gold question; every third declares its order significant."""
    return gold.select("question_id").distinct().withColumn("order_significant", F.col("question_id") % 3 == 0)


def v_cand(gold: DataFrame) -> DataFrame:
    """Candidate result rows by question_id % 5.

    0 identical; 1 c2 + 1e-9 (precision noise); 2 first row duplicated in front;
    3 rows in reverse order; 4 first row missing.
    """
    v = F.col("question_id") % 5
    sizes = gold.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"))
    base = gold.join(sizes, "question_id")
    kept = base.filter((v != 4) | (F.col("row_pos") > 1)).select(
        "question_id",
        F.when(v == 2, F.col("row_pos") + 1)
        .when(v == 3, F.col("_n") + 1 - F.col("row_pos"))
        .when(v == 4, F.col("row_pos") - 1)
        .otherwise(F.col("row_pos"))
        .alias("row_pos"),
        "c0",
        "c1",
        F.when(v == 1, F.col("c2") + F.lit(1e-9)).otherwise(F.col("c2")).alias("c2"),
    )
    dup = gold.filter((v == 2) & (F.col("row_pos") == 1)).select("question_id", "row_pos", "c0", "c1", "c2")
    return kept.unionByName(dup)


def v_candidate_rows(gold: DataFrame, cand: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four candidates per gold question: (candidates, rows).

    idx 0 and 1 repeat the gold rows, idx 2 is ``v_cand``, idx 3 drops the
    first gold row and is errored (no result) when question_id % 6 = 0.
    """
    cols = ["question_id", "idx", "row_pos", "c0", "c1", "c2"]
    g0 = gold.withColumn("idx", F.lit(0)).select(cols)
    g1 = gold.withColumn("idx", F.lit(1)).select(cols)
    c2 = cand.withColumn("idx", F.lit(2)).select(cols)
    g3 = (
        gold.filter((F.col("row_pos") > 1) & (F.col("question_id") % 6 != 0))
        .withColumn("idx", F.lit(3))
        .withColumn("row_pos", F.col("row_pos") - 1)
        .select(cols)
    )
    rows = g0.unionByName(g1).unionByName(c2).unionByName(g3)
    candidates = (
        v_gold_questions(gold)
        .select("question_id", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("idx"))
        .withColumn("errored", (F.col("idx") == 3) & (F.col("question_id") % 6 == 0))
    )
    return candidates, rows


def v_runs(t: Tables) -> DataFrame:
    """One scored run per order (case_id = o_orderkey); see ``sqlviews.V_RUNS``."""
    o = t.orders
    k = F.col("o_orderkey")
    price = F.floor(F.col("o_totalprice")).cast("long")
    return o.select(
        k.alias("case_id"),
        F.concat(F.lit("db"), (F.col("o_custkey") % 7).cast("string")).alias("db_id"),
        F.when(k % 3 == 0, F.lit("anthropic/claude-sonnet-4-6"))
        .when(k % 3 == 1, F.lit("beta"))
        .otherwise(F.lit("openrouter/x/gamma"))
        .alias("model"),
        F.when(k % 13 != 0, F.col("o_orderpriority")).alias("difficulty"),
        (k % 3 + 1).cast("long").alias("attempts"),
        (k % 17 == 0).alias("guard_rejected"),
        F.when(k % 41 == 0, F.lit("provider_error: timeout"))
        .when((F.col("o_orderstatus") == "O") & (k % 5 == 0), F.lit("no such table: ghost"))
        .alias("error"),
        (F.col("o_orderstatus") == "F").alias("matches_gold"),
        (price % 4000).alias("input_tokens"),
        (price % 700).alias("output_tokens"),
        (price % 10000).cast("double").alias("latency_ms"),
        F.when((k % 3 == 2) & (k % 4 != 0), (price % 1000).cast("double") / 4).alias("provider_cost_usd"),
        F.when(k % 11 == 0, F.lit(None).cast("array<string>"))
        .when(k % 3 == 0, F.array(F.lit("ORDERS"), F.lit("nation")))
        .when(k % 3 == 1, F.array(F.lit("lineitem"), F.lit("Customer"), F.lit("orders")))
        .otherwise(F.array().cast("array<string>"))
        .alias("retrieved_tables"),
        F.when(k % 2 == 0, F.array(F.lit("orders"), F.lit("customer")))
        .when(k % 7 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("lineitem")))
        .alias("gold_tables"),
        F.col("o_orderdate").alias("started_at"),
    )


def v_head(runs: DataFrame) -> DataFrame:
    """A second batch on the same cases: the verdict flips where case_id % 29 = 0."""
    return runs.withColumn(
        "matches_gold", F.when(F.col("case_id") % 29 == 0, ~F.col("matches_gold")).otherwise(F.col("matches_gold"))
    )


def v_bindings(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Literal bindings of one query per customer: (bindings, aliases, query_tables).

    column = c_name when key % 3 = 0 else c_mktsegment, qualified by alias ``c``
    when key is even; literal = 'nowhere' when key % 7 = 0, else the customer's
    segment (lower-cased when key % 4 = 0); orders joins in when key % 5 = 0.
    A second binding asks for the customer's own key in ``orders.o_custkey``,
    so it is off-column exactly for customers without orders.
    """
    c = t.customer
    k = F.col("c_custkey")
    bindings = c.select(
        k.alias("query_id"),
        F.lit(1).alias("binding_id"),
        F.when(k % 2 == 0, F.lit("c")).alias("qualifier"),
        F.when(k % 3 == 0, F.lit("c_name")).otherwise(F.lit("c_mktsegment")).alias("column_name"),
        F.when(k % 7 == 0, F.lit("nowhere"))
        .when(k % 4 == 0, F.lower(F.col("c_mktsegment")))
        .otherwise(F.col("c_mktsegment"))
        .alias("literal"),
    ).unionByName(
        c.select(
            k.alias("query_id"), F.lit(2).alias("binding_id"), F.lit("orders").alias("qualifier"), F.lit("o_custkey").alias("column_name"),
            k.cast("string").alias("literal"),
        )
    )
    aliases = c.filter(k % 2 == 0).select(k.alias("query_id"), F.lit("c").alias("alias"), F.lit("customer").alias("table_name"))
    tables = c.select(k.alias("query_id"), F.lit("customer").alias("table_name")).unionByName(
        c.filter(k % 5 == 0).select(k.alias("query_id"), F.lit("orders").alias("table_name"))
    )
    return bindings, aliases, tables
