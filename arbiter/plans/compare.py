"""cmp_*: result-set comparison over the derived gold/candidate results."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.functions.cells import result_cells
from arbiter.operators import compare as R
from arbiter.plans.sqlviews import V_CAND, V_GOLD, V_GOLD_Q, with_views
from arbiter.sources import fixtures as fx
from arbiter.sources.tables import Tables

OUT = ["question_id", "correct", "reason", "applied_rules", "n_gold_rows", "n_cand_rows"]


def _inputs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gold = fx.v_gold_stable(t)
    return gold, fx.v_cand(gold), fx.v_gold_questions(gold)


def cmp_strict(spark, sf_dir):
    gold, cand, q = _inputs(spark, sf_dir)
    return R.compare_results(gold, cand, q, R.DEFAULT_RULES).select(OUT)


def cmp_lenient(spark, sf_dir):
    gold, cand, q = _inputs(spark, sf_dir)
    return R.compare_results(gold, cand, q, R.LENIENT_RULES).select(OUT)


def cmp_ordered(spark, sf_dir):
    gold, cand, q = _inputs(spark, sf_dir)
    return R.compare_results(gold, cand, q, ("column_position", "exact")).select(OUT)


def cmp_rescore(spark, sf_dir):
    gold, cand, q = _inputs(spark, sf_dir)
    return R.rescore(*R.compare_strict_and_lenient(gold, cand, q))


def cmp_gold_verify(spark, sf_dir):
    gold, _, q = _inputs(spark, sf_dir)
    actual = gold.withColumn("c2", F.col("c2").cast("decimal(15,2)"))
    return R.verify_gold(gold, actual, q, gold.columns[2:], actual.columns[2:], ["c0", "c1", "c2"])


def cmp_gold_verify_changed(spark, sf_dir):
    """Every third question's stored flags come back in other case: these rows must not verify."""
    gold, _, q = _inputs(spark, sf_dir)
    actual = gold.withColumn("c1", F.when(F.col("question_id") % 3 == 0, F.lower("c1")).otherwise(F.col("c1")))
    return R.verify_gold(gold, actual, q, gold.columns[2:], actual.columns[2:], ["c0", "c1", "c2"])


def cmp_gold_verify_renamed(spark, sf_dir):
    """Equal rows under another label: nothing verifies."""
    gold, _, q = _inputs(spark, sf_dir)
    return R.verify_gold(gold, gold, q, gold.columns[2:], ["c0", "c1", "price"], ["c0", "c1", "c2"])


def _mixed(spark, sf_dir):
    """Six questions of one to two columns and different types: (gold, candidate) in one batch of cell arrays."""
    t = Tables(spark, sf_dir)
    high = F.lit("12345678901234567890.12").cast("decimal(22,2)")
    shown = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey"))
    pairs = [
        (t.nation.select("n_name"), t.nation.select("n_name")),
        (t.customer.select("c_custkey", "c_acctbal"), t.customer.select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)"))),
        (t.orders.select((F.col("o_orderkey") + 9007199254740992).alias("k")), t.orders.select((F.col("o_orderkey") + 9007199254740993).cast("decimal(20,0)").alias("k"))),
        (t.part.select("p_partkey", shown.alias("s")), t.part.select(shown.alias("s"), "p_partkey")),
        (t.supplier.select((high + F.col("s_suppkey")).alias("v")), t.supplier.select((high + F.col("s_suppkey") + F.lit("0.05").cast("decimal(3,2)")).alias("v"))),
        (t.region.select("r_regionkey", (F.lit(0.1) + F.lit(0.2)).alias("x")), t.region.select("r_regionkey", F.lit(0.3).alias("x"))),
    ]
    sides = []
    for side in (0, 1):
        frames = [p[side].select(F.lit(i + 1).cast("long").alias("question_id"), F.lit(None).cast("long").alias("row_pos"), result_cells(p[side], p[side].columns).alias("cells")) for i, p in enumerate(pairs)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        sides.append(out)
    return sides[0], sides[1], spark.range(1, len(pairs) + 1).select(F.col("id").alias("question_id"))


def cmp_mixed_width(spark, sf_dir):
    gold, cand, q = _mixed(spark, sf_dir)
    return R.compare_results(gold, cand, q, R.DEFAULT_RULES, gold_values=["cells"], cand_values=["cells"]).select(OUT)


def _segment_frames(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gold = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    )
    cand = spark.sql(
        "SELECT c.c_mktsegment AS segment, sum(o.o_totalprice) + 1e-9 AS value, count(*) AS orders "
        "FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
        customer=t.customer, orders=t.orders,
    )
    return gold, cand


def cmp_pair_multiset(spark, sf_dir):
    gold, cand = _segment_frames(spark, sf_dir)
    return R.compare_frames(gold, cand, R.DEFAULT_RULES)


def cmp_pair_ordered(spark, sf_dir):
    gold, cand = _segment_frames(spark, sf_dir)
    # gold ordered by segment ascending, candidate by value: order significant.
    return R.compare_frames(
        gold, cand, R.DEFAULT_RULES, order_significant=True, gold_order=["c_mktsegment"], cand_order=["value"]
    )


def cmp_score_runs(spark, sf_dir):
    """One run per gold question; rejected (q % 13 = 0) and errored (q % 11 = 0) runs stay unscored."""
    gold, cand, q = _inputs(spark, sf_dir)
    runs = q.select(
        F.col("question_id").alias("case_id"), "question_id",
        (F.col("question_id") % 13 == 0).alias("guard_rejected"),
        F.when(F.col("question_id") % 11 == 0, F.lit("no such table: x")).alias("error"),
        (F.col("question_id") % 2 + 1).alias("attempts"),
    )
    return R.score_runs(runs, R.compare_results(gold, cand, q, R.DEFAULT_RULES))


QUERIES = {
    "cmp_score_runs": cmp_score_runs,
    "cmp_strict": cmp_strict,
    "cmp_lenient": cmp_lenient,
    "cmp_ordered": cmp_ordered,
    "cmp_rescore": cmp_rescore,
    "cmp_gold_verify": cmp_gold_verify,
    "cmp_gold_verify_changed": cmp_gold_verify_changed,
    "cmp_gold_verify_renamed": cmp_gold_verify_renamed,
    "cmp_mixed_width": cmp_mixed_width,
    "cmp_pair_multiset": cmp_pair_multiset,
    "cmp_pair_ordered": cmp_pair_ordered,
}

_VIEWS = with_views(V_GOLD, V_GOLD_Q, V_CAND)


def _sides(round_c2: bool) -> str:
    c2 = "round_even(c2, 6)" if round_c2 else "c2"
    return f""",
g AS (SELECT question_id, row_pos, c0, c1, {c2} AS c2 FROM v_gold),
c AS (SELECT question_id, row_pos, c0, c1, {c2} AS c2 FROM v_cand),
cnt AS (SELECT q.question_id,
               (SELECT count(*) FROM v_gold x WHERE x.question_id = q.question_id) AS n_gold_rows,
               (SELECT count(*) FROM v_cand x WHERE x.question_id = q.question_id) AS n_cand_rows
        FROM v_gold_q q),
ord AS (SELECT coalesce(g.question_id, c.question_id) AS question_id,
               bool_or(g.row_pos IS NULL OR c.row_pos IS NULL OR g.c0 IS DISTINCT FROM c.c0
                       OR g.c1 IS DISTINCT FROM c.c1 OR g.c2 IS DISTINCT FROM c.c2) AS mis
        FROM g FULL OUTER JOIN c ON g.question_id = c.question_id AND g.row_pos = c.row_pos GROUP BY 1),
gm AS (SELECT question_id, c0, c1, c2, count(*) AS n FROM g GROUP BY ALL),
cm AS (SELECT question_id, c0, c1, c2, count(*) AS n FROM c GROUP BY ALL),
ms AS (SELECT coalesce(gm.question_id, cm.question_id) AS question_id,
              bool_or(gm.n IS DISTINCT FROM cm.n) AS mis,
              bool_or(gm.n IS NULL OR cm.n IS NULL) AS set_mis
       FROM gm FULL OUTER JOIN cm ON gm.question_id = cm.question_id AND gm.c0 IS NOT DISTINCT FROM cm.c0
            AND gm.c1 IS NOT DISTINCT FROM cm.c1 AND gm.c2 IS NOT DISTINCT FROM cm.c2 GROUP BY 1)
"""


def _verdict_sql(mis_expr: str, rules: str) -> str:
    return f"""
, v AS (SELECT q.question_id, NOT coalesce({mis_expr}, false) AS correct, cnt.n_gold_rows, cnt.n_cand_rows
       FROM v_gold_q q LEFT JOIN ord ON ord.question_id = q.question_id
       LEFT JOIN ms ON ms.question_id = q.question_id JOIN cnt ON cnt.question_id = q.question_id)
SELECT question_id, correct,
       CASE WHEN correct AND n_gold_rows = 0 THEN 'both result sets empty'
            WHEN correct THEN 'result sets match' ELSE 'result sets differ' END AS reason,
       '{rules}' AS applied_rules, n_gold_rows, n_cand_rows
FROM v"""


_STRICT = _VIEWS.rstrip() + _sides(True) + _verdict_sql(
    "CASE WHEN q.order_significant THEN ord.mis ELSE ms.mis END",
    "column_position,null_sentinel,float_tolerance,order_insensitive,exact",
)
_LENIENT = _VIEWS.rstrip() + _sides(False) + _verdict_sql("ms.set_mis", "column_position,set,exact")
_ORDERED = _VIEWS.rstrip() + _sides(False) + _verdict_sql("ord.mis", "column_position,exact")

_RESCORE = f"""
WITH s AS ({_STRICT}), l AS ({_LENIENT})
SELECT s.question_id, s.correct AS strict_correct, l.correct AS lenient_correct,
       CASE WHEN s.correct THEN 'correct' WHEN l.correct THEN 'scorer_artifact' ELSE 'genuine' END AS rescore_class
FROM s FULL OUTER JOIN l ON s.question_id = l.question_id"""

_GOLD_VERIFY = (
    _VIEWS
    + """SELECT question_id, true AS labels_match, true AS rows_match, true AS verified FROM v_gold_q"""
)

_GOLD_VERIFY_CHANGED = (
    _VIEWS
    + """SELECT question_id, true AS labels_match,
  NOT EXISTS (SELECT 1 FROM v_gold g WHERE g.question_id = q.question_id AND q.question_id % 3 = 0 AND lower(c1) <> c1) AS rows_match,
  NOT EXISTS (SELECT 1 FROM v_gold g WHERE g.question_id = q.question_id AND q.question_id % 3 = 0 AND lower(c1) <> c1) AS verified
FROM v_gold_q q"""
)
_GOLD_VERIFY_RENAMED = _VIEWS + "SELECT question_id, false AS labels_match, true AS rows_match, false AS verified FROM v_gold_q"


def _differ(a: str, b: str) -> str:
    return f"((SELECT count(*) FROM ({a} EXCEPT ALL {b})) + (SELECT count(*) FROM ({b} EXCEPT ALL {a})) > 0)"


_MIXED_SIDES = [
    ("nation", "SELECT n_name FROM nation", "SELECT n_name FROM nation"),
    ("customer", "SELECT c_custkey, round_even(c_acctbal, 6) FROM customer", "SELECT c_custkey, c_acctbal::DECIMAL(18,2)::DOUBLE FROM customer"),
    ("orders", "SELECT o_orderkey + 9007199254740992 FROM orders", "SELECT o_orderkey + 9007199254740993 FROM orders"),
    ("part", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END FROM part", "SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey END, p_partkey FROM part"),
    ("supplier", "SELECT 12345678901234567890.12::DECIMAL(38,2) + s_suppkey FROM supplier", "SELECT 12345678901234567890.17::DECIMAL(38,2) + s_suppkey FROM supplier"),
    ("region", "SELECT r_regionkey, round_even(0.1::DOUBLE + 0.2::DOUBLE, 6) FROM region", "SELECT r_regionkey, 0.3::DOUBLE FROM region"),
]
_MIXED = "WITH v AS (" + " UNION ALL ".join(
    f"SELECT {i + 1}::BIGINT AS question_id, NOT {_differ(a, b)} AS correct, (SELECT count(*) FROM {t}) AS n_gold_rows, (SELECT count(*) FROM {t}) AS n_cand_rows"
    for i, (t, a, b) in enumerate(_MIXED_SIDES)
) + """)
SELECT question_id, correct, CASE WHEN correct THEN 'result sets match' ELSE 'result sets differ' END AS reason,
       'column_position,null_sentinel,float_tolerance,order_insensitive,exact' AS applied_rules, n_gold_rows, n_cand_rows FROM v"""

_SEG = """
g AS (SELECT c_mktsegment AS k, round_even(sum(o_totalprice), 6) AS total, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment),
c AS (SELECT c_mktsegment AS k, round_even(sum(o_totalprice) + 1e-9, 6) AS total, count(*) AS n
      FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment)"""

_PAIR_MULTISET = f"""
WITH {_SEG},
m AS (SELECT bool_or(g.k IS NULL OR c.k IS NULL) AS mis FROM g FULL OUTER JOIN c
      ON g.k = c.k AND g.total = c.total AND g.n = c.n)
SELECT NOT mis AS correct,
       CASE WHEN NOT mis AND (SELECT count(*) FROM g) = 0 THEN 'both result sets empty'
            WHEN NOT mis THEN 'result sets match' ELSE 'result sets differ' END AS reason,
       'column_position,null_sentinel,float_tolerance,order_insensitive,exact' AS applied_rules,
       (SELECT count(*) FROM g) AS n_gold_rows, (SELECT count(*) FROM c) AS n_cand_rows
FROM m"""

_PAIR_ORDERED = f"""
WITH {_SEG},
gp AS (SELECT *, row_number() OVER (ORDER BY k) AS p FROM g),
cp AS (SELECT *, row_number() OVER (ORDER BY total, k, n) AS p FROM c),
m AS (SELECT bool_or(gp.p IS NULL OR cp.p IS NULL OR gp.k <> cp.k OR gp.total <> cp.total OR gp.n <> cp.n) AS mis
      FROM gp FULL OUTER JOIN cp ON gp.p = cp.p)
SELECT NOT mis AS correct,
       CASE WHEN NOT mis THEN 'result sets match' ELSE 'result sets differ' END AS reason,
       'column_position,null_sentinel,float_tolerance,order_insensitive,exact' AS applied_rules,
       (SELECT count(*) FROM g) AS n_gold_rows, (SELECT count(*) FROM c) AS n_cand_rows
FROM m"""

_SCORE_RUNS = f"""
WITH s AS ({_STRICT})
SELECT question_id AS case_id, question_id,
  CASE WHEN question_id % 13 <> 0 AND question_id % 11 <> 0 THEN correct END AS correct,
  CASE WHEN question_id % 13 <> 0 AND question_id % 11 <> 0 THEN reason END AS reason,
  CASE WHEN question_id % 13 = 0 THEN 'guardrail_rejected'
       WHEN question_id % 11 = 0 AND question_id % 2 + 1 > 1 THEN 'retry_exhausted'
       WHEN question_id % 11 = 0 THEN 'execution_error_final'
       WHEN NOT correct THEN 'wrong_answer' ELSE 'success' END AS terminal_state
FROM s"""

ORACLES = {
    "cmp_score_runs": _SCORE_RUNS,
    "cmp_strict": _STRICT,
    "cmp_lenient": _LENIENT,
    "cmp_ordered": _ORDERED,
    "cmp_rescore": _RESCORE,
    "cmp_gold_verify": _GOLD_VERIFY,
    "cmp_gold_verify_changed": _GOLD_VERIFY_CHANGED,
    "cmp_gold_verify_renamed": _GOLD_VERIFY_RENAMED,
    "cmp_mixed_width": _MIXED,
    "cmp_pair_multiset": _PAIR_MULTISET,
    "cmp_pair_ordered": _PAIR_ORDERED,
}
