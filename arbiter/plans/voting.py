"""vote_*: majority vote over four derived candidates per gold question."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import compare as R
from arbiter.operators import voting as V
from arbiter.plans.sqlviews import V_CAND, V_CAND_ROWS, V_CANDS, V_GOLD, V_GOLD_Q, V_VOTE, with_views
from arbiter.session import stable
from arbiter.sources import fixtures as fx
from arbiter.sources.tables import Tables

VALUES = ["c0", "c1", "c2"]


def _outcomes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    gold = fx.v_gold_stable(t)
    cands, rows = fx.v_candidate_rows(gold, fx.v_cand(gold))
    fps = V.candidate_fingerprints(rows, cands, VALUES)
    return gold, cands, rows, V.majority_vote(fps)


def vote_outcome(spark, sf_dir):
    return _outcomes(spark, sf_dir)[3]


def vote_outcome_exact(spark, sf_dir):
    """V1 without trust in hashes: the classes of the vote, compared row by row with their representatives."""
    gold = fx.v_gold_stable(Tables(spark, sf_dir))
    cands, rows = fx.v_candidate_rows(gold, fx.v_cand(gold))
    fps = V.candidate_fingerprints(rows, cands, VALUES)
    return V.majority_vote(V.exact_classes(rows, fps, VALUES))


def vote_distribution(spark, sf_dir):
    return V.agreement_distribution(_outcomes(spark, sf_dir)[3])


def vote_selected_score(spark, sf_dir):
    gold, _, rows, outcomes = _outcomes(spark, sf_dir)
    outcomes = stable(outcomes)  # one row a question; the vote runs once for the pick and the result
    picked = V.select_by_vote(outcomes, rows)
    verdict = R.compare_results(gold, picked, fx.v_gold_questions(gold), R.DEFAULT_RULES)
    return outcomes.select("question_id", "selected_index").join(verdict, "question_id").select(
        "question_id", "selected_index", "correct", "reason"
    )


def vote_k(spark, sf_dir):
    _, cands, _, _ = _outcomes(spark, sf_dir)
    return V.check_k(cands).select("question_id", F.col("k").cast("long").alias("k"), "valid")


def vote_null_places(spark, sf_dir):
    """Per nation four candidates that differ only in where the NULL stands; one has no result and may not vote."""
    n = Tables(spark, sf_dir).nation.select(F.col("n_nationkey").cast("long").alias("question_id"))
    runs = n.select("question_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("idx"))
    failed = (F.col("idx") == 0) & (F.col("question_id") % 2 == 0)
    runs = runs.withColumn("error", F.when(failed, F.lit("timeout"))).withColumn("has_result", F.col("idx") != 3)
    key = F.col("question_id") + 1
    rows = runs.where(F.col("error").isNull() & F.col("has_result")).select(
        "question_id", "idx", F.lit(None).cast("long").alias("row_pos"), F.when(F.col("idx") != 1, key).alias("c0"), F.when(F.col("idx") == 1, key).alias("c1")
    )
    return V.majority_vote(V.candidate_fingerprints(rows, V.votable(runs), ["c0", "c1"]))


QUERIES = {
    "vote_null_places": vote_null_places,
    "vote_outcome_exact": vote_outcome_exact,
    "vote_outcome": vote_outcome,
    "vote_distribution": vote_distribution,
    "vote_selected_score": vote_selected_score,
    "vote_k": vote_k,
}

_BASE = with_views(V_GOLD, V_GOLD_Q, V_CAND, V_CAND_ROWS, V_CANDS, V_VOTE)

ORACLES = {
    "vote_null_places": """
SELECT n_nationkey::BIGINT AS question_id,
  -- even questions: candidate 0 failed, so 1 and 2 are one class each; odd: 0 and 2 agree
  CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS selected_index,
  CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS agreement, 4::BIGINT AS n_candidates,
  CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS n_votable, 2::BIGINT AS n_groups, n_nationkey % 2 = 0 AS tie
FROM nation""",
    "vote_outcome": _BASE + "SELECT * FROM outcome",
    "vote_distribution": _BASE
    + """, b AS (
  SELECT CASE WHEN n_votable >= 1 AND n_groups = 1 THEN 'unanimous'
              WHEN agreement * 2 > n_votable THEN 'majority' ELSE 'no_majority' END AS bucket
  FROM outcome)
SELECT d.bucket, count(b.bucket)::BIGINT AS n
FROM (VALUES ('unanimous'), ('majority'), ('no_majority')) d(bucket) LEFT JOIN b ON b.bucket = d.bucket
GROUP BY d.bucket""",
    "vote_selected_score": _BASE
    + """, picked AS (
  SELECT r.question_id, r.c0, r.c1, round_even(r.c2, 6) AS c2, r.row_pos
  FROM cand_rows r JOIN outcome o ON o.question_id = r.question_id AND o.selected_index = r.idx),
gm AS (SELECT question_id, c0, c1, round_even(c2, 6) AS c2, count(*) AS n FROM v_gold GROUP BY ALL),
pm AS (SELECT question_id, c0, c1, c2, count(*) AS n FROM picked GROUP BY ALL),
om AS (SELECT g.question_id, bool_or(g.row_pos IS NULL OR p.row_pos IS NULL OR g.c0 <> p.c0 OR g.c1 <> p.c1
                                     OR round_even(g.c2, 6) <> p.c2) AS mis
       FROM v_gold g FULL OUTER JOIN picked p ON g.question_id = p.question_id AND g.row_pos = p.row_pos GROUP BY 1),
mm AS (SELECT coalesce(gm.question_id, pm.question_id) AS question_id, bool_or(gm.n IS DISTINCT FROM pm.n) AS mis
       FROM gm FULL OUTER JOIN pm ON gm.question_id = pm.question_id AND gm.c0 = pm.c0 AND gm.c1 = pm.c1
            AND gm.c2 = pm.c2 GROUP BY 1)
SELECT o.question_id, o.selected_index,
       NOT coalesce(CASE WHEN q.order_significant THEN om.mis ELSE mm.mis END, false) AS correct,
       CASE WHEN NOT coalesce(CASE WHEN q.order_significant THEN om.mis ELSE mm.mis END, false)
            THEN 'result sets match' ELSE 'result sets differ' END AS reason
FROM outcome o JOIN v_gold_q q ON q.question_id = o.question_id
LEFT JOIN om ON om.question_id = o.question_id LEFT JOIN mm ON mm.question_id = o.question_id""",
    "vote_k": _BASE + "SELECT question_id, count(*)::BIGINT AS k, count(*) >= 1 AS valid FROM cands GROUP BY 1",
}
ORACLES["vote_outcome_exact"] = ORACLES["vote_outcome"]
