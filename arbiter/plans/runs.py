"""runs_*: run classification and batch metrics over runs derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import runs as M
from arbiter.plans.sqlviews import PRICES_SQL, V_PASS1, V_RESULTS, V_RUNS, with_views
from arbiter.sources import fixtures as fx
from arbiter.sources.tables import Tables

TWIN_MODEL = "claude-sonnet-4-6"


def _results(spark, sf_dir):
    return M.case_results(fx.v_runs(Tables(spark, sf_dir)))


def runs_terminal_state(spark, sf_dir):
    return _results(spark, sf_dir).select("case_id", "terminal_state", "correct")


def runs_recall(spark, sf_dir):
    return _results(spark, sf_dir).select("case_id", F.round("retrieval_recall", 6).alias("retrieval_recall"))


def runs_metrics_by_model(spark, sf_dir):
    return M.batch_metrics(_results(spark, sf_dir), ["model"])


def runs_metrics_total(spark, sf_dir):
    return M.batch_metrics(_results(spark, sf_dir))


def runs_list_cost(spark, sf_dir):
    r = _results(spark, sf_dir)
    totals = r.groupBy("model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    return M.list_cost(totals, M.prices_frame(spark)).select(
        "model", "input_tokens", "output_tokens", F.round("list_cost_usd", 9).alias("list_cost_usd")
    )


def runs_terminal_counts(spark, sf_dir):
    return M.terminal_counts(_results(spark, sf_dir))


def runs_pass_by(spark, sf_dir):
    return M.pass_at_1_by(_results(spark, sf_dir), ["difficulty", "db_id"]).select(
        "attribute", "key", F.col("total").cast("long").alias("total"),
        F.col("n_correct").cast("long").alias("n_correct"), "accuracy"
    )


def runs_summary(spark, sf_dir):
    """pass@1, recall, non-zero terminal states and pass@1 by difficulty as one long table."""
    return M.summary(_results(spark, sf_dir))


def runs_pass1_derived(spark, sf_dir):
    d = M.derive_pass1(_results(spark, sf_dir))
    return d.select("case_id", "correct", "terminal_state", "attempts", "input_tokens", "output_tokens", "latency_ms")


def runs_twin(spark, sf_dir):
    return M.twin_from_passk(_results(spark, sf_dir), TWIN_MODEL)


def runs_twin_paired(spark, sf_dir):
    """M12 + M13: two independently given batches on the same cases (base and head runs)."""
    runs = fx.v_runs(Tables(spark, sf_dir))
    return M.twin_report(M.case_results(runs), M.case_results(fx.v_head(runs)), TWIN_MODEL)


def runs_eligible_errors(spark, sf_dir):
    d = M.derive_pass1(_results(spark, sf_dir))
    return d.groupBy("model").agg(
        F.count_if(F.col("terminal_state").isin("execution_error_final", "retry_exhausted")).cast("long").alias("eligible")
    )


def runs_provider_table(spark, sf_dir):
    t = M.provider_table(_results(spark, sf_dir), M.prices_frame(spark))
    return t.select("model", "total", "n_correct_1", "n_correct_k", "pass1", "passk",
                    F.round("cost_usd", 6).alias("cost_usd"), "cost_basis", "mean_latency_ms", "provider_errors")


def runs_best_model(spark, sf_dir):
    return M.best_model(M.provider_table(_results(spark, sf_dir), M.prices_frame(spark)))


def runs_prompt_delta(spark, sf_dir):
    runs = fx.v_runs(Tables(spark, sf_dir))
    base = M.run_report(M.case_results(runs), F.lit("v3"), F.lit("fp-base"), "orders", 3)
    head = M.run_report(M.case_results(fx.v_head(runs)), F.lit("v4"), F.lit("fp-head"), "orders", 3)
    return M.report_delta(base, head)


def runs_session_ids(spark, sf_dir):
    r = fx.v_runs(Tables(spark, sf_dir))
    sid = M.batch_session_id(F.lit("bird"), F.col("model"),
                             F.when(F.col("model") == "beta", F.lit("")).otherwise(F.lit("v3")), F.col("started_at"))
    return r.groupBy(sid.alias("session_id")).agg(F.count(F.lit(1)).cast("long").alias("n_runs"))


QUERIES = {
    "runs_terminal_state": runs_terminal_state,
    "runs_recall": runs_recall,
    "runs_metrics_by_model": runs_metrics_by_model,
    "runs_metrics_total": runs_metrics_total,
    "runs_list_cost": runs_list_cost,
    "runs_terminal_counts": runs_terminal_counts,
    "runs_pass_by": runs_pass_by,
    "runs_summary": runs_summary,
    "runs_pass1_derived": runs_pass1_derived,
    "runs_twin": runs_twin,
    "runs_twin_paired": runs_twin_paired,
    "runs_eligible_errors": runs_eligible_errors,
    "runs_provider_table": runs_provider_table,
    "runs_best_model": runs_best_model,
    "runs_prompt_delta": runs_prompt_delta,
    "runs_session_ids": runs_session_ids,
}

_W = with_views(V_RUNS, V_RESULTS, V_PASS1, PRICES_SQL)

_METRICS_SELECT = """
  count(*)::BIGINT AS total, count(*) FILTER (WHERE correct)::BIGINT AS n_correct,
  count(*) FILTER (WHERE correct) / count(*) AS accuracy,
  sum(attempts)::BIGINT AS total_attempts, sum(attempts) / count(*) AS mean_attempts,
  sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens,
  sum(latency_ms) AS total_latency_ms, sum(latency_ms) / count(*) AS mean_latency_ms,
  sum(provider_cost_usd) AS provider_cost_usd,
  count(retrieval_recall)::BIGINT AS n_with_recall, round(avg(retrieval_recall), 6) AS mean_retrieval_recall"""

_PROVIDER = """provider AS (
  SELECT r.model, count(*)::BIGINT AS total,
         count(*) FILTER (WHERE p.correct)::BIGINT AS n_correct_1,
         count(*) FILTER (WHERE r.correct)::BIGINT AS n_correct_k,
         count(*) FILTER (WHERE p.correct) / count(*) AS pass1,
         count(*) FILTER (WHERE r.correct) / count(*) AS passk,
         sum(r.provider_cost_usd) AS provider_cost,
         sum(r.input_tokens) AS tin, sum(r.output_tokens) AS tout,
         avg(r.latency_ms) AS mean_latency_ms,
         count(*) FILTER (WHERE starts_with(r.error, 'provider_error:'))::BIGINT AS provider_errors,
         min(r.case_id) AS first_case
  FROM v_results r JOIN v_pass1 p ON p.case_id = r.case_id GROUP BY r.model),
provider_cost AS (
  SELECT v.*, CASE WHEN starts_with(v.model, 'openrouter/') THEN provider_cost
                   ELSE (tin * coalesce(p1.input_per_mtok, p2.input_per_mtok)
                         + tout * coalesce(p1.output_per_mtok, p2.output_per_mtok)) / 1000000 END AS cost_usd,
         CASE WHEN starts_with(v.model, 'openrouter/') THEN 'openrouter' ELSE 'direct-list' END AS cost_basis
  FROM provider v LEFT JOIN prices p1 ON p1.price_model = v.model
  LEFT JOIN prices p2 ON p2.price_model = string_split(v.model, '/')[-1])"""

_REPORT = """(SELECT count(*) AS total,
         count(*) FILTER (WHERE correct AND attempts = 1) AS n1,
         count(*) FILTER (WHERE correct) AS nk
  FROM (SELECT attempts, NOT guard_rejected AND error IS NULL AND {mg} AS correct FROM v_runs))"""

ORACLES = {
    "runs_terminal_state": _W + "SELECT case_id, terminal_state, correct FROM v_results",
    "runs_recall": _W + "SELECT case_id, round(retrieval_recall, 6) AS retrieval_recall FROM v_results",
    "runs_metrics_by_model": _W + f"SELECT model, {_METRICS_SELECT} FROM v_results GROUP BY model",
    "runs_metrics_total": _W + f"SELECT {_METRICS_SELECT} FROM v_results",
    "runs_list_cost": _W
    + """, t AS (SELECT model, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens
           FROM v_results GROUP BY model)
SELECT t.model, t.input_tokens::BIGINT AS input_tokens, t.output_tokens::BIGINT AS output_tokens,
       round((t.input_tokens * coalesce(p1.input_per_mtok, p2.input_per_mtok)
              + t.output_tokens * coalesce(p1.output_per_mtok, p2.output_per_mtok)) / 1000000, 9) AS list_cost_usd
FROM t LEFT JOIN prices p1 ON p1.price_model = t.model
LEFT JOIN prices p2 ON p2.price_model = string_split(t.model, '/')[-1]""",
    "runs_terminal_counts": _W
    + """SELECT d.s AS terminal_state, count(r.case_id)::BIGINT AS n
FROM (VALUES ('success'), ('wrong_answer'), ('retry_exhausted'), ('execution_error_final'),
             ('guardrail_rejected'), ('retrieval_empty')) d(s)
LEFT JOIN v_results r ON r.terminal_state = d.s GROUP BY d.s""",
    "runs_pass_by": _W
    + """SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(db_id) = 0 THEN 'db_id'
                 ELSE 'total' END AS attribute,
       CASE WHEN grouping(difficulty) = 0 THEN difficulty WHEN grouping(db_id) = 0 THEN db_id END AS key,
       count(*)::BIGINT AS total, count(*) FILTER (WHERE correct)::BIGINT AS n_correct,
       count(*) FILTER (WHERE correct) / count(*) AS accuracy
FROM v_results GROUP BY GROUPING SETS ((difficulty), (db_id), ())""",
    "runs_summary": _W
    + """SELECT 'pass@1' AS metric, NULL::VARCHAR AS key, count(*) FILTER (WHERE correct) / count(*) AS value FROM v_results
UNION ALL
SELECT 'retrieval_recall', CAST(count(retrieval_recall) AS VARCHAR), round(avg(retrieval_recall), 6)
FROM v_results HAVING count(retrieval_recall) > 0
UNION ALL
SELECT 'terminal_state', terminal_state, CAST(count(*) AS DOUBLE) FROM v_results GROUP BY terminal_state
UNION ALL
SELECT 'pass@1_by_difficulty', coalesce(difficulty, 'None'), count(*) FILTER (WHERE correct) / count(*)
FROM v_results GROUP BY difficulty""",
    "runs_pass1_derived": _W
    + "SELECT case_id, correct, terminal_state, attempts, input_tokens, output_tokens, latency_ms FROM v_pass1",
    "runs_twin": _W
    + """, a AS (SELECT count(*) AS n1, count(*) FILTER (WHERE p.correct) AS c1, count(*) FILTER (WHERE r.correct) AS ck,
                count(*) FILTER (WHERE NOT p.correct) AS failed_1,
                count(*) FILTER (WHERE NOT p.correct AND r.correct) AS recovered,
                sum(p.attempts) AS a1, sum(r.attempts) AS ak, sum(p.latency_ms) AS l1, sum(r.latency_ms) AS lk,
                sum(p.input_tokens) AS i1, sum(p.output_tokens) AS o1, sum(r.input_tokens) AS ik, sum(r.output_tokens) AS ok
         FROM v_results r JOIN v_pass1 p ON p.case_id = r.case_id)
SELECT n1::BIGINT AS total, c1::BIGINT AS n_correct_1, ck::BIGINT AS n_correct_k,
       c1 / n1 AS pass_at_1, ck / n1 AS pass_at_k, round(ck / n1 - c1 / n1, 9) AS gap,
       CASE WHEN failed_1 > 0 THEN recovered / failed_1 ELSE 0.0 END AS recovery_rate,
       (ak - a1)::BIGINT AS added_attempts, round(lk - l1, 6) AS added_latency_ms,
       round((ik * 3.0 + ok * 15.0) / 1000000 - (i1 * 3.0 + o1 * 15.0) / 1000000, 9) AS added_cost_usd
FROM a""",
    "runs_twin_paired": with_views(V_RUNS) + """,
b AS (SELECT case_id, NOT guard_rejected AND error IS NULL AND matches_gold AS correct FROM v_runs),
h AS (SELECT case_id, NOT guard_rejected AND error IS NULL
                      AND CASE WHEN case_id % 29 = 0 THEN NOT matches_gold ELSE matches_gold END AS correct FROM v_runs)
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE b.correct)::BIGINT AS n_correct_1,
       count(*) FILTER (WHERE h.correct)::BIGINT AS n_correct_k,
       count(*) FILTER (WHERE b.correct) / count(*) AS pass_at_1, count(*) FILTER (WHERE h.correct) / count(*) AS pass_at_k,
       round(count(*) FILTER (WHERE h.correct) / count(*) - count(*) FILTER (WHERE b.correct) / count(*), 9) AS gap,
       CASE WHEN count(*) FILTER (WHERE NOT b.correct) > 0
            THEN count(*) FILTER (WHERE NOT b.correct AND h.correct) / count(*) FILTER (WHERE NOT b.correct) ELSE 0.0 END
         AS recovery_rate,
       0::BIGINT AS added_attempts, 0.0 AS added_latency_ms, 0.0 AS added_cost_usd  -- same runs: no added cost
FROM b JOIN h ON h.case_id = b.case_id""",
    "runs_eligible_errors": _W
    + """SELECT model, count(*) FILTER (WHERE terminal_state IN ('execution_error_final', 'retry_exhausted'))::BIGINT
       AS eligible FROM v_pass1 GROUP BY model""",
    "runs_provider_table": _W
    + ", "
    + _PROVIDER
    + """
SELECT model, total, n_correct_1, n_correct_k, pass1, passk, round(cost_usd, 6) AS cost_usd, cost_basis,
       mean_latency_ms, provider_errors FROM provider_cost""",
    "runs_best_model": _W
    + ", "
    + _PROVIDER
    + """
SELECT arg_max(model, (pass1, -first_case)) AS best_model, max(pass1) AS best_pass1, count(*)::BIGINT AS n_models
FROM provider_cost""",
    "runs_prompt_delta": with_views(V_RUNS)
    + f""", b AS {_REPORT.format(mg="matches_gold")},
h AS {_REPORT.format(mg="CASE WHEN case_id % 29 = 0 THEN NOT matches_gold ELSE matches_gold END")}
SELECT round(h.n1 / h.total - b.n1 / b.total, 9) AS delta_pass1,
       round(h.nk / h.total - b.nk / b.total, 9) AS delta_passk,
       CASE WHEN h.n1 / h.total - b.n1 / b.total < 0 OR h.nk / h.total - b.nk / b.total < 0 THEN 'regression'
            WHEN h.n1 / h.total - b.n1 / b.total > 0 OR h.nk / h.total - b.nk / b.total > 0 THEN 'improvement'
            ELSE 'none' END AS verdict,
       false AS same_fingerprint, 1.0 / b.total AS grain
FROM b, h""",
    "runs_session_ids": with_views(V_RUNS)
    + """SELECT concat_ws(':', 'bird', model, CASE WHEN model = 'beta' THEN NULL ELSE 'v3' END,
                 strftime(started_at, '%Y-%m-%d')) AS session_id, count(*)::BIGINT AS n_runs
FROM v_runs GROUP BY 1""",
}
