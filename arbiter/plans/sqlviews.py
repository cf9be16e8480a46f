"""The fixture derivations of ``arbiter.sources.fixtures`` as DuckDB CTEs.

Each constant is one ``name AS (...)`` item; ``with_views`` joins the ones a
query needs into a WITH clause.
"""

from __future__ import annotations

V_GOLD = """v_gold AS (
  SELECT l_orderkey % 50 AS question_id,
         row_number() OVER (PARTITION BY l_orderkey % 50
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_pos,
         l_partkey AS c0, l_returnflag AS c1, l_extendedprice AS c2
  FROM lineitem)"""

V_GOLD_Q = """v_gold_q AS (
  SELECT DISTINCT question_id, question_id % 3 = 0 AS order_significant FROM v_gold)"""

V_CAND = """v_cand AS (
  SELECT g.question_id,
         CASE WHEN g.question_id % 5 = 2 THEN g.row_pos + 1
              WHEN g.question_id % 5 = 3 THEN s.n + 1 - g.row_pos
              WHEN g.question_id % 5 = 4 THEN g.row_pos - 1
              ELSE g.row_pos END AS row_pos,
         g.c0, g.c1,
         CASE WHEN g.question_id % 5 = 1 THEN g.c2 + 1e-9 ELSE g.c2 END AS c2
  FROM v_gold g JOIN (SELECT question_id, count(*) AS n FROM v_gold GROUP BY question_id) s
    ON g.question_id = s.question_id
  WHERE g.question_id % 5 <> 4 OR g.row_pos > 1
  UNION ALL
  SELECT question_id, row_pos, c0, c1, c2 FROM v_gold WHERE question_id % 5 = 2 AND row_pos = 1)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"

V_CAND_ROWS = """cand_rows AS (
  SELECT question_id, 0 AS idx, row_pos, c0, c1, c2 FROM v_gold
  UNION ALL SELECT question_id, 1 AS idx, row_pos, c0, c1, c2 FROM v_gold
  UNION ALL SELECT question_id, 2 AS idx, row_pos, c0, c1, c2 FROM v_cand
  UNION ALL SELECT question_id, 3 AS idx, row_pos - 1, c0, c1, c2 FROM v_gold
            WHERE row_pos > 1 AND question_id % 6 <> 0)"""

V_CANDS = """cands AS (
  SELECT question_id, idx, (idx = 3 AND question_id % 6 = 0) AS errored
  FROM (SELECT question_id, unnest([0, 1, 2, 3]) AS idx FROM v_gold_q))"""

V_VOTE = """fp AS (
  SELECT c.question_id, c.idx, c.errored,
         coalesce(md5(string_agg(r.c0::VARCHAR || '|' || r.c1 || '|' || round_even(r.c2, 6)::VARCHAR, '#'
                      ORDER BY r.c0, r.c1, round_even(r.c2, 6))), '') AS fp
  FROM cands c LEFT JOIN cand_rows r ON r.question_id = c.question_id AND r.idx = c.idx
  GROUP BY c.question_id, c.idx, c.errored),
classes AS (
  SELECT question_id, fp, count(*) AS size, min(idx) AS first_idx FROM fp WHERE NOT errored GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY size DESC, first_idx) AS rk,
         max(size) OVER (PARTITION BY question_id) AS top,
         count(*) OVER (PARTITION BY question_id) AS n_groups
  FROM classes),
outcome AS (
  SELECT n.question_id,
         coalesce(p.selected_index, 0)::BIGINT AS selected_index,
         coalesce(p.agreement, 0)::BIGINT AS agreement,
         n.n_candidates::BIGINT AS n_candidates, n.n_votable::BIGINT AS n_votable,
         coalesce(p.n_groups, 0)::BIGINT AS n_groups, coalesce(p.tie, false) AS tie
  FROM (SELECT question_id, count(*) AS n_candidates, count(*) FILTER (WHERE NOT errored) AS n_votable
        FROM fp GROUP BY 1) n
  LEFT JOIN (SELECT question_id, max(CASE WHEN rk = 1 THEN first_idx END) AS selected_index,
                    max(top) AS agreement, max(n_groups) AS n_groups,
                    count(*) FILTER (WHERE size = top) > 1 AS tie
             FROM ranked GROUP BY 1) p ON p.question_id = n.question_id)"""

V_RUNS = """v_runs AS (
  SELECT o_orderkey AS case_id,
         'db' || CAST(o_custkey % 7 AS VARCHAR) AS db_id,
         CASE o_orderkey % 3 WHEN 0 THEN 'anthropic/claude-sonnet-4-6' WHEN 1 THEN 'beta'
              ELSE 'openrouter/x/gamma' END AS model,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS difficulty,
         CAST(o_orderkey % 3 + 1 AS BIGINT) AS attempts,
         o_orderkey % 17 = 0 AS guard_rejected,
         CASE WHEN o_orderkey % 41 = 0 THEN 'provider_error: timeout'
              WHEN o_orderstatus = 'O' AND o_orderkey % 5 = 0 THEN 'no such table: ghost' END AS error,
         o_orderstatus = 'F' AS matches_gold,
         CAST(floor(o_totalprice) AS BIGINT) % 4000 AS input_tokens,
         CAST(floor(o_totalprice) AS BIGINT) % 700 AS output_tokens,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 10000 AS DOUBLE) AS latency_ms,
         CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 4 <> 0
              THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 4 END AS provider_cost_usd,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL
              WHEN o_orderkey % 3 = 0 THEN ['ORDERS', 'nation']
              WHEN o_orderkey % 3 = 1 THEN ['lineitem', 'Customer', 'orders']
              ELSE CAST([] AS VARCHAR[]) END AS retrieved_tables,
         CASE WHEN o_orderkey % 2 = 0 THEN ['orders', 'customer']
              WHEN o_orderkey % 7 = 0 THEN CAST([] AS VARCHAR[])
              ELSE ['lineitem'] END AS gold_tables,
         o_orderdate AS started_at
  FROM orders)"""

V_RESULTS = """v_results AS (
  SELECT *,
         CASE WHEN guard_rejected THEN 'guardrail_rejected'
              WHEN error IS NOT NULL AND attempts > 1 THEN 'retry_exhausted'
              WHEN error IS NOT NULL THEN 'execution_error_final'
              WHEN NOT matches_gold THEN 'wrong_answer' ELSE 'success' END AS terminal_state,
         (NOT guard_rejected AND error IS NULL AND matches_gold) AS correct,
         CASE WHEN retrieved_tables IS NOT NULL
                   AND len(list_distinct(list_transform(gold_tables, lambda x: lower(x)))) > 0
              THEN len(list_intersect(list_distinct(list_transform(gold_tables, lambda x: lower(x))),
                                      list_distinct(list_transform(retrieved_tables, lambda x: lower(x)))))
                   / len(list_distinct(list_transform(gold_tables, lambda x: lower(x)))) END AS retrieval_recall
  FROM v_runs)"""

V_PASS1 = """v_pass1 AS (
  SELECT case_id, model, db_id, difficulty, error,
         correct AND attempts = 1 AS correct,
         CASE WHEN correct AND attempts = 1 THEN 'success'
              WHEN attempts > 1 THEN 'execution_error_final' ELSE terminal_state END AS terminal_state,
         CAST(1 AS BIGINT) AS attempts,
         input_tokens // attempts AS input_tokens, output_tokens // attempts AS output_tokens,
         latency_ms / attempts AS latency_ms
  FROM v_results)"""

PRICES_SQL = """prices(price_model, input_per_mtok, output_per_mtok) AS (
  VALUES ('claude-sonnet-4-6', 3.0::DOUBLE, 15.0::DOUBLE), ('claude-haiku-4-5', 1.0, 5.0),
         ('claude-opus-4-8', 5.0, 25.0), ('claude-opus-4-7', 5.0, 25.0), ('claude-opus-4-6', 5.0, 25.0))"""
