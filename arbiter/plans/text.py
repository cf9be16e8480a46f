"""text_* / log_*: reply extraction, error classification, roll-ups, fingerprints, stage logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import text as X
from arbiter.sources.tables import Tables
from arbiter.streaming.stagelog import run_span_stream, run_stream, windowed_stage_counts

NL = "\n"


def replies(spark, sf_dir):
    """Model replies derived from every conversation turn (whole texts).

    conv_id % 3 = 0: prose, then a fenced SQL block; 1: prose, then a SELECT
    line; 2: the text alone.
    """
    c = Tables(spark, sf_dir).conversations
    k = F.col("conv_id") % 3
    fenced = F.concat(F.lit("Thinking: "), F.col("text"), F.lit(NL + "```sql" + NL + "SELECT count(*) FROM orders WHERE o_custkey = "),
                      F.col("conv_id").cast("string"), F.lit(NL + "```"))
    opener = F.concat(F.col("text"), F.lit(NL + "SELECT "), F.col("turn").cast("string"), F.lit(" AS turn_no FROM conversations"))
    reply = F.when(k == 0, fenced).when(k == 1, opener).otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", "text", reply.alias("reply"))


def text_extract_sql(spark, sf_dir):
    return replies(spark, sf_dir).select("conv_id", "turn", X.extract_sql(F.col("reply")).alias("sql"))


def errors(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    k = F.col("o_orderkey")
    err = (
        F.when(k % 6 == 0, F.concat(F.lit("no such table: ghost_"), (k % 10).cast("string")))
        .when(k % 6 == 1, F.concat(F.lit('relation "tbl_'), (k % 4).cast("string"), F.lit('" does not exist')))
        .when(k % 6 == 2, F.concat(F.lit("no such column: c"), (k % 5).cast("string"), F.lit(", no such column: c"),
                                   (k % 5).cast("string"), F.lit(" and no such column: d1)")))
        .when(k % 6 == 3, F.lit("Unknown column x in field list"))
        .when(k % 6 == 4, F.lit("syntax error near FROM"))
    )
    return o.select(k.alias("case_id"), err.alias("error"))


def text_errors(spark, sf_dir):
    e = errors(spark, sf_dir)
    return e.select("case_id", X.is_not_found_error(F.col("error")).alias("not_found"),
                    X.missing_identifier(F.col("error")).alias("missing"))


def text_attempt_rollup(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    att = li.select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_quantity").cast("long") * 10).alias("input_tokens"),
        (F.col("l_linenumber") * 7).cast("long").alias("output_tokens"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit(None).cast("double"))
        .when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber") * 0.25).alias("provider_cost_usd"),
    )
    return X.rollup_attempts(att)


def text_fingerprint(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    parts = c.select(F.col("conv_id").alias("group_id"), F.col("turn").cast("string").alias("name"), F.col("text").alias("body"))
    return X.fingerprint(parts)


def text_summary_parse(spark, sf_dir):
    """Parse JSON replies derived from conversation turns; malformed ones fall back."""
    c = Tables(spark, sf_dir).conversations
    k = F.col("conv_id") % 4
    obj = F.to_json(F.struct(F.col("role").alias("short"), F.col("text").alias("long")))
    reply = (
        F.when(k == 0, F.concat(F.lit("```json" + NL), obj, F.lit(NL + "```")))
        .when(k == 1, F.concat(F.lit("Here you go: "), obj, F.lit(" -- done")))
        .when(k == 2, F.concat(F.lit("{not json: "), F.col("role"), F.lit("}")))
        .otherwise(F.col("text"))
    )
    fallback = F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" by "), F.col("role"), F.lit("."))
    p = X.parse_summary(reply, fallback)
    return c.select("conv_id", "turn", p["short"].alias("short"), p["long"].alias("long"))


def stage_sides(e):
    """(start events, end events) derived from ``events`` (every tenth event never ends)."""
    start = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("attempt"),
                     F.lit("start").alias("kind"), "ts", F.lit(None).cast("string").alias("error_class"),
                     F.lit(None).cast("int").alias("n_items"))
    end = e.filter(F.col("event_id") % 10 != 0).select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("attempt"),
        F.lit("end").alias("kind"),
        F.expr("ts + make_dt_interval(0, 0, 0, CAST(value AS DECIMAL(18, 6)))").alias("ts"),
        F.when(F.col("event_type") == "error", F.lit("ExecutionError")).alias("error_class"),
        F.get_json_object("props", "$.k").cast("int").alias("n_items"),
    )
    return start, end


def stage_events(spark, sf_dir):
    start, end = stage_sides(Tables(spark, sf_dir).events)
    return start.unionByName(end)


def log_stage_rollup(spark, sf_dir):
    return X.stage_rollup(X.pair_spans(stage_events(spark, sf_dir)))


def log_span_stream(spark, sf_dir):
    """The spans paired while the events stream in."""
    return run_span_stream(spark, f"{sf_dir}/events.parquet", stage_sides)


def log_stage_latency(spark, sf_dir):
    return X.stage_latency(X.pair_spans(stage_events(spark, sf_dir)))


def log_stage_windows(spark, sf_dir):
    return windowed_stage_counts(Tables(spark, sf_dir).events)


def log_stage_stream(spark, sf_dir):
    return run_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")


QUERIES = {
    "text_extract_sql": text_extract_sql,
    "text_errors": text_errors,
    "text_attempt_rollup": text_attempt_rollup,
    "text_fingerprint": text_fingerprint,
    "text_summary_parse": text_summary_parse,
    "log_stage_rollup": log_stage_rollup,
    "log_stage_latency": log_stage_latency,
    "log_stage_windows": log_stage_windows,
    "log_stage_stream": log_stage_stream,
    "log_span_stream": log_span_stream,
}

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


_REPLIES = """r AS (SELECT conv_id, turn, role, text,
  CASE WHEN conv_id % 3 = 0 THEN 'Thinking: ' || text || chr(10) || '```sql' || chr(10)
            || 'SELECT count(*) FROM orders WHERE o_custkey = ' || CAST(conv_id AS VARCHAR) || chr(10) || '```'
       WHEN conv_id % 3 = 1 THEN text || chr(10) || 'SELECT ' || CAST(turn AS VARCHAR) || ' AS turn_no FROM conversations'
       ELSE text END AS reply FROM conversations)"""

_EXTRACT = f"""SELECT conv_id, turn,
  CASE WHEN len(regexp_extract_all(reply, '(?s)```[^\\n]*\\n(.*?)```', 1)) > 0
       THEN {_strip("regexp_extract_all(reply, '(?s)```[^\\n]*\\n(.*?)```', 1)[-1]")}
       WHEN regexp_extract(reply, '(?ims)^[ \\t]*((?:SELECT|WITH)\\b.*)', 1) <> ''
       THEN {_strip("regexp_extract(reply, '(?ims)^[ \\t]*((?:SELECT|WITH)\\b.*)', 1)")}
       ELSE {_strip("reply")} END AS sql
FROM r"""

_ERR = """e AS (SELECT o_orderkey AS case_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'no such table: ghost_' || CAST(o_orderkey % 10 AS VARCHAR)
       WHEN 1 THEN 'relation "tbl_' || CAST(o_orderkey % 4 AS VARCHAR) || '" does not exist'
       WHEN 2 THEN 'no such column: c' || CAST(o_orderkey % 5 AS VARCHAR) || ', no such column: c'
                   || CAST(o_orderkey % 5 AS VARCHAR) || ' and no such column: d1)'
       WHEN 3 THEN 'Unknown column x in field list' WHEN 4 THEN 'syntax error near FROM' END AS error FROM orders)"""

_MI = """'no such (?:table|column):\\s*([^\\s).,]+)|"([^"]+)"\\s+does not exist'"""

_EVENTS = """ev AS (
  SELECT user_id AS run_id, event_type AS stage, event_id AS attempt, ts AS start_ts,
         CASE WHEN event_id % 10 <> 0 THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS end_ts,
         CASE WHEN event_id % 10 <> 0 AND event_type = 'error' THEN 'ExecutionError' END AS error_class,
         CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS n_items
  FROM events)"""

ORACLES = {
    "text_extract_sql": f"WITH {_REPLIES} {_EXTRACT}",
    "text_errors": f"""WITH {_ERR},
ab AS (SELECT case_id, error, regexp_extract_all(coalesce(error, ''), {_MI}, 1) AS a,
              regexp_extract_all(coalesce(error, ''), {_MI}, 2) AS b FROM e),
nm AS (SELECT case_id, error, list_filter(list_transform(range(1, len(a) + 1),
              lambda i: CASE WHEN coalesce(a[i], '') <> '' THEN a[i] ELSE b[i] END), lambda x: coalesce(x, '') <> '') AS names
       FROM ab)
SELECT case_id,
  coalesce(contains(lower(error), 'no such table') OR contains(lower(error), 'no such column')
           OR contains(lower(error), 'does not exist') OR contains(lower(error), 'unknown column'), false) AS not_found,
  array_to_string(list_filter(names, lambda v, i: list_position(names, v) = i), ' ') AS missing
FROM nm""",
    "text_attempt_rollup": text_attempt_rollup,
    "text_fingerprint": text_fingerprint,
    "text_summary_parse": text_summary_parse,
    "log_stage_rollup": log_stage_rollup,
    "log_stage_latency": log_stage_latency,
    "log_stage_windows": log_stage_windows,
    "log_stage_stream": log_stage_stream,
}

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


_REPLIES = """r AS (SELECT conv_id, turn, role, text,
  CASE WHEN conv_id % 3 = 0 THEN 'Thinking: ' || text || chr(10) || '```sql' || chr(10)
            || 'SELECT count(*) FROM orders WHERE o_custkey = ' || CAST(conv_id AS VARCHAR) || chr(10) || '```'
       WHEN conv_id % 3 = 1 THEN text || chr(10) || 'SELECT ' || CAST(turn AS VARCHAR) || ' AS turn_no FROM conversations'
       ELSE text END AS reply FROM conversations)"""

_EXTRACT = f"""SELECT conv_id, turn,
  CASE WHEN len(regexp_extract_all(reply, '(?s)```[^\\n]*\\n(.*?)```', 1)) > 0
       THEN {_strip("regexp_extract_all(reply, '(?s)```[^\\n]*\\n(.*?)```', 1)[-1]")}
       WHEN regexp_extract(reply, '(?ims)^[ \\t]*((?:SELECT|WITH)\\b.*)', 1) <> ''
       THEN {_strip("regexp_extract(reply, '(?ims)^[ \\t]*((?:SELECT|WITH)\\b.*)', 1)")}
       ELSE {_strip("reply")} END AS sql
FROM r"""

_ERR = """e AS (SELECT o_orderkey AS case_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'no such table: ghost_' || CAST(o_orderkey % 10 AS VARCHAR)
       WHEN 1 THEN 'relation "tbl_' || CAST(o_orderkey % 4 AS VARCHAR) || '" does not exist'
       WHEN 2 THEN 'no such column: c' || CAST(o_orderkey % 5 AS VARCHAR) || ', no such column: c'
                   || CAST(o_orderkey % 5 AS VARCHAR) || ' and no such column: d1)'
       WHEN 3 THEN 'Unknown column x in field list' WHEN 4 THEN 'syntax error near FROM' END AS error FROM orders)"""

_MI = """'no such (?:table|column):\\s*([^\\s).,]+)|"([^"]+)"\\s+does not exist'"""

_EVENTS = """ev AS (
  SELECT user_id AS run_id, event_type AS stage, event_id AS attempt, ts AS start_ts,
         CASE WHEN event_id % 10 <> 0 THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END AS end_ts,
         CASE WHEN event_id % 10 <> 0 AND event_type = 'error' THEN 'ExecutionError' END AS error_class,
         CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS n_items
  FROM events)"""

ORACLES = {
    "text_extract_sql": f"WITH {_REPLIES} {_EXTRACT}",
    "text_errors": f"""WITH {_ERR}
SELECT case_id,
  coalesce(contains(lower(error), 'no such table') OR contains(lower(error), 'no such column')
           OR contains(lower(error), 'does not exist') OR contains(lower(error), 'unknown column'), false) AS not_found,
  array_to_string(list_distinct_ordered, ' ') AS missing
FROM (SELECT case_id, error,
        list_reduce(list_prepend([]::VARCHAR[], list_filter(list_transform(
          list_zip(regexp_extract_all(coalesce(error, ''), {_MI}, 1), regexp_extract_all(coalesce(error, ''), {_MI}, 2)),
          lambda z: CASE WHEN coalesce(z[1], '') <> '' THEN z[1] ELSE z[2] END), lambda x: coalesce(x, '') <> '')::VARCHAR[][]),
          lambda acc, x: acc) AS dummy,
        list_filter(list_transform(
          list_zip(regexp_extract_all(coalesce(error, ''), {_MI}, 1), regexp_extract_all(coalesce(error, ''), {_MI}, 2)),
          lambda z: CASE WHEN coalesce(z[1], '') <> '' THEN z[1] ELSE z[2] END), lambda x: coalesce(x, '') <> '') AS names
      FROM e) x,
LATERAL (SELECT list_filter(names, lambda v, i: list_position(names, v) = i) AS list_distinct_ordered)""",
    "text_attempt_rollup": """SELECT l_orderkey AS run_id, count(*)::BIGINT AS attempts,
  sum(CAST(l_quantity AS BIGINT) * 10)::BIGINT AS input_tokens, sum(l_linenumber * 7)::BIGINT AS output_tokens,
  sum(CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_linenumber % 2 = 1 THEN l_linenumber * 0.25 END)::DOUBLE AS provider_cost_usd
FROM lineitem GROUP BY l_orderkey""",
    "text_fingerprint": """SELECT conv_id AS group_id,
  'sha256:' || sha256(string_agg(CAST(turn AS VARCHAR) || chr(0) || text || chr(0), '' ORDER BY CAST(turn AS VARCHAR))) AS fingerprint
FROM conversations GROUP BY conv_id""",
    "text_summary_parse": f"""WITH c AS (SELECT conv_id, turn, role, text,
  CASE conv_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'x' WHEN 2 THEN 'bad' ELSE 'plain' END AS kind FROM conversations)
SELECT conv_id, turn,
  CASE WHEN kind = 'x' THEN {_strip("role")} ELSE '' END AS short,
  CASE WHEN kind = 'x' AND {_strip("text")} <> '' THEN {_strip("text")}
       ELSE 'Turn ' || CAST(turn AS VARCHAR) || ' by ' || role || '.' END AS long
FROM c""",
    "log_stage_rollup": f"""WITH {_EVENTS}
SELECT stage, count(*)::BIGINT AS n_spans, count(end_ts)::BIGINT AS n_completed,
  round(avg((epoch_us(end_ts) - epoch_us(start_ts)) / 1000.0), 3) AS mean_ms,
  count(*) FILTER (WHERE error_class IS NOT NULL)::BIGINT AS n_errors, sum(n_items)::BIGINT AS n_items
FROM ev GROUP BY stage""",
    "log_stage_windows": """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
  event_type AS stage, count(*)::BIGINT AS n_events, sum(round(value * 1000))::DOUBLE AS total_ms,
  count(*) FILTER (WHERE event_type = 'error')::BIGINT AS n_errors
FROM events GROUP BY ALL""",
}
ORACLES["log_stage_stream"] = ORACLES["log_stage_windows"]
ORACLES["log_span_stream"] = f"WITH {_EVENTS} SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 1000.0 AS duration_ms FROM ev"
# Up to its accuracy (10,000 rows of a stage) the sketch gives the value of the rank itself.
ORACLES["log_stage_latency"] = f"""WITH {_EVENTS}, d AS (SELECT stage, (epoch_us(end_ts) - epoch_us(start_ts)) / 1000.0 AS ms FROM ev),
r AS (SELECT stage, ms, row_number() OVER (PARTITION BY stage ORDER BY ms) AS rk, count(*) OVER (PARTITION BY stage) AS n FROM d WHERE ms IS NOT NULL)
SELECT stage, min(ms) FILTER (WHERE rk >= 0.5 * n) AS p50_ms, min(ms) FILTER (WHERE rk >= 0.95 * n) AS p95_ms FROM r GROUP BY stage"""
