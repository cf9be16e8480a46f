"""Text and log extraction: SQL from model replies, error classification, roll-ups, fingerprints.

All extraction is regex / JSON functions on whole texts (no prefixes), so each
row is one codegen'd expression; roll-ups are partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
FENCE_BLOCK = r"(?s)```[^\n]*\n(.*?)```"
STMT_OPENER = r"(?ims)^[ \t]*((?:SELECT|WITH)\b.*)"
NOT_FOUND_MARKERS = ("no such table", "no such column", "does not exist", "unknown column")
MISSING_IDENT = r"""no such (?:table|column):\s*([^\s).,]+)|"([^"]+)"\s+does not exist"""
EDGE_SPACE = r"^\s+|\s+$"
OBJECT_SPAN = r"(?s)(\{.*\})"


def strip(c: Column) -> Column:
    """Python-style strip of surrounding whitespace (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def extract_sql(text: Column) -> Column:
    """Last fenced block; else from the first line opening with SELECT/WITH; else the stripped text."""
    fences = F.regexp_extract_all(text, F.lit(FENCE_BLOCK), 1)
    opener = F.regexp_extract(text, STMT_OPENER, 1)
    return (
        F.when(F.size(fences) > 0, strip(F.element_at(fences, -1)))
        .when(opener != "", strip(opener))
        .otherwise(strip(text))
    )


def is_not_found_error(error: Column) -> Column:
    """The lowered message contains one of the not-found markers; NULL is false."""
    low = F.lower(error)
    return F.coalesce(F.exists(F.array(*[F.lit(m) for m in NOT_FOUND_MARKERS]), lambda m: F.instr(low, m) > 0), F.lit(False))


def missing_identifier(error: Column) -> Column:
    """The reported missing names, distinct in order of appearance, space-joined ('' when none)."""
    a = F.regexp_extract_all(F.coalesce(error, F.lit("")), F.lit(MISSING_IDENT), 1)
    b = F.regexp_extract_all(F.coalesce(error, F.lit("")), F.lit(MISSING_IDENT), 2)
    names = F.transform(F.arrays_zip(a, b), lambda z: F.when(F.coalesce(z["0"], F.lit("")) != "", z["0"]).otherwise(z["1"]))
    names = F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(F.array_distinct(names), " ")


def rollup_attempts(attempts: DataFrame) -> DataFrame:
    """Per run, tokens summed over attempts; provider cost NULL when never reported."""
    return attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("long").alias("attempts"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.sum("provider_cost_usd").alias("provider_cost_usd"),
    )


def pair_spans(events: DataFrame) -> DataFrame:
    """Pair start/end stage events by (run, stage, attempt) into spans with a duration."""
    return events.groupBy("run_id", "stage", "attempt").agg(
        F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("start_ts"),
        F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("end_ts"),
        F.max(F.when(F.col("kind") == "end", F.col("error_class"))).alias("error_class"),
        F.max(F.when(F.col("kind") == "end", F.col("n_items"))).alias("n_items"),
    ).withColumn(
        "duration_ms",
        (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1000.0,
    )


def stage_rollup(spans: DataFrame) -> DataFrame:
    """Per stage: spans, completed spans, mean duration, errors, items."""
    return spans.groupBy("stage").agg(
        F.count(F.lit(1)).cast("long").alias("n_spans"),
        F.count("end_ts").cast("long").alias("n_completed"),
        F.round(F.avg("duration_ms"), 3).alias("mean_ms"),
        F.count_if(F.col("error_class").isNotNull()).cast("long").alias("n_errors"),
        F.sum("n_items").cast("long").alias("n_items"),
    )


def stage_latency(spans: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Approximate p50/p95 per stage (bounded-memory sketch, mergeable across tasks)."""
    return spans.groupBy("stage").agg(
        F.percentile_approx("duration_ms", [0.5, 0.95], accuracy).alias("q")
    ).select("stage", F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"))


def fingerprint(parts: DataFrame, group: str = "group_id") -> DataFrame:
    """``sha256:`` digest over (name, NUL, body, NUL) sorted by name, per group.

    A sequential hash needs the group's parts in one task; its input (a
    prompt's named parts) is small by nature.
    """
    nul = F.lit("\u0000")
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("name", "body"))), lambda s: F.concat(s["name"], nul, s["body"], nul)), ""
    )
    return parts.groupBy(group).agg(F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("fingerprint"))


def parse_summary(reply: Column, fallback_long: Column) -> Column:
    """struct(short, long) from a model reply holding a JSON object; English fallback."""
    s = strip(reply)
    fenced = s.startswith("```")
    unfenced = F.regexp_replace(s, r"^`+|`+$", "")
    unfenced = F.regexp_replace(unfenced, r"^[^\n]*\n", "")  # drop a language-tag line
    body = F.when(fenced, unfenced).otherwise(s)
    obj = F.regexp_extract(body, OBJECT_SPAN, 1)
    parsed = F.from_json(obj, "short string, long string")
    ok = (obj != "") & parsed.isNotNull()
    short = F.when(ok, strip(F.coalesce(parsed["short"], F.lit("")))).otherwise(F.lit(""))
    long_ = F.when(ok, strip(F.coalesce(parsed["long"], F.lit(""))))
    return F.struct(short.alias("short"), F.when(F.coalesce(long_, F.lit("")) != "", long_).otherwise(fallback_long).alias("long"))
