"""Run classification and batch metrics over a ``runs`` table.

``runs`` columns (nullable where the reference allows None): case_id,
db_id, model, difficulty, attempts, guard_rejected, error, correct (the
comparator's verdict, NULL when not scored), input_tokens, output_tokens,
latency_ms, provider_cost_usd, retrieved_tables ARRAY<STRING>,
gold_tables ARRAY<STRING>.  Every metric is one aggregation; per-group
metrics use GROUPING SETS so all cuts come from one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Terminal states in declaration order.
TERMINAL_STATES = (
    "success",
    "wrong_answer",
    "retry_exhausted",
    "execution_error_final",
    "guardrail_rejected",
    "retrieval_empty",
)

# List prices, USD per 1M input / output tokens.
PRICES = (
    ("claude-sonnet-4-6", 3.0, 15.0),
    ("claude-haiku-4-5", 1.0, 5.0),
    ("claude-opus-4-8", 5.0, 25.0),
    ("claude-opus-4-7", 5.0, 25.0),
    ("claude-opus-4-6", 5.0, 25.0),
)
TOKENS_PER_MILLION = 1_000_000
PROVIDER_ERROR_PREFIX = "provider_error:"
OPENROUTER_PREFIX = "openrouter/"


def prices_frame(spark: SparkSession) -> DataFrame:
    """The price list as a five-row frame (a fixed size bound: safe to broadcast)."""
    return spark.createDataFrame(list(PRICES), "price_model string, input_per_mtok double, output_per_mtok double")


def terminal_state(guard_rejected: Column, error: Column, attempts: Column, correct: Column) -> Column:
    """M1: first match of rejected / retried error / single error / wrong / success."""
    return (
        F.when(F.coalesce(guard_rejected, F.lit(False)), F.lit("guardrail_rejected"))
        .when(error.isNotNull() & (attempts > 1), F.lit("retry_exhausted"))
        .when(error.isNotNull(), F.lit("execution_error_final"))
        .when(correct.isNotNull() & ~correct, F.lit("wrong_answer"))
        .otherwise(F.lit("success"))
    )


def retrieval_recall(retrieved: Column, gold: Column) -> Column:
    """M6: case-insensitive |retrieved ∩ gold| / |gold|; NULL if not retrieved or gold empty."""
    g = F.array_distinct(F.transform(gold, lambda x: F.lower(x)))
    r = F.array_distinct(F.transform(retrieved, lambda x: F.lower(x)))
    return F.when(
        retrieved.isNotNull() & (F.size(g) > 0), F.size(F.array_intersect(g, r)) / F.size(g)
    )


def case_results(runs: DataFrame) -> DataFrame:
    """Scored runs: terminal_state, correct (only a scored, matching run), recall."""
    scored = ~F.coalesce(F.col("guard_rejected"), F.lit(False)) & F.col("error").isNull()
    state = terminal_state(F.col("guard_rejected"), F.col("error"), F.col("attempts"), F.col("matches_gold"))
    out = runs.withColumn("terminal_state", state).withColumn(
        "correct", scored & F.coalesce(F.col("matches_gold"), F.lit(False))
    )
    if "retrieved_tables" in runs.columns and "gold_tables" in runs.columns:
        out = out.withColumn("retrieval_recall", retrieval_recall(F.col("retrieved_tables"), F.col("gold_tables")))
    return out


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def batch_metrics(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M2, M3, M5, M7: accuracy, attempts, tokens, latency, provider cost, recall."""
    if "retrieval_recall" not in results.columns:  # retrieval did not run: recall undefined
        results = results.withColumn("retrieval_recall", F.lit(None).cast("double"))
    g = results.groupBy(*by) if by else results.groupBy()
    agg = g.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("correct")).alias("n_correct"),
        F.sum("attempts").alias("total_attempts"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum("provider_cost_usd").alias("provider_cost_usd"),
        F.count("retrieval_recall").alias("n_with_recall"),
        F.avg("retrieval_recall").alias("mean_retrieval_recall"),
    )
    return agg.select(
        *by,
        F.col("total").cast("long").alias("total"),
        F.col("n_correct").cast("long").alias("n_correct"),
        _ratio(F.col("n_correct"), F.col("total")).alias("accuracy"),
        F.coalesce(F.col("total_attempts"), F.lit(0)).cast("long").alias("total_attempts"),
        _ratio(F.coalesce(F.col("total_attempts"), F.lit(0)), F.col("total")).alias("mean_attempts"),
        F.coalesce(F.col("total_input_tokens"), F.lit(0)).cast("long").alias("total_input_tokens"),
        F.coalesce(F.col("total_output_tokens"), F.lit(0)).cast("long").alias("total_output_tokens"),
        F.coalesce(F.col("total_latency_ms"), F.lit(0.0)).alias("total_latency_ms"),
        _ratio(F.coalesce(F.col("total_latency_ms"), F.lit(0.0)), F.col("total")).alias("mean_latency_ms"),
        "provider_cost_usd",
        F.col("n_with_recall").cast("long").alias("n_with_recall"),
        F.round("mean_retrieval_recall", 6).alias("mean_retrieval_recall"),
    )


def list_cost(df: DataFrame, prices: DataFrame, model: str = "model", tin: str = "input_tokens", tout: str = "output_tokens") -> DataFrame:
    """M4: list-price cost; exact model id first, then its last path segment; unknown -> NULL."""
    p_exact = F.broadcast(prices.select(F.col("price_model").alias("_m1"), F.col("input_per_mtok").alias("_i1"), F.col("output_per_mtok").alias("_o1")))
    p_bare = F.broadcast(prices.select(F.col("price_model").alias("_m2"), F.col("input_per_mtok").alias("_i2"), F.col("output_per_mtok").alias("_o2")))
    bare = F.element_at(F.split(F.col(model), "/"), -1)
    joined = df.join(p_exact, F.col(model) == F.col("_m1"), "left").join(p_bare, bare == F.col("_m2"), "left")
    pi = F.coalesce("_i1", "_i2")
    po = F.coalesce("_o1", "_o2")
    cost = (F.col(tin) * pi + F.col(tout) * po) / F.lit(TOKENS_PER_MILLION)
    return joined.withColumn("list_cost_usd", cost).drop("_m1", "_i1", "_o1", "_m2", "_i2", "_o2")


def terminal_counts(results: DataFrame) -> DataFrame:
    """M8: a count for each of the six states, zero when absent."""
    spark = results.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(TERMINAL_STATES)], "terminal_state string, state_ordinal int")
    counts = results.groupBy("terminal_state").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, "terminal_state", "left").select(
        "terminal_state", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def pass_at_1_by(results: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """M9: accuracy per value of each attribute (NULL group kept) plus the total, one scan."""
    cols = ", ".join(attrs)
    sets = ", ".join([f"({a})" for a in attrs] + ["()"])
    results.createOrReplaceTempView("_arbiter_results")
    gid_case = " ".join(
        f"WHEN grouping_id({cols}) = {(1 << len(attrs)) - 1 - (1 << (len(attrs) - 1 - i))} THEN '{a}'"
        for i, a in enumerate(attrs)
    )
    key_case = " ".join(
        f"WHEN grouping_id({cols}) = {(1 << len(attrs)) - 1 - (1 << (len(attrs) - 1 - i))} THEN CAST({a} AS STRING)"
        for i, a in enumerate(attrs)
    )
    sql = f"""
        SELECT CASE {gid_case} ELSE 'total' END AS attribute,
               CASE {key_case} END AS key,
               count(*) AS total, count_if(correct) AS n_correct,
               count_if(correct) / count(*) AS accuracy
        FROM _arbiter_results GROUP BY GROUPING SETS ({sets})"""
    return results.sparkSession.sql(sql)


def summary(results: DataFrame) -> DataFrame:
    """(metric, key, value): pass@1, recall, the terminal states that occur and pass@1 by difficulty; one scan by grouping sets."""
    if "retrieval_recall" not in results.columns:
        results = results.withColumn("retrieval_recall", F.lit(None).cast("double"))
    sets = results.groupingSets([["terminal_state"], ["difficulty"], []], "terminal_state", "difficulty").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("ok"),
        F.count("retrieval_recall").alias("with_recall"), F.avg("retrieval_recall").alias("recall"))

    def row(when: Column, metric: str, key: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value")))

    whole, accuracy = F.col("g") == 3, _ratio(F.col("ok"), F.col("n"))
    rows = F.array(
        row(whole, "pass@1", F.lit(None), accuracy),
        row(whole & F.col("recall").isNotNull(), "retrieval_recall", F.col("with_recall"), F.round("recall", 6)),
        row(F.col("g") == 1, "terminal_state", F.col("terminal_state"), F.col("n")),
        row(F.col("g") == 2, "pass@1_by_difficulty", F.coalesce("difficulty", F.lit("None")), accuracy),
    )
    return sets.select(F.inline(F.filter(rows, lambda x: x.isNotNull())))


def derive_pass1(results: DataFrame) -> DataFrame:
    """pass@1 view of a pass@k run.

    Correct only when correct on the first attempt; a retried run becomes an
    attempt-1 execution error; tokens are split evenly per attempt (integer
    division), latency by float division; recall and provider cost are dropped.
    """
    first = F.col("correct") & (F.col("attempts") == 1)
    share = F.when(F.col("attempts") > 0, F.col("attempts")).otherwise(F.lit(1)).cast("long")
    state = (
        F.when(first, F.lit("success"))
        .when(F.col("attempts") > 1, F.lit("execution_error_final"))
        .otherwise(F.col("terminal_state"))
    )
    return results.withColumns(
        {
            "correct": first,
            "terminal_state": state,
            "input_tokens": F.floor(F.col("input_tokens") / share).cast("long"),
            "output_tokens": F.floor(F.col("output_tokens") / share).cast("long"),
            "latency_ms": F.col("latency_ms") / share,
            "attempts": F.lit(1).cast("long"),
            "retrieval_recall": F.lit(None).cast("double"),
            "provider_cost_usd": F.lit(None).cast("double"),
        }
    )


def price_of(model: str) -> tuple[float, float] | None:
    """Price of one model id (exact first, then its last path segment)."""
    table = {m: (i, o) for m, i, o in PRICES}
    return table.get(model) or table.get(model.rsplit("/", 1)[-1])


def twin_report(pass1: DataFrame, passk: DataFrame, model: str) -> DataFrame:
    """pass@1 vs pass@k on the same cases: gap, recovery, added attempts/latency/cost."""
    a = pass1.select("case_id", F.col("correct").alias("c1"), F.col("attempts").alias("a1"),
                     F.col("latency_ms").alias("l1"), F.col("input_tokens").alias("i1"), F.col("output_tokens").alias("o1"))
    b = passk.select("case_id", F.col("correct").alias("ck"), F.col("attempts").alias("ak"),
                     F.col("latency_ms").alias("lk"), F.col("input_tokens").alias("ik"), F.col("output_tokens").alias("ok"))
    j = a.join(b, "case_id", "full_outer")
    agg = j.agg(
        F.count("c1").alias("n1"), F.count_if(F.col("c1")).alias("n_correct_1"),
        F.count("ck").alias("nk"), F.count_if(F.col("ck")).alias("n_correct_k"),
        F.count_if(~F.col("c1")).alias("failed_1"),
        F.count_if(~F.col("c1") & F.coalesce(F.col("ck"), F.lit(False))).alias("recovered"),
        F.sum("a1").alias("attempts_1"), F.sum("ak").alias("attempts_k"),
        F.sum("l1").alias("latency_1"), F.sum("lk").alias("latency_k"),
        F.sum("i1").alias("in_1"), F.sum("o1").alias("out_1"), F.sum("ik").alias("in_k"), F.sum("ok").alias("out_k"),
    )
    price = price_of(model)
    pi, po = (F.lit(price[0]), F.lit(price[1])) if price else (F.lit(None).cast("double"),) * 2
    priced = agg
    cost_k = (F.col("in_k") * pi + F.col("out_k") * po) / F.lit(TOKENS_PER_MILLION)
    cost_1 = (F.col("in_1") * pi + F.col("out_1") * po) / F.lit(TOKENS_PER_MILLION)
    p1 = _ratio(F.col("n_correct_1"), F.col("n1"))
    pk = _ratio(F.col("n_correct_k"), F.col("nk"))
    return priced.select(
        F.col("n1").cast("long").alias("total"),
        F.col("n_correct_1").cast("long").alias("n_correct_1"),
        F.col("n_correct_k").cast("long").alias("n_correct_k"),
        p1.alias("pass_at_1"),
        pk.alias("pass_at_k"),
        F.round(pk - p1, 9).alias("gap"),
        _ratio(F.col("recovered"), F.col("failed_1")).alias("recovery_rate"),
        (F.col("attempts_k") - F.col("attempts_1")).cast("long").alias("added_attempts"),
        F.round(F.col("latency_k") - F.col("latency_1"), 6).alias("added_latency_ms"),
        F.round(cost_k - cost_1, 9).alias("added_cost_usd"),
    )


def twin_from_passk(passk: DataFrame, model: str) -> DataFrame:
    """M11 + M12 in one pass: the twin report of a pass@k run against its own derived pass@1 view.

    The derived view is a per-row function of the same rows (first-attempt
    correctness, per-attempt token and latency shares), so one aggregation
    replaces the join of the run with itself.
    """
    share = F.when(F.col("attempts") > 0, F.col("attempts")).otherwise(F.lit(1)).cast("long")
    c1 = F.col("correct") & (F.col("attempts") == 1)
    agg = passk.agg(
        F.count(F.lit(1)).alias("n1"), F.count_if(c1).alias("n_correct_1"), F.count_if(F.col("correct")).alias("n_correct_k"),
        F.count_if(~c1).alias("failed_1"), F.count_if(~c1 & F.col("correct")).alias("recovered"),
        F.count(F.lit(1)).alias("attempts_1"), F.sum("attempts").alias("attempts_k"),
        F.sum(F.col("latency_ms") / share).alias("latency_1"), F.sum("latency_ms").alias("latency_k"),
        F.sum(F.floor(F.col("input_tokens") / share)).alias("in_1"), F.sum(F.floor(F.col("output_tokens") / share)).alias("out_1"),
        F.sum("input_tokens").alias("in_k"), F.sum("output_tokens").alias("out_k"),
    )
    return _twin_select(agg, model)


def _twin_select(agg: DataFrame, model: str) -> DataFrame:
    price = price_of(model)
    pi, po = (F.lit(price[0]), F.lit(price[1])) if price else (F.lit(None).cast("double"),) * 2
    cost_k = (F.col("in_k") * pi + F.col("out_k") * po) / F.lit(TOKENS_PER_MILLION)
    cost_1 = (F.col("in_1") * pi + F.col("out_1") * po) / F.lit(TOKENS_PER_MILLION)
    p1 = _ratio(F.col("n_correct_1"), F.col("n1"))
    pk = _ratio(F.col("n_correct_k"), F.col("n1"))
    return agg.select(
        F.col("n1").cast("long").alias("total"),
        F.col("n_correct_1").cast("long").alias("n_correct_1"),
        F.col("n_correct_k").cast("long").alias("n_correct_k"),
        p1.alias("pass_at_1"),
        pk.alias("pass_at_k"),
        F.round(pk - p1, 9).alias("gap"),
        _ratio(F.col("recovered"), F.col("failed_1")).alias("recovery_rate"),
        (F.col("attempts_k") - F.col("attempts_1")).cast("long").alias("added_attempts"),
        F.round(F.col("latency_k") - F.col("latency_1"), 6).alias("added_latency_ms"),
        F.round(cost_k - cost_1, 9).alias("added_cost_usd"),
    )


def provider_table(results: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per model: pass@1 (derived), pass@k, cost on its basis, latency, provider errors."""
    # pass@1 is a per-row function of the pass@k run: no self-join needed.
    base = results.withColumn("correct_1", F.col("correct") & (F.col("attempts") == 1))
    agg = base.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("correct_1")).alias("n_correct_1"),
        F.count_if(F.col("correct")).alias("n_correct_k"),
        F.sum("provider_cost_usd").alias("provider_cost"),
        F.sum("input_tokens").alias("tin"),
        F.sum("output_tokens").alias("tout"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.count_if(F.col("error").startswith(PROVIDER_ERROR_PREFIX)).alias("provider_errors"),
        F.min("case_id").alias("first_case"),
    )
    priced = list_cost(agg, prices, "model", "tin", "tout")
    is_or = F.col("model").startswith(OPENROUTER_PREFIX)
    return priced.select(
        "model",
        F.col("total").cast("long").alias("total"),
        F.col("n_correct_1").cast("long").alias("n_correct_1"),
        F.col("n_correct_k").cast("long").alias("n_correct_k"),
        _ratio(F.col("n_correct_1"), F.col("total")).alias("pass1"),
        _ratio(F.col("n_correct_k"), F.col("total")).alias("passk"),
        F.when(is_or, F.col("provider_cost")).otherwise(F.col("list_cost_usd")).alias("cost_usd"),
        F.when(is_or, F.lit("openrouter")).otherwise(F.lit("direct-list")).alias("cost_basis"),
        "mean_latency_ms",
        F.col("provider_errors").cast("long").alias("provider_errors"),
        "first_case",
    )


def best_model(table: DataFrame) -> DataFrame:
    """Argmax of pass@1; the first model (by first case) wins ties."""
    return table.agg(
        F.max_by("model", F.struct(F.col("pass1"), -F.col("first_case"))).alias("best_model"),
        F.max("pass1").alias("best_pass1"),
        F.count(F.lit(1)).alias("n_models"),
    ).select("best_model", "best_pass1", F.col("n_models").cast("long").alias("n_models"))


def run_report(results: DataFrame, version: Column, fingerprint: Column, slice_name: str, k: int) -> DataFrame:
    """A run report pinned to a prompt: total, n_correct_1 (derived) and n_correct_k."""
    return results.withColumn("c1", F.col("correct") & (F.col("attempts") == 1)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("c1")).alias("n_correct_1"),
        F.count_if(F.col("correct")).alias("n_correct_k"),
        F.min("model").alias("model"),
    ).select(
        version.alias("prompt_version"), fingerprint.alias("prompt_fingerprint"), "model",
        F.lit(slice_name).alias("slice_name"), F.lit(k).alias("k"),
        F.col("total").cast("long").alias("total"), F.col("n_correct_1").cast("long").alias("n_correct_1"),
        F.col("n_correct_k").cast("long").alias("n_correct_k"),
    )


def report_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """Δpass@1, Δpass@k, verdict, same-fingerprint noise flag and grain (1/n).

    Both reports are one row each: tagged, stacked and folded by one global
    aggregate (no join).
    """
    cols = ["prompt_fingerprint", "total", "n_correct_1", "n_correct_k"]
    both = base.select(F.lit("b").alias("_s"), *cols).unionByName(head.select(F.lit("h").alias("_s"), *cols))
    pick = lambda side, c: F.max(F.when(F.col("_s") == side, F.col(c))).alias(f"{side}_{c}")
    j = both.agg(*[pick(side, c) for side in ("b", "h") for c in cols])
    p = lambda n, t: _ratio(F.col(n), F.col(t))
    d1 = p("h_n_correct_1", "h_total") - p("b_n_correct_1", "b_total")
    dk = p("h_n_correct_k", "h_total") - p("b_n_correct_k", "b_total")
    same = F.col("b_prompt_fingerprint") == F.col("h_prompt_fingerprint")
    return j.select(
        F.round(d1, 9).alias("delta_pass1"),
        F.round(dk, 9).alias("delta_passk"),
        F.when((d1 < 0) | (dk < 0), F.lit("regression")).when((d1 > 0) | (dk > 0), F.lit("improvement")).otherwise(F.lit("none")).alias("verdict"),
        same.alias("same_fingerprint"),
        _ratio(F.lit(1.0), F.col("b_total")).alias("grain"),
    )


def batch_session_id(label: Column, model: Column, prompt: Column, ts: Column) -> Column:
    """``label:model[:prompt]:UTC date``; an empty prompt is omitted."""
    return F.concat_ws(":", label, model, F.nullif(prompt, F.lit("")), F.date_format(ts, "yyyy-MM-dd"))
