"""Query-log audit: rule cascades over per-query feature tables, failure taxonomy, fan-out.

SQL parsing is not rebuilt: callers pass the features a parser extracted
(statement kinds, join counts, flags, referenced tables, join pairs).  Each
cascade is one CASE chain per row; set logic over references is anti-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MAX_JOINS = 4
JOIN_TAGS = ("table_mismatch", "join_mismatch")
FLAT_LOSS = 0.02
ELIGIBLE_STATES = ("execution_error_final", "retry_exhausted")


def _fmt(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)


def guard(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """G1: (query_id, decision, rule, reason), first violated rule wins; ``keep`` names features to carry along."""
    f = F.col
    rules = [
        (f("sql_empty"), None, None),
        (~f("parsed"), "parse_error", F.lit("candidate did not parse under the named or generic dialect")),
        (f("write_kind").isNotNull(), "read_only", _fmt("%s mutates data or schema; the gate is read-only", f("write_kind"))),
        (f("write_command").isNotNull(), "read_only", _fmt("%s writes data; the gate is read-only", f("write_command"))),
        (f("n_statements") > 1, "dangerous_op",
         _fmt("%d statements in one candidate; stacked queries are not permitted", f("n_statements"))),
        (f("meta_command").isNotNull(), "dangerous_op",
         _fmt("%s is a side-effecting meta-command; not permitted", f("meta_command"))),
        (f("unknown_command").isNotNull(), "dangerous_op",
         _fmt("%s is an unsupported/side-effecting command; not permitted", f("unknown_command"))),
        (f("unconstrained_join") & ~f("has_where"), "cost",
         F.lit("join with no ON/USING predicate and no WHERE; this is a cartesian product")),
        (f("n_joins") > MAX_JOINS, "cost", _fmt(f"%d joins exceeds the complexity budget of {MAX_JOINS}", f("n_joins"))),
        (f("bare_star_scan"), "cost", F.lit("SELECT * with no WHERE or LIMIT; this is an unbounded full scan")),
    ]
    decision = F.lit("allow")
    rule: Column = F.lit(None).cast("string")
    reason: Column = F.lit(None).cast("string")
    for cond, name, why in reversed(rules):
        decision = F.when(cond, F.lit("reject" if name else "allow")).otherwise(decision)
        rule = F.when(cond, F.lit(name).cast("string")).otherwise(rule)
        reason = F.when(cond, why if why is not None else F.lit(None).cast("string")).otherwise(reason)
    return features.select("query_id", decision.alias("decision"), rule.alias("rule"), reason.alias("reason"), *keep)


def references_minus_ctes(refs: DataFrame, ctes: DataFrame) -> DataFrame:
    """Referenced table names that are not the query's own CTEs (case-insensitive)."""
    db = [c for c in ("db_id",) if c in refs.columns]
    r = refs.select("query_id", *db, F.lower("table_name").alias("table_name"))
    c = ctes.select("query_id", F.lower("cte_name").alias("table_name"))
    return r.join(c, ["query_id", "table_name"], "left_anti").distinct()


def table_scope(refs: DataFrame, allowed: DataFrame) -> DataFrame:
    """(query_id, out_of_scope, reason) for queries touching tables outside their own db's tables.

    ``refs`` and ``allowed`` carry ``db_id``; without it (one database) the
    allowed set holds for every query.
    """
    keys = [c for c in ("db_id",) if c in allowed.columns]
    a = allowed.select(*keys, F.lower("table_name").alias("table_name")).distinct()
    out = refs.join(a, [*keys, "table_name"], "left_anti")
    return out.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("table_name")), ", ").alias("out_of_scope")).withColumn(
        "reason", F.concat(F.lit("references table(s) outside this db's scope: "), F.col("out_of_scope"))
    )


def guard_with_scope(features: DataFrame, scope: DataFrame) -> DataFrame:
    """G1 then G2: a query the rules allow is still rejected when it leaves the db's tables."""
    g = (
        guard(features, ["sql_empty"])
        .join(scope.select("query_id", "out_of_scope", F.col("reason").alias("scope_reason")), "query_id", "left")
    )
    scoped = (F.col("decision") == "allow") & F.col("out_of_scope").isNotNull() & ~F.col("sql_empty")
    return g.select(
        "query_id",
        F.when(scoped, F.lit("reject")).otherwise(F.col("decision")).alias("decision"),
        F.when(scoped, F.lit("table_scope")).otherwise(F.col("rule")).alias("rule"),
        F.when(scoped, F.col("scope_reason")).otherwise(F.col("reason")).alias("reason"),
    )


def soundness(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(query_id, flagged, rule, reason): first of null_ordering, minmax_subquery, field_catenation; ``keep`` as in ``guard``."""
    f = F.col
    checks = [
        (f("min_col").isNotNull() & ~f("min_guarded"), "null_ordering",
         _fmt("min(%s) without a NOT NULL guard on %s: a NULL sorts first, so the minimum can be NULL-driven and wrong",
              f("min_col"), f("min_col"))),
        (f("asc_limit_col").isNotNull() & ~f("asc_limit_guarded"), "null_ordering",
         _fmt("ORDER BY %s ASC with LIMIT and no NOT NULL guard on %s: a NULL sorts first, so the top row can be "
              "NULL-driven and wrong", f("asc_limit_col"), f("asc_limit_col"))),
        (f("eq_subquery_agg").isNotNull(), "minmax_subquery",
         _fmt("= (SELECT %s(…) …) selects a row by matching a scalar %s subquery; ORDER BY … LIMIT 1 is the idiomatic form",
              f("eq_subquery_agg"), f("eq_subquery_agg"))),
        (f("n_concat_cols") >= 2, "field_catenation",
         _fmt("projection concatenates distinct fields (%s); the question likely wants them returned as separate columns",
              f("concat_cols"))),
    ]
    rule: Column = F.lit(None).cast("string")
    reason: Column = F.lit(None).cast("string")
    for cond, name, why in reversed(checks):
        rule = F.when(cond, F.lit(name)).otherwise(rule)
        reason = F.when(cond, why).otherwise(reason)
    return features.select("query_id", rule.isNotNull().alias("flagged"), rule.alias("rule"), reason.alias("reason"), *keep)


def null_order_hazard(df: DataFrame, table_name: str) -> DataFrame:
    """Per column, does the first ascending row hold NULL (NULLS FIRST engines)?"""
    cols = df.columns
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(table_name).alias("table_name"), F.lit(c).alias("column_name"),
                 F.col(c).cast("long").alias("n_null"), (F.col(c) > 0).alias("first_asc_is_null"))
        for c in cols
    ])).alias("s")).select("s.*")


def safe_top_k(df: DataFrame, col: str, k: int, tiebreak: list[str]) -> DataFrame:
    """G5 fix: lowest ``k`` non-NULL values, NULLs last (a top-k, so a limit is the feature)."""
    return df.orderBy(F.col(col).asc_nulls_last(), *[F.col(t).asc() for t in tiebreak]).limit(k)


def extreme_rows(df: DataFrame, col: str, kind: str = "min", group: list[str] | None = None) -> DataFrame:
    """Rows owning the min/max of ``col`` (ties kept), globally or per group.

    The extreme is an aggregate (scalar subquery, or per group a partial
    aggregate joined back), never a window over the whole table.
    """
    agg = F.min(col) if kind == "min" else F.max(col)
    if not group:
        return df.filter(F.col(col) == df.agg(agg).scalar())
    ext = df.groupBy(*group).agg(agg.alias("_ext"))
    return df.join(ext, group).filter(F.col(col) == F.col("_ext")).drop("_ext")


def first_extreme_row(df: DataFrame, col: str, key: str, kind: str = "min") -> DataFrame:
    """G6 (first only): the single row owning the extreme, ties broken by ``key``."""
    order = F.struct(F.col(col), -F.col(key)) if kind == "max" else F.struct(F.col(col), F.col(key))
    pick = F.max_by if kind == "max" else F.min_by
    return df.agg(pick(F.struct(*df.columns), order).alias("r")).select("r.*")


def spurious_joins(pairs: DataFrame, fk_edges: DataFrame) -> DataFrame:
    """Queries joining a table pair with no FK edge (undirected); a db with no FKs never flags."""
    e = fk_edges.select("db_id", F.array_sort(F.array(F.lower("a"), F.lower("b"))).alias("pair")).distinct()
    p = pairs.select("query_id", "db_id", F.array_sort(F.array(F.lower("a"), F.lower("b"))).alias("pair"))
    bad = p.join(e, ["db_id", "pair"], "left_anti").join(e.select("db_id").distinct(), "db_id", "left_semi")
    return bad.select("query_id").distinct().withColumn("spurious_join", F.lit(True))


def categorize(gold: DataFrame, cand: DataFrame, spurious: DataFrame | None = None) -> DataFrame:
    """(question_id, tags ARRAY<STRING>) from gold vs candidate feature rows."""
    g = gold.select([F.col(c).alias(f"g_{c}") if c != "question_id" else F.col(c) for c in gold.columns])
    c = cand.select([F.col(x).alias(f"c_{x}") if x != "question_id" else F.col(x) for x in cand.columns])
    j = g.join(c, "question_id")
    if spurious is not None:
        j = j.join(spurious.select(F.col("query_id").alias("question_id"), "spurious_join"), "question_id", "left")
    else:
        j = j.withColumn("spurious_join", F.lit(False))
    gt, ct = F.array_sort(F.array_distinct(F.col("g_tables"))), F.array_sort(F.array_distinct(F.col("c_tables")))
    ne = lambda a: ~F.col(f"g_{a}").eqNullSafe(F.col(f"c_{a}"))
    tags = F.array(
        F.when(gt != ct, F.lit("table_mismatch")),
        F.when(F.size(F.array_except(gt, ct)) > 0, F.lit("missing_table")),
        F.when(F.size(F.array_except(ct, gt)) > 0, F.lit("extra_table")),
        F.when(ne("n_joins"), F.lit("join_mismatch")),
        F.when(F.coalesce(F.col("spurious_join"), F.lit(False)), F.lit("spurious_join")),
        F.when(ne("aggs"), F.lit("aggregate_mismatch")),
        F.when(ne("group_by"), F.lit("group_by_mismatch")),
        F.when(ne("distinct"), F.lit("distinct_mismatch")),
        F.when(ne("where"), F.lit("where_mismatch")),
        F.when(ne("limit"), F.lit("limit_mismatch")),
        F.when(ne("n_select"), F.lit("projection_count_mismatch")),
    )
    found = F.filter(tags, lambda x: x.isNotNull())
    out = (
        F.when(~F.col("c_parsed"), F.array(F.lit("candidate_unparseable")))
        .when(~F.col("g_parsed"), F.array(F.lit("gold_unparseable")))
        .when(F.size(found) == 0, F.array(F.lit("shape_matches_value_level")))
        .otherwise(found)
    )
    return j.select("question_id", out.alias("tags"))


def tag_counts(tags: DataFrame, top: int | None = None) -> DataFrame:
    """Failures per tag, most common first (ties by tag); optionally the top few."""
    counts = tags.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).cast("long").alias("n"))
    if top is None:
        return counts
    return counts.orderBy(F.desc("n"), F.asc("tag")).limit(top)


def join_fanout(left: DataFrame, right: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """Exact output rows of an equi-join before running it: sum over keys of n_left * n_right.

    The products are decimals: they leave the range of a long just when the join is dangerous.
    """
    l_ = left.groupBy(F.col(lkey).alias("_k")).agg(F.count(F.lit(1)).alias("_nl"))
    r_ = right.groupBy(F.col(rkey).alias("_k")).agg(F.count(F.lit(1)).alias("_nr"))
    return l_.join(r_, "_k").agg(
        F.coalesce(F.sum(F.col("_nl").cast("decimal(19,0)") * F.col("_nr").cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,0)").alias("join_rows")
    )


def failure_records(results: DataFrame, cases: DataFrame, tags: DataFrame) -> DataFrame:
    """Every failed case with its question, both queries, what the comparator said, and its tags.

    ``results``: (question_id, db_id, difficulty, correct, terminal_state,
    candidate_sql, note); ``cases``: (question_id, question, gold_sql);
    ``tags``: (question_id, tags).  A case without a tag row has no tags.
    """
    failed = results.where(~F.col("correct"))
    return failed.join(cases.select("question_id", "question", "gold_sql"), "question_id").join(tags, "question_id", "left").select(
        "question_id", "db_id", "difficulty", "terminal_state", "question", "gold_sql", "candidate_sql", F.col("note").alias("comparator_reason"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def detector_mismatches(outcomes: DataFrame) -> DataFrame:
    """The outcomes whose verdict or rule is not the expected one, with the side that failed."""
    vmatch = F.col("actual_verdict") == F.col("expected_verdict")
    rmatch = F.col("expected_rule").isNull() | F.col("expected_rule").eqNullSafe(F.col("actual_rule"))
    return outcomes.where(~(vmatch & rmatch)).withColumn("mismatch", F.when(~vmatch, F.lit("verdict")).otherwise(F.lit("rule")))


def ab_lift(base: DataFrame, head: DataFrame) -> DataFrame:
    """Accuracy lift of ``head`` over ``base`` and the change of the join bucket; one row, whatever the batch sizes.

    Both sides are (correct, tags) per case, and ``recall`` where tables were
    retrieved; the two batches are stacked and folded by one global aggregate.
    An empty batch has accuracy 0.  The recall of ``head`` is the mean over its
    cases that have one, the missed recall the rest to 1; both NULL without any.
    """
    recall = F.col("recall").cast("double") if "recall" in head.columns else F.lit(None).cast("double")
    both = base.select(F.lit("a").alias("p"), "correct", "tags", F.lit(None).cast("double").alias("recall")).unionByName(
        head.select(F.lit("b").alias("p"), "correct", "tags", recall.alias("recall")))
    join_tags = F.array(*[F.lit(x) for x in JOIN_TAGS])
    counts = []
    for p in ("a", "b"):
        own = F.col("p") == p
        counts += [
            F.count_if(own).alias(f"{p}_total"), F.count_if(own & F.col("correct")).alias(f"{p}_correct"),
            F.count_if(own & ~F.col("correct") & F.arrays_overlap(F.col("tags"), join_tags)).alias(f"{p}_join_bucket"),
        ]

    def rate(p: str) -> Column:
        return F.when(F.col(f"{p}_total") > 0, F.col(f"{p}_correct") / F.col(f"{p}_total")).otherwise(F.lit(0.0))

    lift = rate("b") - rate("a")
    counts += [F.count("recall").alias("n_with_recall"), F.avg("recall").alias("mean_recall")]
    return both.agg(*counts).select(
        "a_correct", "b_correct", F.round(lift, 9).alias("lift"),
        F.when(lift > 0, F.lit("lift")).when(lift >= -FLAT_LOSS, F.lit("flat")).otherwise(F.lit("regression")).alias("verdict"),
        "a_join_bucket", "b_join_bucket",
        F.when(F.col("b_join_bucket") < F.col("a_join_bucket"), F.lit("shrank"))
        .when(F.col("b_join_bucket") > F.col("a_join_bucket"), F.lit("grew")).otherwise(F.lit("held")).alias("bucket"),
        "n_with_recall", F.round("mean_recall", 9).alias("recall"), F.round(1 - F.col("mean_recall"), 9).alias("missed_recall"),
    )


def detector_report(outcomes: DataFrame) -> DataFrame:
    """Catch rate, verdict agreement, rule agreement over (expected, actual) outcomes."""
    dangerous = F.col("expected_verdict") == "reject"
    caught = dangerous & (F.col("actual_verdict") == "reject")
    vmatch = F.col("actual_verdict") == F.col("expected_verdict")
    rmatch = F.col("expected_rule").isNull() | F.col("expected_rule").eqNullSafe(F.col("actual_rule"))
    a = outcomes.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(dangerous).alias("n_dangerous"), F.count_if(caught).alias("n_caught"),
        F.count_if(vmatch & rmatch).alias("n_agree"), F.bool_and(vmatch).alias("all_verdicts_match"),
        F.bool_and(rmatch).alias("all_rules_match"),
    )
    return a.select(
        F.col("total").cast("long"), F.col("n_dangerous").cast("long"), F.col("n_caught").cast("long"),
        F.when(F.col("n_dangerous") > 0, F.col("n_caught") / F.col("n_dangerous")).otherwise(F.lit(0.0)).alias("catch_rate"),
        F.col("n_agree").cast("long"), "all_verdicts_match", "all_rules_match",
    )
