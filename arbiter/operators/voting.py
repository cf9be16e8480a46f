"""Candidate voting: equivalence classes of result sets and majority vote.

Two candidates are one class when their canonical rows are equal as
multisets (default rules, order never significant).  Each candidate's rows
reduce to an order-free fingerprint -- row count plus two independent 64-bit
hash sums kept as DECIMAL(38,0) -- by a partial aggregate, so no candidate's
rows ever meet in one task and no pairs of candidates are formed.  A
collision needs both 64-bit sums and the count to agree by chance;
``exact_classes`` rules it out: each member is compared row by row with its
class's representative only, and what differs becomes a class of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbiter.operators.compare import DEFAULT_RULES, Side, apply_rules, _cells
from arbiter.session import stable

#: Members of a class that ``exact_classes`` compares at once.
SLOTS = 16


def _candidate_cells(rows: DataFrame, values: Sequence[str], rules: Sequence[str]) -> DataFrame:
    """Canonical rows (question_id STRUCT<question_id, idx>, cells)."""
    side = Side(
        rows.select(
            F.struct("question_id", "idx").alias("question_id"),
            F.col("row_pos"),
            F.lit(False).alias("order_significant"),
            *values,
        ),
        tuple(values),
    )
    return _cells(apply_rules(side, rules))


def candidate_fingerprints(
    rows: DataFrame,
    candidates: DataFrame,
    values: Sequence[str],
    rules: Sequence[str] = DEFAULT_RULES,
) -> DataFrame:
    """(question_id, idx, errored, fp) for every candidate; empty results get the empty fingerprint."""
    cells = _candidate_cells(rows, values, rules)
    # xxhash64 passes over NULL, so each field is hashed with a flag: (1, NULL) and (NULL, 1) stay apart.
    fields = [F.col(f"cells.{f.name}") for f in cells.schema["cells"].dataType.fields]
    flagged = [x for f in fields for x in (f.isNull(), f)]
    h1 = F.xxhash64(F.lit(len(fields)), *flagged).cast("decimal(38,0)")
    h2 = F.xxhash64(F.lit("arbiter-fp"), *flagged).cast("decimal(38,0)")
    per = cells.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(h1).alias("s1"), F.sum(h2).alias("s2")
    ).select(
        F.col("question_id.question_id").alias("question_id"),
        F.col("question_id.idx").alias("idx"),
        "n",
        "s1",
        "s2",
    )
    fp = F.concat_ws(
        ":",
        F.coalesce(F.col("n"), F.lit(0)).cast("string"),
        F.coalesce(F.col("s1"), F.lit(0)).cast("string"),
        F.coalesce(F.col("s2"), F.lit(0)).cast("string"),
    )
    return candidates.select("question_id", "idx", "errored").join(per, ["question_id", "idx"], "left").select(
        "question_id", "idx", "errored", fp.alias("fp")
    )


def exact_classes(rows: DataFrame, fingerprints: DataFrame, values: Sequence[str], rules: Sequence[str] = DEFAULT_RULES) -> DataFrame:
    """``fingerprints`` whose classes are equal row by row: a member that differs from its class's first one gets another fingerprint.

    Rows are counted per (class, row), keyed by the whole row, so a hot question
    spreads over the cluster; ``SLOTS`` members at once, the class's first one
    among them, have a counter each, so equal rows of a task combine before the
    one shuffle.  Members that differ are compared among themselves in another
    round; without a collision there is one round.
    """
    cells = _candidate_cells(rows, values, rules).select(F.col("question_id.question_id").alias("question_id"), F.col("question_id.idx").alias("idx"), "cells")
    fingerprints = stable(fingerprints)
    known, open_, round_ = fingerprints, fingerprints.where(~F.col("errored")), 0
    while True:
        first = open_.groupBy("question_id", "fp").agg(F.array_sort(F.collect_set("idx")).alias("everyone")).where("size(everyone) > 1")
        placed = first.select("question_id", F.expr("everyone[0]").alias("rep"), F.size("everyone").alias("size"), F.posexplode("everyone").alias("pos", "idx"))
        others = SLOTS - 1
        part = F.when(F.col("pos") == 0, F.expr(f"sequence(0, (size - 2) div {others})")).otherwise(F.expr(f"array((pos - 1) div {others})"))
        slot = F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.expr(f"1 + (pos - 1) % {others}"))
        members = stable(placed.select("question_id", "idx", "rep", slot.cast("int").alias("slot"), F.explode(part).alias("part")))
        width = 1 + (members.agg(F.max("slot")).collect()[0][0] or 0)
        counts = [F.count_if(F.col("slot") == k).alias(f"n{k}") for k in range(width)]
        per_row = cells.join(members, ["question_id", "idx"]).groupBy("question_id", "rep", "part", "cells").agg(*counts)
        differ = F.array(F.lit(None).cast("int"), *(F.when(F.col(f"n{k}") != F.col("n0"), F.lit(k)) for k in range(1, width)))
        differing = per_row.select("question_id", "rep", "part", F.explode(differ).alias("slot")).where(F.col("slot").isNotNull()).distinct()
        other = members.join(differing, ["question_id", "rep", "part", "slot"]).select("question_id", "idx").distinct()
        split = stable(open_.join(other, ["question_id", "idx"], "left_semi"))
        if split.isEmpty():
            return known
        round_ += 1
        renamed = split.select("question_id", "idx", F.concat("fp", F.lit(f"#{round_}")).alias("other_fp"))
        known = known.join(renamed, ["question_id", "idx"], "left").select("question_id", "idx", "errored", F.coalesce("other_fp", "fp").alias("fp"))
        open_ = known.join(split, ["question_id", "idx"], "left_semi")


def majority_vote(fingerprints: DataFrame) -> DataFrame:
    """One VoteOutcome row per question.

    Largest class wins, a size tie goes to the class with the earliest index;
    errored candidates do not vote; when all errored, index 0 with agreement 0.
    """
    counts = fingerprints.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(~F.col("errored")).alias("n_votable"),
    )
    classes = (
        fingerprints.filter(~F.col("errored"))
        .groupBy("question_id", "fp")
        .agg(F.count(F.lit(1)).alias("size"), F.min("idx").alias("first_idx"))
    )
    w = Window.partitionBy("question_id").orderBy(F.desc("size"), F.asc("first_idx"))
    ranked = classes.select(
        "question_id",
        "size",
        "first_idx",
        F.row_number().over(w).alias("rk"),
        F.max("size").over(Window.partitionBy("question_id")).alias("top"),
        F.count(F.lit(1)).over(Window.partitionBy("question_id")).alias("n_groups"),
    )
    per_q = ranked.groupBy("question_id").agg(
        F.max(F.when(F.col("rk") == 1, F.col("first_idx"))).alias("selected_index"),
        F.max("top").alias("agreement"),
        F.max("n_groups").alias("n_groups"),
        (F.count_if(F.col("size") == F.col("top")) > 1).alias("tie"),
    )
    return counts.join(per_q, "question_id", "left").select(
        "question_id",
        F.coalesce("selected_index", F.lit(0)).cast("long").alias("selected_index"),
        F.coalesce("agreement", F.lit(0)).cast("long").alias("agreement"),
        F.col("n_candidates").cast("long").alias("n_candidates"),
        F.col("n_votable").cast("long").alias("n_votable"),
        F.coalesce("n_groups", F.lit(0)).cast("long").alias("n_groups"),
        F.coalesce("tie", F.lit(False)).alias("tie"),
    )


def votable(runs: DataFrame) -> DataFrame:
    """``errored`` iff the run has an error or produced no result (empty stays votable)."""
    return runs.withColumn("errored", F.col("error").isNotNull() | F.col("has_result").isNull() | ~F.col("has_result"))


def select_by_vote(outcomes: DataFrame, rows: DataFrame) -> DataFrame:
    """The selected candidate's rows (question_id, row_pos, values...)."""
    pick = outcomes.select("question_id", F.col("selected_index").alias("idx"))
    return rows.join(pick, ["question_id", "idx"], "left_semi").drop("idx")


def check_k(candidates: DataFrame) -> DataFrame:
    """k per question; a question with k < 1 cannot be voted (reported, not dropped)."""
    return candidates.groupBy("question_id").agg(F.count(F.lit(1)).alias("k")).withColumn("valid", F.col("k") >= 1)


def agreement_distribution(outcomes: DataFrame) -> DataFrame:
    """unanimous / majority / no_majority counts, zero-filled."""
    bucket = (
        F.when((F.col("n_votable") >= 1) & (F.col("n_groups") == 1), F.lit("unanimous"))
        .when(F.col("agreement") * 2 > F.col("n_votable"), F.lit("majority"))
        .otherwise(F.lit("no_majority"))
    )
    counted = outcomes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spark = outcomes.sparkSession
    dim = spark.createDataFrame([("unanimous", 0), ("majority", 1), ("no_majority", 2)], "bucket string, ord int")
    return F.broadcast(dim).join(counted, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def shuffle_field_order(catalog: DataFrame, seed: int) -> DataFrame:
    """Seeded permutation of the columns inside each table; seed 0 keeps declaration order."""
    if seed == 0:
        key = F.col("ordinal")
    else:
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("table_name"), F.col("column_name")))
    w = Window.partitionBy("db_id", "table_name").orderBy(key, F.col("ordinal"))
    return catalog.withColumn("shuffled_ordinal", F.row_number().over(w))
