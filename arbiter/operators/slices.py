"""Stratified, seeded question slices.

Eligibility is a join against per-db table counts; allocation across
difficulty strata is largest-remainder over the (tiny) strata table; the
seeded draw orders each stratum by ``md5(seed|id)`` and keeps an exact top-n
in two bounded stages, so a stratum holding most questions never lands in
one task.  The reference draws with Python's Mersenne Twister, which no
engine reproduces; ``md5`` ordering is deterministic and portable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.operators.profile import top_n_per_group

# Slice presets (name, min_tables, max_tables, n, seed).
PRESETS = (
    ("small", 0, 5, 50, 20260611),
    ("large", 6, 10**9, 40, 20260613),
    ("ci", 0, 5, 12, 20260619),
    ("holdout", 0, 5, 100, 20260626),
    ("wide", 0, 5, 250, 20260630),
)


#: (name, least tables, most tables, questions, seed).
Preset = tuple[str, int, int, int, int]


def seeded_key(seed: Column | int, qid: Column) -> Column:
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", s.cast("string"), qid.cast("string")))


def largest_remainder(sizes: DataFrame, n: Column | int, key: str = "stratum", by: list[str] | None = None) -> DataFrame:
    """K1: exact split of ``n`` over strata proportional to ``size``; leftovers to largest fractions, ties by key."""
    by = by or []
    nn = n if isinstance(n, Column) else F.lit(n)
    total = F.sum("size").over(Window.partitionBy(*by)) if by else F.sum("size").over(Window.partitionBy())
    s = sizes.withColumn("_total", total).withColumn("_n", nn)
    raw = F.when(F.col("_total") > 0, F.col("_n") * F.col("size") / F.col("_total")).otherwise(F.lit(0.0))
    s = s.withColumn("_raw", raw).withColumn("_floor", F.floor("_raw").cast("long"))
    left = F.col("_n") - F.sum("_floor").over(Window.partitionBy(*by)) if by else F.col("_n") - F.sum("_floor").over(Window.partitionBy())
    w = Window.partitionBy(*by).orderBy(F.desc(F.col("_raw") - F.col("_floor")), F.asc(key))
    s = s.withColumn("_left", left).withColumn("_rk", F.row_number().over(w))
    return s.select(*by, key, "size", (F.col("_floor") + F.when(F.col("_rk") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("alloc"))


def eligible(questions: DataFrame, table_counts: DataFrame, min_tables: int, max_tables: int) -> DataFrame:
    tc = table_counts.filter((F.col("table_count") >= min_tables) & (F.col("table_count") <= max_tables))
    return questions.join(tc.select("db_id"), "db_id", "left_semi")


def stratified_draw(pool: DataFrame, n: int | Column, seed: int, n_max: int | None = None) -> DataFrame:
    """K2 core: ``n`` ids from ``pool`` (question_id, difficulty) keeping the difficulty mix.

    ``n`` may be a column (e.g. a scalar subquery); ``n_max`` bounds it for the
    first top-n stage.  ``n`` is capped at the pool size.
    """
    sizes = pool.groupBy(F.col("difficulty").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    nn = n if isinstance(n, Column) else F.lit(n)
    n_eff = F.greatest(F.least(nn, F.sum("size").over(Window.partitionBy())), F.lit(0))
    alloc = largest_remainder(sizes, n_eff).select(F.col("stratum").alias("difficulty"), "alloc")
    keyed = pool.select("question_id", "difficulty", seeded_key(seed, F.col("question_id")).alias("_k"))
    top = top_n_per_group(keyed, ["difficulty"], [F.asc("_k"), F.asc("question_id")], n_max or int(n),
                          bucket_key=F.xxhash64("question_id"), rank_name="_r")
    return top.join(F.broadcast(alloc), "difficulty").filter(F.col("_r") <= F.col("alloc")).select("question_id", "difficulty")


def select_slice(questions: DataFrame, table_counts: DataFrame, min_tables: int, max_tables: int, n: int, seed: int) -> DataFrame:
    """K2: eligible by table count, stratified by difficulty, seeded; (question_id, difficulty)."""
    return stratified_draw(eligible(questions, table_counts, min_tables, max_tables), n, seed)


def preset_candidates(questions: DataFrame, table_counts: DataFrame, presets: Sequence[Preset], slack: int = 0) -> DataFrame:
    """K7: one job for all presets: (preset, difficulty, size, table_count, question_id, rank).

    Every question is dealt to the presets that its database is eligible for;
    per preset and difficulty the pool size and the first ``n + slack``
    questions in seeded order stay.  The result is bounded by presets x
    difficulties x n, so draws that depend on each other (hold-out, superset)
    work on it alone; ``slack`` is the most that other draws can take away.
    """
    rules = F.array(*[F.struct(F.lit(p[0]).alias("preset"), F.lit(p[1]).alias("lo"), F.lit(p[2]).alias("hi"), F.lit(p[4]).alias("seed")) for p in presets])
    known = questions.join(table_counts.select("db_id", "table_count"), "db_id")
    fits = F.filter(rules, lambda p: (F.col("table_count") >= p["lo"]) & (F.col("table_count") <= p["hi"]))
    dealt = known.select("question_id", "difficulty", "table_count", F.explode(fits).alias("p")).select(
        "question_id", "difficulty", "table_count", F.col("p.preset").alias("preset"), seeded_key(F.col("p.seed"), F.col("question_id")).alias("_k")
    )
    sizes = dealt.groupBy("preset", "difficulty").agg(F.count(F.lit(1)).alias("size"))
    most = max(p[3] for p in presets) + slack
    top = top_n_per_group(dealt, ["preset", "difficulty"], [F.asc("_k"), F.asc("question_id")], most,
                          bucket_key=F.xxhash64("question_id"), rank_name="rank")
    return top.join(sizes, ["preset", "difficulty"]).select("preset", "difficulty", "size", "table_count", "question_id", "rank")


def draw_preset(candidates: DataFrame, preset: Preset, excluded: DataFrame | None = None, taken: Column | int = 0) -> DataFrame:
    """K2, K3, K6: (question_id, difficulty, table_count) of one preset, from ``preset_candidates``.

    ``excluded`` (question_id, difficulty, table_count) leaves the pool first;
    ``taken`` counts ids that the slice already has.
    """
    name, lo, hi, n, _ = preset
    own = candidates.where(F.col("preset") == name)
    sizes = own.groupBy(F.col("difficulty").alias("stratum")).agg(F.max("size").alias("size"))
    if excluded is not None:
        inside = excluded.where((F.col("table_count") >= lo) & (F.col("table_count") <= hi)).dropDuplicates(["question_id"])
        gone = inside.groupBy(F.col("difficulty").alias("stratum")).agg(F.count(F.lit(1)).alias("gone"))
        sizes = sizes.join(gone, "stratum", "left").select("stratum", (F.col("size") - F.coalesce("gone", F.lit(0))).alias("size"))
        own = own.join(inside.select("question_id"), "question_id", "left_anti")
    taken = taken if isinstance(taken, Column) else F.lit(taken)
    wanted = F.greatest(F.least(F.lit(n) - taken, F.sum("size").over(Window.partitionBy())), F.lit(0))
    alloc = largest_remainder(sizes, wanted).select(F.col("stratum").alias("difficulty"), "alloc")
    place = F.row_number().over(Window.partitionBy("difficulty").orderBy("rank"))
    return own.withColumn("_r", place).join(alloc, "difficulty").where("_r <= alloc").select("question_id", "difficulty", "table_count")


def superset_draw(candidates: DataFrame, preset: Preset, base: DataFrame, exclude: DataFrame) -> DataFrame:
    """K3: ``base`` kept verbatim, topped up from the preset's pool without base and ``exclude``."""
    size = base.agg(F.count(F.lit(1))).scalar()
    return base.unionByName(draw_preset(candidates, preset, base.unionByName(exclude), size))


def ineligible_base(base: DataFrame, questions: DataFrame, table_counts: DataFrame, min_tables, max_tables) -> DataFrame:
    """K3 guard: base ids that are not eligible."""
    return base.join(eligible(questions, table_counts, min_tables, max_tables), "question_id", "left_anti").select("question_id")


def require_eligible(base: DataFrame, questions: DataFrame, table_counts: DataFrame, min_tables, max_tables) -> DataFrame:
    """K3 guard: (n_base) of an eligible base; running it fails when any base id is not eligible."""
    known = eligible(questions, table_counts, min_tables, max_tables).select("question_id", F.lit(True).alias("_ok"))
    n_bad = F.count_if(F.col("_ok").isNull())
    message = F.concat(n_bad.cast("string"), F.lit(" base question(s) are not eligible"))
    return base.select("question_id").join(known, "question_id", "left").agg(
        F.when(n_bad > 0, F.raise_error(message).cast("long")).otherwise(F.count(F.lit(1))).cast("long").alias("n_base")
    )


def mix_counts(slice_df: DataFrame, questions: DataFrame) -> DataFrame:
    """K5: counts per difficulty and per db in one GROUPING SETS pass."""
    j = slice_df.select("question_id").join(questions.select("question_id", "db_id", "difficulty"), "question_id")
    return j.sparkSession.sql("""
        SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'db_id' END AS cut,
               coalesce(difficulty, db_id) AS key, count(*) AS n
        FROM {slice} GROUP BY GROUPING SETS ((difficulty), (db_id))""", slice=j)
