"""slice_*: seeded stratified slices of questions derived from orders.

Questions: one per order, db_id = 'db' || o_custkey % 7, difficulty =
o_orderpriority.  Database k holds the first 4 + k catalog tables (by name),
so db0 and db1 are small schemas (<= 5 tables) and db2..db6 large ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators import catalog as C
from arbiter.operators import slices as K
from arbiter.plans.schema import STAR_SCHEMA
from arbiter.sources.fixtures import stable
from arbiter.sources.tables import TABLES, Tables

N_DBS = 7
PRESET = {name: (lo, hi, n, seed) for name, lo, hi, n, seed in K.PRESETS}


def questions(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select(
        F.col("o_orderkey").alias("question_id"),
        F.concat(F.lit("db"), (F.col("o_custkey") % N_DBS).cast("string")).alias("db_id"),
        F.col("o_orderpriority").alias("difficulty"),
    )


def db_tables(spark, sf_dir):
    """(db_id, table_name): db k holds catalog tables with ordinal <= 4 + k."""
    t = Tables(spark, sf_dir)
    cat = C.catalog_tables(C.catalog_from_frames(spark, "all", {n: getattr(t, n) for n in TABLES}))
    return cat.filter(F.col("table_ordinal") <= 4 + N_DBS - 1).select(
        "table_name",
        F.explode(F.sequence(F.greatest(F.col("table_ordinal") - 4, F.lit(0)), F.lit(N_DBS - 1))).alias("k"),
    ).select(F.concat(F.lit("db"), F.col("k").cast("string")).alias("db_id"), "table_name")


def table_counts(spark, sf_dir):
    """Tables per db."""
    return db_tables(spark, sf_dir).groupBy("db_id").agg(F.countDistinct("table_name").cast("long").alias("table_count"))


def slice_db_sizes(spark, sf_dir):
    """S4 with sizes: tables and total rows per db (one count per table, joined to the db map)."""
    from functools import reduce
    from pyspark.sql import DataFrame
    t = Tables(spark, sf_dir)
    rows = reduce(DataFrame.unionByName, [getattr(t, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n"))
                                          for n in TABLES])
    return db_tables(spark, sf_dir).join(rows, "table_name").groupBy("db_id").agg(
        F.countDistinct("table_name").cast("long").alias("table_count"), F.sum("n").cast("long").alias("n_rows"))


def _slice(spark, sf_dir, name):
    lo, hi, n, seed = PRESET[name]
    return K.select_slice(questions(spark, sf_dir), table_counts(spark, sf_dir), lo, hi, n, seed)


def slice_largest_remainder(spark, sf_dir):
    lo, hi, n, _ = PRESET["small"]
    pool = K.eligible(questions(spark, sf_dir), table_counts(spark, sf_dir), lo, hi)
    sizes = pool.groupBy(F.col("difficulty").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return K.largest_remainder(sizes, n).select("stratum", F.col("size").cast("long").alias("size"), "alloc")


def slice_small(spark, sf_dir):
    return _slice(spark, sf_dir, "small")


def slice_large(spark, sf_dir):
    return _slice(spark, sf_dir, "large")


def slice_ci(spark, sf_dir):
    return _slice(spark, sf_dir, "ci")


#: Presets drawn together: the hold-out leaves out the small and CI slices, the wide one the hold-out.
_TOGETHER = ("small", "ci", "holdout", "wide")


def _drawn(spark, sf_dir):
    """(small, ci, holdout, wide) from one bounded candidate table: the questions are scanned in one job."""
    presets = [(name, *PRESET[name]) for name in _TOGETHER]
    by = {p[0]: p for p in presets}
    slack = sum(p[3] for p in presets if p[0] != "wide")
    cands = stable(K.preset_candidates(questions(spark, sf_dir), table_counts(spark, sf_dir), presets, slack))
    small, ci = K.draw_preset(cands, by["small"]), K.draw_preset(cands, by["ci"])
    hold = stable(K.draw_preset(cands, by["holdout"], small.unionByName(ci)))
    return small, ci, hold, K.superset_draw(cands, by["wide"], small, hold)


def slice_holdout(spark, sf_dir):
    """K6: dev (small) and CI ids are removed before sampling."""
    return _drawn(spark, sf_dir)[2].select("question_id", "difficulty")


def slice_wide(spark, sf_dir):
    """K3: superset of the small slice, never meeting the hold-out."""
    return _drawn(spark, sf_dir)[3].select("question_id", "difficulty")


def slice_base_guard(spark, sf_dir):
    """K3 guard over the small slice as the base of the wide one: its size, or an error."""
    lo, hi, _, _ = PRESET["wide"]
    return K.require_eligible(_slice(spark, sf_dir, "small"), questions(spark, sf_dir), table_counts(spark, sf_dir), lo, hi)


def slice_checks(spark, sf_dir):
    """K4: base within the superset; superset and hold-out disjoint; CI overlap unchanged; conditional counts over the slices of each id."""
    small, ci, hold, wide = _drawn(spark, sf_dir)
    tagged = None
    for name, part in (("small", small), ("ci", ci), ("holdout", hold), ("wide", wide)):
        rows = part.select("question_id", F.lit(name).alias("s"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    has = {n: F.max(F.col("s") == n).alias(n) for n in _TOGETHER}
    per_id = tagged.groupBy("question_id").agg(*has.values())
    return per_id.agg(
        F.count_if("wide").cast("long").alias("n_wide"),
        F.count_if(F.col("small") & ~F.col("wide")).cast("long").alias("base_missing"),
        F.count_if(F.col("wide") & F.col("holdout")).cast("long").alias("holdout_overlap"),
        (F.count_if(F.col("wide") & F.col("ci")) == F.count_if(F.col("small") & F.col("ci"))).alias("ci_overlap_unchanged"),
    )


def slice_mix(spark, sf_dir):
    return K.mix_counts(_slice(spark, sf_dir, "small"), questions(spark, sf_dir)).select(
        "cut", "key", F.col("n").cast("long").alias("n"))


def slice_changed_gold(spark, sf_dir):
    """K8: same question id in two releases whose gold SQL text differs."""
    o = Tables(spark, sf_dir).orders
    a = o.select(F.col("o_orderkey").alias("question_id"),
                 F.concat(F.lit("SELECT count(*) FROM orders WHERE o_custkey = "), F.col("o_custkey").cast("string")).alias("sql_a"))
    b = o.filter(F.col("o_orderkey") % 53 != 0).select(
        F.col("o_orderkey").alias("question_id"),
        F.when(F.col("o_orderkey") % 37 == 0, F.concat(F.lit("SELECT count(*) FROM orders WHERE o_custkey = "),
                                                       F.col("o_custkey").cast("string"), F.lit(" AND o_orderstatus = 'F'")))
        .otherwise(F.concat(F.lit("SELECT count(*) FROM orders WHERE o_custkey = "), F.col("o_custkey").cast("string"))).alias("sql_b"))
    j = a.join(b, "question_id")
    return j.agg(F.count(F.lit(1)).cast("long").alias("n_shared"),
                 F.count_if(F.col("sql_a") != F.col("sql_b")).cast("long").alias("n_changed"))


def slice_adopted_whole(spark, sf_dir):
    """K7: the adopted-whole preset -- every question id, sorted (no sampling)."""
    return questions(spark, sf_dir).select("question_id").orderBy("question_id")


QUERIES = {
    "slice_base_guard": slice_base_guard,
    "slice_adopted_whole": slice_adopted_whole,
    "slice_table_counts": slice_db_sizes,
    "slice_largest_remainder": slice_largest_remainder,
    "slice_small": slice_small,
    "slice_large": slice_large,
    "slice_ci": slice_ci,
    "slice_holdout": slice_holdout,
    "slice_wide": slice_wide,
    "slice_checks": slice_checks,
    "slice_mix": slice_mix,
    "slice_changed_gold": slice_changed_gold,
}

# ---------------------------------------------------------------- oracle SQL
_N_TABLES = len(STAR_SCHEMA)
_Q = "q AS (SELECT o_orderkey AS question_id, 'db' || CAST(o_custkey % 7 AS VARCHAR) AS db_id, o_orderpriority AS difficulty FROM orders)"
_TC = ("tc AS (SELECT 'db' || CAST(k AS VARCHAR) AS db_id, CAST(least(4 + k, " + str(_N_TABLES) + ") AS BIGINT) AS table_count "
       "FROM range(0, 7) t(k))")


def _draw_sql(name: str, pool: str, n: str, seed: int) -> str:
    return f"""{name}_sizes AS (SELECT difficulty, count(*) AS size FROM {pool} GROUP BY 1),
{name}_n AS (SELECT greatest(least({n}, (SELECT count(*) FROM {pool})), 0) AS n),
{name}_raw AS (SELECT difficulty, size, (SELECT n FROM {name}_n) * size / sum(size) OVER () AS raw FROM {name}_sizes),
{name}_alloc AS (SELECT difficulty, floor(raw)::BIGINT + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, difficulty)
                   <= (SELECT n FROM {name}_n) - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS alloc FROM {name}_raw),
{name} AS (SELECT p.question_id, p.difficulty FROM (
   SELECT question_id, difficulty, row_number() OVER (PARTITION BY difficulty
          ORDER BY md5('{seed}' || '|' || CAST(question_id AS VARCHAR)), question_id) AS r FROM {pool}) p
   JOIN {name}_alloc a ON a.difficulty = p.difficulty WHERE p.r <= a.alloc)"""


def _elig(lo, hi) -> str:
    return f"(SELECT * FROM q WHERE db_id IN (SELECT db_id FROM tc WHERE table_count BETWEEN {lo} AND {hi}))"


def _slice_sql(name: str) -> str:
    lo, hi, n, seed = PRESET[name]
    return f"{name}_pool AS {_elig(lo, hi)},\n" + _draw_sql(name, f"{name}_pool", str(n), seed)


_HOLD = _slice_sql("small") + ",\n" + _slice_sql("ci") + f""",
holdout_pool AS (SELECT * FROM {_elig(*PRESET['holdout'][:2])} e
  WHERE question_id NOT IN (SELECT question_id FROM small UNION SELECT question_id FROM ci)),
""" + _draw_sql("holdout", "holdout_pool", str(PRESET["holdout"][2]), PRESET["holdout"][3])

_WIDE = _HOLD + f""",
wide_pool AS (SELECT * FROM {_elig(*PRESET['wide'][:2])} e WHERE question_id NOT IN (SELECT question_id FROM small)
              AND question_id NOT IN (SELECT question_id FROM holdout)),
""" + _draw_sql("wide_top", "wide_pool", f"{PRESET['wide'][2]} - (SELECT count(*) FROM small)", PRESET["wide"][3]) + """,
wide AS (SELECT question_id, difficulty FROM small UNION ALL SELECT question_id, difficulty FROM wide_top)"""

_HEAD = f"WITH {_Q}, {_TC},\n"

ORACLES = {
    "slice_base_guard": _HEAD + _slice_sql("small") + f""",
base AS (SELECT count(*)::BIGINT AS n_base FROM small)
SELECT n_base FROM base""",
    "slice_adopted_whole": "SELECT o_orderkey AS question_id FROM orders ORDER BY 1",
    "slice_table_counts": "WITH sizes AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {i} AS ord, count(*) AS n FROM {t}" for i, t in enumerate(sorted(STAR_SCHEMA), start=1))
    + ") SELECT 'db' || CAST(k AS VARCHAR) AS db_id, count(*)::BIGINT AS table_count, sum(n)::BIGINT AS n_rows "
    "FROM sizes, range(0, 7) r(k) WHERE ord <= 4 + k GROUP BY k",
    "slice_largest_remainder": _HEAD + f"""pool AS {_elig(0, 5)},
sizes AS (SELECT difficulty AS stratum, count(*) AS size FROM pool GROUP BY 1),
raw AS (SELECT stratum, size, 50 * size / sum(size) OVER () AS raw FROM sizes)
SELECT stratum, size::BIGINT AS size, floor(raw)::BIGINT + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, stratum)
       <= 50 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS alloc FROM raw""",
    "slice_small": _HEAD + _slice_sql("small") + "\nSELECT * FROM small",
    "slice_large": _HEAD + _slice_sql("large") + "\nSELECT * FROM large",
    "slice_ci": _HEAD + _slice_sql("ci") + "\nSELECT * FROM ci",
    "slice_holdout": _HEAD + _HOLD + "\nSELECT * FROM holdout",
    "slice_wide": _HEAD + _WIDE + "\nSELECT * FROM wide",
    "slice_checks": _HEAD + _WIDE + """
SELECT (SELECT count(*) FROM wide)::BIGINT AS n_wide,
       (SELECT count(*) FROM small WHERE question_id NOT IN (SELECT question_id FROM wide))::BIGINT AS base_missing,
       (SELECT count(*) FROM wide WHERE question_id IN (SELECT question_id FROM holdout))::BIGINT AS holdout_overlap,
       (SELECT count(*) FROM wide WHERE question_id IN (SELECT question_id FROM ci))
         = (SELECT count(*) FROM small WHERE question_id IN (SELECT question_id FROM ci)) AS ci_overlap_unchanged""",
    "slice_mix": _HEAD + _slice_sql("small") + """
SELECT 'difficulty' AS cut, s.difficulty AS key, count(*)::BIGINT AS n FROM small s GROUP BY s.difficulty
UNION ALL SELECT 'db_id', q.db_id, count(*)::BIGINT FROM small s JOIN q ON q.question_id = s.question_id GROUP BY q.db_id""",
    "slice_changed_gold": """SELECT count(*)::BIGINT AS n_shared, count(*) FILTER (WHERE o_orderkey % 37 = 0)::BIGINT AS n_changed
FROM orders WHERE o_orderkey % 53 <> 0""",
}
