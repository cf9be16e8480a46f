"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected ``target / source_size`` times.  The
documents of a source are laid end to end in a fixed order (size class, then a
digest), their expected copies are summed as a prefix, one offset per source is
added, and a document is emitted once per integer boundary that its stretch of
the prefix crosses.  Counts so differ from expectation by less than one within
every run of the order, and as the order begins with the size class, the words
taken stay near the target also when lengths are very uneven.

The prefix sum is never computed in one task: rows are ranked inside
(source, size class, digest slice), and only the counts of these groups are
accumulated.  The digest slices are ranges of the order itself, so their number
changes no result.

Edge cases: a null text has size 0; a null source is a source of its own, last
in order; sources of size 0 get target 0 and no copies; repeated rows are
sampled one by one; an empty table gives an empty mix.  Input columns keep
their names, whatever they are: the operator packs them into one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbiter.llm.common import word_count, written

WEIGHTS = (5, 2, 1)
#: Rows that one digest slice holds on average.
SLICE_ROWS = 50_000
DIGEST_BITS = 32
OFFSET_BITS = 16


def _digest(*cols: Column) -> Column:
    """The first 32 bits of an MD5 over the columns (nulls as empty) as a long."""
    text = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, DIGEST_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeat: float = 3.0) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all sizes by weight, no target above ``max_repeat`` times its size.

    Weights repeat over the sources in code point order, null last.  Sources
    whose cap is reached first are those with the least cap per weight, so one
    running sum in that order finds the level at which the rest share the rest.
    The table has one row per source, already summed.
    """
    n = len(weights)
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    per = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(ordered) - 1) % n + 1).cast("int"))
    cap = F.lit(float(max_repeat)) * F.col("source_size")
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    t = sizes.withColumn("weight", per).withColumn("cap", cap)
    t = (
        t.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
    )
    t = t.withColumn("full", (F.col("total") - F.col("capped_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left"))
    rest = W.partitionBy()
    t = t.withColumn("left_total", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(rest)).withColumn(
        "left_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(rest)
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("left_total") * F.col("weight") / F.when(F.col("left_weight") > 0, F.col("left_weight")))
    return t.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_copies(
    docs: DataFrame,
    payload: Column | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    max_repeat: float = 3.0,
    seed: int = 0,
) -> DataFrame:
    """(row, source, size, source_size, target, copies) per document; ``row`` is ``payload``, by default all columns."""
    payload = payload if payload is not None else F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        payload.alias("row"),
        F.col(f"`{source_col}`").alias("source"),
        F.col(f"`{id_col}`").alias("id"),
        word_count(text).alias("size"),
        _digest(F.col(f"`{id_col}`"), text).alias("digest"),
    ).withColumn("class", F.floor(F.log2(F.col("size") + F.lit(1.0)) * 8).cast("int"))
    slim = written(rows.select("source", "size", "class", "digest"), "mix-sizes")
    bits = 0
    while (SLICE_ROWS << bits) < slim.count() and bits < DIGEST_BITS and bits < 20:
        bits += 1
    part = F.shiftright(F.col("digest"), DIGEST_BITS - bits).alias("slice")
    groups = slim.groupBy("source", "class", part).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    classes = groups.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    before = W.partitionBy("source").orderBy("class").rowsBetween(W.unboundedPreceding, -1)
    class_start = classes.select("source", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("class_start"))
    inside = W.partitionBy("source", "class").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = groups.withColumn("in_class", F.coalesce(F.sum("n").over(inside), F.lit(0)))

    def match(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        b = b.select(*(F.col(k).alias(f"r_{k}") for k in keys), *(c for c in b.columns if c not in keys))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
        return a.join(b, on, how).drop(*(f"r_{k}" for k in keys))

    starts = match(match(starts, class_start, ["source", "class"]), targets, ["source"])
    unit = F.lit(float(1 << OFFSET_BITS))
    offset = F.shiftright(_digest(F.lit(str(seed)), F.col("source")), DIGEST_BITS - OFFSET_BITS) / unit
    starts = starts.select(
        "source", "class", "slice", "source_size", "target",
        (F.col("class_start") + F.col("in_class")).alias("start"),
        F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0)).alias("rate"),
        offset.alias("offset"),
    )
    # One exchange deals out the rows; the ranking window and the join of the starts both use it.
    order = W.partitionBy("source", "class", "slice").orderBy("digest", "size", "id")
    ranked = rows.withColumn("slice", part).withColumn("rank", F.row_number().over(order))
    joined = match(ranked, starts, ["source", "class", "slice"])
    end = F.col("start") + F.col("rank")
    crossed = F.floor(F.col("rate") * end + F.col("offset")) - F.floor(F.col("rate") * (end - 1) + F.col("offset"))
    return joined.select(
        "row", "source", "size", "source_size", "target",
        F.least(crossed, F.ceil(F.col("rate"))).cast("long").alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once per boundary it crosses, with the columns of ``docs``."""
    found = mix_copies(docs, **options).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = mix_copies(docs, F.col("doc_id"))
    return found.select(
        F.col("row").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


_SHARES = r"""
sized AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
         3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total
  FROM sources),
levels AS (
  SELECT *,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped_before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighted),
full_ones AS (SELECT *, (total - capped_before) * weight >= cap * weight_left AS is_full FROM levels),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN cap
         ELSE (total - sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ()) * weight
              / sum(CASE WHEN is_full THEN 0.0 ELSE weight END) OVER () END AS target
  FROM full_ones),
ranked AS (
  SELECT s.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    (('0x' || substr(md5('0' || chr(31) || coalesce(s.source, '')), 1, 8))::BIGINT >> 16) / 65536.0::DOUBLE AS shift,
    row_number() OVER (
      PARTITION BY s.source
      ORDER BY floor(log2(size + 1.0::DOUBLE) * 8),
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 8))::BIGINT, size, doc_id) AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (
  SELECT *, least(floor(rate * k + shift) - floor(rate * (k - 1) + shift), ceil(rate))::BIGINT AS copies FROM ranked)
"""

ORACLE = f"WITH {_SHARES.format(docs='documents')} SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mixed"
