"""Row positions for ordered result sets, computed without a per-group task.

A result set is an ordered list: its rows carry a dense position ``1..n``
inside each group (question).  ``row_number().over(partitionBy(q))`` would put
every row of one question into one task; a single question can hold a third of
all rows, so positions are assigned from one global range sort instead:

1. range-partition on (group, order keys) and sort inside each partition;
2. number the rows of every partition (``monotonically_increasing_id`` keeps the
   partition index in its upper bits and the in-partition index below);
3. turn per-partition row counts (one row per partition: a proven size bound,
   so it is broadcast) into global offsets;
4. subtract the global index of each group's first row (a partial aggregate per
   group, joined back on the group key).

The tagged rows are written once: both uses must see the same tags.

The order keys must form a total order for positions to be reproducible; that
is the caller's contract, exactly as for the reference's ordered lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbiter.session import stable

_LOW_BITS = (1 << 33) - 1


def _sort_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def dense_position(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    name: str = "row_pos",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = 1-based position of each row inside its group, by ``order_cols``.

    After the range sort a group spans a run of consecutive partitions, so the
    table of (partition, group) row counts has at most partitions + groups rows.
    From it, two small windows give each (partition, group) the rows of the
    same group in earlier partitions and the in-partition index where the
    group starts; one join brings both back to the rows.
    """
    groups = list(group_cols)
    keys = _sort_cols(groups) + _sort_cols(order_cols)
    ranged = (
        df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ).sortWithinPartitions(*keys)
    tagged = ranged.select(
        "*",
        F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)).alias("_local"),
    )
    # Partition and in-partition indexes are not reproducible across two
    # executions (sampled range bounds, adaptive coalescing): materialize the
    # tagged rows once so the count table and the rows agree, and so a lost
    # executor re-reads them instead of re-tagging.
    tagged = stable(tagged)
    if not groups:
        tagged = tagged.withColumn("_grp", F.lit(0))
        groups_k = ["_grp"]
    else:
        groups_k = groups
    blocks = tagged.groupBy("_pid", *groups_k).agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_lstart"))
    before = Window.partitionBy(*groups_k).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_pid", *groups_k, "_lstart", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    out = tagged.join(offsets, ["_pid", *groups_k]).withColumn(
        name, F.col("_before") + F.col("_local") - F.col("_lstart") + 1
    )
    drop = ["_pid", "_local", "_lstart", "_before"] + (["_grp"] if not groups else [])
    return out.drop(*drop)
