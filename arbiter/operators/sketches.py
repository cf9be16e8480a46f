"""Mergeable sketches: distinct counts kept up to date part by part, and upper bounds of join sizes.

* ``SketchStore`` (P1, opt-in) keeps one HyperLogLog sketch per column and table
  part, next to exact row and null counts.  A new part is read alone; a
  profile merges the stored sketches and reads no data at all.
* ``FanoutBounds`` (G11) keeps one count-min sketch per join column.  The inner
  product of two sketches' rows is never below the size of their equi-join, so
  only pairs whose bound is over the budget are counted exactly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.operators.audit import join_fanout
from arbiter.operators.profile import _is_scalar, plain_text

#: Bits of a sketch's register index: a relative standard error of about 1.04 / sqrt(2^bits).
HLL_BITS = 14
#: Share of all rows by which a count-min count may be too high, and its confidence.
CM_ERROR, CM_CONFIDENCE, CM_SEED = 0.0005, 0.99, 42


def _hashed(name: str, dtype: T.DataType) -> Column:
    """A cell as what sketches hash: whole numbers as they are, else text."""
    c = F.col(f"`{name}`")
    whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return c.cast("long") if whole else plain_text(c, dtype)


class SketchStore:
    """Approximate distinct counts under ``path``, by table and part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, table: str, part: str, df: DataFrame) -> SketchStore:
        """Add a part of a table, or replace it; one scan of the part, one row per column and task shuffled."""
        fields = [f for f in df.schema.fields if _is_scalar(f.dataType)]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(fields):
            aggs += [F.count(F.col(f"`{f.name}`")).alias(f"n_{i}"), F.hll_sketch_agg(_hashed(f.name, f.dataType), F.lit(HLL_BITS)).alias(f"s_{i}")]
        rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal"), F.col("rows"), F.col(f"n_{i}").alias("non_null"), F.col(f"s_{i}").alias("sketch")) for i, f in enumerate(fields)]
        found = df.agg(*aggs).select(F.lit(table).alias("table_name"), F.lit(part).alias("part"), F.inline(F.array(*rows)))
        found.write.partitionBy("table_name", "part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        return self

    def profile(self) -> DataFrame:
        """(table_name, column_name, row_count, non_null_count, approx_distinct) of all parts together."""
        schema = "column_name string, ordinal int, rows long, non_null long, sketch binary, table_name string, part string"
        merged = self.spark.read.schema(schema).parquet(self.path).groupBy("table_name", "column_name").agg(
            F.sum("rows").alias("row_count"), F.sum("non_null").alias("non_null_count"), F.hll_union_agg("sketch").alias("s"))
        return merged.select("table_name", "column_name", "row_count", "non_null_count", F.hll_sketch_estimate("s").alias("approx_distinct"))


def relative_error(bits: int = HLL_BITS, deviations: float = 4.0) -> float:
    """Relative error that an estimate exceeds only with the probability of so many standard deviations."""
    return deviations * 1.04 / 2 ** (bits / 2)


def count_min_table(sketch: bytes) -> np.ndarray:
    """The counters of a serialized count-min sketch, one row per hash."""
    version, _, depth, width = struct.unpack(">iqii", sketch[:20])
    if version != 1:
        raise ValueError(f"unknown sketch version {version}")
    return np.frombuffer(sketch, ">i8", depth * width, 20 + 8 * depth).reshape(depth, width)


def inner_product(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the sum over values of count times count, exact in Python integers."""
    return min(sum(int(x) * int(y) for x, y in zip(p[hit].tolist(), q[hit].tolist(), strict=True)) for p, q in zip(a, b, strict=True) for hit in [(p > 0) & (q > 0)])


def fanout_bounds(frames: dict[str, DataFrame], columns: Iterable[tuple[str, str]]) -> dict[tuple[str, str], np.ndarray]:
    """{(table, column): counters}: one count-min sketch per column, one scan per table; a sketch's size does not depend on the data."""
    wanted: dict[str, list[str]] = {}
    for t, c in dict.fromkeys(columns):
        wanted.setdefault(t, []).append(c)
    out = {}
    for table, names in wanted.items():
        df = frames[table]
        sketch = lambda c: F.count_min_sketch(_hashed(c, df.schema[c].dataType), F.lit(CM_ERROR), F.lit(CM_CONFIDENCE), F.lit(CM_SEED))  # noqa: B023, E731
        row = df.agg(*(sketch(c).alias(f"s_{i}") for i, c in enumerate(names))).first()
        out |= {(table, c): count_min_table(bytes(row[i])) for i, c in enumerate(names)}
    return out


def join_budgets(frames: dict[str, DataFrame], joins: Sequence[tuple[str, str, str, str, str]], budget: int) -> DataFrame:
    """G11 over many joins (name, left, left column, right, right column): (join_name, bound, join_rows, over_budget).

    ``join_rows`` is exact, and counted only where the bound is over the
    budget; elsewhere it is NULL: the join is within the budget for certain.
    """
    held = fanout_bounds(frames, [x for _, a, b, c, d in joins for x in ((a, b), (c, d))])
    spark = next(iter(frames.values())).sparkSession
    bounds = {name: inner_product(held[a, b], held[c, d]) for name, a, b, c, d in joins}
    known = spark.createDataFrame([(n, str(v)) for n, v in bounds.items()], "join_name string, bound string").withColumn("bound", F.col("bound").cast("decimal(38,0)"))
    exact = [join_fanout(frames[a], frames[c], b, d).select(F.lit(name).alias("join_name"), "join_rows") for name, a, b, c, d in joins if bounds[name] > budget]
    none = spark.createDataFrame([], "join_name string, join_rows decimal(38,0)")
    counted = reduce(DataFrame.unionByName, exact, none)
    return known.join(counted, "join_name", "left").select("join_name", "bound", "join_rows", F.coalesce(F.col("join_rows") > budget, F.lit(False)).alias("over_budget"))
