"""Catalog-side sources: foreign keys, key checks, sample rows, schema text, descriptions.

Parquet carries no declared keys, so declared edges come from a small FK
table; a parent's implicit key column is resolved from the data (its first
column when that column is unique and non-null), and an edge holds when the
child has no orphan values (one anti-join per edge).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.operators.profile import plain_text

# Fixed values.
SAMPLE_ROWS = 3
MAX_CELL = 40
ELLIPSIS = "…"


def primary_keys(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, pk_col): the first column when unique and non-null (one aggregate per table)."""
    parts = []
    for name, df in frames.items():
        first = df.columns[0]
        parts.append(df.agg(
            F.lit(name).alias("table_name"),
            F.lit(first).alias("pk_col"),
            ((F.count(F.col(first)) == F.count(F.lit(1))) & (F.count_distinct(first) == F.count(F.lit(1)))).alias("is_key"),
        ))
    return reduce(DataFrame.unionByName, parts).filter("is_key").drop("is_key")


def foreign_keys(declared: DataFrame, pks: DataFrame) -> DataFrame:
    """Distinct (child, child_col, parent, parent_col); an implicit parent column becomes the parent's key."""
    j = declared.join(pks.withColumnRenamed("table_name", "parent"), "parent", "left")
    return j.select(
        "child", "child_col", "parent",
        F.coalesce(F.col("parent_col"), F.col("pk_col"), F.lit("(pk)")).alias("parent_col"),
    ).distinct()


def validate_foreign_keys(fks: list[tuple[str, str, str, str]], frames: dict[str, DataFrame]) -> DataFrame:
    """Orphan child values per edge (child LEFT ANTI parent); the edge holds when there are none."""
    parts = []
    for child, ccol, parent, pcol in fks:
        c = frames[child].select(F.col(ccol).alias("_k")).filter(F.col("_k").isNotNull())
        p = frames[parent].select(F.col(pcol).alias("_k"))
        orphans = c.join(p, "_k", "left_anti")
        parts.append(orphans.agg(F.count(F.lit(1)).cast("long").alias("orphans")).select(
            F.lit(child).alias("child"), F.lit(ccol).alias("child_col"), F.lit(parent).alias("parent"),
            F.lit(pcol).alias("parent_col"), "orphans", (F.col("orphans") == 0).alias("holds")))
    return reduce(DataFrame.unionByName, parts)


def truncate_cell(c, dtype) -> F.Column:
    if isinstance(dtype, T.ArrayType):
        s = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: plain_text(x, dtype.elementType)), ", "), F.lit("]"))
    else:
        s = plain_text(c, dtype)
    return F.when(F.length(s) <= MAX_CELL, s).otherwise(F.concat(F.substring(s, 1, MAX_CELL), F.lit(ELLIPSIS)))


def sample_rows(frames: dict[str, DataFrame], n: int = SAMPLE_ROWS) -> DataFrame:
    """First ``n`` rows per table (ordered by all its columns, left to right), long cells cut at 40 chars + '…'."""
    parts = []
    for name, df in frames.items():
        order = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns]
        cells = F.array(*[F.coalesce(truncate_cell(F.col(f"`{c}`"), df.schema[c].dataType), F.lit("None")) for c in df.columns])
        top = df.orderBy(*order).limit(n)
        # The window spans at most n rows (after the limit).
        parts.append(top.select(
            F.lit(name).alias("table_name"), F.lit(", ".join(df.columns)).alias("columns"),
            F.row_number().over(Window.orderBy(*order)).alias("row_no"),
            F.concat(F.lit("("), F.array_join(cells, ", "), F.lit(")")).alias("row_text"),
        ))
    return reduce(DataFrame.unionByName, parts)


def join_path_text(db_id: str, fks: DataFrame, samples: DataFrame) -> DataFrame:
    """Per db, FK lines ``child.col -> parent.col`` (sorted) then the sample rows per table."""
    fk_lines = fks.agg(F.array_sort(F.collect_list(F.format_string(
        "  %s.%s -> %s.%s", "child", "child_col", "parent", "parent_col"))).alias("l"))
    fk_text = fk_lines.select(F.when(F.size("l") > 0, F.array_join("l", "\n")).otherwise(F.lit("  (none declared)")).alias("fk"))
    per_table = samples.groupBy("table_name", "columns").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row_text"))),
                                 lambda s: F.concat(F.lit("    "), s["row_text"])), "\n").alias("rows"))
    samp = per_table.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "table_name", F.concat(F.lit("  "), F.col("table_name"), F.lit(" ("), F.col("columns"), F.lit("):\n"), F.col("rows")).alias("t")))),
        lambda s: s["t"]), "\n").alias("samples"))
    fk_s = fk_text.select("fk").scalar()
    return samp.select(
        F.lit(db_id).alias("db_id"),
        F.concat(F.lit("-- Foreign-key relationships (join paths):\n"), fk_s,
                 F.lit("\n\n-- Sample rows (value formats):\n"), F.col("samples")).alias("text"),
    )


def merge_descriptions(supplied: DataFrame, profiling: DataFrame, source: str) -> DataFrame:
    """Supplied only / profiling only / fused (supplied + ' ' + profiling when they differ after strip)."""
    s = supplied.select(F.lower("column_key").alias("column_key"), F.col("text").alias("s")).filter(F.col("s") != "")
    p = profiling.select(F.lower("column_key").alias("column_key"), F.col("text").alias("p")).filter(F.col("p") != "")
    if source == "supplied":
        return s.select("column_key", F.col("s").alias("description"))
    if source == "profiling":
        return p.select("column_key", F.col("p").alias("description"))
    j = s.join(p, "column_key", "full_outer")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    both = F.col("s").isNotNull() & F.col("p").isNotNull() & (strip(F.col("s")) != strip(F.col("p")))
    return j.select("column_key", F.when(both, F.concat_ws(" ", "s", "p")).otherwise(F.coalesce("s", "p")).alias("description"))
