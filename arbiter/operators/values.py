"""Value index and literal steering.

The index maps each normalized value to the ``table.column`` keys that hold
it: every distinct value of every column, since a literal that is not in the
index is taken not to occur.  Values over ``DIGEST_OVER`` characters are kept
as their digest.

``ValueIndex`` keeps it on disk by table and by a hash of the value: a table
can be added or replaced alone, and a lookup reads the hash partitions of its
literals only and drops other values before anything is shuffled, so what it
moves follows the literals, not the data.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.operators.profile import _is_scalar, plain_text
from arbiter.session import stable

# Fixed values.
WHITESPACE_EDGES = r"^\s+|\s+$"
#: A value that neither begins nor ends with one of these has no such edges.
EDGE_CHARS = " \t\n\x0b\f\r\x85\u2028\u2029"
#: Normalized values of more characters are indexed by their digest.
DIGEST_OVER = 64
#: Hash partitions of a table's values, and hash buckets of literals that a lookup may broadcast.
PARTS, BUCKETS = 16, 1 << 20
#: Columns that one word of a mask holds.
WORD_BITS = 62


def normalize_value(v: Column) -> Column:
    """L1: strip surrounding whitespace, then casefold."""
    text = v.cast("string")
    return F.lower(F.when(F.btrim(text, F.lit(EDGE_CHARS)) == text, text).otherwise(F.regexp_replace(text, WHITESPACE_EDGES, "")))


def index_key(v: Column) -> Column:
    """What a value is indexed and looked up by."""
    norm = normalize_value(v)
    return F.when(F.length(norm) > DIGEST_OVER, F.concat(F.lit("sha256:"), F.sha2(norm, 256))).otherwise(norm)


def column_key(table: Column, column: Column) -> Column:
    return F.concat(F.lower(table), F.lit("."), F.lower(column))


class ValueIndex:
    """L2: the index under ``path``, partitioned by table and hash of the value; rows (value_norm, holders) per table."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, frames: dict[str, DataFrame], redact: Iterable[str] = ()) -> ValueIndex:
        """Add tables, or replace them; other tables' files are not touched.  PII columns are skipped entirely."""
        hidden = {r.casefold() for r in redact}
        kept = {}
        for name, df in frames.items():
            cols = [f.name for f in df.schema.fields if f"{name}.{f.name}".casefold() not in hidden]
            if cols:
                kept[name] = df.select(*(F.col(f"`{c}`") for c in cols))
        rows, holders = self._masks(kept)
        rows = rows.withColumn("part", self._part()).repartition("table_name", "part").sortWithinPartitions("table_name", "part", "value_norm")
        rows.select("value_norm", holders.alias("holders"), "table_name", "part").write.partitionBy("table_name", "part").option(
            "partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/values")
        keys = self.spark.createDataFrame([(n.casefold(), f"{n}.{c}".casefold()) for n, df in kept.items() for c in df.columns], "table_name string, column_key string")
        keys.coalesce(1).write.partitionBy("table_name").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/columns")
        return self

    def _masks(self, frames: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
        """((table_name, value_norm, w0, w1, ...), holders): each table's values with a bit mask of the columns that hold them, and the keys of these.

        Every column is read by tasks of its own and becomes what it is indexed
        by; equal cells of a task combine before the one shuffle.
        """
        columns: dict[str, list[tuple[str, T.StructField]]] = {}
        for name, df in frames.items():
            columns.setdefault(name.lower(), []).extend((name, f) for f in df.schema.fields if _is_scalar(f.dataType))
        columns = {name: of for name, of in columns.items() if of}
        words = max([-(-len(of) // WORD_BITS) for of in columns.values()] + [1])
        names = [f"w{w}" for w in range(words)]
        parts = [self.spark.createDataFrame([], "table_name string, value_norm string, " + ", ".join(f"{n} long" for n in names))]
        for of in columns.values():
            for n, (name, f) in enumerate(of):
                c = F.col(f"`{f.name}`")
                value = index_key(c) if isinstance(f.dataType, T.StringType) else F.lower(plain_text(c, f.dataType))
                bits = [F.lit(1 << n % WORD_BITS if n // WORD_BITS == w else 0).cast("long").alias(names[w]) for w in range(words)]
                parts.append(frames[name].where(c.isNotNull()).select(F.lower(F.lit(name)).alias("table_name"), value.alias("value_norm"), *bits))
        rows = reduce(DataFrame.unionByName, parts).groupBy("table_name", "value_norm").agg(*(F.bit_or(n).alias(n) for n in names))
        keys = F.lit(None).cast("array<string>")
        for of in columns.values():
            keys = F.when(F.col("table_name") == F.lower(F.lit(of[0][0])), F.array(*(column_key(F.lit(t), F.lit(f.name)) for t, f in of))).otherwise(keys)
        bit = lambda i: reduce(Column.__or__, ((F.floor(i / WORD_BITS) == w) & (F.call_function("shiftright", F.col(names[w]), (i % WORD_BITS).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0) for w in range(words)))
        return rows, F.array_sort(F.array_distinct(F.filter(keys, lambda _, i: bit(i))))

    @staticmethod
    def _part() -> Column:
        return F.pmod(F.xxhash64("value_norm"), F.lit(PARTS)).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("value_norm string, holders array<string>, table_name string, part int").parquet(f"{self.path}/values")

    def pairs(self) -> DataFrame:
        """(value_norm, column_key)."""
        return self.rows().select("value_norm", F.explode("holders").alias("column_key"))

    def columns(self) -> DataFrame:
        """(column_key) of every indexed column."""
        return self.spark.read.schema("column_key string, table_name string").parquet(f"{self.path}/columns").select("column_key")

    def holders(self, values: DataFrame) -> DataFrame:
        """(value_norm, holders) of the values asked, those that occur; ``values`` has the column value_norm.

        At most ``PARTS`` numbers reach the driver and ``BUCKETS`` the tasks,
        whatever the literals.
        """
        asked = values.select("value_norm").where(F.col("value_norm").isNotNull()).distinct()
        parts = [r.part for r in asked.select(self._part().alias("part")).distinct().collect()]
        bucket = F.pmod(F.xxhash64("value_norm"), F.lit(BUCKETS))
        maybe = self.rows().where(F.col("part").isin(parts)).select("value_norm", "holders", bucket.alias("b"))
        few = maybe.join(F.broadcast(asked.select(bucket.alias("b")).distinct()), "b", "left_semi")
        return few.join(asked, "value_norm", "left_semi").groupBy("value_norm").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("holders")))).alias("holders"))


def columns_containing(index: ValueIndex, lookups: DataFrame, value_col: str = "value") -> DataFrame:
    """L3: for each lookup row, the sorted keys of the columns that hold the value."""
    probe = lookups.withColumn("_v", index_key(F.col(value_col)))
    holders = index.holders(probe.select(F.col("_v").alias("value_norm")))
    return probe.join(holders, probe["_v"] == holders["value_norm"], "left").drop("_v", "value_norm").withColumn(
        "holders", F.coalesce(F.col("holders"), F.array().cast("array<string>"))
    )


def resolve_bindings(bindings: DataFrame, aliases: DataFrame, query_tables: DataFrame, indexed: DataFrame) -> DataFrame:
    """L4: (query_id, binding_id, written, literal, key) for every indexed key a binding may mean.

    A qualified column resolves its qualifier through the query's alias map
    (unknown qualifier = a table name); a bare column maps to every table of
    the query.  Keys that are not indexed are dropped (unknown, never steered).
    """
    b = bindings.withColumn("_q", F.lower(F.col("qualifier"))).withColumn("_c", F.lower(F.col("column_name")))
    a = aliases.select("query_id", F.lower("alias").alias("_q"), F.lower("table_name").alias("_t"))
    qualified = (
        b.filter(F.col("_q").isNotNull() & (F.col("_q") != ""))
        .join(a, ["query_id", "_q"], "left")
        .withColumn("key", F.concat(F.coalesce(F.col("_t"), F.col("_q")), F.lit("."), F.col("_c")))
        .drop("_t")
    )
    bare = (
        b.filter(F.col("_q").isNull() | (F.col("_q") == ""))
        .join(query_tables.select("query_id", F.lower("table_name").alias("_t")), "query_id")
        .withColumn("key", F.concat(F.col("_t"), F.lit("."), F.col("_c")))
        .drop("_t")
    )
    written = F.when(F.col("_q").isNotNull() & (F.col("_q") != ""), F.concat(F.col("qualifier"), F.lit("."), F.col("column_name"))).otherwise(F.col("column_name"))
    both = qualified.unionByName(bare).withColumn("written", written)
    return both.join(indexed, both["key"] == indexed["column_key"], "left_semi").select(
        "query_id", "binding_id", "written", "literal", "key"
    )


def check_literals(resolved: DataFrame, index: ValueIndex) -> DataFrame:
    """(query_id, literal, constrained_column, candidate_columns) for off-column literals.

    Fires iff the bound column is indexed, none of its keys holds the literal,
    and another column does; deduplicated on (query, written column, literal).
    Only the distinct literals meet the index; a literal without holders never fires.
    """
    r = resolved.withColumn("_v", index_key(F.col("literal")))
    keys = stable(r.groupBy("query_id", "binding_id", "written", "literal", "_v").agg(F.collect_set("key").alias("keys")))
    holders = index.holders(keys.select(F.col("_v").alias("value_norm")))
    j = keys.join(holders, keys["_v"] == holders["value_norm"]).where(~F.arrays_overlap("keys", "holders"))
    cands = F.array_sort(F.array_except(F.col("holders"), F.col("keys")))
    found = j.select(
        "query_id", "binding_id", "literal", F.col("written").alias("constrained_column"), cands.alias("candidate_columns")
    ).filter(F.size("candidate_columns") > 0)
    return found.groupBy("query_id", "constrained_column", "literal").agg(
        F.min("binding_id").alias("binding_id"), F.min("candidate_columns").alias("candidate_columns")
    )


def steering_message(findings: DataFrame) -> DataFrame:
    """One correction text per query, findings in binding order."""
    line = F.format_string(
        "The value '%s' does not occur in %s; it occurs in %s. Revise the query to constrain one of those columns instead.",
        F.col("literal"), F.col("constrained_column"), F.array_join(F.col("candidate_columns"), ", "),
    )
    return findings.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("binding_id"), line.alias("l")))), lambda s: s["l"]), " ").alias("message")
    )
