"""Key discovery: inclusion dependencies between columns, read off one shuffle of the data.

Every column is read by tasks of its own, so none holds the values of several.
An aggregate per family, keyed by the value itself, ors the columns that hold it
into a bit mask.  Equal cells of a task combine before the shuffle, so a hot
value costs a row per task, and a value that every table holds is still one row.  Counting the values per mask
leaves a table of at most a few thousand rows, from which the distinct count
of every column and the overlap of every pair of columns follow: A is included
in B when the overlap equals A's distinct count.  No pair of columns is joined.

Values of one family compare across types (``int`` and ``bigint``); doubles
and floats are no keys; texts over ``DIGEST_OVER`` characters are told apart by
a digest, so a found edge is confirmed on the values themselves by an
anti-join (``catalogio.validate_foreign_keys``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of more characters are replaced by their digest before the shuffle.
DIGEST_OVER = 32
#: Columns that one word of a mask holds.
WORD_BITS = 62
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: A short table prefix of a column name, as in ``l_orderkey``.
_PREFIX = r"^[a-z]{1,2}_"


def family(dtype: T.DataType) -> str | None:
    """What a column's values compare as; None: no key."""
    if isinstance(dtype, _INTEGRAL):
        return "integer"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return dtype.typeName()
    return None


def key_columns(frames: dict[str, DataFrame]) -> list[tuple[int, str, str, int, str]]:
    """(id, table, column, ordinal, family) of the columns that may be keys, in table and column order."""
    found = [(t, f.name, i, family(f.dataType)) for t in sorted(frames) for i, f in enumerate(frames[t].schema.fields, start=1)]
    return [(n, *c) for n, c in enumerate(c for c in found if c[3])]


def _value(name: str, dtype: T.DataType) -> Column:
    """What a cell compares as within its family: whole numbers and times natively, others as text."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, _INTEGRAL):
        return c.cast("long")
    if isinstance(dtype, T.DecimalType):
        return F.regexp_replace(c.cast("string"), r"\.?0+$", "") if dtype.scale else c.cast("string")
    return F.when(F.length(c) > DIGEST_OVER, F.sha2(c, 256)).otherwise(c) if isinstance(dtype, T.StringType) else c


def column_masks(frames: dict[str, DataFrame]) -> tuple[DataFrame, int]:
    """((w0, w1, ..., n), words): how many values are held by exactly the columns of a mask; every column is read once, one shuffle a family."""
    columns = key_columns(frames)
    words = -(-len(columns) // WORD_BITS) or 1
    names = [f"w{w}" for w in range(words)]
    cells: dict[str, list[DataFrame]] = {}
    for n, table, name, _, fam in columns:
        bits = [F.lit(1 << n % WORD_BITS if n // WORD_BITS == w else 0).cast("long").alias(names[w]) for w in range(words)]
        value = _value(name, frames[table].schema[name].dataType).alias("value")
        cells.setdefault(fam, []).append(frames[table].where(F.col(f"`{name}`").isNotNull()).select(value, *bits))
    held = [reduce(DataFrame.unionByName, of).groupBy("value").agg(*(F.bit_or(n).alias(n) for n in names)).groupBy(*names).agg(F.count(F.lit(1)).alias("n")) for of in cells.values()]
    return reduce(DataFrame.unionByName, held).groupBy(*names).agg(F.sum("n").alias("n")), words


def column_facts(frames: dict[str, DataFrame]) -> DataFrame:
    """(column, table_name, column_name, ordinal, n_rows, n_non_null) of the columns that may be keys; one aggregate a table."""
    parts = []
    for table in sorted(frames):
        own = [(n, c, i) for n, t, c, i, _ in key_columns(frames) if t == table]
        if own:
            wide = frames[table].agg(F.count(F.lit(1)).alias("n_rows"), *(F.count(F.col(f"`{c}`")).alias(f"nn_{n}") for n, c, _ in own))
            rows = [F.struct(F.lit(n).alias("column"), F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"), F.col("n_rows"), F.col(f"nn_{n}").alias("n_non_null")) for n, c, i in own]
            parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def inclusions(frames: dict[str, DataFrame]) -> DataFrame:
    """(child, child_col, child_ordinal, parent, parent_col, n_values, n_parent_values): columns whose every value stands in a key column.

    A key column is unique and without nulls in its table; a column without
    values is included in none.
    """
    masks, words = column_masks(frames)
    count = len(key_columns(frames))
    in_mask = lambda c: reduce(lambda a, b: a | b, ((F.floor(c / WORD_BITS) == w) & (F.expr(f"w{w}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (c % WORD_BITS).cast("int"))) != 0) for w in range(words)))
    members = F.filter(F.sequence(F.lit(0), F.lit(count - 1)), in_mask)
    a = masks.select("n", members.alias("m")).select("n", "m", F.explode("m").alias("a"))
    overlap = a.select("n", "a", F.explode("m").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("both"))
    facts = column_facts(frames)
    own = overlap.where("a = b").select(F.col("a").alias("column"), F.col("both").alias("n_distinct"))
    known = facts.join(own, "column")
    child = known.select(F.col("column").alias("a"), F.col("table_name").alias("child"), F.col("column_name").alias("child_col"), F.col("ordinal").alias("child_ordinal"), F.col("n_distinct").alias("n_values"))
    parent = known.where("n_distinct = n_rows and n_non_null = n_rows").select(F.col("column").alias("b"), F.col("table_name").alias("parent"), F.col("column_name").alias("parent_col"), F.col("n_distinct").alias("n_parent_values"))
    found = overlap.where("a <> b").join(child, "a").join(parent, "b").where(F.col("both") == F.col("n_values"))
    return found.select("child", "child_col", "child_ordinal", "parent", "parent_col", F.col("n_values").cast("long").alias("n_values"), F.col("n_parent_values").cast("long").alias("n_parent_values"))


def stem(name: Column) -> Column:
    """A column's name without a short table prefix: ``l_orderkey`` and ``o_orderkey`` have the same."""
    return F.regexp_replace(F.lower(name), _PREFIX, "")


def foreign_keys(included: DataFrame) -> DataFrame:
    """(child, child_col, child_ordinal, parent, parent_col): inclusions into another table's key of the same name.

    Small numbers are included in every larger key, so the names decide among
    inclusions.  Two keys with equal values reference each other; the one of
    the later table name is the child.
    """
    named = included.where((F.col("child") != F.col("parent")) & (stem(F.col("child_col")) == stem(F.col("parent_col"))))
    other = named.select(F.col("child").alias("parent"), F.col("child_col").alias("parent_col"), F.col("parent").alias("child"), F.col("parent_col").alias("child_col"), F.lit(True).alias("back"))
    both = named.join(other, ["child", "child_col", "parent", "parent_col"], "left")
    return both.where(F.col("back").isNull() | (F.col("child") > F.col("parent"))).select("child", "child_col", "child_ordinal", "parent", "parent_col")
