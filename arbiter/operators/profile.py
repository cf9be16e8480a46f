"""Column profiling: two scans a table and one shuffle a kind of value.

* ``Profiles`` counts equal cells by one hash aggregate with map-side combine
  per kind of value.  Every column is read by tasks of its own, so none holds
  the values of several.  Texts over ``DIGEST_OVER`` characters take part as a
  prefix and a 128-bit digest, so no long text is a shuffle key.  Row, null and
  distinct counts and the top values come from these counts.
* Typed extremes, length ranges, char-class flags and the least and greatest
  text (whose common prefix is the prefix of every value) come from one
  aggregate a table.  What a type rules out is not matched cell by cell.
* The top values of long texts are ranked by their prefixes; only the
  candidates' digests go back to the table to fetch and order whole texts.
* ``top_n_per_group`` -- exact top-n in two stages (per hash bucket, then per
  group over at most n x buckets survivors), so no group's values meet in one
  task.

The reference derives length range, char class and prefix from a 200-value
sample; here they are exact over the whole column (documented divergence).
Doubles and floats print in plain decimal form, negative zero as 0.0.
"""

from __future__ import annotations

import os.path
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.session import stable

# Fixed values.
DEFAULT_TOP_K = 5
MAX_LISTED = 5
DEFAULT_SAMPLE_LIMIT = 200
#: Texts of more characters are counted by their first characters and a digest.
DIGEST_OVER = 64
CHAR_CLASS_PATTERNS = (
    ("digits", r"^[0-9]+$"),
    ("alpha", r"^\p{L}+$"),
    ("alnum", r"^[\p{L}\p{N}]+$"),
)

_SCALAR = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
    T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _is_scalar(dt: T.DataType) -> bool:
    return isinstance(dt, _SCALAR)


def plain_text(c: Column, dtype: T.DataType | None = None) -> Column:
    """A cell as text; fractions in plain decimal form, without a sign of zero."""
    if not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    text = (c + F.lit(0).cast(dtype)).cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    return F.when(F.contains(text, F.lit("E")), F.coalesce(F.regexp_replace(plain, r"\.$", ".0"), text)).otherwise(text)


def _order_keys(c: Column, dt: T.DataType) -> tuple[Column, Column, Column]:
    """(double, exact decimal, text): native order; the decimal parts numbers that one double stands for."""
    exact, text = F.lit(None).cast("decimal(38,18)"), F.lit(None).cast("string")
    if isinstance(dt, _NUMERIC):
        own = exact if isinstance(dt, (T.FloatType, T.DoubleType)) else c.try_cast("decimal(38,18)")
        return c.cast("double"), own, text
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double"), exact, text
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        micros = F.unix_micros(c.cast("timestamp"))
        return micros.cast("double"), micros.cast("decimal(38,18)"), text
    return F.lit(None).cast("double"), exact, c.cast("string")


_VALUES = "table_name string, column_name string, value string, num_key double, exact_key decimal(38,18), str_key string"
_NATIVE_ORDER = ("num_key", "exact_key", "str_key")


def distinct_values(df: DataFrame | dict[str, DataFrame], table_name: str | None = None,
                    max_len: int | None = None) -> DataFrame:
    """(table_name, column_name, value, num_key, exact_key, str_key): each column's distinct non-null values.

    Columns of the same exact type (across all given tables) are unpivoted
    together in their native type and de-duplicated by one hash aggregate with
    map-side combine; only distinct values are then formatted as text.  One
    shuffle per type, not per column.
    """
    frames = df if isinstance(df, dict) else {table_name: df}
    by_type: dict[str, list[DataFrame]] = {}
    types: dict[str, T.DataType] = {}
    for name, frame in frames.items():
        fields = [f for f in frame.schema.fields if _is_scalar(f.dataType)]
        groups: dict[str, list[str]] = {}
        for f in fields:
            key = f.dataType.simpleString()
            groups.setdefault(key, []).append(f.name)
            types[key] = f.dataType
        for key, cols in groups.items():
            def value(c: str, dt: T.DataType = types[key]) -> Column:
                v = F.col(f"`{c}`")
                # Text longer than the limit can never qualify: drop it before the shuffle.
                if max_len is not None and isinstance(dt, T.StringType):
                    v = F.when(F.length(v) <= max_len, v)
                return v
            cells = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                                       value(c).alias("_v")) for c in cols])
            by_type.setdefault(key, []).append(frame.select(F.inline(cells)).where(F.col("_v").isNotNull()))
    parts = []
    for key, frs in by_type.items():
        u = reduce(DataFrame.unionByName, frs)
        num, exact, s = _order_keys(F.col("_v"), types[key])
        part = u.distinct().select("table_name", "column_name", plain_text(F.col("_v"), types[key]).alias("value"), num.alias("num_key"),
                                   exact.alias("exact_key"), s.alias("str_key"))
        if max_len is not None:
            part = part.where(F.length("value") <= max_len)
        parts.append(part)
    if not parts:  # no scalar column at all
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([], _VALUES)
    return reduce(DataFrame.unionByName, parts)


def _least(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, (i, value): the ``limit`` least distinct texts of the i-th column; no more are ever held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, pa.Array] = {}
        for batch in batches:
            for i, cells in enumerate(batch.columns):
                old = kept.get(i)
                if old is not None and len(old) == limit:
                    cells = cells.filter(pc.less(cells, old[-1]))
                new = pc.unique(cells.drop_null())
                if len(new):
                    both = new if old is None else pc.unique(pa.concat_arrays([old, new]))
                    kept[i] = both.take(pc.array_sort_indices(both)[:limit])
        for i, values in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), values.cast(pa.string())], ["i", "value"])

    return run


def least_values(frames: dict[str, DataFrame], limit: int, max_len: int) -> DataFrame:
    """(table_name, column_name, rank, value): the ``limit`` least distinct texts of each column, of those up to ``max_len`` characters.

    One scan a table; each task sends ``limit`` texts a column at most, whatever it reads.
    """
    parts, names = [], []
    for table, frame in frames.items():
        own = [f for f in frame.schema.fields if _is_scalar(f.dataType)]
        if not own:
            continue
        texts = [plain_text(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(own)]
        cells = frame.select(*texts).select(*(F.when(F.length(f"c{i}") <= max_len, F.col(f"c{i}")).alias(f"c{i}") for i in range(len(own))))
        parts.append(cells.mapInArrow(_least(limit), "i int, value string").withColumn("t", F.lit(table)))
        names += [(table, i, f.name) for i, f in enumerate(own)]
    spark = next(iter(frames.values())).sparkSession
    if not parts:  # no scalar column at all
        return spark.createDataFrame([], "table_name string, column_name string, rank int, value string")
    least = reduce(DataFrame.unionByName, parts).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("t", "i").orderBy("value")))
    named = spark.createDataFrame(names, "t string, i int, column_name string")
    return least.where(F.col("rank") <= limit).join(F.broadcast(named), ["t", "i"]).select(F.col("t").alias("table_name"), "column_name", "rank", "value")


def top_n_per_group(
    df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], n: int, buckets: int | None = None,
    bucket_key: Column | None = None, rank_name: str = "rank",
) -> DataFrame:
    """Exact top-n rows per group by ``order`` (a total order), in two bounded stages.

    A group is cut into as many hash buckets as there are shuffle partitions.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = bucket_key if bucket_key is not None else F.xxhash64(*[F.col(c) for c in df.columns])
    staged = df.withColumn("_bucket", F.pmod(key, F.lit(buckets)))
    w1 = Window.partitionBy(*group_cols, "_bucket").orderBy(*order)
    survivors = staged.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n).drop("_r1", "_bucket")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return survivors.withColumn(rank_name, F.row_number().over(w2)).filter(F.col(rank_name) <= n)


_SLOTS = ("i", "x", "e", "t", "g")


def _slots(c: Column, dt: T.DataType) -> dict[str, Column]:
    """What a cell is counted by: whole numbers, fractions, decimals, texts (or their beginnings), digests of long texts."""
    if isinstance(dt, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return {"i": c.cast("long")}
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return {"x": c.cast("double")}
    if isinstance(dt, T.DecimalType):
        return {"e": c.try_cast("decimal(38,18)"), "t": c.cast("string")}
    if isinstance(dt, T.StringType):
        return {"t": F.substring(c, 1, DIGEST_OVER), "g": F.when(F.length(c) > DIGEST_OVER, F.unhex(F.md5(c)))}
    return {"t": c.cast("string")} if _is_scalar(dt) else {}


def _classes(c: Column, t: Column, dt: T.DataType) -> list[Column]:
    """Per char class whether a cell is of it (null: null); only texts and decimals are matched."""
    no = F.when(c.isNotNull(), F.lit(False))
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return [c >= 0, no, c >= 0]
    if isinstance(dt, (T.FloatType, T.DoubleType)):  # NaN and Infinity are letters, all others have a point
        letters = F.isnan(c) | (c == float("inf"))
        return [no, F.when(c.isNotNull(), letters), F.when(c.isNotNull(), letters)]
    if isinstance(dt, T.BooleanType):
        return [no, c.isNotNull() | c, c.isNotNull() | c]
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return [no, no, no]
    return [t.rlike(pat) for _, pat in CHAR_CLASS_PATTERNS]


def _seen(df: DataFrame, columns: Sequence[tuple[int, T.StructField]]) -> DataFrame:
    """One row per scalar column, by its number: minima, maxima and conjunctions over its cells."""
    cells = df.select(*(x for n, f in columns for c in [F.col(f"`{f.name}`")] for x in (c.alias(f"c{n}"), plain_text(c, f.dataType).alias(f"t{n}"))))
    metrics = []
    for n, f in columns:
        c, t = F.col(f"c{n}"), F.col(f"t{n}")
        metrics += [F.min(c).alias(f"min{n}"), F.max(c).alias(f"max{n}"), F.min(F.length(t)).alias(f"minlen{n}"), F.max(F.length(t)).alias(f"maxlen{n}"),
                    F.min(t).alias(f"mint{n}"), F.max(t).alias(f"maxt{n}")]
        metrics += [F.bool_and(x).alias(f"{name}{n}") for (name, _), x in zip(CHAR_CLASS_PATTERNS, _classes(c, t, f.dataType), strict=True)]
    rows = [F.struct(F.lit(n).alias("column"), plain_text(F.col(f"min{n}"), f.dataType).alias("min"), plain_text(F.col(f"max{n}"), f.dataType).alias("max"),
                     *(F.col(f"{k}{n}").alias(k) for k in ("minlen", "maxlen", "mint", "maxt", *(name for name, _ in CHAR_CLASS_PATTERNS)))) for n, f in columns]
    return cells.agg(*metrics).select(F.inline(F.array(*rows)))


class Profiles:
    """The profiles of several tables; building one reads every table twice.

    Columns that are not scalar are counted, not compared: what is not
    computed is NULL.
    """

    def __init__(self, frames: dict[str, DataFrame], redact: Iterable[str] = ()):
        self.frames = dict(sorted(frames.items()))
        self.redact = {c.casefold() for c in redact}
        self.fields = [(t, i, f) for t, df in self.frames.items() for i, f in enumerate(df.schema.fields)]
        self.spark = next(iter(self.frames.values())).sparkSession
        kinds = {"i": "long", "x": "double", "e": "decimal(38,18)", "t": "string", "g": "binary"}
        parts, seen = {}, []
        for table, df in self.frames.items():
            own = [(n, f) for n, (t, _, f) in enumerate(self.fields) if t == table]
            for n, f in own:
                slots = _slots(F.col(f"`{f.name}`"), f.dataType)
                parts.setdefault(tuple(slots), []).append(df.select(
                    F.lit(n).alias("column"), F.col(f"`{f.name}`").isNotNull().alias("filled"), *(c.cast(kinds[k]).alias(k) for k, c in slots.items())))
            if scalar := [(n, f) for n, f in own if _is_scalar(f.dataType)]:
                seen.append(_seen(df, scalar))
        counts = [reduce(DataFrame.unionByName, of).groupBy("column", "filled", *slots).agg(F.count(F.lit(1)).alias("n")).select(
            "column", "filled", *(F.col(k) if k in slots else F.lit(None).cast(kinds[k]).alias(k) for k in _SLOTS), "n") for slots, of in parts.items()]
        self.counts = stable(reduce(DataFrame.unionByName, counts))
        rows = reduce(DataFrame.unionByName, seen).collect() if seen else []  # one row a column
        self.seen = {r.column: r.asDict() for r in rows}

    def _hidden(self, table: str, column: str) -> bool:
        return f"{table}.{column}".casefold() in self.redact

    def columns(self) -> DataFrame:
        """One row per column."""
        rows = []
        for n, (table, i, f) in enumerate(self.fields):
            scalar, at = _is_scalar(f.dataType), self.seen.get(n, {}).get
            cls = next((name for name, _ in CHAR_CLASS_PATTERNS if at(name)), "mixed")
            prefix = os.path.commonprefix([at("mint"), at("maxt")]) if at("mint") is not None else ""
            hidden = self._hidden(table, f.name)
            rows.append((
                n, table, f.name, i + 1, f.dataType.simpleString(), scalar, None if hidden else at("min"), None if hidden else at("max"),
                at("minlen"), at("maxlen"), cls if scalar else None, "" if hidden else prefix, hidden,
            ))
        known = self.spark.createDataFrame(
            rows, "column int, table_name string, column_name string, ordinal int, declared_type string, scalar boolean, min_value string, "
            "max_value string, min_len int, max_len int, char_class string, common_prefix string, redacted boolean")
        totals = self.counts.groupBy("column").agg(
            F.sum("n").alias("row_count"), F.sum(F.when(F.col("filled"), F.col("n"))).alias("non_null_count"), F.count_if("filled").alias("distinct_count"))
        none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        j = known.join(totals, "column", "left").select(*known.columns, *(none(c).alias(c) for c in ("row_count", "non_null_count", "distinct_count")))
        null_count = F.col("row_count") - F.col("non_null_count")
        distinct = F.when(F.col("scalar"), F.col("distinct_count"))
        return j.select(
            "table_name", "column_name", "ordinal", "declared_type", "row_count", "non_null_count", distinct.alias("distinct_count"),
            null_count.alias("null_count"), F.when(F.col("row_count") > 0, null_count / F.col("row_count")).otherwise(F.lit(0.0)).alias("null_fraction"),
            ((F.col("non_null_count") > 0) & (distinct == F.col("non_null_count"))).alias("is_unique"),
            "min_value", "max_value", "min_len", "max_len", (F.col("min_len").isNotNull() & (F.col("min_len") == F.col("max_len"))).alias("is_constant_length"),
            F.when((F.col("non_null_count") == 0) & F.col("scalar"), F.lit("empty")).otherwise(F.col("char_class")).alias("char_class"),
            "common_prefix", "redacted",
        )

    def _long_columns(self) -> list[tuple[int, str, T.StructField]]:
        """The columns that hold texts counted by digest."""
        return [(n, t, f) for n, (t, _, f) in enumerate(self.fields)
                if isinstance(f.dataType, T.StringType) and (self.seen.get(n, {}).get("maxlen") or 0) > DIGEST_OVER]

    def _whole_texts(self, wanted: DataFrame) -> DataFrame:
        """(column, g, whole): the texts behind digests, read again from their columns only."""
        parts = [self.frames[t].select(F.lit(n).alias("column"), F.col(f"`{f.name}`").alias("whole")).where(F.length("whole") > DIGEST_OVER) for n, t, f in self._long_columns()]
        if not parts:
            return self.spark.createDataFrame([], "column int, g binary, whole string")
        cells = reduce(DataFrame.unionByName, parts).withColumn("g", F.unhex(F.md5("whole")))
        return cells.join(wanted.select("column", "g"), ["column", "g"], "left_semi").groupBy("column", "g").agg(F.first("whole").alias("whole"))

    def top(self, k: int = DEFAULT_TOP_K) -> DataFrame:
        """P8 (and P10): (table_name, column_name, rank, value, n): count desc, native value asc; redacted columns list none."""
        shown = [n for n, (t, _, f) in enumerate(self.fields) if _is_scalar(f.dataType) and not self._hidden(t, f.name)]
        names = self.spark.createDataFrame([(n, t, f.name) for n, (t, _, f) in enumerate(self.fields)], "column int, table_name string, column_name string")
        held = self.counts.where(F.col("filled") & F.col("column").isin(shown))
        # Ranked with ties, since long texts may share their beginnings.
        order = [F.desc("n"), *(F.asc_nulls_first(c) for c in ("i", "x", "e", "t"))]
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        staged = held.withColumn("_b", F.pmod(F.xxhash64(*_SLOTS), F.lit(buckets)))
        staged = staged.withColumn("_r", F.rank().over(Window.partitionBy("column", "_b").orderBy(*order))).where(F.col("_r") <= k)
        best = staged.withColumn("_r", F.rank().over(Window.partitionBy("column").orderBy(*order))).where(F.col("_r") <= k).drop("_r", "_b", "filled")
        if self._long_columns():
            best = stable(best)
            best = best.join(self._whole_texts(best.where(F.col("g").isNotNull())), ["column", "g"], "left")
        else:
            best = best.withColumn("whole", F.lit(None).cast("string"))
        of = lambda *kinds: F.col("column").isin([n for n, (_, _, f) in enumerate(self.fields) if isinstance(f.dataType, kinds)])
        value = (
            F.when(of(T.BooleanType), F.col("i").cast("boolean").cast("string")).when(F.col("i").isNotNull(), F.col("i").cast("string"))
            .when(of(T.FloatType), plain_text(F.col("x").cast("float"), T.FloatType())).when(of(T.DoubleType), plain_text(F.col("x"), T.DoubleType()))
            .otherwise(F.coalesce("whole", "t"))
        )
        last = Window.partitionBy("column").orderBy(*order, F.asc_nulls_first("whole"))
        ranked = best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        return ranked.join(names, "column").select("table_name", "column_name", F.col("rank").cast("int").alias("rank"), value.alias("value"), F.col("n").cast("long").alias("n"))


def profile_table(df: DataFrame, table_name: str, redact: Iterable[str] = ()) -> DataFrame:
    """P1-P6, P10 of one table."""
    return Profiles({table_name: df}, redact).columns()


def profile_top_values(df: DataFrame, table_name: str, k: int = DEFAULT_TOP_K, redact: Iterable[str] = ()) -> DataFrame:
    """P8 (and P10) of one table."""
    return Profiles({table_name: df}, redact).top(k)


def distinct_sample(df: DataFrame, table_name: str, limit: int = DEFAULT_SAMPLE_LIMIT) -> DataFrame:
    """Up to ``limit`` distinct non-null values per column, smallest first (deterministic)."""
    vals = distinct_values(df, table_name)
    order = [*(F.asc_nulls_last(k) for k in _NATIVE_ORDER), F.asc("value")]
    top = top_n_per_group(vals, ["table_name", "column_name"], order, limit, bucket_key=F.xxhash64("value"))
    return top.select("table_name", "column_name", F.col("rank").cast("int").alias("rank"), "value")


_CLASS_PHRASE = {"digits": "all digits", "alpha": "all letters", "alnum": "alphanumeric", "mixed": "mixed characters"}


def render_column_english(profile: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """One English paragraph per column, clauses in a fixed order, omitted when empty.

    ``top`` may list more values than are shown: the list then ends in an ellipsis.
    """
    p = profile
    if top is not None:
        more = F.max("rank") > MAX_LISTED
        listed = top.groupBy("table_name", "column_name").agg(
            F.concat(F.array_join(
                F.transform(
                    F.slice(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), 1, MAX_LISTED),
                    lambda s: F.format_string('"%s" (%d)', s["value"], s["n"]),
                ),
                ", ",
            ), F.when(more, F.lit(", …")).otherwise(F.lit(""))).alias("_top"),
            F.count(F.lit(1)).alias("_ntop"),
        )
        p = p.join(listed, ["table_name", "column_name"], "left")
    else:
        p = p.withColumn("_top", F.lit(None).cast("string")).withColumn("_ntop", F.lit(0))
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    pct = F.bround(F.col("null_fraction") * 100, 0).cast("long")
    shape = F.concat_ws(
        ", ",
        F.when(F.col("is_constant_length"), F.format_string("exactly %d characters long", F.col("min_len")))
        .when(F.col("min_len").isNotNull(), F.format_string("%d–%d characters long", F.col("min_len"), F.col("max_len"))),
        F.try_element_at(F.create_map(*[x for kv in _CLASS_PHRASE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]), F.col("char_class")),
        F.when(F.col("common_prefix") != "", F.concat(F.lit("always beginning with "), q(F.col("common_prefix")))),
    )
    body = F.concat_ws(
        " ",
        F.when(F.col("null_count") == 0, F.format_string("No NULLs across %d rows.", F.col("row_count")))
        .otherwise(F.format_string("%d of %d rows are NULL (%d%%).", F.col("null_count"), F.col("row_count"), pct)),
        F.when(F.col("is_unique"), F.format_string("All %d non-NULL values are distinct (unique).", F.col("distinct_count")))
        .when(F.col("distinct_count").isNotNull(), F.format_string("%d distinct values.", F.col("distinct_count"))),
        F.when(shape != "", F.concat(F.lit("Values are "), shape, F.lit("."))),
        F.when(F.col("min_value").isNotNull() & F.col("max_value").isNotNull(),
               F.when(F.col("min_value") == F.col("max_value"), F.concat(F.lit("The only value is "), q(F.col("min_value")), F.lit(".")))
               .otherwise(F.concat(F.lit("Ranges from "), q(F.col("min_value")), F.lit(" to "), q(F.col("max_value")), F.lit(".")))),
        F.when(F.col("_top").isNotNull() & ~F.col("is_unique"), F.concat(F.lit("Most common: "), F.col("_top"), F.lit("."))),
    )
    head = F.format_string('Column "%s" (declared type %s).', F.col("column_name"), F.when(F.col("declared_type") != "", F.col("declared_type")).otherwise(F.lit("?")))
    text = (
        F.when(F.col("row_count") == 0, F.concat(head, F.lit(" The table is empty.")))
        .when(F.col("non_null_count") == 0, F.concat(head, F.format_string(" All %d rows are NULL.", F.col("row_count"))))
        .otherwise(F.concat_ws(" ", head, body))
    )
    return p.select("table_name", "column_name", "ordinal", text.alias("english"))


def profile_db(frames: dict[str, DataFrame], redact: Iterable[str] = ()) -> DataFrame:
    """Every column of every table, tables in name order."""
    return Profiles(frames, redact).columns()


def render_table_english(profile: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """(table_name, english): a header with the row count, then one line per column in their order."""
    lines = render_column_english(profile, top).join(profile.select("table_name", "column_name", "row_count"), ["table_name", "column_name"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "english"))), lambda x: F.concat(F.lit("- "), x["english"]))
    return lines.groupBy("table_name").agg(F.max("row_count").alias("n"), listed.alias("lines")).select(
        "table_name", F.concat(F.format_string('Table "%s" (%d rows):\n', "table_name", "n"), F.array_join("lines", "\n")).alias("english"))
