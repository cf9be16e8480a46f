"""Cell canonicalization: typed columns -> one comparable string per cell.

The rules mirror how a Python comparator sees driver values:

* numbers compare by value across types (``1 == 1.0 == Decimal(1)``): every
  numeric cell prints as its exact decimal value without trailing zeros, so no
  digit of a long or a decimal is lost on the way through a double;
* ``float_tolerance`` rounds float/double/decimal cells half-even to 6 places
  (``bround``, decimals as decimals); integer cells are untouched;
* NULL becomes a tag distinct from every value (``null_sentinel``): values are
  prefixed ``V`` and NULL is ``N``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the comparator.
FLOAT_DECIMALS = 6
NULL_TAG = "N"
VALUE_TAG = "V"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
# Whole doubles below have a plain decimal form of at most 38 digits.
_MOST_PLAIN = 1e38
_EXACT = T.DecimalType(38, 18)
#: One cell of a result of any width: a kind and one slot per way to compare.
CELL_FIELDS = ("kind", "dec", "dbl", "txt")


def is_cells(dtype: T.DataType) -> bool:
    """Whether a column holds rows as ``result_cells`` writes them."""
    return isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType) and tuple(dtype.elementType.names) == CELL_FIELDS


def _stripped(text: Column) -> Column:
    """Plain decimal text without trailing zeros of its fraction."""
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def number_text(c: Column, dtype: T.DataType) -> Column:
    """The exact value of a number as text: equal for 1, 1.0 and Decimal('1.00'), different for numbers that differ in any digit."""
    if isinstance(dtype, _INTEGRAL):
        return c.cast("string")
    if isinstance(dtype, T.DecimalType):
        return _stripped(c.cast("string"))
    x = c.cast("double")
    size = F.abs(x)
    whole = F.when((x == F.rint(x)) & (size < F.lit(_MOST_PLAIN)), x.cast("decimal(38,0)").cast("string"))
    # A fraction prints plain where 18 places hold all its digits.
    exact = x.cast("string").try_cast(_EXACT)
    fraction = F.when(exact.cast("double") == x, _stripped(exact.cast("string")))
    return F.coalesce(whole, fraction, x.cast("string"))


def rounded(c: Column, dtype: T.DataType) -> Column:
    """``float_tolerance`` of one cell; decimals stay decimals."""
    if isinstance(dtype, T.DecimalType):
        return F.bround(c, FLOAT_DECIMALS) if dtype.scale > FLOAT_DECIMALS else c
    if isinstance(dtype, _FRACTIONAL):
        return F.bround(c.cast("double"), FLOAT_DECIMALS)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, _FRACTIONAL):
        return F.transform(c, lambda x: rounded(x, dtype.elementType))
    if is_cells(dtype):
        return F.transform(c, lambda x: x.withField("dec", F.bround(x["dec"], FLOAT_DECIMALS).cast(_EXACT)).withField("dbl", F.bround(x["dbl"], FLOAT_DECIMALS)))
    return c


def result_cells(df: DataFrame, value_cols: list[str]) -> Column:
    """The row as ``ARRAY<STRUCT<kind, dec, dbl, txt>>``: results of any width and types fit in one column of a batch."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def cell(c: str) -> Column:
        dt, v = types[c], F.col(f"`{c}`")
        none = {"dec": F.lit(None).cast(_EXACT), "dbl": F.lit(None).cast("double"), "txt": F.lit(None).cast("string")}
        if isinstance(dt, _INTEGRAL) or (isinstance(dt, T.DecimalType) and dt.scale <= 18 and dt.precision - dt.scale <= 20):
            kind, none["dec"] = "num", v.cast(_EXACT)
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            kind, none["dbl"] = "num", v.cast("double")
        elif isinstance(dt, T.DecimalType):
            kind, none["txt"] = "num", number_text(v, dt)
        else:
            kind, none["txt"] = dt.simpleString(), cell_text(v, dt, float_tolerance=False)
        return F.struct(F.when(v.isNotNull(), F.lit(kind)).alias("kind"), *(none[k].alias(k) for k in ("dec", "dbl", "txt")))

    return F.array(*[cell(c) for c in value_cols])


def comparable_cells(cells: Column) -> Column:
    """``ARRAY<STRING>`` of a ``result_cells`` array: kind and exact value, NULL apart from every value."""
    value = lambda x: F.coalesce(number_text(x["dec"], _EXACT), number_text(x["dbl"], T.DoubleType()), x["txt"])
    return F.transform(cells, lambda x: F.when(x["kind"].isNull(), F.lit(NULL_TAG)).otherwise(F.concat(F.lit(VALUE_TAG), x["kind"], F.lit(":"), value(x))))


def cell_text(c: Column, dtype: T.DataType, float_tolerance: bool = True) -> Column:
    """Canonical text of one typed cell (NULL stays NULL; tagging is separate)."""
    if isinstance(dtype, _INTEGRAL):
        return c.cast("string")
    if isinstance(dtype, _FRACTIONAL):
        return number_text(rounded(c, dtype) if float_tolerance else c, dtype)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("string")
    return F.to_json(F.array(c))


def tagged(text: Column) -> Column:
    """``null_sentinel``: NULL equals only NULL, never '', 0 or 'None'."""
    return F.when(text.isNull(), F.lit(NULL_TAG)).otherwise(F.concat(F.lit(VALUE_TAG), text))

