"""Column classes and the few column expressions every operator shares.

Four classes matter: numeric, datetime, text (booleans included) and nested.
NULL and NaN both count as missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

MISSING_LABEL = "__NA__"

# Texts longer than this are compared by their SHA-256 digest, so that counting
# distinct documents does not shuffle the documents themselves.
DIGEST_ABOVE = 64


def kind(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, NESTED_TYPES):
        return "nested"
    return "text"


def col(name: str) -> Column:
    """A column reference that survives dots and spaces in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(df: DataFrame, names: Iterable[str] | None = None) -> list[T.StructField]:
    return [df.schema[n] for n in (names if names is not None else df.columns)]


def of_kind(df: DataFrame, *kinds: str, names: Iterable[str] | None = None) -> list[str]:
    return [f.name for f in fields(df, names) if kind(f.dataType) in kinds]


def present(field: T.StructField) -> Column:
    """The column with NaN turned into NULL."""
    c = col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def as_double(field: T.StructField) -> Column:
    """Numeric value as a double; text is parsed, unparsable text is missing."""
    if kind(field.dataType) == "numeric":
        return present(field).cast("double")
    parsed = col(field.name).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def as_text(field: T.StructField) -> Column:
    """One text per distinct value (adding 0.0 folds -0.0 into 0.0)."""
    c = present(field)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def as_identity(field: T.StructField) -> Column:
    """Like ``as_text`` but long texts are replaced by their digest."""
    c = as_text(field)
    if kind(field.dataType) in ("text", "nested"):
        return F.when(F.length(c) > DIGEST_ABOVE, F.sha2(c, 256)).otherwise(c)
    return c


def unpivot_values(df: DataFrame, names: Sequence[str], value, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of (keep..., column_name, value); ``value`` maps a field to a column."""
    if not names:
        raise ValueError("no columns to unpivot")
    # kept columns are renamed meanwhile: a column may be both kept and unpivoted
    held = {f"_keep_{i}": k for i, k in enumerate(keep)}
    narrow = df.select(
        *[col(k).alias(h) for h, k in held.items()], *[value(f).alias(f.name) for f in fields(df, names)]
    )
    long = narrow.unpivot(list(held), [col(n) for n in names], "column_name", "value")
    return long.withColumnsRenamed(held)


def numeric_long(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Non-missing numeric values, one row per (row, column)."""
    return unpivot_values(df, names, as_double, keep).filter(F.col("value").isNotNull())


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL when whole is 0 (ANSI division would raise)."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def half_up(c: Column, digits: int) -> Column:
    return F.round(c, digits)
