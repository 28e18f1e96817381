"""Column kinds (numeric, text, temporal, boolean) and NaN handling."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def ref(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, TEMPORAL):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "numeric")


def text_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "text")


def nan_to_null(c: Column) -> Column:
    """NaN becomes NULL; a NULL compares as unknown, a NaN as the largest value."""
    return F.when(~F.isnan(c), c)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN taken as missing."""
    c = ref(name)
    return nan_to_null(c) if isinstance(df.schema[name].dataType, FLOATING) else c


def number(df: DataFrame, name: str) -> Column:
    """The column as a double with NaN taken as missing."""
    return present(df, name).cast("double")


def normalise_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the floating columns of a table."""
    wanted = set(df.columns if columns is None else columns)
    floats = [
        f.name
        for f in df.schema.fields
        if f.name in wanted and isinstance(f.dataType, FLOATING)
    ]
    if not floats:
        return df
    return df.withColumns({name: nan_to_null(ref(name)) for name in floats})
