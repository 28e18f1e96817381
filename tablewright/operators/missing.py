"""Missing values: drop or fill."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import INTEGRAL, kind_of, normalise_missing, number, present, ref
from tablewright.operators.frequencies import mode_values
from tablewright.operators.fused import scalars

# Fixed value: share of missing values above which a column is dropped.
NULL_SHARE = 0.5


def drop_sparse_columns(df: DataFrame, threshold: float = NULL_SHARE) -> DataFrame:
    """Drop columns whose share of missing values is above the threshold."""
    shares = scalars(
        df, {c: F.avg(present(df, c).isNull().cast("double")) for c in df.columns}
    )
    sparse = [c for c, share in shares.items() if share is not None and share > threshold]
    return df.drop(*sparse)


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    return normalise_missing(df).na.drop("any")


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill missing cells with given values; the result type holds the value."""
    filled = {}
    for name, value in values.items():
        if name not in df.columns:
            continue
        c = present(df, name)
        if isinstance(df.schema[name].dataType, INTEGRAL) and isinstance(value, float):
            c = c.cast("double")
        filled[name] = F.coalesce(c, F.lit(value))
    return df.withColumns(filled) if filled else df


def column_means(df: DataFrame, columns) -> dict[str, float | None]:
    columns = list(columns)
    if not columns:
        return {}
    return scalars(df, {c: F.avg(number(df, c)) for c in columns})


def fill_missing(df: DataFrame, values: Mapping[str, object] | None = None) -> DataFrame:
    """Fill with the given value, else the mean (numeric) or the mode (others).

    A column of nulls only has neither and stays as it is.
    """
    values = dict(values or {})
    open_columns = {f.name: f.dataType for f in df.schema.fields if f.name not in values}
    if not open_columns:
        return fill_values(df, values)
    facts = {}
    for name, dtype in open_columns.items():
        facts[name, "gaps"] = F.count_if(present(df, name).isNull())
        if kind_of(dtype) == "numeric":
            facts[name, "mean"] = F.avg(number(df, name))
    found = scalars(df, facts)
    gaps = [name for name in open_columns if found[name, "gaps"]]
    means = {n: found[n, "mean"] for n in gaps if (n, "mean") in found}
    others = [n for n in gaps if n not in means]
    fills = {**values, **means, **(mode_values(df, others) if others else {})}
    return fill_values(df, {c: v for c, v in fills.items() if v is not None})


def handle_missing(df: DataFrame, strategy: str = "remove", threshold: float = NULL_SHARE, values=None) -> DataFrame:
    if strategy == "remove":
        return drop_incomplete_rows(drop_sparse_columns(df, threshold))
    if strategy == "fill":
        return fill_missing(df, values)
    return df
