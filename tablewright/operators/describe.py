"""Descriptive statistics of columns."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import moments
from tablewright.functions.kinds import (
    kind_of,
    number,
    numeric_columns,
    present,
    ref,
)
from tablewright.operators.fused import numeric_metrics, per_column, scalars, unpivoted
from tablewright.operators.frequencies import modes
from tablewright.operators.quantiles import PowerSums, quantiles_and_powers
from tablewright.operators.ranking import grouped_quantiles

QUARTILES = (0.25, 0.5, 0.75)

_DESCRIBE_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, "
    "q25 double, q50 double, q75 double, max double"
)


def _moments(sums: PowerSums | None) -> dict[str, float | None]:
    """Deviations and the biased g1 and g2; undefined ones are null."""
    out = dict.fromkeys(("std", "std_pop", "skewness", "kurtosis"))
    if sums is None or not sums.rows:
        return out
    n = sums.rows
    m2, m3, m4 = sums.central()
    m2 = max(m2, 0.0)
    out["std_pop"] = math.sqrt(m2 / n)
    if n > 1:
        out["std"] = math.sqrt(m2 / (n - 1))
    if m2 > 0:
        out["skewness"] = math.sqrt(n) * m3 / m2**1.5
        out["kurtosis"] = n * m4 / (m2 * m2) - 3.0
    return out


class NumericSummary:
    """Count, moments, extremes and quartiles of numeric columns in two scans.

    The first scan takes counts, extremes, means and quantile sketches; the
    second settles the quartiles and sums the powers around the means. Other operators take their bounds from here.
    """

    def __init__(self, df: DataFrame, columns: Iterable[str] | None = None):
        self.columns = numeric_columns(df) if columns is None else list(columns)
        self.values: dict[str, dict] = {}
        if not self.columns:
            return
        quartiles, sketches, powers = quantiles_and_powers(
            df, {name: QUARTILES for name in self.columns}, powers=True
        )
        for name in self.columns:
            seen, found = sketches[name], quartiles[name]
            self.values[name] = {
                "count": seen.rows,
                "min": seen.low,
                "max": seen.high,
                "mean": seen.mean,
                "q25": found[0.25],
                "q50": found[0.5],
                "q75": found[0.75],
                **_moments(powers.get(name) if powers else None),
            }

    def __getitem__(self, name: str) -> dict:
        return self.values[name]

    def frame(self, spark, schema: str, metrics: Iterable[str]) -> DataFrame:
        rows = [(name, *[self.values[name][m] for m in metrics]) for name in self.columns]
        return spark.createDataFrame(rows, schema)


def describe(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    group_by: Iterable[str] = (),
    summary: NumericSummary | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum."""
    columns = numeric_columns(df) if columns is None else list(columns)
    group_by = list(group_by)
    if not group_by:
        summary = summary or NumericSummary(df, columns)
        metrics = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
        return summary.frame(df.sparkSession, _DESCRIBE_SCHEMA, metrics)
    columns = [c for c in columns if c not in group_by]
    basics = _numeric(
        df,
        {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
        columns,
        group_by,
    )
    long = unpivoted(df, {n: number(df, n) for n in columns}, group_by)
    quartiles = grouped_quantiles(
        long, "value", QUARTILES, [*group_by, "column"], ["q25", "q50", "q75"]
    ).drop("n")
    on = [basics[k].eqNullSafe(quartiles[k]) for k in [*group_by, "column"]]
    return basics.join(quartiles, on, "left").select(
        *[basics[g] for g in group_by],
        basics["column"],
        *["count", "mean", "std", "min", "q25", "q50", "q75", "max"],
    )


def _numeric(df: DataFrame, metrics, columns, group_by) -> DataFrame:
    names = numeric_columns(df) if columns is None else list(columns)
    return numeric_metrics(df, {n: number(df, n) for n in names}, metrics, group_by)


def skewness(df: DataFrame, columns=None, group_by=()) -> DataFrame:
    return _numeric(df, {"skewness": moments.corrected_skewness}, columns, group_by)


def kurtosis(df: DataFrame, columns=None, group_by=()) -> DataFrame:
    return _numeric(df, {"kurtosis": moments.corrected_kurtosis}, columns, group_by)


def spans(df: DataFrame, columns=None, group_by=()) -> DataFrame:
    """Maximum minus minimum."""
    return _numeric(df, {"range": lambda c: F.max(c) - F.min(c)}, columns, group_by)


def variation(df: DataFrame, columns=None, group_by=()) -> DataFrame:
    return _numeric(df, {"coefficient_variation": moments.variation}, columns, group_by)


def extremes(df: DataFrame, columns=None, group_by=()) -> DataFrame:
    return _numeric(df, {"min": F.min, "max": F.max}, columns, group_by)


def interquartile_range(df: DataFrame, columns=None, group_by=()) -> DataFrame:
    table = describe(df, columns, group_by)
    return table.select(*[ref(g) for g in group_by], "column", (F.col("q75") - F.col("q25")).alias("iqr"))


def numeric_modes(df: DataFrame, columns=None) -> DataFrame:
    columns = numeric_columns(df) if columns is None else list(columns)
    return modes(df, columns).select("column", F.col("mode").cast("double").alias("mode"))


def distributions(df: DataFrame, columns=None, summary: NumericSummary | None = None) -> DataFrame:
    """Mean, median, deviation, biased skewness and kurtosis, and a normality test."""
    summary = summary or NumericSummary(df, columns)
    base = summary.frame(
        df.sparkSession,
        "column string, count bigint, mean double, median double, std double, "
        "skewness double, kurtosis double",
        ["count", "mean", "q50", "std", "skewness", "kurtosis"],
    )
    statistic, p_value = moments.normality(
        F.col("count"), F.col("skewness"), F.col("kurtosis")
    )
    return base.select(
        "*", statistic.alias("normality_statistic"), p_value.alias("normality_p")
    )


def normality_test(df: DataFrame, columns=None) -> DataFrame:
    """Omnibus normality statistic and p-value; null below 8 values."""
    parts = _numeric(df, {"n": F.count, "g1": F.skewness, "g2": F.kurtosis}, columns, ())
    statistic, p_value = moments.normality(F.col("n"), F.col("g1"), F.col("g2"))
    return parts.select("column", "n", statistic.alias("statistic"), p_value.alias("p_value"))


def missing_by_column(df: DataFrame, columns=None) -> DataFrame:
    columns = df.columns if columns is None else list(columns)
    return per_column(
        df,
        columns,
        {
            "missing": lambda c: F.count_if(present(df, c).isNull()),
            "missing_percent": lambda c: F.avg(
                F.when(present(df, c).isNull(), F.lit(100.0)).otherwise(0.0)
            ),
        },
    )


def missing_total(df: DataFrame) -> DataFrame:
    """Missing cells in the whole table and their share of all cells."""
    per_row = sum(
        (F.when(present(df, c).isNull(), F.lit(1)).otherwise(0) for c in df.columns),
        F.lit(0),
    )
    return df.agg(
        F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias("total_missing"),
        (F.avg(per_row) * 100.0 / F.lit(float(len(df.columns)))).alias("missing_percent"),
    )


# Bytes of one value of a fixed-width type.
WIDTHS = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "float": 4,
    "date": 4,
    "bigint": 8,
    "double": 8,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


def _width(dtype: T.DataType) -> int | None:
    return 16 if isinstance(dtype, T.DecimalType) else WIDTHS.get(dtype.simpleString())


def _text_bytes(name: str, dtype: T.DataType) -> Column:
    text = ref(name) if kind_of(dtype) == "text" else F.to_json(F.struct(ref(name)))
    return F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint")


def type_profile(df: DataFrame) -> DataFrame:
    """Type, kind flags and estimated bytes per column.

    Bytes are the value width times the rows, or the text length in UTF-8.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def size(name: str):
        width = _width(types[name])
        return _text_bytes(name, types[name]) if width is None else F.count(F.lit(1)) * width

    return per_column(
        df,
        df.columns,
        {
            "data_type": lambda n: F.lit(types[n].simpleString()),
            "bytes": size,
            "is_numeric": lambda n: F.lit(kind_of(types[n]) in ("numeric", "boolean")),
            "is_categorical": lambda n: F.lit(kind_of(types[n]) == "text"),
            "is_datetime": lambda n: F.lit(kind_of(types[n]) == "datetime"),
        },
    )


def table_facts(df: DataFrame) -> dict:
    """Rows, and per column its missing cells and bytes, from one scan."""
    facts: dict = {"rows": F.count(F.lit(1))}
    for f in df.schema.fields:
        facts["missing", f.name] = F.count_if(present(df, f.name).isNull())
        if _width(f.dataType) is None:
            facts["bytes", f.name] = _text_bytes(f.name, f.dataType)
    found = scalars(df, facts)
    for f in df.schema.fields:
        if ("bytes", f.name) not in found:
            found["bytes", f.name] = found["rows"] * _width(f.dataType)
    return found


def missing_from(df: DataFrame, facts: dict) -> tuple[DataFrame, DataFrame]:
    """:func:`missing_by_column` and :func:`missing_total` from :func:`table_facts`."""
    rows, gaps = facts["rows"], {c: facts["missing", c] for c in df.columns}
    share = {c: n * 100.0 / rows if rows else None for c, n in gaps.items()}
    total = sum(gaps.values())
    spark = df.sparkSession
    return (
        spark.createDataFrame(
            [(c, n, share[c]) for c, n in gaps.items()], "column string, missing bigint, missing_percent double"
        ),
        spark.createDataFrame(
            [(total, total / rows * 100.0 / len(gaps) if rows else None)], "total_missing bigint, missing_percent double"
        ),
    )


def extremes_from(df: DataFrame, summary: NumericSummary) -> DataFrame:
    return summary.frame(df.sparkSession, "column string, min double, max double", ["min", "max"])


def types_from(df: DataFrame, facts: dict) -> DataFrame:
    """:func:`type_profile` from :func:`table_facts`."""
    rows = [
        (
            f.name,
            f.dataType.simpleString(),
            facts["bytes", f.name],
            kind_of(f.dataType) in ("numeric", "boolean"),
            kind_of(f.dataType) == "text",
            kind_of(f.dataType) == "datetime",
        )
        for f in df.schema.fields
    ]
    schema = "column string, data_type string, bytes bigint, is_numeric boolean, is_categorical boolean, is_datetime boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type."""
    rows = [(f.dataType.simpleString(),) for f in df.schema.fields]
    types = df.sparkSession.createDataFrame(rows, "data_type string")
    return types.groupBy("data_type").agg(F.count(F.lit(1)).alias("columns"))
