"""The full profile of a table: tidy tables that share their passes."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import numeric_columns, text_columns
from tablewright.operators import describe as D
from tablewright.operators import frequencies as Q
from tablewright.operators.correlate import correlations
from tablewright.operators.histogram import histogram
from tablewright.operators.outliers import detect_outliers
from tablewright.session import held

# Parts of the profile and their default methods.
DEFAULT_CONFIG = {
    "basic_stats": True,
    "distributions": True,
    "correlations": {"enabled": True, "methods": ["pearson", "spearman"]},
    "outliers": {"enabled": True, "methods": ["zscore", "iqr"]},
    "missing_values": True,
    "unique_values": True,
    "data_types": True,
}


def _wanted(config: Mapping, part: str) -> bool:
    setting = config.get(part, True)
    return setting.get("enabled", True) if isinstance(setting, Mapping) else bool(setting)


def _methods(config: Mapping, part: str) -> list[str]:
    setting = config.get(part)
    default = DEFAULT_CONFIG[part]["methods"]
    return list(setting.get("methods", default)) if isinstance(setting, Mapping) else default


def profile(
    df: DataFrame, key: str | Iterable[str] = (), config: Mapping | None = None
) -> dict[str, DataFrame]:
    """All profile tables of ``df`` by name.

    Numeric facts take two scans whatever the number of columns; rows, missing cells and bytes
    one together, value counts one per type, histograms and outliers one each. ``key`` names
    the columns that identify a row in the outlier table.
    """
    config = DEFAULT_CONFIG if config is None else config
    numeric, text = numeric_columns(df), text_columns(df)
    out: dict[str, DataFrame] = {}
    needs_summary = any(_wanted(config, p) for p in ("basic_stats", "distributions", "outliers"))
    summary = D.NumericSummary(df, numeric) if needs_summary and numeric else None
    counts = None
    facts = D.table_facts(df)
    rows = facts["rows"]
    if _wanted(config, "basic_stats") or _wanted(config, "unique_values"):
        counts = [held(t) for t in Q.typed_counts(df)]
    if _wanted(config, "basic_stats"):
        if summary is not None:
            out["describe"] = D.describe(df, numeric, summary=summary)
            out["shape"] = shape(df, summary)
            out["numeric_modes"] = Q.modes(df, counts=counts).filter(F.col("column").isin(numeric))
        if text:
            of_text = F.col("column").isin(text)
            shares = Q.value_proportions(df, counts=counts, rows=rows)
            out["categories"] = Q.modes(df, counts=counts).filter(of_text).join(
                Q.distinct_counts(df, counts=counts, rows=rows).drop("distinct_percent"), "column"
            )
            out["frequencies"] = shares.filter(of_text)
    if _wanted(config, "distributions") and summary is not None:
        out["distributions"] = D.distributions(df, numeric, summary)
        out["histograms"] = histogram(df, numeric, summary=summary)
    if _wanted(config, "correlations") and numeric:
        out["correlations"] = correlations(df, numeric, _methods(config, "correlations"))
    if _wanted(config, "outliers") and summary is not None:
        out["outliers"] = detect_outliers(df, key, numeric, _methods(config, "outliers"), summary)
    if _wanted(config, "missing_values"):
        out["missing"], out["missing_total"] = D.missing_from(df, facts)
    if _wanted(config, "unique_values"):
        out["distinct"] = Q.distinct_counts(df, counts=counts, rows=rows)
        out["top_values"] = Q.top_values(df, counts=counts)
        if numeric:
            out["extremes"] = D.extremes(df, numeric) if summary is None else D.extremes_from(df, summary)
    if _wanted(config, "data_types"):
        out["types"] = D.types_from(df, facts)
        out["type_counts"] = D.type_counts(df)
    out["size"] = df.sparkSession.createDataFrame(
        [(rows, len(df.columns))], "rows bigint, columns bigint"
    )
    return out


def shape(df: DataFrame, summary: D.NumericSummary) -> DataFrame:
    """Corrected skewness and kurtosis, range, interquartile range and variation."""
    rows = []
    for name in summary.columns:
        v = summary[name]
        n, g1, g2 = v["count"], v["skewness"], v["kurtosis"]
        flat = n and v["min"] == v["max"]
        skew = kurt = None
        if n >= 3:
            skew = 0.0 if flat else (n * (n - 1)) ** 0.5 / (n - 2) * g1
        if n >= 4:
            kurt = 0.0 if flat else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        spread = v["max"] - v["min"] if n else None
        iqr = v["q75"] - v["q25"] if n else None
        varies = v["std"] / v["mean"] if v["std"] is not None and v["mean"] else None
        rows.append((name, skew, kurt, spread, iqr, varies))
    return df.sparkSession.createDataFrame(
        rows,
        "column string, skewness double, kurtosis double, range double, iqr double, "
        "coefficient_variation double",
    )


def record_run(spark, path: str, run_id: str, config: Mapping | None = None) -> None:
    """Append one run to a history table."""
    text = json.dumps(DEFAULT_CONFIG if config is None else config)
    spark.createDataFrame([(run_id, text)], "run_id string, configuration string").withColumn(
        "recorded_at", F.current_timestamp()
    ).write.mode("append").parquet(path)
