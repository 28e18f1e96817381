"""Histograms with automatic or given bin counts."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import INTEGRAL, number, numeric_columns, ref
from tablewright.operators.describe import NumericSummary


def auto_bins(n: int, low: float, high: float, iqr: float, integral: bool) -> int:
    """Bin count from the wider of Freedman-Diaconis and half the square-root
    width, no wider than Sturges; bins of whole numbers are at least 1 wide."""
    span = high - low
    if n == 0 or span == 0:
        return 1
    sturges = span / (math.log2(n) + 1.0)
    freedman = 2.0 * iqr * n ** (-1.0 / 3.0)
    width = min(max(freedman, span / math.sqrt(n) / 2.0), sturges)
    if integral:
        width = max(width, 1.0)
    return max(int(math.ceil(span / width)), 1)


def bin_edges(low: float, high: float) -> tuple[float, float]:
    """A single repeated value gets one bin of width 1 around it."""
    return (low - 0.5, high + 0.5) if low == high else (low, high)


def histogram(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    bins: int | None = None,
    summary: NumericSummary | None = None,
) -> DataFrame:
    """``(column, bin, left, right, count)``, empty bins included.

    Bins are closed on the left; the last one is closed on both sides. All
    columns share one counting scan.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    facts = {}
    if bins is None:
        summary = summary or NumericSummary(df, columns)
        for name in columns:
            v = summary[name]
            if v["count"]:
                integral = isinstance(df.schema[name].dataType, INTEGRAL)
                iqr = v["q75"] - v["q25"]
                facts[name] = (
                    *bin_edges(v["min"], v["max"]),
                    auto_bins(v["count"], v["min"], v["max"], iqr, integral),
                )
    else:
        from tablewright.operators.fused import scalars

        found = scalars(
            df,
            {(n, f): fn(number(df, n)) for n in columns for f, fn in (("lo", F.min), ("hi", F.max))},
        )
        for name in columns:
            if found[name, "lo"] is not None:
                facts[name] = (*bin_edges(found[name, "lo"], found[name, "hi"]), bins)
    return fixed_histogram(df, facts)


def fixed_histogram(df: DataFrame, facts: dict[str, tuple[float, float, int]]) -> DataFrame:
    """Counts for given ``{column: (low, high, bins)}``; values outside are left out."""
    spark = df.sparkSession
    schema = "column string, bin bigint, left double, right double, count bigint"
    if not facts:
        return spark.createDataFrame([], schema)
    names = list(facts)
    lows = F.array(*[F.lit(float(facts[n][0])) for n in names])
    highs = F.array(*[F.lit(float(facts[n][1])) for n in names])
    sizes = F.array(*[F.lit(int(facts[n][2])) for n in names])
    cells = F.array(*[number(df, n) for n in names])
    i, v = F.col("i"), F.col("value")
    width = (highs[i] - lows[i]) / sizes[i]
    counts = (
        df.select(F.posexplode(cells).alias("i", "value"))
        .filter(v.isNotNull() & (v >= lows[i]) & (v <= highs[i]))
        .select("i", F.least(F.floor((v - lows[i]) / width), (sizes[i] - 1).cast("bigint")).alias("bin"))
        .groupBy("i", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # the frame of all bins: a few numbers per column, unfolded on the executors
    frame = spark.createDataFrame(
        [(k, n, *map(float, facts[n][:2]), int(facts[n][2])) for k, n in enumerate(names)],
        "i int, column string, low double, high double, bins bigint",
    ).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)))
    step = (F.col("high") - F.col("low")) / F.col("bins")
    return frame.join(counts, ["i", "bin"], "left").select(
        "column",
        "bin",
        (F.col("low") + F.col("bin") * step).alias("left"),
        F.when(F.col("bin") == F.col("bins") - 1, F.col("high"))
        .otherwise(F.col("low") + (F.col("bin") + 1) * step)
        .alias("right"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    )
