"""The reduced table behind a chart, of bounded size whatever the input."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import ChartError
from tablewright.functions.kinds import number, ref
from tablewright.operators.correlate import correlation_matrix, pearson
from tablewright.operators.fused import scalars, unpivoted
from tablewright.operators.histogram import histogram
from tablewright.operators.ranking import grouped_quantiles
from tablewright.session import broadcast_if_small, held

# Fixed value: points of a density curve.
CURVE_POINTS = 500
# Cells a kernel's width is cut into, terms of a cell's series, and the widths at which a
# kernel is zero in doubles: the first term left out is below 1e-16 of the kernel.
CELLS_PER_WIDTH = 16
SERIES_TERMS = 20
KERNEL_REACH = 39.0


def _spread_order(key: Iterable[str]) -> list[Column]:
    """An order that looks random but is the same on every run."""
    text = F.concat_ws("|", *[ref(k).cast("string") for k in key])
    return [F.md5(text), *[ref(k) for k in key]]


def _picked(df: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*_spread_order(keys)).limit(limit)


def scatter(df: DataFrame, key, x: str, y: str, color: str | None = None, size: str | None = None, limit: int | None = None) -> DataFrame:
    """A mark per row; with a ``limit`` so many, picked by the hash of the key."""
    keys = [key] if isinstance(key, str) else list(key)
    shown = [ref(x).alias("x"), ref(y).alias("y")]
    if color:
        shown.append(ref(color).alias("color"))
    if size:
        shown.append(ref(size).alias("size"))
    return _picked(df, keys, limit).select(*[ref(k) for k in keys], *shown)


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """All rows as counts on a grid of ``bins`` by ``bins``."""
    cx, cy = number(df, x), number(df, y)
    v = scalars(df, {"x0": F.min(cx), "x1": F.max(cx), "y0": F.min(cy), "y1": F.max(cy)})

    def cell(c, low, high):
        if low is None or low == high:
            return F.when(c.isNotNull(), F.lit(0).cast("bigint"))
        width = F.lit((high - low) / bins)
        return F.least(F.floor((c - F.lit(low)) / width), F.lit(bins - 1).cast("bigint"))

    cells = df.select(cell(cx, v["x0"], v["x1"]).alias("x_bin"), cell(cy, v["y0"], v["y1"]).alias("y_bin"))
    return cells.na.drop("any").groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))


def lines(df: DataFrame, x: str, y: str | Iterable[str]) -> DataFrame:
    """``(x, series, value)``: mean of each y column at every x, in order of x."""
    names = [y] if isinstance(y, str) else list(y)
    long = unpivoted(df, {n: number(df, n) for n in names}, [x], "series").withColumnRenamed(x, "x")
    return long.groupBy("x", "series").agg(F.avg("value").alias("value")).orderBy("x", "series")


def bars(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Heights add up per x (and colour)."""
    groups = [ref(x).alias("x")] + ([ref(color).alias("color")] if color else [])
    return df.groupBy(*groups).agg(F.sum(number(df, y)).alias("height"))


def histogram_bars(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    return histogram(df, [column], bins)


def pie(df: DataFrame, names: str, values: str) -> DataFrame:
    """Sum per name and its share of the total."""
    sums = df.groupBy(ref(names).alias("name")).agg(F.sum(number(df, values)).alias("value"))
    total = scalars(df, {"t": F.sum(number(df, values))})["t"]
    return sums.withColumn("share", F.try_divide(F.col("value"), F.lit(total).cast("double")))


def box(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers inside 1.5 interquartile ranges, outliers per group."""
    group = ref(by) if by else F.lit("all")
    cells = df.select(group.alias("group"), number(df, column).alias("value")).filter("value IS NOT NULL")
    fences = grouped_quantiles(cells, "value", (0.25, 0.5, 0.75), ["group"], ["q25", "median", "q75"])
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    fences = fences.select(
        F.col("group").alias("g"), "n", "q25", "median", "q75",
        (F.col("q25") - reach).alias("low_fence"), (F.col("q75") + reach).alias("high_fence"),
    )
    counts = cells.groupBy("group", "value").agg(F.count(F.lit(1)).alias("count"))
    joined = counts.join(broadcast_if_small(fences), F.col("group").eqNullSafe(F.col("g")))
    inside = F.col("value").between(F.col("low_fence"), F.col("high_fence"))
    return joined.groupBy("group", "n", "q25", "median", "q75").agg(
        F.min(F.when(inside, F.col("value"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("high_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("count"))), F.lit(0)).alias("outliers"),
    )


def density(df: DataFrame, column: str, by: str | None = None, points: int = CURVE_POINTS) -> DataFrame:
    """Gaussian kernel density on an even grid from minimum to maximum.

    The width is the sample deviation times ``n ** (-1/5)``. Rows are summed up in cells of a
    sixteenth of it, as moments around the middle of their cell, in one aggregation; the
    kernel of a cell is a series in these, cut where a term is below double precision. Every cell
    meets only the points its kernel reaches before it is zero in doubles. Work is linear in the rows, and
    cells are as many as the range holds, whatever the rows. Groups are curves of their own. A group
    without spread (one row, or equal values) has no curve: it is one point of its
    value with a null density.
    """
    group = ref(by) if by else F.lit("all")
    cells = df.select(group.alias("group"), number(df, column).alias("value")).filter("value IS NOT NULL")
    facts = (
        cells.groupBy("group")
        .agg(
            F.count("value").cast("double").alias("n"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.stddev_samp("value").alias("std"),
        )
        .select(
            F.col("group").alias("g"),
            "n",
            "low",
            "high",
            F.when(F.col("low") < F.col("high"), F.col("std") * F.pow("n", F.lit(-0.2))).alias("h"),
        )
    )
    facts = held(facts)
    curves = facts.filter("h IS NOT NULL")
    reached = broadcast_if_small(curves)
    placed = cells.join(reached, F.col("group").eqNullSafe(F.col("g"))).withColumn(
        "cell", F.floor((F.col("value") - F.col("low")) / (F.col("h") / CELLS_PER_WIDTH))
    )
    middle = F.col("low") + (F.col("cell") + 0.5) * (F.col("h") / CELLS_PER_WIDTH)
    t = (F.col("value") - middle) / F.col("h")
    moments = []
    placed = placed.withColumns({"t": t}).withColumn("m0", F.exp(-0.5 * F.col("t") * F.col("t")))
    for k in range(SERIES_TERMS):
        power = F.col("m0") * F.pow("t", F.lit(float(k))) if k else F.col("m0")
        moments.append((F.sum(power) / F.lit(float(math.factorial(k)))).alias(f"m{k}"))
    summed = placed.groupBy("group", "cell", "low", "high", "h").agg(*moments)
    step = (F.col("high") - F.col("low")) / F.lit(float(points - 1))
    reach = KERNEL_REACH * F.col("h")
    first = F.greatest(F.ceil((middle - reach - F.col("low")) / step), F.lit(0))
    last = F.least(F.floor((middle + reach - F.col("low")) / step), F.lit(points - 1))
    met = summed.filter(first <= last).withColumn("point", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    met = met.withColumn("d", (F.col("low") + F.col("point") * step - middle) / F.col("h"))
    series = F.col(f"m{SERIES_TERMS - 1}")
    for k in reversed(range(SERIES_TERMS - 1)):
        series = series * F.col("d") + F.col(f"m{k}")
    heights = met.groupBy("group", "point").agg(F.sum(F.exp(-0.5 * F.col("d") * F.col("d")) * series).alias("height"))
    every = curves.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    joined = every.join(heights, F.col("g").eqNullSafe(F.col("group")) & (F.col("at") == F.col("point")), "left")
    scale = F.col("n") * F.col("h") * F.lit((2 * math.pi) ** 0.5)
    height = F.greatest(F.coalesce("height", F.lit(0.0)), F.lit(0.0))
    curve = joined.select(
        F.col("g").alias("group"), F.col("at").alias("point"), (F.col("low") + F.col("at") * step).alias("x"),
        (height / scale).alias("density"),
    )
    single = facts.filter("h IS NULL").select(
        F.col("g").alias("group"), F.lit(0).alias("point"), F.col("low").alias("x"), F.lit(None).cast("double").alias("density")
    )
    return curve.unionByName(single)


def violin(df: DataFrame, column: str, by: str | None = None, points: int = CURVE_POINTS) -> DataFrame:
    return density(df, column, by, points)


def heatmap(df: DataFrame, columns: Iterable[str] | None = None, wide: bool = False) -> DataFrame:
    """Correlation cells, or the square form."""
    cells = pearson(df, columns)
    if not wide:
        return cells.select("column_a", "column_b", "correlation")
    names = columns or [r["column_a"] for r in cells.select("column_a").distinct().orderBy("column_a").collect()]
    return correlation_matrix(cells, names)


def scatter_matrix(df: DataFrame, key, columns: Iterable[str], color: str | None = None, limit: int | None = None) -> DataFrame:
    """Marks of every column pair; with a ``limit`` one selection of rows serves all pairs."""
    keys = [key] if isinstance(key, str) else list(key)
    names = list(columns)
    picked = _picked(df, keys, limit)
    shown = [ref(color).cast("string").alias("color")] if color else []
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("x_column"), F.lit(b).alias("y_column"),
                number(df, a).alias("x"), number(df, b).alias("y"),
            )
            for a, b in combinations(names, 2)
        ]
    )
    return picked.select(*[ref(k) for k in keys], *shown, F.inline(pairs))


def parallel_coordinates(df: DataFrame, key, columns: Iterable[str], color: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows, all or ``limit`` of them, with every axis scaled to [0, 1] by the whole table."""
    keys = [key] if isinstance(key, str) else list(key)
    names = list(columns)
    ends = scalars(
        df, {(n, f): fn(number(df, n)) for n in names for f, fn in (("lo", F.min), ("hi", F.max))}
    )

    def axis(n):
        low, high = ends[n, "lo"], ends[n, "hi"]
        if low is None:
            return F.lit(None).cast("double").alias(n)
        return ((number(df, n) - F.lit(low)) / F.lit((high - low) or 1.0)).alias(n)

    shown = [ref(color).alias("color")] if color else []
    picked = _picked(df, keys, limit)
    return picked.select(*[ref(k) for k in keys], *shown, *[axis(n) for n in names])


def apply_filters(df: DataFrame, filters: Iterable[Mapping]) -> DataFrame:
    """Filter controls: ``select`` equals, ``multiselect`` is one of (empty: all),
    ``slider`` at least."""
    for control in filters:
        c, kind, value = ref(control["column"]), control["type"], control.get("value")
        if kind == "select":
            df = df.filter(c == F.lit(value)) if value is not None else df
        elif kind == "multiselect":
            df = df.filter(c.isin(list(value))) if value else df
        elif kind == "slider":
            df = df.filter(c >= F.lit(value)) if value is not None else df
        else:
            raise ChartError(f"unknown filter type: {kind}")
    return df


def first_rows(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


CHARTS: dict[str, Callable[..., DataFrame]] = {
    "scatter": scatter,
    "line": lines,
    "bar": bars,
    "histogram": histogram_bars,
    "box": box,
    "violin": violin,
    "heatmap": heatmap,
    "pie": pie,
    "density": density,
    "scatter_matrix": scatter_matrix,
    "parallel_coordinates": parallel_coordinates,
}


class ChartBook:
    """Chart tables by kind, with a ledger of what was asked for."""

    def __init__(self):
        self._ledger: list[tuple[str, str]] = []

    def chart_data(self, kind: str, df: DataFrame, **options) -> DataFrame:
        table = chart_data(kind, df, **options)
        self._ledger.append((kind, ", ".join(f"{k}={v}" for k, v in sorted(options.items()))))
        return table

    def ledger(self, spark) -> DataFrame:
        rows = [(i + 1, *entry) for i, entry in enumerate(self._ledger)]
        return spark.createDataFrame(rows, "position int, kind string, options string")

    def summary(self, spark) -> DataFrame:
        """Charts per kind."""
        return self.ledger(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("charts"))


def chart_data(kind: str, df: DataFrame, **options) -> DataFrame:
    if kind not in CHARTS:
        raise ChartError(f"unknown chart type: {kind}", {"available": sorted(CHARTS)})
    return CHARTS[kind](df, **options)
