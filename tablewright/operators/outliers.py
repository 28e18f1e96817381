"""Outlier detection (report) and outlier removal (filter)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import CleanError
from tablewright.functions.kinds import number, numeric_columns, ref
from tablewright.operators.describe import NumericSummary
from tablewright.operators.fused import scalars
from tablewright.operators.quantiles import exact_quantiles

# Limits used when detecting.
Z_LIMIT = 3.0
FENCE = 1.5
# Fixed value: limit used by both methods when removing.
REMOVAL_THRESHOLD = 3.0


def detect_outliers(
    df: DataFrame,
    key: str | Iterable[str],
    columns: Iterable[str] | None = None,
    methods: Iterable[str] = ("zscore", "iqr"),
    summary: NumericSummary | None = None,
) -> DataFrame:
    """``(key..., column, method, value)`` per outlying cell.

    ``zscore``: further than 3 population deviations from the mean. ``iqr``:
    outside 1.5 interquartile ranges beyond the quartiles. Bounds come from one
    summary of all columns, the cells from one scan.
    """
    keys = [key] if isinstance(key, str) else list(key)
    columns = numeric_columns(df) if columns is None else list(columns)
    methods = list(methods)
    unknown = set(methods) - {"zscore", "iqr"}
    if unknown:
        raise CleanError(f"unknown outlier methods: {sorted(unknown)}")
    summary = summary or NumericSummary(df, columns)
    cells, conditions = [], []
    for name in columns:
        v = summary[name]
        if not v["count"]:
            continue
        c = number(df, name)
        for method in methods:
            if method == "zscore":
                if not v["std_pop"]:
                    continue
                outside = F.abs((c - F.lit(v["mean"])) / F.lit(v["std_pop"])) > Z_LIMIT
            else:
                reach = FENCE * (v["q75"] - v["q25"])
                outside = (c < F.lit(v["q25"] - reach)) | (c > F.lit(v["q75"] + reach))
            conditions.append(outside)
            cells.append(
                F.when(
                    outside,
                    F.struct(
                        F.lit(name).alias("column"),
                        F.lit(method).alias("method"),
                        c.alias("value"),
                    ),
                )
            )
    kept = [ref(k) for k in keys]
    if not cells:
        return df.select(*kept).limit(0).select(
            "*", *[F.lit(None).cast(t).alias(n) for n, t in (("column", "string"), ("method", "string"), ("value", "double"))]
        )
    hits = F.filter(F.array(*cells), lambda cell: cell.isNotNull())
    # few rows hold an outlier; only those are unfolded
    some = reduce(lambda a, b: a | b, conditions)
    return df.filter(some).select(*kept, F.inline(hits))


def _within_deviations(df: DataFrame, name: str, threshold: float) -> Column | None:
    c = number(df, name)
    v = scalars(df.select(ref(name)), {"mean": F.avg(c), "std": F.stddev_samp(c)})
    if not v["std"]:
        return ref(name).isNotNull()
    return F.abs((c - F.lit(v["mean"])) / F.lit(v["std"])) <= threshold


def _within_fences(df: DataFrame, name: str, threshold: float) -> Column | None:
    q = exact_quantiles(df, {name: (0.25, 0.75)})[name]
    if q[0.25] is None:
        return ref(name).isNotNull()
    reach = threshold * (q[0.75] - q[0.25])
    return number(df, name).between(F.lit(q[0.25] - reach), F.lit(q[0.75] + reach))


def remove_outliers(
    df: DataFrame,
    method: str = "zscore",
    threshold: float = REMOVAL_THRESHOLD,
    columns: Iterable[str] | None = None,
    sequential: bool = True,
) -> DataFrame:
    """Keep rows whose values lie within the bounds; rows with a null go.

    Columns are taken one after another and each one's bounds are computed on
    the rows that survived the ones before. ``sequential=False`` computes all
    bounds on the input. ``columns=None`` means all numeric columns, an empty
    list none. Deviations are sample ones; a column without spread only loses
    its nulls.
    """
    rules = {"zscore": _within_deviations, "iqr": _within_fences}
    if method not in rules:
        raise CleanError(f"unknown outlier method: {method}")
    names = numeric_columns(df) if columns is None else [c for c in columns if c in df.columns]
    rule = rules[method]
    if not sequential:
        conditions = [rule(df, name, threshold) for name in names]
        for condition in conditions:
            df = df.filter(condition)
        return df
    # bounds only need the numeric columns, so the passes read no others
    narrow = df.select(*[ref(n) for n in names])
    for name in names:
        condition = rule(narrow, name, threshold)
        narrow = narrow.filter(condition)
        df = df.filter(condition)
    return df
