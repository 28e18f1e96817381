"""Scalers: parameters from one or two scans, transforms as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.functions.kinds import number, ref
from tablewright.operators.fused import scalars
from tablewright.operators.quantiles import exact_quantiles
from tablewright.operators.ranking import column_ranks
from tablewright.session import held

METHODS = ("standard", "minmax", "robust", "power", "quantile")

# Fixed values of the quantile transform: number of landmarks, and the distance
# from 0 and 1 at which positions are clipped.
LANDMARKS = 1000
CLIP = 1e-7
# Fixed values of the power transform's search: first window, first step, last step.
POWER_WINDOW = (-2.0, 4.0)
POWER_STEP = 0.5
POWER_LAST_STEP = 0.0005
POWER_REACH = 1e6


def fit_scaler(df: DataFrame, columns: Iterable[str], method: str) -> dict[str, dict]:
    columns = list(columns)
    if method not in METHODS:
        raise PrepareError(f"unknown scaling method: {method}", {"available_methods": list(METHODS)})
    if not columns:
        return {}
    fitted = {
        "standard": _fit_standard,
        "minmax": _fit_minmax,
        "robust": _fit_robust,
        "power": _fit_power,
        "quantile": _fit_quantile,
    }[method](df, columns)
    return {c: {"method": method, **fitted[c]} for c in columns}


def _fit_standard(df: DataFrame, columns: list[str]) -> dict:
    got = scalars(
        df,
        {(c, f): fn(number(df, c)) for c in columns for f, fn in (("mean", F.avg), ("std", F.stddev_pop))},
    )
    return {c: {"mean": got[c, "mean"], "std": got[c, "std"]} for c in columns}


def _fit_minmax(df: DataFrame, columns: list[str]) -> dict:
    got = scalars(
        df,
        {(c, f): fn(number(df, c)) for c in columns for f, fn in (("min", F.min), ("max", F.max))},
    )
    return {c: {"min": got[c, "min"], "max": got[c, "max"]} for c in columns}


def _fit_robust(df: DataFrame, columns: list[str]) -> dict:
    got = exact_quantiles(df, {c: (0.25, 0.5, 0.75) for c in columns})
    return {
        c: {
            "median": got[c][0.5],
            "iqr": None if got[c][0.5] is None else got[c][0.75] - got[c][0.25],
        }
        for c in columns
    }


def yeo_johnson(c: Column, lam: Column) -> Column:
    up = F.when(F.abs(lam) < 1e-12, F.log1p(c)).otherwise((F.pow(c + 1, lam) - 1) / lam)
    mirror = 2 - lam
    down = F.when(F.abs(mirror) < 1e-12, -F.log1p(-c)).otherwise(
        -(F.pow(1 - c, mirror) - 1) / mirror
    )
    return F.when(c >= 0, up).otherwise(down)


def _log_scale(centre: Column, lam: Column) -> Column:
    """Logarithm of the transform's slope at the centre, but for a constant factor."""
    return F.when(centre >= 0, lam * F.log1p(F.abs(centre))).otherwise((2 - lam) * F.log1p(F.abs(centre)))


def _power_gap(a: Column, b: Column, lam: Column) -> Column:
    """``((1 + a) ** lam / (1 + b) ** lam - 1) / lam`` from the logarithm of the ratio."""
    ratio = F.log1p((a - b) / (1 + b))
    return F.when(F.abs(lam) < 1e-12, ratio).otherwise(F.expm1(lam * ratio) / lam)


def yeo_johnson_gap(c: Column, centre: Column, lam: Column) -> Column:
    """Transformed value less the transformed centre, divided by the scale at the centre.

    No two large numbers are subtracted, and no power of a large number is left: values
    close together far from zero keep their spread.
    """
    same_side = F.when(c >= 0, _power_gap(c, centre, lam)).otherwise(-_power_gap(-c, -centre, 2 - lam))
    across = (yeo_johnson(c, lam) - yeo_johnson(centre, lam)) * F.exp(-_log_scale(centre, lam))
    return F.when((c >= 0) == (centre >= 0), same_side).otherwise(across)


def _fit_power(df: DataFrame, columns: list[str]) -> dict:
    """Lambda of largest likelihood per column, then mean and deviation.

    A grid of lambdas is scored for all columns at once and zoomed in on. Equal
    values are counted first, so a round reads distinct values only.
    """
    positions = F.posexplode(F.array(*[number(df, c) + F.lit(0.0) for c in columns]))
    counts = held(
        df.select(positions.alias("i", "value"))
        .filter(F.col("value").isNotNull())
        .groupBy("i", "value")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    v, w = F.col("value"), F.col("w")
    base = {
        r["i"]: r
        for r in counts.groupBy("i")
        .agg(
            F.sum(w).alias("n"),
            (F.sum(v * w) / F.sum(w)).alias("mean"),
            F.sum(w * F.signum(v) * F.log1p(F.abs(v))).alias("jacobian"),
            (F.min(v) == F.max(v)).alias("constant"),
        )
        .collect()
    }
    open_columns = [i for i in base if not base[i]["constant"]]
    best = {i: 1.0 for i in range(len(columns))}
    low, high = POWER_WINDOW
    steps = int(round((high - low) / POWER_STEP))
    grids = {i: [low + k * POWER_STEP for k in range(steps + 1)] for i in open_columns}
    step = POWER_STEP

    def score(grids: dict[int, list[float]]) -> dict[int, list[float]]:
        size = len(next(iter(grids.values())))
        table = F.array(
            *[
                F.array(*[F.lit(x) for x in grids.get(i, [1.0] * size)])
                for i in range(len(columns))
            ]
        )
        centres = F.array(*[F.lit(base[i]["mean"] if i in base else 0.0) for i in range(len(columns))])
        rows = counts.select("i", "value", "w", F.posexplode(table[F.col("i")]).alias("k", "lam"))
        lam = F.col("lam")
        # measured from the transformed mean, which keeps the small variances
        t = yeo_johnson_gap(v, centres[F.col("i")], lam)
        sums = (
            rows.select("i", "k", "w", t.alias("t"))
            .groupBy("i", "k")
            .agg(F.sum(w * F.col("t")).alias("s1"), F.sum(w * F.col("t") * F.col("t")).alias("s2"))
            .collect()
        )
        out = {i: [-math.inf] * size for i in grids}
        for r in sums:
            i, n = r["i"], base[r["i"]]["n"]
            if i not in grids:
                continue
            variance = r["s2"] / n - (r["s1"] / n) ** 2
            if variance > 0 and math.isfinite(variance):
                x = grids[i][r["k"]]
                centre = base[i]["mean"]
                scale = (x if centre >= 0 else 2 - x) * math.log1p(abs(centre))
                out[i][r["k"]] = -n / 2 * (math.log(variance) + 2 * scale) + (x - 1) * base[i]["jacobian"]
        return out

    while open_columns:
        scores = score(grids)
        lost = [columns[i] for i in open_columns if max(scores[i]) == -math.inf]
        if lost:
            raise PrepareError("no power transform has a finite likelihood", {"columns": lost})
        moved = False
        for i in open_columns:
            k = max(range(len(scores[i])), key=lambda j: scores[i][j])
            best[i] = grids[i][k]
            moved = moved or k in (0, len(scores[i]) - 1)
        if moved:
            # the best is on the rim of a window: slide the windows with twice the step
            far = [columns[i] for i in open_columns if abs(best[i]) > POWER_REACH]
            if far:
                raise PrepareError("the likelihood has no peak", {"columns": far})
            step *= 2
            grids = {i: [best[i] + (j - 4) * step for j in range(9)] for i in open_columns}
            continue
        if step <= POWER_LAST_STEP:
            for i in open_columns:
                best[i] = _peak(grids[i], scores[i])
            break
        step /= 4
        grids = {i: [best[i] + (j - 4) * step for j in range(9)] for i in open_columns}
    transformed = {
        (c, f): fn(yeo_johnson_gap(number(df, c), F.lit(_centre(base, i)), F.lit(best[i])))
        for i, c in enumerate(columns)
        for f, fn in (("mean", F.avg), ("std", F.stddev_pop))
    }
    got = scalars(df, transformed)
    return {
        c: {"lambda": best[i], "centre": _centre(base, i), "mean": got[c, "mean"], "std": got[c, "std"]}
        for i, c in enumerate(columns)
    }


def _centre(base: dict, i: int) -> float:
    return base[i]["mean"] if i in base else 0.0


def _peak(xs: list[float], ys: list[float]) -> float:
    """Top of the parabola through the best point and its neighbours."""
    k = max(range(len(ys)), key=lambda j: ys[j])
    if k in (0, len(ys) - 1):
        return xs[k]
    bend = ys[k - 1] - 2 * ys[k] + ys[k + 1]
    if not math.isfinite(bend) or bend >= 0:
        return xs[k]
    return xs[k] + (xs[k + 1] - xs[k]) * (ys[k - 1] - ys[k + 1]) / (2 * bend)


def _fit_quantile(df: DataFrame, columns: list[str]) -> dict:
    """Landmarks at up to 1000 even levels, interpolated between exact order statistics."""
    ranks = column_ranks(df, columns)
    # keep the few distinct values next to a landmark
    last = F.col("total") - 1
    marks = F.least(F.col("total"), F.lit(LANDMARKS)) - 1

    def landmark_index(position: Column) -> Column:
        return F.floor(F.try_divide(position * marks, last))

    near = ranks.filter(
        (last == 0)
        | (landmark_index(F.col("before") + F.col("count") + 1) > landmark_index(F.col("before") - 2))
    )
    rows = near.select("column", "value", "before", "count", "total").collect()
    fitted = {c: {"landmarks": []} for c in columns}
    by_column: dict[str, list] = {}
    for r in rows:
        by_column.setdefault(r["column"], []).append(r)
    for name, found in by_column.items():
        found.sort(key=lambda r: r["before"])
        total = found[0]["total"]
        size = min(total, LANDMARKS)
        at, landmarks = 0, []

        def value_at(index: int, start: int) -> tuple[float, int]:
            while found[start]["before"] + found[start]["count"] <= index:
                start += 1
            return found[start]["value"], start

        for i in range(size):
            position = (total - 1) * (i / (size - 1)) if size > 1 else 0.0
            floor = min(math.floor(position), total - 1)
            lower, at = value_at(floor, at)
            upper, _ = value_at(min(floor + 1, total - 1), at)
            landmarks.append(lower + (upper - lower) * (position - floor))
        fitted[name]["landmarks"] = landmarks
    return fitted


def _safe(divisor: float | None) -> float:
    return divisor if divisor else 1.0


def scaled(c: Column, params: dict) -> Column:
    """The scaled value; columns without spread become 0."""
    method = params["method"]
    c = c.cast("double")
    if method == "standard":
        return (c - F.lit(params["mean"])) / F.lit(_safe(params["std"]))
    if method == "minmax":
        if params["min"] is None:
            return c
        return (c - F.lit(params["min"])) / F.lit(_safe(params["max"] - params["min"]))
    if method == "robust":
        return (c - F.lit(params["median"])) / F.lit(_safe(params["iqr"]))
    if method == "power":
        t = yeo_johnson_gap(c, F.lit(params["centre"]), F.lit(params["lambda"]))
        return (t - F.lit(params["mean"])) / F.lit(_safe(params["std"]))
    return _to_normal(params["landmarks"])(c)


def inverse_normal(p):
    """Quantiles of the normal distribution for an array of probabilities.

    Newton steps on the tail's logarithm, ``log(Q(x))``, from an asymptotic start. The
    tail is a continued fraction far out and a series near the middle.
    """
    import numpy as np

    low = np.minimum(p, 1 - p)
    wanted = np.log(low)
    x = np.sqrt(np.maximum(-2 * np.log(2 * np.maximum(low, 1e-300)), 0.0))
    for _ in range(40):
        density = np.exp(-0.5 * x * x) / np.sqrt(2 * np.pi)
        term, series = x.copy(), x.copy()
        for k in range(1, 60):
            term = term * x * x / (2 * k + 1)
            series = series + term
        near = 0.5 - density * series
        fraction = x + 0.0
        for k in range(60, 0, -1):
            fraction = x + k / np.where(fraction == 0, 1e-300, fraction)
        tail = np.where(x < 2.5, near, density / np.where(fraction == 0, 1.0, fraction))
        step = (np.log(tail) - wanted) * tail / density
        x = np.maximum(x + step, 0.0)
        if not np.any(np.abs(step) > 1e-13 * (1 + x)):
            break
    return np.where(p < 0.5, -x, x)


def _to_normal(landmarks: list[float]):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def to_normal(values):
        import numpy as np
        import pandas as pd

        x = values.to_numpy(dtype="float64")
        marks = np.maximum.accumulate(np.asarray(landmarks))
        levels = np.linspace(0.0, 1.0, len(marks)) if len(marks) else marks
        if not len(marks):
            return pd.Series(np.full(len(x), np.nan))
        # repeated landmarks: middle of the first and the last one
        first = 1.0 - np.interp(-x, -marks[::-1], 1.0 - levels[::-1])
        position = (np.interp(x, marks, levels) + first) / 2.0
        position = np.where(x - CLIP < marks[0], 0.0, position)
        position = np.where(x + CLIP > marks[-1], 1.0, position)
        position = np.clip(position, CLIP, 1.0 - CLIP)
        return pd.Series(np.where(np.isnan(x), np.nan, inverse_normal(position)))

    return lambda c: F.when(c.isNotNull(), to_normal(c))
