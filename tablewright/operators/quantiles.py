"""Exact quantiles without a sort and without holding a column in one task.

A quantile sketch brackets each wanted order statistic; the last scan counts
the rows below the bracket and the distinct values inside it. Where the brackets
would hold too many values to fetch, one scan before it counts and sketches inside
them and narrows them; should they still hold too many, the counted values are
ranked on the executors. So the table is read two or three times, whatever its
size. The sketch only steers: a bracket that misses its value is moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import number, ref
from tablewright.operators.fused import scalars
from tablewright.operators.ranking import rank_table
from tablewright.session import held

# Sketch size; its rank error is about 0.0002 of the rows.
SKETCH_SIZE = 32_768
# Distinct values fetched in one round, over all columns together.
FETCH_ROWS = 200_000
# Half widths of the brackets, as shares of the rows, and the row count from
# which each one is wide enough to hold both neighbours of a quantile.
WIDTHS = ((0.0008, 5_000), (0.02, 200))


@dataclass
class ColumnSketch:
    """What the first scan learns about a column."""

    rows: int
    low: float | None
    high: float | None
    mean: float | None
    points: dict[float, float]

    def bracket(self, level: float) -> tuple[float, float]:
        for width, enough in WIDTHS:
            if self.rows >= enough:
                below, above = level - width, level + width
                return (
                    self.low if below <= 0 else self.points[below],
                    self.high if above >= 1 else self.points[above],
                )
        return self.low, self.high


@dataclass
class PowerSums:
    """Sums of the powers 1 to 4 of the distance from ``centre``."""

    centre: float
    rows: int = 0
    sums: list[float] = field(default_factory=lambda: [0.0] * 4)

    def add(self, rows: int, sums: Iterable[float]) -> None:
        self.rows += rows
        self.sums = [a + b for a, b in zip(self.sums, sums)]

    def central(self) -> tuple[float, float, float]:
        """Second to fourth central sums; the centre is within rounding of the mean."""
        n = self.rows
        s1, s2, s3, s4 = self.sums
        d = s1 / n
        m2 = s2 - n * d * d
        m3 = s3 - 3 * d * s2 + 2 * n * d**3
        m4 = s4 - 4 * d * s3 + 6 * d * d * s2 - 3 * n * d**4
        return m2, m3, m4


def _sketch_levels(levels: Iterable[float]) -> list[float]:
    out = set()
    for p in levels:
        for width, _ in WIDTHS:
            out |= {x for x in (p - width, p + width) if 0 < x < 1}
    return sorted(out) or [0.5]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, value)`` rows, one per non-missing cell of the given columns."""
    cells = F.array(*[number(df, name) + F.lit(0.0) for name in columns])
    return df.select(F.posexplode(cells).alias("i", "value")).filter(
        F.col("value").isNotNull()
    )


def sketch_columns(
    df: DataFrame, levels: Mapping[str, Iterable[float]]
) -> dict[str, ColumnSketch]:
    """First scan: count, extremes, mean and a sketch of every column."""
    names = list(levels)
    points = _sketch_levels(p for ps in levels.values() for p in ps)
    sketch = F.kll_sketch_agg_double("value", SKETCH_SIZE)
    rows = (
        _long(df, names)
        .groupBy("i")
        .agg(
            F.count("value").alias("rows"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.avg("value").alias("mean"),
            F.kll_sketch_get_quantile_double(
                sketch, F.array(*[F.lit(p) for p in points])
            ).alias("points"),
        )
        .collect()
    )
    found = {name: ColumnSketch(0, None, None, None, {}) for name in names}
    for r in rows:
        found[names[r["i"]]] = ColumnSketch(
            r["rows"], r["low"], r["high"], r["mean"], dict(zip(points, r["points"]))
        )
    return found


@dataclass
class _Target:
    """One order statistic: the ``index``-th smallest value, known to a bracket."""

    column: str
    index: int
    low: float
    high: float
    value: float | None = None


def _disjoint(brackets: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[list[float]] = []
    for low, high in sorted(brackets):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return [(low, high) for low, high in merged]


def _zone(zones: list[list[tuple[float, float]]]) -> Column:
    """Zone of a value: ``2j + 1`` in bracket ``j``, ``2j`` in the gap before it."""
    i, v = F.col("i"), F.col("value")
    slots = max(len(z) for z in zones)
    if slots > 16:
        lows = F.array(*[F.array(*[F.lit(z[0]) for z in zs]) for zs in zones])
        highs = F.array(*[F.array(*[F.lit(z[1]) for z in zs]) for zs in zones])
        return F.size(F.filter(lows[i], lambda b: b <= v)) + F.size(
            F.filter(highs[i], lambda b: b < v)
        )
    zone = F.lit(0)
    for j in range(slots):
        # NaN is above every number, so a column without bracket j adds nothing
        low = [zs[j][0] if j < len(zs) else math.nan for zs in zones]
        high = [zs[j][1] if j < len(zs) else math.nan for zs in zones]
        zone = zone + (v >= F.array(*[F.lit(b) for b in low])[i]).cast("int")
        zone = zone + (v > F.array(*[F.lit(b) for b in high])[i]).cast("int")
    return zone


def _zone_counts(
    df: DataFrame,
    zones: dict[str, list[tuple[float, float]]],
    centres: dict[str, float] | None,
) -> DataFrame:
    """``(i, zone, value, count)``: values inside a bracket, each gap as one row."""
    names = list(zones)
    aggregates = [F.count(F.lit(1)).alias("count")]
    if centres is not None:
        centre = F.array(*[F.lit(centres[name]) for name in names])[F.col("i")]
        d = F.col("d")
        powers = [d, d * d, d * d * d, d * d * d * d]
        aggregates += [F.sum(p).alias(f"s{k}") for k, p in enumerate(powers)]
        distance = (F.col("value") - centre).alias("d")
    else:
        distance = F.lit(0.0).alias("d")
    placed = _long(df, names).select("i", "value", _zone(list(zones.values())).alias("zone"), distance)
    inside = F.when(F.col("zone") % 2 == 1, F.col("value"))
    return placed.groupBy("i", "zone", inside.alias("value")).agg(*aggregates)


def _narrow(
    df: DataFrame, open_targets: list[_Target], centres: dict[str, float] | None
) -> dict[str, PowerSums] | None:
    """Shrink full brackets by counting and sketching inside them, in one scan.

    The same scan takes the power sums around ``centres``.
    """
    by_bracket: dict[tuple[str, float, float], list[_Target]] = {}
    for t in open_targets:
        by_bracket.setdefault((t.column, t.low, t.high), []).append(t)
    facts = {}
    for name, centre in (centres or {}).items():
        c, d = number(df, name), number(df, name) - F.lit(centre)
        facts[name, "rows"] = F.count(c)
        for k, p in enumerate((d, d * d, d * d * d, d * d * d * d)):
            facts[name, k] = F.sum(p)
    for key in by_bracket:
        name, low, high = key
        c = number(df, name) + F.lit(0.0)
        within = (c >= low) & (c <= high)
        facts[key, "below"] = F.count_if(c < low)
        facts[key, "inside"] = F.count_if(within)
        facts[key, "sketch"] = F.kll_sketch_agg_double(F.when(within, c), SKETCH_SIZE)
    got = scalars(df, facts)
    asked = []
    for at, (key, targets) in enumerate(by_bracket.items()):
        rows = got[key, "inside"]
        if key[1] == key[2] or not rows:
            continue
        slack = max(WIDTHS[0][0], 3.0 / rows)
        levels = []
        for t in targets:
            p = (t.index - got[key, "below"]) / rows
            levels += [min(max(p - slack, 0.0), 1.0), min(max(p + slack, 0.0), 1.0)]
        asked.append((at, got[key, "sketch"], levels))
    if asked:  # a row per bracket
        table = df.sparkSession.createDataFrame([a[:2] for a in asked], "at int, sketch binary")
        # Spark takes the levels as literals only, so every bracket has a branch of its own
        points = F.coalesce(
            *[
                F.when(F.col("at") == at, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, levels))))
                for at, _, levels in asked
            ]
        )
        points = table.select("at", points.alias("points"))
        brackets = list(by_bracket.values())
        for row in points.collect():
            for i, t in enumerate(brackets[row["at"]]):
                t.low, t.high = row["points"][2 * i], row["points"][2 * i + 1]
    if centres is None:
        return None
    return {n: PowerSums(c, got[n, "rows"], [got[n, k] or 0.0 for k in range(4)]) for n, c in centres.items()}


def _settle(
    df: DataFrame,
    targets: list[_Target],
    fetch_rows: int,
    centres: dict[str, float] | None,
    sketches: dict[str, ColumnSketch],
) -> dict[str, PowerSums] | None:
    """Resolve every target, moving its bracket should the sketch have missed.

    Returns power sums of the columns in ``centres``.
    """
    # a settled target still takes a few rows
    fetch_rows = max(fetch_rows, 16 * len(targets))
    powers = None
    open_targets = [t for t in targets if t.value is None]
    brackets = {(t.column, t.low, t.high) for t in open_targets}
    width = 2 * WIDTHS[0][0]
    if sum(width * sketches[name].rows for name, _, _ in brackets) > fetch_rows:
        powers = _narrow(df, open_targets, centres)
    for _ in range(64):
        open_targets = [t for t in targets if t.value is None]
        wanted_sums = centres if powers is None else None
        if not open_targets and not wanted_sums:
            return powers
        zones = {
            name: _disjoint((t.low, t.high) for t in open_targets if t.column == name)
            for name in dict.fromkeys(t.column for t in open_targets)
        }
        if wanted_sums is not None:
            zones = {name: zones.get(name, []) for name in wanted_sums}
        names = list(zones)
        if not any(zones.values()):
            zones[names[0]] = [(math.inf, math.inf)]
        counted = held(_zone_counts(df, zones, wanted_sums))
        if wanted_sums is not None:
            powers = {name: PowerSums(wanted_sums[name]) for name in names}
            sums = counted.groupBy("i").agg(F.sum("count").alias("rows"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])
            for row in sums.collect():  # a row per column
                powers[names[row["i"]]].add(row["rows"], [row[f"s{k}"] for k in range(4)])
        by_column = {
            name: sorted((t for t in open_targets if t.column == name), key=lambda t: t.index) for name in names
        }
        if counted.count() > fetch_rows:
            _rank_inside(counted, names, by_column, zones)
            continue
        entries: dict[str, list] = {name: [] for name in names}
        for row in counted.select("i", "zone", "value", "count").collect():
            entries[names[row["i"]]].append((row["zone"], row["value"], row["count"]))
        for name in names:
            _locate(
                sorted(entries[name], key=lambda e: (e[0], -math.inf if e[1] is None else e[1])),
                by_column[name],
                zones[name],
            )
    raise RuntimeError("quantile brackets did not settle")


def _rank_inside(counted: DataFrame, names: list[str], by_column: dict, zones: dict) -> None:
    """Find targets among counted values that are too many to fetch, on the executors."""
    totals = counted.groupBy("i", "zone").agg(F.sum("count").alias("count")).collect()  # a row per zone
    wanted = []
    for at, name in enumerate(names):
        sizes = sorted((r["zone"], r["count"]) for r in totals if r["i"] == at)
        for k, target in enumerate(by_column[name]):
            seen = 0
            for zone, count in sizes:
                if target.index < seen + count:
                    if zone % 2:
                        wanted.append((at, zone, k, target.index - seen))
                    else:
                        _locate([(zone, None, target.index + 1)], [target], zones[name])
                    break
                seen += count
    if not wanted:
        return
    inside = counted.filter(F.col("zone") % 2 == 1).select("i", "zone", "value", "count")
    ranked = rank_table(inside, ["i", "zone"])
    asked = counted.sparkSession.createDataFrame(wanted, "i int, zone int, k int, offset bigint")
    found = ranked.join(F.broadcast(asked), ["i", "zone"]).filter(  # a row per target
        (F.col("before") <= F.col("offset")) & (F.col("offset") < F.col("before") + F.col("count"))
    )
    for row in found.select("i", "k", "value").collect():
        by_column[names[row["i"]]][row["k"]].value = row["value"]


def _locate(entries: list, targets: list[_Target], brackets: list) -> None:
    """Walk the counted zones in order and fill in the targets they cover."""
    seen = at = 0
    for zone, value, count in entries:
        seen += count
        while at < len(targets) and targets[at].index < seen:
            target = targets[at]
            if zone % 2:
                target.value = value
            else:
                # the sketch missed: the value lies in this gap
                j = zone // 2
                target.low = brackets[j - 1][1] if j else -math.inf
                target.high = brackets[j][0] if j < len(brackets) else math.inf
            at += 1


def quantiles_and_powers(
    df: DataFrame,
    levels: Mapping[str, Iterable[float]],
    fetch_rows: int = FETCH_ROWS,
    powers: bool = False,
) -> tuple[dict, dict, dict | None]:
    """Quantiles, first-scan facts and, if asked, power sums of every column."""
    wanted = {name: sorted(set(ps)) for name, ps in levels.items()}
    pruned = df.select(*[ref(name) for name in wanted])
    sketches = sketch_columns(pruned, wanted)
    targets: list[_Target] = []
    picks: dict[tuple[str, float], tuple[_Target, _Target, float]] = {}
    for name, ps in wanted.items():
        sketch = sketches[name]
        if not sketch.rows:
            continue
        for p in ps:
            position = (sketch.rows - 1) * p
            floor = math.floor(position)
            pair = []
            for index in (floor, min(floor + 1, sketch.rows - 1)):
                target = _Target(name, index, *sketch.bracket(p))
                if index == 0:
                    target.value = sketch.low
                elif index == sketch.rows - 1:
                    target.value = sketch.high
                pair.append(target)
            targets += pair
            picks[name, p] = (*pair, position - floor)
    centres = None
    if powers:
        centres = {n: s.mean for n, s in sketches.items() if s.rows}
    sums = _settle(pruned, targets, fetch_rows, centres, sketches)
    result: dict[str, dict[float, float | None]] = {}
    for name, ps in wanted.items():
        result[name] = {}
        for p in ps:
            if (name, p) not in picks:
                result[name][p] = None
                continue
            lower, upper, share = picks[name, p]
            if share == 0 or lower.value == upper.value:
                result[name][p] = lower.value
            else:
                result[name][p] = lower.value + (upper.value - lower.value) * share
    return result, sketches, sums


def exact_quantiles(
    df: DataFrame,
    levels: Mapping[str, Iterable[float]],
    fetch_rows: int = FETCH_ROWS,
) -> dict[str, dict[float, float | None]]:
    """Quantiles with linear interpolation, per column, nulls and NaN left out."""
    return quantiles_and_powers(df, levels, fetch_rows)[0]
