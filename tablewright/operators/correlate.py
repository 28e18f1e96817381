"""Correlation matrices as tidy tables ``(method, column_a, column_b, correlation)``.

Every pair uses the rows where both columns are present.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import ProfileError
from tablewright.functions.kinds import number, numeric_columns, ref
from tablewright.operators.fused import counted, scalars
from tablewright.operators.ranking import attach, rank_table
from tablewright.session import held

# Default methods, and the limit above which a pair is reported.
METHODS = ("pearson", "spearman")
HIGH_CORRELATION = 0.9

# Up to this many pairs the aggregates run as native expressions; more would
# overflow the generated code, and are summed as matrix products.
NATIVE_PAIRS = 10
# Up to this many columns the matrix is put together on the driver.
DRIVER_COLUMNS = 200

SCHEMA = "method string, column_a string, column_b string, correlation double"


def _ratio(cov: float | None, var_x: float | None, var_y: float | None) -> float | None:
    """The one rule of all paths: no correlation with an infinite value on either side."""
    if cov is None or not var_x or not var_y:
        return None
    r = cov / math.sqrt(var_x) / math.sqrt(var_y)
    return max(-1.0, min(1.0, r)) if math.isfinite(r) else None


def _pair_correlations(
    df: DataFrame, pairs: dict[tuple[str, str], tuple[Column, Column]], counts: bool = False
):
    """Correlation of expression pairs; rows with either side null are skipped.

    A side whose values in those rows are all equal, or one that holds an infinite
    value there, has no correlation. With ``counts`` the numbers of rows come too.
    """
    names: dict[tuple[str, str], tuple[str, str]] = {}
    sides: dict[str, Column] = {}
    for key, (x, y) in pairs.items():
        names[key] = (str(x), str(y))
        sides[str(x)], sides[str(y)] = x, y
    if len(pairs) <= NATIVE_PAIRS:
        found = _native_pairs(df, pairs, names, sides)
    else:
        order = list(sides)
        labels = [f"_{i}" for i in range(len(order))]
        table = df.select(*[sides[text].alias(label) for text, label in zip(order, labels)])
        places = {key: (order.index(x), order.index(y)) for key, (x, y) in names.items()}
        rows = _pair_rows(table, sorted(set(places.values()))).collect()  # one row per pair
        by_place = {(r["i"], r["j"]): (r["r"], int(r["n"])) for r in rows}
        found = {key: by_place.get(place, (None, 0)) for key, place in places.items()}
    r = {key: value for key, (value, _) in found.items()}
    return (r, {key: n for key, (_, n) in found.items()}) if counts else r


def _native_pairs(df, pairs, names, sides) -> dict:
    """Few pairs as native aggregates: one scan when the pairs have their nulls on
    the same rows, else a second one for the pairs that do not."""

    def spread(c: Column) -> Column:
        return F.when(F.min(c) < F.max(c), F.var_pop(c))

    first = {}
    for text, c in sides.items():
        first[text, "n"] = F.count(c)
        first[text, "var"] = spread(c)
    for key, (x, y) in pairs.items():
        first[key, "n"] = F.regr_count(x, y)
        first[key, "cov"] = F.covar_pop(x, y)
    got = scalars(df, first)
    result, uneven = {}, {}
    for key, (x, y) in pairs.items():
        tx, ty = names[key]
        if got[key, "n"] == got[tx, "n"] == got[ty, "n"]:
            result[key] = _ratio(got[key, "cov"], got[tx, "var"], got[ty, "var"]), got[key, "n"]
        else:
            uneven[key, "x"] = spread(F.when(y.isNotNull(), x))
            uneven[key, "y"] = spread(F.when(x.isNotNull(), y))
    if uneven:
        variances = scalars(df, uneven)
        for key in {k for k, _ in uneven}:
            result[key] = _ratio(got[key, "cov"], variances[key, "x"], variances[key, "y"]), got[key, "n"]
    return result


_PARTS = ["n", "mx", "my", "vx", "vy", "c", "lx", "hx", "ly", "hy", "bad"]


def _pair_rows(table: DataFrame, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """``(i, j, n, r)`` of column pairs; ``None`` means every pair with ``i <= j``.

    Each task multiplies its rows as matrices, every batch around its own means, and
    sends means and co-moments, one row per pair whatever the number of rows it saw.
    The parts are then merged around the common mean.
    """
    k = len(table.columns)

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        i, j = np.triu_indices(k) if pairs is None else np.array(pairs, dtype="int64").reshape(-1, 2).T
        dense = pairs is None or 4 * len(pairs) >= k * k
        total = {name: np.zeros(len(i)) for name in _PARTS}
        total["lx"][:] = total["ly"][:] = np.inf
        total["hx"][:] = total["hy"][:] = -np.inf
        for batch in batches:
            # nulls arrive as NaN
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            seen = ~np.isnan(x)
            odd = np.isinf(x)
            mask = seen.astype("float64")
            plain = np.where(seen & ~odd, x, 0.0)
            middle = plain.sum(axis=0) / np.maximum((seen & ~odd).sum(axis=0), 1)
            x0 = np.where(seen & ~odd, plain - middle, 0.0)
            square = x0 * x0
            if dense:
                n, sx, sxx, sxy = mask.T @ mask, x0.T @ mask, square.T @ mask, x0.T @ x0
                odds = odd.astype("float64").T @ mask
                n, bad = n[i, j], odds[i, j] + odds[j, i]
                a, b, aa, bb, ab = sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]
            else:
                sums = np.zeros((7, len(i)))
                for at, (p, q) in enumerate(zip(i, j)):
                    mp, mq = mask[:, p], mask[:, q]
                    sums[:, at] = [
                        mp @ mq, x0[:, p] @ mq, x0[:, q] @ mp, square[:, p] @ mq, square[:, q] @ mp,
                        x0[:, p] @ x0[:, q], odd[:, p] @ mq + odd[:, q] @ mp,
                    ]
                n, a, b, aa, bb, ab, bad = sums
            ends = {}
            if seen.all():
                low, high = x.min(axis=0, initial=np.inf), x.max(axis=0, initial=-np.inf)
                ends = {"lx": low[i], "hx": high[i], "ly": low[j], "hy": high[j]}
            else:
                down, up = np.where(seen, x, np.inf), np.where(seen, x, -np.inf)
                ends = {e: np.empty(len(i)) for e in ("lx", "hx", "ly", "hy")}
                for at, (p, q) in enumerate(zip(i, j)):
                    both = seen[:, p] & seen[:, q]
                    ends["lx"][at] = down[both, p].min(initial=np.inf)
                    ends["hx"][at] = up[both, p].max(initial=-np.inf)
                    ends["ly"][at] = down[both, q].min(initial=np.inf)
                    ends["hy"][at] = up[both, q].max(initial=-np.inf)
            for e, of in (("lx", np.minimum), ("ly", np.minimum), ("hx", np.maximum), ("hy", np.maximum)):
                total[e] = of(total[e], ends[e])
            some = np.maximum(n, 1)
            mx, my = middle[i] + a / some, middle[j] + b / some
            vx, vy, c = aa - a * a / some, bb - b * b / some, ab - a * b / some
            every = np.maximum(total["n"] + n, 1)
            dx, dy, share = mx - total["mx"], my - total["my"], total["n"] * n / every
            total["vx"] += vx + dx * dx * share
            total["vy"] += vy + dy * dy * share
            total["c"] += c + dx * dy * share
            total["mx"] = total["mx"] + dx * n / every
            total["my"] = total["my"] + dy * n / every
            total["n"] = total["n"] + n
            total["bad"] += bad
        places = {"i": i.astype("int32"), "j": j.astype("int32")}
        yield pa.RecordBatch.from_pydict({**places, **total})

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in _PARTS)
    cells = table.select(*[ref(c).cast("double").alias(c) for c in table.columns])
    parts = cells.mapInArrow(multiply, schema).filter("n > 0")
    same = Window.partitionBy("i", "j")  # a row per task
    centred = parts.withColumns(
        {
            "dx": F.col("mx") - F.sum(F.col("n") * F.col("mx")).over(same) / F.sum("n").over(same),
            "dy": F.col("my") - F.sum(F.col("n") * F.col("my")).over(same) / F.sum("n").over(same),
        }
    )
    merged = centred.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("vx") + F.col("n") * F.col("dx") * F.col("dx")).alias("vx"),
        F.sum(F.col("vy") + F.col("n") * F.col("dy") * F.col("dy")).alias("vy"),
        F.sum(F.col("c") + F.col("n") * F.col("dx") * F.col("dy")).alias("c"),
        ((F.min("lx") < F.max("hx")) & (F.min("ly") < F.max("hy")) & (F.sum("bad") == 0)).alias("good"),
    )
    spread = F.col("good") & (F.col("vx") > 0) & (F.col("vy") > 0)
    r = F.when(spread, F.col("c") / F.sqrt(F.when(spread, F.col("vx"))) / F.sqrt(F.when(spread, F.col("vy"))))
    bounded = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return merged.select("i", "j", "n", bounded.alias("r"))


def _square(spark, method: str, columns: list[str], values: dict) -> DataFrame:
    rows = []
    for a in columns:
        for b in columns:
            r = values.get((a, b), values.get((b, a)))
            rows.append((method, a, b, r))
    return spark.createDataFrame(rows, SCHEMA)


def _upper(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, a) for a in columns] + list(combinations(columns, 2))


def pearson(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    columns = numeric_columns(df) if columns is None else list(columns)
    if len(columns) > DRIVER_COLUMNS:
        return _pearson_blocks(df, columns)
    pairs = {(a, b): (number(df, a), number(df, b)) for a, b in _upper(columns)}
    return _square(df.sparkSession, "pearson", columns, _pair_correlations(df, pairs))


def _pearson_blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Very many columns: the matrix itself stays on the executors."""
    table = df.select(*[number(df, c).alias(f"_{i}") for i, c in enumerate(columns)])
    labels = F.array(*[F.lit(c) for c in columns])
    # pairs without a common row have a row too
    numbers = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("i"))
    every = numbers.select("i", F.explode(F.sequence(F.col("i"), F.lit(len(columns) - 1))).alias("j"))
    half = every.join(_pair_rows(table).select("i", "j", "r"), ["i", "j"], "left")
    mirrored = half.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r")
    return half.unionByName(mirrored).select(
        F.lit("pearson").alias("method"),
        labels[F.col("i")].alias("column_a"),
        labels[F.col("j")].alias("column_b"),
        F.col("r").alias("correlation"),
    )


def _rank_cell(df: DataFrame, spec: tuple[str, str | None]) -> Column:
    column, other = spec
    c = number(df, column) + F.lit(0.0)
    return c if other is None else F.when(number(df, other).isNotNull(), c)


def spec_ranks(df: DataFrame, specs: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Rank tables by spec: ``(column, other)`` ranks ``column`` over the rows where
    ``other`` is present too."""
    counts = counted(df, {label: _rank_cell(df, spec) for label, spec in specs.items()}, "spec")
    return held(rank_table(counts, ["spec"]))


def with_ranks(df: DataFrame, specs: dict[str, tuple[str, str | None]], ranks: DataFrame) -> DataFrame:
    """Add the average rank of every spec as a column, by joining the rank tables."""
    for label, (column, other) in specs.items():
        table = ranks.filter(F.col("spec") == label)
        df = attach(df, column, table, "avg_rank", label)
        if other is not None:
            df = df.withColumn(label, F.when(number(df, other).isNotNull(), ref(label)))
    return df


def spearman(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Pearson correlation of average ranks, ranked per pair on its complete rows."""
    columns = numeric_columns(df) if columns is None else list(columns)
    plain = df.select(*[number(df, c).alias(c) for c in columns])
    gaps = scalars(plain, {c: F.count_if(ref(c).isNull()) for c in columns})
    specs: dict[str, tuple[str, str | None]] = {}

    def rank_name(a: str, b: str) -> str:
        # only a partner with gaps changes the rows a is ranked over
        other = b if a != b and gaps[b] else None
        label = f"_rank_{columns.index(a)}_{'' if other is None else columns.index(other)}"
        specs[label] = (a, other)
        return label

    names = {(a, b): (rank_name(a, b), rank_name(b, a)) for a, b in _upper(columns)}
    ranked = with_ranks(plain, specs, spec_ranks(plain, specs)).select(*specs)
    pairs = {key: (ref(x), ref(y)) for key, (x, y) in names.items()}
    values = _pair_correlations(held(ranked), pairs)
    return _square(df.sparkSession, "spearman", columns, values)


def _tied_pairs(count: Column) -> Column:
    wide = count.cast("decimal(38,0)")
    return F.sum((wide * (wide - 1) / 2).cast("decimal(38,0)"))


# Rows that lie in a block of neighbouring values, and the blocks there are at most.
BLOCK_ROWS = 200_000
MOST_BLOCKS = 5_000


def _concordant(low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> int:
    """Pairs of weighted points of which one is smaller in both coordinates.

    Points stay in the order of ``high`` within the places that share the upper binary
    digits of ``low``; at each digit the upper half counts the lower half before it.
    """
    order = np.argsort(high, kind="stable")
    k, v, w = np.unique(low, return_inverse=True)[1].ravel()[order], high[order], weight[order]
    at, found = np.arange(len(k)), 0
    for digit in reversed(range(int(k.max(initial=0)).bit_length())):
        prefix, upper = k >> (digit + 1), (k >> digit & 1).astype(bool)
        fresh = np.r_[True, prefix[1:] != prefix[:-1]]
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        tie = np.maximum.accumulate(np.where(fresh | np.r_[True, v[1:] != v[:-1]], at, 0))
        lower = np.where(upper, 0, w)
        before = np.cumsum(lower) - lower
        found += int(((before[tie] - before[start]) * w)[upper].sum())
        # both halves of every part one after the other, their order kept
        zeros = np.cumsum(~upper) - ~upper
        zeros -= zeros[start]
        heads = np.flatnonzero(fresh)
        halves = np.repeat(np.add.reduceat((~upper).astype(np.int64), heads), np.diff(np.r_[heads, len(k)]))
        to = start + np.where(upper, halves + at - start - zeros, zeros)
        moved = np.empty_like(at)
        moved[to] = at
        k, v, w = k[moved], v[moved], w[moved]
    return found


def _count_block(block: pa.Table) -> pa.Table:
    low, high, weight = (block.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "w"))
    return pa.table({"c": pa.array([_concordant(low, high, weight)], pa.int64())})


def _in_blocks(ranks: DataFrame, rows: int, blocks: int) -> DataFrame:
    """Ranks with ``place``: dense rank and block of a value.

    A value that fills a block has an odd one to itself; the others hold two blocks' rows at most.
    """
    block = 2 * F.expr(f"before * {blocks}L div {rows}L") + (F.col("count") * blocks > rows).cast("bigint")
    return ranks.withColumn("place", F.struct(block.alias("block"), F.col("dense").alias("dense")))


def kendall_tau(df: DataFrame, a: str, b: str) -> float | None:
    """Tau-b of two columns, exact, in two shuffles of the points.

    Rows with one x and y collapse into a weighted point. Each side is cut into blocks of
    neighbouring values. Pairs in one block of x are counted there, pairs in different blocks
    of x and one of y in that one, and all others from the weights of the cells of blocks: two
    cells of different blocks of x part at exactly one binary digit of the blocks' numbers; for
    each digit, the cells on the upper side count the lower-side cells of smaller y that
    share the higher digits. No pair of points is ever formed.
    """
    points = (
        df.select(
            (number(df, a) + F.lit(0.0)).alias("x"), (number(df, b) + F.lit(0.0)).alias("y")
        )
        .na.drop("any")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    points = held(points)
    ranks = {}
    facts = {}
    for side in ("x", "y"):
        counts = points.groupBy(F.col(side).alias("value")).agg(F.sum("w").alias("count"))
        ranks[side] = held(rank_table(counts))
        facts[side] = scalars(
            ranks[side], {"ties": _tied_pairs(F.col("count")), "rows": F.max("total")}
        )
    rows = facts["x"]["rows"]
    if not rows or rows < 2:
        return None
    both = scalars(points, {"ties": _tied_pairs(F.col("w"))})["ties"]
    blocks = max(1, min(MOST_BLOCKS, rows // BLOCK_ROWS))
    placed = points
    for side in ("x", "y"):
        placed = attach(placed, side, _in_blocks(ranks[side], rows, blocks), "place", f"p{side}")
    placed = held(
        placed.select(*[F.col(f"p{s}")[f].alias(f"{f}_{s}") for s in "xy" for f in ("block", "dense")], "w")
    )
    concordant = Decimal(0)
    for side, low in (("x", "dense_x"), ("y", "block_x")):
        inside = placed.filter(F.col(f"block_{side}") % 2 == 0).select(
            f"block_{side}", F.col(low).alias("low"), F.col("dense_y").alias("high"), "w"
        )
        counted = inside.groupBy(f"block_{side}").applyInArrow(_count_block, "c bigint")
        concordant += scalars(counted, {"c": F.sum(F.col("c").cast("decimal(38,0)"))})["c"] or 0
    digits = (2 * blocks + 1).bit_length()
    cells = placed.groupBy("block_x", "block_y").agg(F.sum("w").alias("w"))
    by_digit = cells.select(
        "block_x", "block_y", "w", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))).alias("digit")
    ).select(
        "digit",
        F.expr("shiftright(block_x, digit + 1)").alias("prefix"),
        F.col("block_y").alias("value"),
        F.expr("IF(getbit(block_x, digit) = 0, w, 0L)").alias("lower"),
        F.expr("IF(getbit(block_x, digit) = 1, w, 0L)").alias("upper"),
    )
    sides = by_digit.groupBy("digit", "prefix", "value").agg(
        F.sum("lower").alias("count"), F.sum("upper").alias("upper")
    )
    counted = rank_table(sides, ["digit", "prefix"], carry=["upper"])
    product = F.col("before").cast("decimal(19,0)") * F.col("upper").cast("decimal(19,0)")
    concordant += scalars(counted, {"c": F.sum(product.cast("decimal(38,0)"))})["c"]
    every = Decimal(rows) * (rows - 1) / 2
    ties_x, ties_y = facts["x"]["ties"], facts["y"]["ties"]
    difference = 2 * concordant - (every - ties_x - ties_y + both)
    scale = (every - ties_x) * (every - ties_y)
    return float(difference / scale.sqrt()) if scale else None


def kendall(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    columns = numeric_columns(df) if columns is None else list(columns)
    values = {(a, b): kendall_tau(df, a, b) for a, b in combinations(columns, 2)}
    spread = scalars(
        df, {c: (F.min(number(df, c)) < F.max(number(df, c))) for c in columns}
    )
    values |= {(c, c): 1.0 if spread[c] else None for c in columns}
    return _square(df.sparkSession, "kendall", columns, values)


_MATRIX = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlations(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    methods: Iterable[str] = METHODS,
) -> DataFrame:
    methods = list(methods)
    unknown = [m for m in methods if m not in _MATRIX]
    if unknown:
        raise ProfileError(f"unknown correlation methods: {unknown}")
    result = None
    for method in methods:
        table = _MATRIX[method](df, columns)
        result = table if result is None else result.unionByName(table)
    return result


def correlation_matrix(tidy: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Wide form of one method: a row per column, a value per column."""
    return (
        tidy.groupBy("column_a")
        .pivot("column_b", list(columns))
        .agg(F.first("correlation"))
        .withColumnRenamed("column_a", "column")
    )


def high_correlations(
    df: DataFrame, threshold: float = HIGH_CORRELATION, columns: Iterable[str] | None = None
) -> DataFrame:
    """Pairs of numeric columns whose Pearson correlation exceeds the threshold in
    size, each pair once."""
    columns = numeric_columns(df) if columns is None else list(columns)
    order = F.array(*[F.lit(c) for c in columns])
    return pearson(df, columns).filter(
        (F.abs("correlation") > threshold)
        & (F.array_position(order, F.col("column_a")) < F.array_position(order, F.col("column_b")))
    ).select("column_a", "column_b", "correlation")
