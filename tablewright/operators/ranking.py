"""Ranks over whole columns without a window that lacks a partition key.

Values are first reduced to ``(keys, value, count)``. The distinct values are
cut into buckets at bounds taken from a hash-ordered selection of them, so the
bucket of a value is a plain expression and a rerun of a lost task gives the
same answer. Inside a bucket a window accumulates; bucket totals, a few rows
per key, supply the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.kinds import kind_of, number, ref
from tablewright.operators.fused import counted
from tablewright.session import broadcast_if_small, held, is_small

# Distinct values per bucket aimed at, and the most buckets made.
BUCKET_VALUES = 100_000
MAX_BUCKETS = 4096
# Distinct values looked at per bucket when bounds are chosen.
BOUND_CANDIDATES = 16
# A value is handled apart from the rest when it fills this share of the rows.
HEAVY_SHARE = 0.001


def bucket_bounds(distinct: DataFrame, value: str, buckets: int) -> list:
    """Bounds that cut the distinct values into about equal buckets."""
    if buckets <= 1:
        return []
    take = BOUND_CANDIDATES * buckets
    chosen = (
        distinct.select(ref(value).alias("v"))
        .filter(F.col("v").isNotNull())
        .orderBy(F.xxhash64("v"), "v")
        .limit(take)
        .collect()
    )
    candidates = sorted({row["v"] for row in chosen})
    if not candidates:
        return []
    step = len(candidates) / buckets
    return sorted({candidates[int(i * step)] for i in range(1, buckets)})


def bucket_of(c: Column, bounds: list) -> Column:
    """Number of bounds at or below the value, found in two array probes."""
    if not bounds:
        return F.lit(0)
    width = max(int(math.sqrt(len(bounds))), 1)
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    starts = F.array(*[F.lit(block[0]) for block in blocks])
    nested = F.array(*[F.array(*[F.lit(b) for b in block]) for block in blocks])
    block = F.size(F.filter(starts, lambda b: b <= c))
    in_block = F.size(
        F.filter(F.element_at(nested, F.greatest(block, F.lit(1))), lambda b: b <= c)
    )
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + in_block)


def rank_table(
    counts: DataFrame,
    keys: Iterable[str] = (),
    value: str = "value",
    carry: Iterable[str] = (),
) -> DataFrame:
    """Positions of every distinct value within its key.

    ``counts`` holds ``keys, value, count``. The result adds ``before`` (rows
    with a smaller value), ``dense`` (smaller distinct values), ``total`` (rows
    of the key) and ``avg_rank`` (the mean of the 1-based ranks of the ties).
    Columns in ``carry`` pass through.
    """
    keys = list(keys)
    counts = held(counts)
    distinct = counts.count()
    buckets = min(MAX_BUCKETS, math.ceil(distinct / BUCKET_VALUES) or 1)
    bounds = bucket_bounds(counts, value, buckets)
    placed = counts.withColumn("_bucket", bucket_of(ref(value), bounds))
    key_columns = [ref(k) for k in keys]
    cell = Window.partitionBy(*key_columns, "_bucket").orderBy(ref(value))
    before = cell.rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumns(
        {
            "_before": F.coalesce(F.sum("count").over(before), F.lit(0)),
            "_dense": F.row_number().over(cell) - 1,
        }
    )
    # one row per (key, bucket); its windows see at most MAX_BUCKETS rows a key
    totals = placed.groupBy(*key_columns, "_bucket").agg(
        F.sum("count").alias("_rows"), F.count(F.lit(1)).alias("_values")
    )
    of_key = Window.partitionBy(*(key_columns or [F.lit(0)]))
    earlier = of_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[ref(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_values").over(earlier), F.lit(0)).alias("_values_before"),
        F.sum("_rows").over(of_key).alias("total"),
    )
    same_cell = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same_cell = same_cell & ref(k).eqNullSafe(F.col(f"_k{i}"))
    joined = inner.join(broadcast_if_small(offsets), same_cell)
    return joined.select(
        *key_columns,
        ref(value),
        "count",
        *[ref(c) for c in carry],
        (F.col("_before") + F.col("_rows_before")).alias("before"),
        (F.col("_dense") + F.col("_values_before")).alias("dense"),
        "total",
    ).withColumn("avg_rank", F.col("before") + (F.col("count") + 1) / 2.0)


def column_ranks(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``(column, value, count, before, dense, total, avg_rank)`` for numeric columns."""
    names = list(columns)
    counts = counted(df, {n: number(df, n) + F.lit(0.0) for n in names})
    return rank_table(counts, ["column"])


def attach(df: DataFrame, on: str, table: DataFrame, wanted: str, name: str) -> DataFrame:
    """Add ``table.wanted`` as ``name`` by matching ``on`` with ``table.value``.

    A table within the size limits is broadcast. Beyond them the values that fill
    the table's rows by themselves (at most ``1 / HEAVY_SHARE`` of them) are matched
    apart and the rest is shuffled, with heavy rows spread over all tasks.
    """
    lookup = table.select(
        F.col("value").alias("_v"),
        F.col(wanted).alias(name),
        (F.col("count") > F.col("total") * HEAVY_SHARE).alias("_heavy"),
    )
    if kind_of(df.schema[on].dataType) == "numeric":
        key, blank = ref(on).cast("double") + F.lit(0.0), F.lit(0.0)
    else:
        key, blank = ref(on), F.lit("")
    if is_small(lookup):
        small = F.broadcast(lookup.drop("_heavy"))
        return df.join(small, key == F.col("_v"), "left").drop("_v")
    heavy = broadcast_if_small(
        lookup.filter("_heavy").select(
            F.col("_v").alias("_hv"), F.col(name).alias("_hit")
        )
    )
    tail = lookup.filter("NOT _heavy").select("_v", name, F.lit(0).alias("_t"))
    spread = F.pmod(F.xxhash64(*[ref(c) for c in df.columns]), F.lit(4096)) + 1
    marked = df.join(heavy, key == F.col("_hv"), "left").withColumn(
        "_s",
        F.when(F.col("_hv").isNotNull() | key.isNull(), spread.cast("int")).otherwise(0),
    )
    found = marked.join(
        tail,
        (F.coalesce(key, blank) == F.col("_v")) & (F.col("_s") == F.col("_t")),
        "left",
    )
    return found.withColumn(name, F.coalesce(F.col("_hit"), F.col(name))).drop(
        "_v", "_hv", "_hit", "_s", "_t"
    )


def grouped_quantiles(
    df: DataFrame,
    column: str,
    levels: Iterable[float],
    group_by: Iterable[str],
    names: Iterable[str] | None = None,
) -> DataFrame:
    """Exact quantiles of a column per group, one row a group.

    A group of any size is spread over the value buckets.
    """
    group_by, levels = list(group_by), list(levels)
    names = list(names or [f"q{p:g}" for p in levels])
    counts = (
        df.select(
            *[ref(g) for g in group_by], (number(df, column) + F.lit(0.0)).alias("value")
        )
        .filter(F.col("value").isNotNull())
        .groupBy(*[ref(g) for g in group_by], "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    ranked = rank_table(counts, group_by)
    after = F.col("before") + F.col("count")
    aggregates = []
    for i, p in enumerate(levels):
        position = (F.col("total") - 1) * F.lit(float(p))
        lower = F.floor(position)
        upper = F.ceil(position)
        aggregates += [
            F.max(F.when((F.col("before") <= lower) & (lower < after), F.col("value"))).alias(f"_l{i}"),
            F.max(F.when((F.col("before") <= upper) & (upper < after), F.col("value"))).alias(f"_u{i}"),
        ]
    found = ranked.groupBy(*[ref(g) for g in group_by], "total").agg(*aggregates)
    quantiles = []
    for i, (p, name) in enumerate(zip(levels, names)):
        position = (F.col("total") - 1) * F.lit(float(p))
        share = position - F.floor(position)
        low, high = F.col(f"_l{i}"), F.col(f"_u{i}")
        quantiles.append((low + (high - low) * share).alias(name))
    return found.select(*[ref(g) for g in group_by], F.col("total").alias("n"), *quantiles)
