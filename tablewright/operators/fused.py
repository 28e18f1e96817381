"""One aggregation over many columns, turned into one row per column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import ref

Metric = Callable[[str], Column]


def per_column(
    df: DataFrame,
    columns: Iterable[str],
    metrics: Mapping[str, Metric],
    group_by: Iterable[str] = (),
    key: str = "column",
) -> DataFrame:
    """``(column, metric, ...)`` rows from a single ``agg`` over the whole table.

    ``metrics`` maps an output name to a function from a column name to an
    aggregate expression. The input is scanned once whatever the column count.
    """
    columns, group_by = list(columns), list(group_by)
    cells = {
        (i, metric): f"_{i}_{metric}" for i in range(len(columns)) for metric in metrics
    }
    aggregates = [
        metrics[metric](columns[i]).alias(cell) for (i, metric), cell in cells.items()
    ]
    if not aggregates:
        raise ValueError("no columns to aggregate")
    wide = df.groupBy(*[ref(g) for g in group_by]).agg(*aggregates)
    rows = [
        F.struct(
            F.lit(name).alias(key),
            *[F.col(cells[i, metric]).alias(metric) for metric in metrics],
        )
        for i, name in enumerate(columns)
    ]
    return wide.select(*[ref(g) for g in group_by], F.inline(F.array(*rows)))


# Columns up to which numeric metrics are one wide aggregation. Beyond it the
# generated code would grow past what the JVM compiles.
WIDE_COLUMNS = 12


def numeric_metrics(
    df: DataFrame,
    cells: Mapping[str, Column],
    metrics: Mapping[str, Callable[[Column], Column]],
    group_by: Iterable[str] = (),
) -> DataFrame:
    """``(group_by..., column, metric, ...)`` over cells of one type, in one scan."""
    cells, group_by = dict(cells), list(group_by)
    if len(cells) <= WIDE_COLUMNS:
        by_name = {m: (lambda n, fn=fn: fn(cells[n])) for m, fn in metrics.items()}
        return per_column(df, cells, by_name, group_by)
    long = unpivoted(df, cells, group_by)
    found = long.groupBy(*[ref(g) for g in group_by], "column").agg(
        *[fn(F.col("value")).alias(m) for m, fn in metrics.items()]
    )
    if group_by:
        return found
    # an empty table has no cells, yet a row per column with what each metric is of nothing
    every = df.sparkSession.createDataFrame([(n,) for n in cells], "column string")
    nothing = long.filter(F.lit(False)).agg(*[fn(F.col("value")).alias(m) for m, fn in metrics.items()])
    absent = every.join(found, "column", "left_anti").crossJoin(nothing)  # with one row
    return found.unionByName(absent)


def scalars(df: DataFrame, expressions: Mapping[object, Column]) -> dict:
    """Evaluate named aggregates in one scan; the result is a handful of values."""
    keys = list(expressions)
    row = df.agg(*[expressions[k].alias(f"_{i}") for i, k in enumerate(keys)]).first()
    return dict(zip(keys, row))


def unpivoted(
    df: DataFrame, cells: Mapping[str, Column], keys: Iterable[str] = (), label: str = "column"
) -> DataFrame:
    """``(keys..., label, value)``: one row per row and cell; cells share a type.

    Works for any column name, which Spark's own unpivot does not.
    """
    names = F.array(*[F.lit(n) for n in cells])
    long = df.select(
        *[ref(k) for k in keys], F.posexplode(F.array(*cells.values())).alias("_cell", "value")
    )
    return long.select(*[ref(k) for k in keys], names[F.col("_cell")].alias(label), "value")


def counted(
    df: DataFrame, cells: Mapping[str, Column], label: str = "column"
) -> DataFrame:
    """``(label, value, count)`` of the non-missing values of cells of one type.

    Rows are grouped by the number of the cell; its name is filled in afterwards.
    """
    names = F.array(*[F.lit(n) for n in cells])
    return (
        df.select(F.posexplode(F.array(*cells.values())).alias("_cell", "value"))
        .filter(F.col("value").isNotNull())
        .groupBy("_cell", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(names[F.col("_cell")].alias(label), "value", "count")
    )


def to_metrics(df: DataFrame, key: str = "column") -> DataFrame:
    """Long form ``(column, metric, value)`` of a per-column result."""
    cells = {m: ref(m).cast("double") for m in df.columns if m != key}
    return unpivoted(df, cells, [key], "metric")
