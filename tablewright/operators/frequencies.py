"""Value frequencies and what follows from them: modes, distinct counts, top values.

Every result starts from ``(column, value, count)`` tables built by one
partial aggregation, so a value that fills a third of the table is combined
before the shuffle and no task ever holds all values of a column.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import FLOATING, INTEGRAL, nan_to_null, ref
from tablewright.operators.fused import counted, per_column


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, INTEGRAL):
        return "bigint"
    if isinstance(dtype, FLOATING):
        return "double"
    if isinstance(dtype, T.DecimalType):
        return dtype.simpleString()
    if isinstance(dtype, T.TimestampNTZType):
        return "timestamp_ntz"
    if isinstance(dtype, (T.TimestampType, T.DateType, T.BooleanType)):
        return dtype.simpleString()
    return "string"


def _comparable(c: Column, family: str) -> Column:
    if family == "double":
        # adding zero turns -0.0 into 0.0
        return nan_to_null(c.cast("double")) + F.lit(0.0)
    return c.cast(family)


def typed_counts(df: DataFrame, columns: Iterable[str] | None = None) -> list[DataFrame]:
    """One ``(column, value, count)`` table per value type, nulls left out.

    Columns of one type share a scan that reads just those columns.
    """
    columns = df.columns if columns is None else list(columns)
    families: dict[str, list[str]] = {}
    for name in columns:
        families.setdefault(_family(df.schema[name].dataType), []).append(name)
    return [
        counted(df, {n: _comparable(ref(n), family) for n in names})
        for family, names in families.items()
    ]


def _union(tables: list[DataFrame]) -> DataFrame:
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def value_counts(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    counts: list[DataFrame] | None = None,
) -> DataFrame:
    """``(column, value, count)`` with the value as text, nulls left out."""
    tables = typed_counts(df, columns) if counts is None else counts
    return _union([t.withColumn("value", F.col("value").cast("string")) for t in tables])


def value_proportions(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    counts: list[DataFrame] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Frequencies with their share of all rows, rows with a null included."""
    total = df.count() if rows is None else rows
    return value_counts(df, columns, counts).withColumn(
        "proportion", F.col("count") / F.lit(float(total or 1))
    )


def modes(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    counts: list[DataFrame] | None = None,
) -> DataFrame:
    """``(column, mode, count)``; of tied values the smallest in its own type.

    A column without values has a null mode, counted 0 times.
    """
    names = df.columns if columns is None else list(columns)
    tables = typed_counts(df, columns) if counts is None else counts
    picked = []
    for table in tables:
        best = F.min(F.struct((-F.col("count")).alias("n"), F.col("value")))
        picked.append(
            table.groupBy("column")
            .agg(best.alias("best"))
            .select(
                "column",
                F.col("best.value").cast("string").alias("mode"),
                (-F.col("best.n")).alias("count"),
            )
        )
    every = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    found = every.join(_union(picked), "column", "left")
    return found.withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


def mode_values(df: DataFrame, columns: Iterable[str]) -> dict[str, object]:
    """Mode per column in the column's own type; a column of nulls has none."""
    found: dict[str, object] = {}
    for table in typed_counts(df, columns):
        best = F.min(F.struct((-F.col("count")).alias("n"), F.col("value")))
        for row in table.groupBy("column").agg(best.alias("best")).collect():
            found[row["column"]] = row["best"]["value"]
    return found


def distinct_counts(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    counts: list[DataFrame] | None = None,
    approximate: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """``(column, distinct_count, distinct_percent)``; nulls are no value."""
    names = df.columns if columns is None else list(columns)
    if approximate:
        out = per_column(
            df, names, {"distinct_count": lambda c: F.approx_count_distinct(ref(c))}
        )
    else:
        tables = typed_counts(df, names) if counts is None else counts
        per_table = [
            t.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
            for t in tables
        ]
        every = df.sparkSession.createDataFrame(
            [(n, 0) for n in names], "column string, distinct_count bigint"
        )
        out = (
            _union([*per_table, every])
            .groupBy("column")
            .agg(F.sum("distinct_count").alias("distinct_count"))
        )
    total = df.count() if rows is None else rows
    return out.withColumn(
        "distinct_percent", F.col("distinct_count") * 100.0 / F.lit(float(total or 1))
    )


def top_values(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    k: int = 5,
    counts: list[DataFrame] | None = None,
) -> DataFrame:
    """The ``k`` most frequent values per column; ties go to the smaller value.

    Spark applies the limit on every input partition before the shuffle.
    """
    tables = typed_counts(df, columns) if counts is None else counts
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    ranked = [
        t.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("value", F.col("value").cast("string"))
        for t in tables
    ]
    return _union(ranked).select("column", "rank", "value", "count")
