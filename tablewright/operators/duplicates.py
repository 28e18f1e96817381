"""Repeated rows and values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import CleanError
from tablewright.functions.kinds import ref


def _ordering(order_by: Iterable[str], descending: bool) -> list[Column]:
    if descending:
        return [ref(c).desc_nulls_last() for c in order_by]
    return [ref(c).asc_nulls_first() for c in order_by]


def drop_duplicates(
    df: DataFrame,
    subset: Iterable[str] | None = None,
    keep: str | bool = "first",
    order_by: Iterable[str] | None = None,
) -> DataFrame:
    """Drop repeated rows; nulls equal each other.

    ``keep`` is ``first``, ``last`` or ``none`` (``False``: every repeated row
    goes). A table has no row order, so ``order_by`` says what first means; by
    default the remaining columns do.
    """
    if keep is False:
        keep = "none"
    if keep not in ("first", "last", "none"):
        raise CleanError(f"unknown keep option: {keep}")
    keys = df.columns if subset is None else list(subset)
    others = [c for c in df.columns if c not in keys]
    if keep == "none":
        # counts combine before the shuffle, so a hot key stays one row a task
        once = df.groupBy(*[ref(k) for k in keys]).agg(
            F.count(F.lit(1)).alias("_copies"),
            *[F.first(ref(c)).alias(c) for c in others],
        )
        return once.filter("_copies = 1").select(*[ref(c) for c in df.columns])
    if not others:
        return df.dropDuplicates()
    order = others if order_by is None else list(order_by)
    window = Window.partitionBy(*[ref(k) for k in keys]).orderBy(
        *_ordering(order, keep == "last")
    )
    # a row number limit is applied on each task's rows before the shuffle
    return df.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place")


def flag_repeats(df: DataFrame, subset: Iterable[str], order_by: Iterable[str], name: str = "is_repeat") -> DataFrame:
    """Mark every row but the first of its key; ``order_by`` must be unique.

    The firsts are found by a combining aggregation and joined back, so a hot
    key is never sorted in one task.
    """
    keys, order = list(subset), list(order_by)
    place = F.struct(*[ref(c) for c in order])
    firsts = df.groupBy(*[ref(k) for k in keys]).agg(F.min(place).alias("_first"))
    firsts = firsts.select("_first", F.lit(True).alias("_is_first"))
    marked = df.withColumn("_row", place)
    joined = marked.join(firsts, F.col("_row").eqNullSafe(F.col("_first")), "left")
    return joined.select(
        *[ref(c) for c in df.columns], F.col("_is_first").isNull().alias(name)
    )


def repeated_rows(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row ``(duplicates)``: rows beyond the first of each distinct row."""
    keys = df.columns if columns is None else list(columns)
    counted = df.groupBy(*[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
