"""Category encoders: one-hot, label and ordinal codes in sorted order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.functions.kinds import ref
from tablewright.operators.fused import counted
from tablewright.operators.ranking import attach, rank_table

# ``position`` is the place of one-hot's 1, in one column; ``sparse`` a sparse vector of it.
METHODS = ("onehot", "label", "ordinal", "position", "sparse")
# Codes written into the expression; more are kept in a table and joined, with equal results.
INLINE_CATEGORIES = 999


def fit_categories(
    df: DataFrame, columns: Iterable[str], inline: int | None = INLINE_CATEGORIES
) -> tuple[dict[str, list[str] | None], dict[str, DataFrame]]:
    """Sorted categories per column, in one job for all columns.

    A column with more than ``inline`` categories gets a code table instead
    (``value, dense, ...``), ranked on the executors. ``None`` lists them all, for
    forms with a column per category.
    """
    names = list(columns)
    if not names:
        return {}, {}
    cells = {n: ref(n).cast("string") for n in names}
    counts = counted(df, cells)
    lists: dict[str, list[str] | None] = {n: [] for n in names}
    tables: dict[str, DataFrame] = {}
    if inline is None:
        for r in counts.select("column", "value").orderBy("column", "value").collect():
            lists[r["column"]].append(r["value"])
        return lists, tables
    # the smallest few of each column; the limit holds before the shuffle
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    found = counts.withColumn("place", place).filter(F.col("place") <= inline + 1)
    for r in sorted(found.collect(), key=lambda r: r["place"]):
        lists[r["column"]].append(r["value"])
    for name in names:
        if len(lists[name]) > inline:
            lists[name] = None
            mine = counts.filter(F.col("column") == name).drop("column")
            tables[name] = rank_table(mine)
    return lists, tables


def one_hot(c: Column, name: str, categories: list[str]) -> list[Column]:
    """A 0/1 column per category; an unknown or missing value is 0 everywhere."""
    return [
        F.coalesce((c == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{name}_{v}")
        for v in categories
    ]


def code(c: Column, categories: list[str], strict: bool = True) -> Column:
    """0-based position in sorted order; an unknown value raises when strict."""
    if not categories:
        return F.lit(None).cast("double")
    pairs = [x for i, v in enumerate(categories) for x in (F.lit(v), F.lit(float(i)))]
    found = F.create_map(*pairs)[c]
    if not strict:
        return found
    complaint = F.concat(F.lit("unknown category: "), c)
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.coalesce(found, F.raise_error(complaint).cast("double"))
    )


def with_codes(df: DataFrame, column: str, table: DataFrame, name: str, strict: bool = True) -> DataFrame:
    """Codes from a table of categories too long to write into an expression."""
    out = attach(df, column, table, "dense", name)
    value = ref(name).cast("double")
    if strict:
        complaint = F.concat(F.lit("unknown category: "), ref(column))
        value = F.when(
            ref(column).isNotNull() & ref(name).isNull(), F.raise_error(complaint).cast("double")
        ).otherwise(value)
    return out.withColumn(name, value)


def sparse_one_hot(df: DataFrame, column: str, size: int, name: str) -> DataFrame:
    """Turn a column of codes into sparse vectors of ``size`` slots with a 1 at the code.

    Slots are the sorted categories, which stay in their table; a null code, of an unknown or
    missing value, gives an empty vector.
    """
    from pyspark.ml.feature import OneHotEncoder

    slot = f"{name}_slot"
    # All there is to learn is the number of slots. The one behind them, for unknown values, is dropped.
    largest = df.sparkSession.createDataFrame([(float(max(size - 1, 0)),)], f"{slot} double")
    encoder = OneHotEncoder(inputCol=slot, outputCol=name, dropLast=True, handleInvalid="keep").fit(largest)
    known = F.coalesce(ref(column).cast("double"), F.lit(float(max(size, 1))))
    return encoder.transform(df.withColumn(slot, known)).drop(slot)


def check_method(method: str) -> None:
    if method not in METHODS:
        raise PrepareError(f"unknown encoding method: {method}", {"available_methods": list(METHODS)})
