"""Values that stand in for missing cells, found by fitting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tablewright.errors import PrepareError
from tablewright.operators.frequencies import mode_values
from tablewright.operators.missing import column_means
from tablewright.operators.quantiles import exact_quantiles

# Fixed value: what a missing category becomes.
MISSING_CATEGORY = "missing"


def fit_fill(df: DataFrame, columns: Iterable[str], method: str) -> dict[str, float | None]:
    """Mean, exact median or most frequent value (smallest on ties) per column."""
    columns = list(columns)
    if method == "mean":
        return column_means(df, columns)
    if method == "median":
        found = exact_quantiles(df, {c: (0.5,) for c in columns})
        return {c: found[c][0.5] for c in columns}
    if method == "most_frequent":
        found = mode_values(df, columns)
        return {c: None if found.get(c) is None else float(found[c]) for c in columns}
    raise PrepareError(
        f"unknown imputation method: {method}",
        {"available_methods": ["mean", "median", "most_frequent", "knn"]},
    )
