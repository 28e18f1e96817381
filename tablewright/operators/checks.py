"""Checks of a table, each one a row of a report.

A row is ``(check, column, passed, severity, observed, expected, count)``.
Schema checks run on the driver; all value checks share one scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import CheckError
from tablewright.functions.kinds import FLOATING, kind_of, number, numeric_columns, present, ref
from tablewright.operators.casting import TYPE_NAMES
from tablewright.operators.duplicates import repeated_rows
from tablewright.operators.fused import per_column, scalars
from tablewright.operators.values import value_table
from tablewright.session import broadcast_if_small

REPORT_SCHEMA = (
    "check string, column string, passed boolean, severity string, "
    "observed string, expected string, count bigint"
)
# Fixed value: percent of missing values allowed by default.
MISSING_PERCENT = 50.0
# Clustering methods that can be named.
CLUSTERING_METHODS = ["None", "DBSCAN", "KMeans"]

Row = tuple


def _text(value) -> str | None:
    return None if value is None else str(value)


def report(df: DataFrame, rows: Iterable[Row]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), REPORT_SCHEMA)


class ValueChecks:
    """Collects aggregates from several checks and evaluates them in one scan."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.aggregates: dict[object, Column] = {}
        self.builders: list[Callable[[dict], list[Row]]] = []

    def add(self, aggregates: Mapping[object, Column], build: Callable[[dict], list[Row]]):
        self.aggregates |= aggregates
        self.builders.append(build)

    def rows(self) -> list[Row]:
        values = scalars(self.df, self.aggregates) if self.aggregates else {}
        return [row for build in self.builders for row in build(values)]


# --- schema checks ---------------------------------------------------------


def required_columns(df: DataFrame, required: Iterable[str]) -> list[Row]:
    required = list(required)
    absent = [c for c in dict.fromkeys(required) if c not in df.columns]
    return [
        ("required_column", c, c not in absent, "error", _text(c in df.columns), "True", int(c in absent))
        for c in dict.fromkeys(required)
    ]


def column_names_match(df: DataFrame, pattern: str) -> list[Row]:
    return [
        ("column_pattern", c, bool(re.match(pattern, c)), "warning", c, pattern, int(not re.match(pattern, c)))
        for c in df.columns
    ]


def column_types(df: DataFrame, expected: Mapping[str, str]) -> list[Row]:
    rows = []
    for name, wanted in expected.items():
        if name not in df.columns:
            continue
        actual = df.schema[name].dataType.simpleString()
        same = actual == TYPE_NAMES.get(wanted, wanted)
        rows.append(("column_type", name, same, "warning", actual, wanted, int(not same)))
    return rows


def column_names(
    columns: Iterable[str],
    unique: bool = True,
    max_length: int | None = None,
    allowed_characters: str | None = None,
    prefix: str | None = None,
    suffix: str | None = None,
) -> list[Row]:
    """Rules on names: unique, length, characters, prefix and suffix."""
    columns = list(columns)
    rows = [("names_present", None, bool(columns), "error", str(len(columns)), ">= 1", 0)]
    for c in dict.fromkeys(columns):
        rules = []
        if unique:
            rules.append(("name_unique", columns.count(c) == 1, columns.count(c), "1"))
        if max_length is not None:
            rules.append(("name_length", len(c) <= max_length, len(c), f"<= {max_length}"))
        if allowed_characters is not None:
            fine = set(c) <= set(allowed_characters)
            rules.append(("name_characters", fine, c, allowed_characters))
        if prefix is not None:
            rules.append(("name_prefix", c.startswith(prefix), c, prefix))
        if suffix is not None:
            rules.append(("name_suffix", c.endswith(suffix), c, suffix))
        rows += [
            (rule, c, ok, "error", str(seen), wanted, int(not ok)) for rule, ok, seen, wanted in rules
        ]
    return rows


# --- value checks, fused -----------------------------------------------------


def add_basic(checks: ValueChecks) -> None:
    width = len(checks.df.columns)

    def build(v):
        rows = v["rows"]
        return [
            ("not_empty", None, rows > 0, "error", str(rows), ">= 1", rows),
            ("has_columns", None, width > 0, "error", str(width), ">= 1", width),
        ]

    checks.add({"rows": F.count(F.lit(1))}, build)


def add_ranges(checks: ValueChecks, ranges: Mapping[str, Mapping]) -> None:
    for name, limits in ranges.items():
        if name not in checks.df.columns or kind_of(checks.df.schema[name].dataType) != "numeric":
            continue
        c = present(checks.df, name)
        for side, extreme, outside in (
            ("min", F.min, lambda c, x: c < x),
            ("max", F.max, lambda c, x: c > x),
        ):
            limit = limits.get(side)
            if limit is None:
                continue
            seen, bad = (f"{side}_value", name), (f"{side}_bad", name)

            def build(v, name=name, side=side, limit=limit, seen=seen, bad=bad):
                return [(f"{side}_value", name, not v[bad], "error", _text(v[seen]), _text(limit), v[bad])]

            checks.add({seen: extreme(c), bad: F.count_if(outside(c, F.lit(limit)))}, build)


def add_missing(checks: ValueChecks, max_percent: float = MISSING_PERCENT) -> None:
    aggregates = {"rows": F.count(F.lit(1))}
    for name in checks.df.columns:
        aggregates["missing", name] = F.count_if(present(checks.df, name).isNull())

    def build(v):
        rows = []
        for name in checks.df.columns:
            percent = 100.0 * v["missing", name] / v["rows"] if v["rows"] else 0.0
            rows.append(
                ("missing_percent", name, percent <= max_percent, "warning",
                 f"{percent:.2f}", f"<= {float(max_percent):.2f}", v["missing", name])
            )
        return rows

    checks.add(aggregates, build)


def rule_column(df: DataFrame, condition: str | Callable[[DataFrame], Column]) -> Column | None:
    """A custom rule as a boolean column, or ``None`` when it does not resolve.

    The rule is a SQL boolean expression or a function from the table to a column.
    """
    try:
        column = condition(df) if callable(condition) else F.expr(condition)
        checked = df.select(F.coalesce(column, F.lit(False)).alias("ok"))
        return column if checked.schema["ok"].dataType.simpleString() == "boolean" else None
    except AnalysisException:
        return None


def add_custom(checks: ValueChecks, rules: Iterable[Mapping]) -> list[str]:
    """Rows failing each rule; a null counts as failing. Returns rules skipped."""
    skipped = []
    for position, rule in enumerate(rules):
        name = rule.get("name", "unnamed_rule")
        condition = rule.get("condition")
        if not condition:
            continue
        column = rule_column(checks.df, condition)
        if column is None:
            skipped.append(name)
            continue
        key = ("custom", position)
        wanted = condition if isinstance(condition, str) else getattr(condition, "__name__", "function")

        def build(v, key=key, name=name, wanted=wanted):
            return [("custom_rule", name, not v[key], "warning", None, wanted, v[key])]

        checks.add({key: F.count_if(~F.coalesce(column, F.lit(False)))}, build)
    return skipped


# --- uniqueness, a shuffle each ---------------------------------------------


def duplicate_rows(df: DataFrame, columns: Iterable[str] | None = None) -> list[Row]:
    names = None if columns is None else list(columns)
    n = repeated_rows(df, names).first()["duplicates"]
    label = None if names is None else ",".join(names)
    check = "duplicate_rows" if names is None else "duplicate_values"
    return [(check, label, n == 0, "warning", str(n), "0", n)]


def table_statistics(df: DataFrame, summary=None) -> DataFrame:
    """Rows, nulls, and for numeric columns mean, deviation, extremes, quartiles."""
    from tablewright.operators.describe import describe, type_profile, missing_by_column

    types = type_profile(df).select("column", "data_type", "bytes")
    gaps = missing_by_column(df).select("column", "missing")
    numbers = describe(df, summary=summary)
    return types.join(gaps, "column").join(numbers, "column", "left")


# --- assertions --------------------------------------------------------------


def checked(*tests: Callable[[DataFrame], object]) -> Callable[[DataFrame], DataFrame]:
    """A step for ``DataFrame.transform`` that runs tests of one's own.

    A test gets the table and raises to refuse it; the table passes unchanged.
    """

    def step(df: DataFrame) -> DataFrame:
        for test in tests:
            test(df)
        return df

    return step


def assert_table(
    df: DataFrame,
    required_columns: Iterable[str] | None = None,
    numeric_columns: Iterable[str] | None = None,
    categorical_columns: Iterable[str] | None = None,
    min_rows: int = 1,
    max_rows: int | None = None,
    allow_nulls: bool = False,
) -> DataFrame:
    """Raise unless the table has the columns, kinds, rows and values asked for.

    Returns the table, so it can stand in a chain. Schema rules come first and
    cost nothing, a look for the first row next to nothing; the rest is one scan.
    """
    absent = sorted(set(required_columns or ()) - set(df.columns))
    if absent:
        raise CheckError(f"missing required columns: {absent}", {"missing": absent})
    for name in numeric_columns or ():
        if name not in df.columns:
            raise CheckError(f"numeric column not found: {name}")
        if kind_of(df.schema[name].dataType) not in ("numeric", "boolean"):
            raise CheckError(f"column is not numeric: {name}")
    for name in categorical_columns or ():
        if name not in df.columns:
            raise CheckError(f"categorical column not found: {name}")
    if allow_nulls and min_rows <= 1 and not max_rows:
        if df.isEmpty():
            raise CheckError("table is empty")
        return df
    aggregates = {"rows": F.count(F.lit(1))}
    if not allow_nulls:
        aggregates |= {("null", c): F.count_if(present(df, c).isNull()) for c in df.columns}
    got = scalars(df, aggregates)
    rows = got["rows"]
    if not rows:
        raise CheckError("table is empty")
    if rows < min_rows:
        raise CheckError(f"{rows} rows, fewer than {min_rows}")
    if max_rows and rows > max_rows:
        raise CheckError(f"{rows} rows, more than {max_rows}")
    nulls = {c: got["null", c] for c in df.columns if not allow_nulls and got["null", c]}
    if nulls:
        raise CheckError("null values found", {"columns_with_nulls": nulls})
    return df


def numeric_range(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    min_value: float | None = None,
    max_value: float | None = None,
) -> DataFrame:
    """Per column: NaN, infinite, below-minimum and above-maximum counts."""
    columns = numeric_columns(df) if columns is None else list(columns)

    def nans(name):
        if not isinstance(df.schema[name].dataType, FLOATING):
            return F.count_if(F.lit(False))
        return F.count_if(F.isnan(ref(name)))

    def never(c):
        return F.lit(False)

    def outside(condition):
        return lambda name: F.count_if(condition(number(df, name)))

    return per_column(
        df,
        columns,
        {
            "nan_count": nans,
            "infinite_count": outside(lambda c: F.abs(c) == float("inf")),
            "below_count": outside((lambda c: c < min_value) if min_value is not None else never),
            "above_count": outside((lambda c: c > max_value) if max_value is not None else never),
        },
    )


def assert_numeric_range(
    df: DataFrame,
    column: str,
    min_value: float | None = None,
    max_value: float | None = None,
    allow_inf: bool = False,
    allow_nan: bool = False,
) -> DataFrame:
    found = numeric_range(df, [column], min_value, max_value).first()
    if not allow_nan and found["nan_count"]:
        raise CheckError("NaN values found", found.asDict())
    if not allow_inf and found["infinite_count"]:
        raise CheckError("infinite values found", found.asDict())
    if found["below_count"]:
        raise CheckError(f"values below minimum {min_value} found", found.asDict())
    if found["above_count"]:
        raise CheckError(f"values above maximum {max_value} found", found.asDict())
    return df


def unexpected_values(df: DataFrame, column: str, allowed: Iterable) -> DataFrame:
    """Observed values outside the allowed set, with their number of rows."""
    observed = (
        df.filter(ref(column).isNotNull())
        .groupBy(ref(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    table = value_table(df, column, allowed, "value")
    return observed.join(broadcast_if_small(table), "value", "left_anti")


def category_facts(df: DataFrame, column: str, allowed: Iterable | None = None) -> DataFrame:
    """One row: nulls, number of categories, categories outside the allowed set."""
    facts = df.agg(
        F.count_if(ref(column).isNull()).alias("null_count"),
        F.count_distinct(ref(column)).alias("category_count"),
    )
    if allowed is None:
        return facts.withColumn("unexpected_count", F.lit(0).cast("bigint"))
    extra = unexpected_values(df, column, allowed).agg(F.count(F.lit(1)).alias("unexpected_count"))
    return facts.crossJoin(extra)  # one row with one row


def assert_categories(
    df: DataFrame,
    column: str,
    allowed_values: Iterable | None = None,
    min_categories: int | None = None,
    max_categories: int | None = None,
    allow_nulls: bool = False,
) -> DataFrame:
    found = category_facts(df, column, allowed_values).first()
    if not allow_nulls and found["null_count"]:
        raise CheckError("null values found", found.asDict())
    if found["unexpected_count"]:
        raise CheckError("values outside the allowed set found", found.asDict())
    n = found["category_count"]
    if min_categories and n < min_categories:
        raise CheckError(f"{n} categories, fewer than {min_categories}")
    if max_categories and n > max_categories:
        raise CheckError(f"{n} categories, more than {max_categories}")
    return df


def assert_clustering_input(df: DataFrame, config: Mapping[str, Mapping]) -> DataFrame:
    """The columns named in the config exist, are numeric and hold no nulls."""
    columns = sorted({c for spec in config.values() for c in spec.get("columns", ())})
    for name, spec in config.items():
        method = spec.get("method")
        if method is not None and method not in CLUSTERING_METHODS:
            raise CheckError(f"unknown clustering method for {name}: {method}")
    return assert_table(df, required_columns=columns, numeric_columns=columns)


def assert_settings(
    settings: Mapping,
    required: Iterable[str],
    types: Mapping[str, type] | None = None,
    ranges: Mapping[str, tuple] | None = None,
) -> None:
    absent = sorted(set(required) - set(settings))
    if absent:
        raise CheckError(f"missing settings: {absent}")
    for name, wanted in (types or {}).items():
        if name in settings and not isinstance(settings[name], wanted):
            raise CheckError(f"setting {name} is no {wanted.__name__}")
    for name, (low, high) in (ranges or {}).items():
        if name in settings and not low <= settings[name] <= high:
            raise CheckError(f"setting {name} is outside [{low}, {high}]")


def training_facts(df: DataFrame, features: Iterable[str], target: str) -> DataFrame:
    """One row: rows, rows with a target, missing feature cells."""
    gaps = sum((present(df, f).isNull().cast("bigint") for f in features), F.lit(0).cast("bigint"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(present(df, target)).alias("target_rows"),
        F.coalesce(F.sum(gaps), F.lit(0)).cast("bigint").alias("missing_cells"),
    )


def assert_training_input(df: DataFrame, features: Iterable[str], target: str, settings: Mapping) -> DataFrame:
    """Features clean, a target for every row, and the settings complete."""
    features = list(features)
    absent = sorted(set([*features, target]) - set(df.columns))
    if absent:
        raise CheckError(f"missing columns: {absent}")
    facts = training_facts(df, features, target).first()
    if not facts["rows"] or not facts["target_rows"]:
        raise CheckError("empty features or target", facts.asDict())
    if facts["rows"] != facts["target_rows"]:
        raise CheckError("features and target differ in length", facts.asDict())
    if facts["missing_cells"]:
        raise CheckError("null values found", facts.asDict())
    assert_settings(
        settings,
        {"model_type", "hyperparameters"},
        {"model_type": str, "hyperparameters": dict},
    )
    return df
