"""The whole validation report of a table, and summaries over reports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import ref
from tablewright.operators import checks as C

# Rules applied when none are given.
DEFAULT_RULES = {
    "missing_values": {"max_percent": 50},
    "duplicates": {"check_full_rows": True},
    "column_types": {},
    "value_ranges": {},
    "custom_rules": [],
}


@dataclass
class ValidationReport:
    name: str
    passed: bool
    checks: DataFrame
    header: DataFrame
    skipped_rules: list[str]


def validate(
    df: DataFrame, rules: Mapping | None = None, name: str = "unnamed_dataset"
) -> ValidationReport:
    """Run the rule set; the table passes when no check of severity error fails."""
    rules = DEFAULT_RULES if rules is None else rules
    fused = C.ValueChecks(df)
    C.add_basic(fused)
    C.add_ranges(fused, rules.get("value_ranges", {}))
    if "missing_values" in rules:
        C.add_missing(fused, rules["missing_values"].get("max_percent", 100))
    skipped = C.add_custom(fused, rules.get("custom_rules", ()))
    rows = C.required_columns(df, rules.get("required_columns", ()))
    if "column_pattern" in rules:
        rows += C.column_names_match(df, rules["column_pattern"])
    rows += C.column_types(df, rules.get("column_types", {}))
    rows += fused.rows()
    duplicates = rules.get("duplicates")
    if duplicates is not None:
        if duplicates.get("check_full_rows", True):
            rows += C.duplicate_rows(df)
        for column in duplicates.get("unique_columns", ()):
            if column in df.columns:
                rows += C.duplicate_rows(df, [column])
    errors = sum(1 for r in rows if not r[2] and r[3] == "error")
    warnings = sum(1 for r in rows if not r[2] and r[3] == "warning")
    header = df.sparkSession.createDataFrame(
        [(name, errors == 0, errors, warnings, len(rows))],
        "dataset string, passed boolean, errors bigint, warnings bigint, checks bigint",
    ).withColumn("validated_at", F.current_timestamp())
    return ValidationReport(name, errors == 0, C.report(df, rows), header, skipped)


def save_report(report: ValidationReport, path: str) -> None:
    """Append the header and the checks to tables below ``path``."""
    report.header.write.mode("append").parquet(f"{path}/headers")
    report.checks.withColumn("dataset", F.lit(report.name)).write.mode("append").parquet(
        f"{path}/checks"
    )


def summarise_reports(headers: DataFrame) -> DataFrame:
    """One row: validations run and passed."""
    return headers.agg(
        F.count(F.lit(1)).alias("total_validations"),
        F.count_if("passed").alias("passed_validations"),
    )


def latest(table: DataFrame, time_column: str, n: int = 5) -> DataFrame:
    """The most recent records; records of one time are ordered by their other columns."""
    simple = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    rest = [
        ref(f.name) if not isinstance(f.dataType, simple) else F.to_json(F.struct(ref(f.name)))
        for f in table.schema.fields
        if f.name != time_column
    ]
    return table.orderBy(F.desc(time_column), *rest).limit(n)
