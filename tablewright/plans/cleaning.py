"""The clean pipeline: seven steps in a fixed order, each one optional."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import normalise_missing, present
from tablewright.operators.casting import fix_types
from tablewright.operators.duplicates import drop_duplicates
from tablewright.operators.missing import NULL_SHARE, handle_missing
from tablewright.operators.outliers import REMOVAL_THRESHOLD, remove_outliers
from tablewright.operators.values import apply_replacements, apply_value_rules, standardise_text
from tablewright.functions.text import TEXT_OPERATIONS
from tablewright.session import held

# Steps in order. Without a configuration the outlier and text
# steps name no columns and so change nothing; a configuration that leaves out
# ``columns`` applies them to all columns.
DEFAULT_CONFIG = {
    "remove_duplicates": {"enabled": True, "subset": None, "keep": "first"},
    "handle_missing_values": {
        "enabled": True,
        "strategy": "remove",
        "threshold": 0.5,
        "fill_values": {},
    },
    "fix_datatypes": {"enabled": True, "infer_types": True, "type_mappings": {}},
    "handle_outliers": {"enabled": True, "method": "zscore", "threshold": 3, "columns": []},
    "standardize_text": {
        "enabled": True,
        "operations": ["lowercase", "strip", "spaces"],
        "columns": [],
    },
    "validate_values": {"enabled": True, "validations": {}},
    "fix_inconsistencies": {"enabled": True, "replacements": {}},
}


def _duplicates(df: DataFrame, cfg: Mapping, _kept: dict) -> DataFrame:
    return drop_duplicates(df, cfg.get("subset"), cfg.get("keep", "first"), cfg.get("order_by"))


def _missing(df: DataFrame, cfg: Mapping, _kept: dict) -> DataFrame:
    return handle_missing(
        df, cfg.get("strategy", "remove"), cfg.get("threshold", NULL_SHARE), cfg.get("fill_values")
    )


def _types(df: DataFrame, cfg: Mapping, kept: dict) -> DataFrame:
    df, failed = fix_types(df, cfg.get("type_mappings"), cfg.get("infer_types", True))
    kept |= failed
    return df


def _outliers(df: DataFrame, cfg: Mapping, _kept: dict) -> DataFrame:
    return remove_outliers(
        df, cfg.get("method", "zscore"), cfg.get("threshold", REMOVAL_THRESHOLD), cfg.get("columns")
    )


def _text(df: DataFrame, cfg: Mapping, _kept: dict) -> DataFrame:
    return standardise_text(df, cfg.get("columns"), cfg.get("operations", list(TEXT_OPERATIONS)))


def _values(df: DataFrame, cfg: Mapping, _kept: dict) -> DataFrame:
    return apply_value_rules(df, cfg.get("validations", {}))


def _replacements(df: DataFrame, cfg: Mapping, _kept: dict) -> DataFrame:
    return apply_replacements(df, cfg.get("replacements", {}))


STEPS = {
    "remove_duplicates": _duplicates,
    "handle_missing_values": _missing,
    "fix_datatypes": _types,
    "handle_outliers": _outliers,
    "standardize_text": _text,
    "validate_values": _values,
    "fix_inconsistencies": _replacements,
}


# Steps that change values but never the number of rows.
SAME_ROWS = {"fix_datatypes", "standardize_text", "fix_inconsistencies"}


@dataclass
class CleanResult:
    """The cleaned table with the table after every step, all still lazy."""

    source: DataFrame
    table: DataFrame
    stages: list[tuple[str, DataFrame]] = field(default_factory=list)
    uncast: dict[str, str] = field(default_factory=dict)

    def ledger(self) -> DataFrame:
        """``(step, initial_rows, final_rows, rows_removed, step_removed)``.

        ``rows_removed`` counts from the start, ``step_removed`` from the step
        before. One job counts the steps that can drop rows.
        """
        changing = [(name, df) for name, df in self.stages if name not in SAME_ROWS]
        initial, *after = _stage_counts([self.source, *[df for _, df in changing]])
        counts = dict(zip([name for name, _ in changing], after))
        before = initial
        rows = []
        for position, (name, _) in enumerate(self.stages):
            n = counts.get(name, before)
            rows.append((position + 1, name, initial, n, initial - n, before - n))
            before = n
        return self.source.sparkSession.createDataFrame(
            rows,
            "position int, step string, initial_rows bigint, final_rows bigint, "
            "rows_removed bigint, step_removed bigint",
        )

    def summary(self) -> DataFrame:
        """One row: rows, columns and nulls before and after."""

        def facts(df: DataFrame, prefix: str) -> DataFrame:
            gaps = sum((present(df, c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
            return df.agg(
                F.count(F.lit(1)).alias(f"{prefix}_rows"),
                F.coalesce(F.sum(gaps), F.lit(0)).alias(f"{prefix}_nulls"),
            )

        # one row with one row
        both = facts(self.source, "initial").crossJoin(facts(self.table, "final"))
        width = len(self.source.columns), len(self.table.columns)
        return both.select(
            "initial_rows",
            "final_rows",
            (F.col("initial_rows") - F.col("final_rows")).alias("rows_removed"),
            F.lit(width[0]).cast("bigint").alias("initial_columns"),
            F.lit(width[1]).cast("bigint").alias("final_columns"),
            F.lit(width[0] - width[1]).cast("bigint").alias("columns_removed"),
            (F.col("initial_nulls") - F.col("final_nulls")).alias("null_values_removed"),
            F.lit(len(self.stages)).cast("bigint").alias("cleaning_steps"),
        )


def _stage_counts(stages: list[DataFrame]) -> list[int]:
    union = None
    for position, df in enumerate(stages):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(position).alias("at"), "n")
        union = one if union is None else union.unionAll(one)
    found = {r["at"]: r["n"] for r in union.collect()}
    return [found[i] for i in range(len(stages))]


def clean(df: DataFrame, config: Mapping | None = None) -> CleanResult:
    """Run the enabled steps; a step missing from the configuration still runs."""
    config = DEFAULT_CONFIG if config is None else config
    source = df
    df = normalise_missing(df)
    result = CleanResult(source, df)
    for name, step in STEPS.items():
        cfg = config.get(name, {})
        if not cfg.get("enabled", True):
            continue
        if name == "handle_outliers" and cfg.get("columns", None) != []:
            # several passes follow: do not repeat the steps before for each
            df = held(df)
        df = step(df, cfg, result.uncast)
        result.stages.append((name, df))
    result.table = df
    return result
