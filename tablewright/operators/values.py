"""Value rules: ranges, patterns, allowed values, replacements, text clean-up."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import kind_of, ref, text_columns
from tablewright.functions.text import TEXT_OPERATIONS, matches_from_start, standardise
from tablewright.session import broadcast_if_small

# Lists longer than this are joined instead of written into the expression.
INLINE_VALUES = 1_000


def standardise_text(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    operations: Iterable[str] = tuple(TEXT_OPERATIONS),
) -> DataFrame:
    """Lower-case, strip and collapse spaces; ``None`` means all text columns."""
    names = text_columns(df) if columns is None else list(columns)
    operations = list(operations)
    changed = {
        n: standardise(ref(n), operations)
        for n in names
        if n in df.columns and kind_of(df.schema[n].dataType) == "text"
    }
    return df.withColumns(changed) if changed else df


def keep_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Closed range; rows with a null go."""
    return df.filter(ref(column).between(low, high))


def keep_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text matches from its start; rows with a null go."""
    return df.filter(matches_from_start(ref(column), pattern))


def value_table(df: DataFrame, column: str, values: Iterable, name: str) -> DataFrame:
    """The caller's values in the column's type, a row each; what does not cast is left out."""
    kinds: dict[type, list] = {}
    for v in values:
        if v is not None:
            kinds.setdefault(type(v), []).append((v,))
    dtype = df.schema[column].dataType
    table = df.sparkSession.createDataFrame([], T.StructType([T.StructField(name, dtype)]))
    for rows in kinds.values():
        given = df.sparkSession.createDataFrame(rows, ["v"])
        table = table.unionByName(given.select(F.col("v").try_cast(dtype).alias(name)))
    return table.filter(F.col(name).isNotNull()).distinct()


def keep_allowed(df: DataFrame, column: str, allowed: Iterable) -> DataFrame:
    """Rows with an allowed value; the values count in the type of the column."""
    values = list(dict.fromkeys(allowed))
    if len(values) <= INLINE_VALUES:
        dtype = df.schema[column].dataType
        return df.filter(ref(column).isin([F.lit(v).try_cast(dtype) for v in values if v is not None]))
    table = value_table(df, column, values, "_allowed")
    return df.join(broadcast_if_small(table), ref(column) == F.col("_allowed"), "left_semi")


def replace_values(df: DataFrame, column: str, mapping: Mapping) -> DataFrame:
    """Swap whole values; unmapped values and nulls stay.

    Old and new values count in the type of the column; what does not cast matches
    nothing, or becomes null. Of old values that are one in that type the first counts.
    """
    mapping = dict(mapping)
    if not mapping:
        return df
    dtype = df.schema[column].dataType
    c = ref(column)
    if len(mapping) <= INLINE_VALUES:
        chosen = None
        for old, new in mapping.items():
            hit = c.isNull() if old is None else c == F.lit(old).try_cast(dtype)
            value = F.lit(new).try_cast(dtype)
            chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
        return df.withColumn(column, chosen.otherwise(c))
    kinds: dict[tuple, list] = {}
    for at, (old, new) in enumerate(mapping.items()):
        kinds.setdefault((type(old), type(new)), []).append((at, old, new))
    table = None
    for (old_kind, new_kind), rows in kinds.items():
        plain = [(at, "" if o is None else o, "" if n is None else n) for at, o, n in rows]
        old = F.lit(None).cast(dtype) if old_kind is type(None) else F.col("o").try_cast(dtype)
        new = F.lit(None).cast(dtype) if new_kind is type(None) else F.col("n").try_cast(dtype)
        part = df.sparkSession.createDataFrame(plain, ["at", "o", "n"])
        part = part.select("at", old.alias("_old"), new.alias("_new"), F.lit(old_kind is type(None)).alias("_none"))
        table = part if table is None else table.unionByName(part)
    table = (
        table.filter("_none OR _old IS NOT NULL")
        .groupBy("_old")
        .agg(F.min_by(F.struct("_new"), "at").alias("_first"))
        .select("_old", F.col("_first._new").alias("_new"), F.lit(True).alias("_hit"))
    )
    joined = df.join(broadcast_if_small(table), c.eqNullSafe(F.col("_old")), "left")
    return joined.select(
        *[
            (F.when(F.col("_hit"), F.col("_new")).otherwise(ref(n)).alias(n) if n == column else ref(n))
            for n in df.columns
        ]
    )


def apply_value_rules(df: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    """``{column: {range, pattern, allowed_values}}`` as filters, in that order."""
    for column, rule in rules.items():
        if column not in df.columns:
            continue
        if "range" in rule:
            df = keep_range(df, column, *rule["range"])
        if "pattern" in rule:
            df = keep_pattern(df, column, rule["pattern"])
        if "allowed_values" in rule:
            df = keep_allowed(df, column, rule["allowed_values"])
    return df


def apply_replacements(df: DataFrame, replacements: Mapping[str, Mapping]) -> DataFrame:
    for column, mapping in replacements.items():
        if column in df.columns:
            df = replace_values(df, column, mapping)
    return df
