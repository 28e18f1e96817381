"""Explicit casts and type inference of text columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import kind_of, ref, text_columns
from tablewright.functions.scalars import DATE_LAYOUTS, parse_boolean, parse_datetime, parse_number
from tablewright.operators.fused import scalars

# Other names callers use for the types.
TYPE_NAMES = {
    "int64": "bigint",
    "int32": "int",
    "float64": "double",
    "float32": "float",
    "str": "string",
    "object": "string",
    "bool": "boolean",
    "datetime64[ns]": "timestamp_ntz",
}
# What every date in one of the layouts looks like: 6 to 30 characters, a digit among them.
DATE_LIKE = r"^(?=[^0-9]*[0-9])[0-9A-Za-z][0-9A-Za-z ,./:-]{5,29}$"
TIME_LIKE = r" \d\d?:\d\d?(:\d\d?)?$"
# Doubles hold every whole number up to this size.
WHOLE_LIMIT = 2.0**53


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Cast each column whole or not at all.

    Returns the table and the columns left as they were, with the reason. All
    casts are tried in one scan.
    """
    wanted = {n: TYPE_NAMES.get(t, t) for n, t in types.items() if n in df.columns}
    if not wanted:
        return df, {}
    tries = {
        name: F.count_if(ref(name).isNotNull() & ref(name).try_cast(target).isNull())
        for name, target in wanted.items()
    }
    failures = scalars(df, tries)
    kept = {n: f"{bad} values do not cast to {wanted[n]}" for n, bad in failures.items() if bad}
    casts = {n: ref(n).try_cast(t) for n, t in wanted.items() if n not in kept}
    return (df.withColumns(casts) if casts else df), kept


def layout_shape(layout: str) -> str:
    """A layout with every run of digits as 9 and every name as a: ``MMM d, yyyy`` is ``a 9, 9``."""
    names = re.sub(r"MMM+", "a", layout)
    return re.sub(r"[yMd]+", "9", names)


def date_shape(c: Column) -> Column:
    """The shape of a text that could be a date, without its time of day; null for other texts."""
    text = F.trim(c)
    day = F.regexp_replace(text, TIME_LIKE, "")
    runs = F.regexp_replace(F.regexp_replace(day, "[A-Za-z]+", "a"), "[0-9]+", "9")
    return F.when(text.rlike(DATE_LIKE), runs)


def possible_layouts(c: Column) -> Column:
    """A bit for each of :data:`DATE_LAYOUTS` that the shape of a text leaves open."""
    shapes: dict[str, int] = {}
    for i, layout in enumerate(DATE_LAYOUTS):
        shapes[layout_shape(layout)] = shapes.get(layout_shape(layout), 0) | 1 << i
    shape, bits = date_shape(c), F.lit(0)

    def chosen(shape: Column) -> Column:
        out = bits
        for text, mask in shapes.items():
            out = F.when(shape == text, mask).otherwise(out)
        return out

    # computed once, and not at all for nulls
    return F.when(c.isNotNull(), F.get(F.transform(F.array(shape), chosen), F.lit(0)))


def inferred_types(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    """Type each text column could have: number, datetime, boolean, else string.

    One scan decides for all columns but those that may be dates of another layout than ISO:
    it keeps the layouts that fit the shape of every value, and a second scan parses by these
    alone. A column counts as a type when all of its values do; a boolean needs true/false,
    t/f, yes/no or y/n texts. Dates are ISO or of one layout, which then follows the type's name.
    """
    names = text_columns(df) if columns is None else list(columns)
    tests = {}
    for name in names:
        c = ref(name)
        value = parse_number(c)
        whole = (value == F.floor(value)) & (F.abs(value) <= WHOLE_LIMIT)
        tests[name, "values"] = F.count(c)
        tests[name, "number"] = F.count(value)
        tests[name, "whole"] = F.count_if(whole & c.rlike(r"^\s*[+-]?\d+\s*$"))
        tests[name, "datetime"] = F.count(parse_datetime(c))
        tests[name, "layouts"] = F.bit_and(possible_layouts(c))
        tests[name, "boolean"] = F.count(parse_boolean(c))
    if not tests:
        return {}
    got = scalars(df, tests)
    types, open_layouts = {}, {}
    for name in names:
        total = got[name, "values"]
        if total and got[name, "whole"] == total:
            types[name] = "bigint"
        elif total and got[name, "number"] == total:
            types[name] = "double"
        elif total and got[name, "datetime"] == total:
            types[name] = "timestamp_ntz"
        elif total and got[name, "boolean"] == total:
            types[name] = "boolean"
        else:
            types[name] = "string"
            left = [x for i, x in enumerate(DATE_LAYOUTS) if total and got[name, "layouts"] >> i & 1]
            open_layouts |= {(name, x): F.count(parse_datetime(ref(name), x)) for x in left}
    if open_layouts:
        parsed = scalars(df, open_layouts)
        for name, layout in reversed(list(open_layouts)):  # the first that fits stays
            if parsed[name, layout] == got[name, "values"]:
                types[name] = f"timestamp_ntz {layout}"
    return types


def convert_inferred(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    parsers = {
        "bigint": lambda c: F.trim(c).try_cast("bigint"),
        "double": parse_number,
        "timestamp_ntz": parse_datetime,
        "boolean": parse_boolean,
    }
    casts = {n: parsers[t](ref(n)) for n, t in types.items() if t in parsers}
    for name, kind in types.items():
        if kind.startswith("timestamp_ntz "):
            casts[name] = parse_datetime(ref(name), kind.removeprefix("timestamp_ntz "))
    return df.withColumns(casts) if casts else df


def infer_and_convert(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    return convert_inferred(df, inferred_types(df, columns))


def fix_types(
    df: DataFrame, type_mappings: Mapping[str, str] | None = None, infer: bool = True
) -> tuple[DataFrame, dict[str, str]]:
    """Explicit casts first, then inference for the text columns not mentioned."""
    mappings = dict(type_mappings or {})
    df, kept = cast_columns(df, mappings)
    if infer:
        rest = [c for c in text_columns(df) if c not in mappings]
        df = infer_and_convert(df, rest)
    return df, kept
