"""Text expressions. Whitespace is the Unicode class, not blanks only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lowercase(c: Column) -> Column:
    return F.lower(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


# Order in which the operations run when several are asked for.
TEXT_OPERATIONS = {
    "lowercase": lowercase,
    "strip": strip,
    "spaces": collapse_spaces,
}


def standardise(c: Column, operations=("lowercase", "strip", "spaces")) -> Column:
    for name, operation in TEXT_OPERATIONS.items():
        if name in operations:
            c = operation(c)
    return c


def matches_from_start(c: Column, pattern: str) -> Column:
    """The pattern is anchored at the start only; the end stays open."""
    return c.rlike("^(?:" + pattern + ")")
