"""Small scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.kinds import ref

# Binary size units, smallest first.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def human_size(size: Column, precision: int = 2) -> Column:
    """Bytes as text with 1024 steps, for example ``1.50 KB``."""
    pattern = f"%.{precision}f %s"
    size = size.cast("double")
    last = len(SIZE_UNITS) - 1

    def written(step: int) -> Column:
        scaled = size / float(1024**step)
        return F.format_string(pattern, scaled, F.lit(SIZE_UNITS[step]))

    text = F.when(size < 1024, written(0))
    for step in range(1, last):
        text = text.when(size < float(1024 ** (step + 1)), written(step))
    return F.when(size.isNotNull(), text.otherwise(written(last)))


def stamp(ts: Column) -> Column:
    """A timestamp as ``yyyyMMdd_HHmmss``."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def display_width(name: str) -> Column:
    """Aggregate: width of a column when shown, longest text or title plus 2."""
    longest = F.coalesce(F.max(F.length(ref(name).cast("string"))), F.lit(0))
    return F.greatest(longest, F.lit(len(name))) + 2


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def parse_number(c: Column) -> Column:
    """Text to double; only plain decimal notation counts as a number."""
    plain = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return F.when(c.rlike(plain), F.trim(c).try_cast("double"))


# Layouts of dates besides ISO, tried in order; the time of day may follow.
DATE_LAYOUTS = ["M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "yyyyMMdd"]
TIME_OF_DAY = "[ HH:mm[:ss]]"


def parse_datetime(c: Column, layout: str | None = None) -> Column:
    """Text to a time without zone, ISO or by one of :data:`DATE_LAYOUTS`."""
    if layout is None:
        return c.try_cast("timestamp_ntz")
    return F.try_to_timestamp(F.trim(c), F.lit(layout + TIME_OF_DAY)).cast("timestamp_ntz")


# Texts read as a truth value.
TRUE_TEXTS = ["true", "t", "yes", "y"]
FALSE_TEXTS = ["false", "f", "no", "n"]


def parse_boolean(c: Column) -> Column:
    token = F.lower(F.trim(c))
    return F.when(token.isin(TRUE_TEXTS), F.lit(True)).when(
        token.isin(FALSE_TEXTS), F.lit(False)
    )
