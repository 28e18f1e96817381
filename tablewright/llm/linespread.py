"""Boilerplate lines: removed where they spread over many sites.

A line is named by two 64-bit hashes of its trimmed text. Per line, a HyperLogLog
sketch of the sites it stands on is built in each task and merged by aggregation. Far
below and far above ``min_sites`` the estimate decides; the lines near it are counted
exactly. Only hashes are shuffled for the counting, and texts once, to be rewritten.

A hot line or a hot site is combined in its tasks before the shuffle. Everything is
DataFrame operations: no Python on the executors.

Inputs: a null text stays null and has no lines. Lines that are empty once trimmed of
ASCII white space are never counted nor removed. A null site counts as no site. Rows
that repeat an id are rewritten each by their own text. Other columns stay as they are;
none may start with ``_line``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import ref
from tablewright.llm.common import written

RELATIVE_ERROR = 0.05  # standard error of the sketches
BAND = 6  # standard errors, and at least so many sites, that count as near
BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _name(line: Column) -> Column:
    """128 bits of a trimmed line, null if nothing is left of it."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    named = F.struct(F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit("line"), trimmed).alias("h2"))
    return F.when(trimmed != "", named)


def spread_lines(docs: DataFrame, min_sites: int, text: str = "text", site: str = "source") -> DataFrame:
    """Names (h1, h2) of the lines that stand on at least ``min_sites`` sites."""
    lines = docs.select(
        ref(site).alias("site"), F.explode(F.transform(_lines(ref(text)), _name)).alias("line")
    ).filter("line is not null")
    lines = lines.select("site", "line.h1", "line.h2")
    sketched = lines.groupBy("h1", "h2").agg(
        F.approx_count_distinct("site", RELATIVE_ERROR).alias("sites"),
        F.min("site").alias("first"),
        F.max("site").alias("last"),
    )
    # A line of one site or none needs no estimate.
    sketched = sketched.filter((F.col("first") != F.col("last")) | F.lit(min_sites <= 1))
    band = max(BAND, int(BAND * RELATIVE_ERROR * min_sites + 1))
    estimated = written(
        sketched.filter(F.col("sites") > min_sites - band).select("h1", "h2", "sites"), "line-sketches"
    )
    sure = estimated.filter(F.col("sites") > min_sites + band).select("h1", "h2")
    near = estimated.filter(F.col("sites") <= min_sites + band).select("h1", "h2")
    counted = (
        lines.join(near, ["h1", "h2"], "left_semi")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("site").alias("sites"))
        .filter(F.col("sites") >= min_sites)
        .select("h1", "h2")
    )
    return sure.unionByName(counted)


def drop_spread_lines(
    docs: DataFrame, min_sites: int = 5, doc_id: str = "doc_id", text: str = "text", site: str = "source"
) -> DataFrame:
    """``docs`` without its widespread lines; adds n_lines and n_removed.

    The lines that stay keep their order and are joined by line feeds again.
    """
    spread = written(spread_lines(docs, min_sites, text, site), "line-spread")
    keyed = docs.withColumns(
        {"_line_id": F.coalesce(ref(doc_id).cast("string"), F.lit("")), "_line_hash": F.xxhash64(ref(text))}
    )
    # A row per text and line name; which of them go is settled on hashes alone.
    names = (
        keyed.select(
            "_line_id",
            "_line_hash",
            F.explode(F.array_distinct(F.transform(_lines(ref(text)), _name))).alias("line"),
        )
        .filter("line is not null")
        .select("_line_id", "_line_hash", "line.h1", "line.h2")
        .join(spread, ["h1", "h2"])
    )
    gone = names.groupBy("_line_id", "_line_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("_line_gone"))
    joined = keyed.join(gone, ["_line_id", "_line_hash"], "left")
    split = _lines(ref(text))
    kept = F.filter(split, lambda line: ~F.coalesce(F.array_contains(F.col("_line_gone"), _name(line)), F.lit(False)))
    cleaned = F.when(F.col("_line_gone").isNull(), ref(text)).otherwise(F.array_join("_line_kept", "\n"))
    return joined.withColumn("_line_kept", F.when(F.col("_line_gone").isNotNull(), kept)).select(
        *[cleaned.alias(c) if c == text else ref(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("_line_gone").isNull(), 0)
        .otherwise(F.size(split) - F.size("_line_kept"))
        .cast("long")
        .alias("n_removed"),
    )
