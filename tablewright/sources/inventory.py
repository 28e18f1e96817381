"""File inventories: sizes, times and rules, without reading the files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import CheckError
from tablewright.functions.scalars import human_size

# Suffixes and size accepted by default.
ALLOWED_SUFFIXES = ("csv", "xlsx")
MAX_SIZE = 200 * 1024 * 1024


def inventory(
    spark: SparkSession,
    path: str | Iterable[str],
    allowed: Iterable[str] | None = None,
    max_size: int | None = None,
    recursive: bool = True,
) -> DataFrame:
    """``(path, suffix, size, size_text, modified, suffix_allowed, size_allowed)``."""
    paths = [path] if isinstance(path, str) else list(path)
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
    except AnalysisException as e:
        raise CheckError(f"path does not exist: {paths}") from e
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    listed = files.select(
        "path", suffix.alias("suffix"), F.col("length").alias("size"),
        human_size(F.col("length")).alias("size_text"),
        F.col("modificationTime").alias("modified"),
    )
    kinds = None if allowed is None else [a.lower().lstrip(".") for a in allowed]
    return listed.withColumns(
        {
            "suffix_allowed": F.lit(True) if kinds is None else F.col("suffix").isin(kinds),
            "size_allowed": F.lit(True) if max_size is None else F.col("size") <= max_size,
        }
    )


def assert_files(spark: SparkSession, path, allowed=ALLOWED_SUFFIXES, max_size: int | None = MAX_SIZE) -> DataFrame:
    files = inventory(spark, path, allowed, max_size)
    broken = files.filter("NOT suffix_allowed OR NOT size_allowed").limit(5).collect()
    if broken:
        raise CheckError("files break the rules", {"files": [r.asDict() for r in broken]})
    return files
