"""Write tables, and keep a ledger of what was written."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import WriteError
from tablewright.functions.kinds import ref

# Codec names as Spark spells them, and the ones it has not.
CODECS = {
    "gzip": "gzip",
    "gz": "gzip",
    "bz2": "bzip2",
    "bzip2": "bzip2",
    "snappy": "snappy",
    "lz4": "lz4",
    "deflate": "deflate",
    "zstd": "zstd",
    "none": "none",
}
SINGLE_FILE_CODECS = ("zip", "xz")

LEDGER_SCHEMA = "path string, format string, compression string, rows bigint, columns int"


def codec(compression: str | None) -> str | None:
    if compression is None:
        return None
    name = compression.lower()
    if name in SINGLE_FILE_CODECS:
        raise WriteError(f"{name} packs single files; use one of {sorted(set(CODECS.values()))}")
    if name not in CODECS:
        raise WriteError(f"unknown compression: {compression}", {"supported": sorted(CODECS)})
    return CODECS[name]


def _writer(df: DataFrame, compression: str | None, mode: str):
    writer = df.write.mode(mode)
    return writer if compression is None else writer.option("compression", compression)


def write_csv(df, path, compression=None, mode="errorifexists", **options) -> None:
    _writer(df, compression, mode).options(**{"header": True, **options}).csv(path)


def write_json(df, path, compression=None, mode="errorifexists", **options) -> None:
    _writer(df, compression, mode).options(**options).json(path)


def write_parquet(df, path, compression=None, mode="errorifexists", **options) -> None:
    _writer(df, compression or "snappy", mode).options(**options).parquet(path)


def write_yaml(df, path, compression=None, mode="errorifexists", **options) -> None:
    """A YAML list with one flow-style record a line; part files join to one list."""
    record = F.to_json(
        F.struct(*[ref(c) for c in df.columns]), {"ignoreNullFields": "false"}
    )
    lines = df.select(F.concat(F.lit("- "), record).alias("value"))
    _writer(lines, compression, mode).options(**options).text(path)


WRITERS: dict[str, Callable] = {
    "csv": write_csv,
    "json": write_json,
    "parquet": write_parquet,
    "yaml": write_yaml,
}


def register_writer(name: str, writer: Callable) -> None:
    """Make a writer ``f(df, path, compression, mode, **options)`` known by name."""
    WRITERS[name.lower()] = writer


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    compression: str | None = None,
    mode: str = "errorifexists",
    ledger: str | None = None,
    **options,
) -> int:
    """Write a table as part files below ``path``; returns the rows written.

    The rows are counted while they are written, without another scan.
    """
    if fmt not in WRITERS:
        raise WriteError(f"unsupported format: {fmt}", {"supported_formats": sorted(WRITERS)})
    chosen = codec(compression)
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    WRITERS[fmt](counted, path, chosen, mode, **options)
    rows = seen.get["rows"]
    if ledger is not None:
        record_export(df.sparkSession, ledger, path, fmt, compression, rows, len(df.columns))
    return rows


def write_tables(
    tables: Mapping[str, DataFrame], path: str, fmt: str = "csv", compression=None,
    mode="errorifexists", ledger: str | None = None, **options,
) -> dict[str, int]:
    """A directory of datasets, one per table."""
    return {
        name: write_table(df, f"{path}/{name}", fmt, compression, mode, ledger, **options)
        for name, df in tables.items()
    }


def record_export(spark: SparkSession, ledger: str, path, fmt, compression, rows, columns) -> None:
    spark.createDataFrame([(path, fmt, compression, rows, columns)], LEDGER_SCHEMA).withColumn(
        "exported_at", F.current_timestamp()
    ).write.mode("append").parquet(ledger)


def export_summary(ledger: DataFrame) -> DataFrame:
    """One row: exports, rows written, formats used."""
    return ledger.agg(
        F.count(F.lit(1)).alias("total_exports"),
        F.sum("rows").alias("total_rows"),
        # bounded by the number of formats
        F.array_join(F.sort_array(F.collect_set("format")), ",").alias("formats"),
    )


def latest_exports(ledger: DataFrame, time_column: str = "exported_at", n: int = 5) -> DataFrame:
    return ledger.orderBy(F.desc(time_column), "path").limit(n)


def save_history(ledger: DataFrame, path: str, mode: str = "errorifexists") -> None:
    ledger.write.mode(mode).json(path)
