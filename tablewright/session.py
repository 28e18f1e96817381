"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TablewrightError

# Rows and bytes a side may have before it is no longer broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A single-machine session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablewright")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder: ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made only if driver and executors are one
    process; others could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise TablewrightError("set spark.checkpoint.dir to a folder all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
    return context.getCheckpointDir()


_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """Keep a frame that several passes read, until :func:`release`.

    Lineage stays, so a lost executor only costs recomputation.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(kept)
    return kept


def release() -> None:
    """Drop every frame kept by the operators, once their results are written.

    A result read later is computed again from its sources.
    """
    while _held:
        frame = _held.pop()
        if frame.sparkSession.getActiveSession() is not None:
            frame.unpersist()


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, the rest by a fixed width."""
    total = F.lit(16)
    for field in df.schema.fields:
        c = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + F.lit(16)
    return total.cast("bigint")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` was measured to have at most ``rows`` rows and ``size`` bytes."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return found[0] <= rows and (found[1] or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after measuring its rows and bytes."""
    return F.broadcast(df) if is_small(df, rows, size) else df
