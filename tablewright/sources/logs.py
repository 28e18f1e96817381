"""Query structured log files (a JSON object per line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a log line and the layouts of its time.
LOG_SCHEMA = (
    "timestamp string, level string, logger string, message string, "
    "module string, function string, line int"
)
TIME_LAYOUTS = ("yyyy-MM-dd HH:mm:ss,SSS", "yyyy-MM-dd HH:mm:ss")


def _with_time(df: DataFrame) -> DataFrame:
    parsed = F.coalesce(
        *[F.try_to_timestamp("timestamp", F.lit(layout)).cast("timestamp_ntz") for layout in TIME_LAYOUTS]
    )
    return df.withColumn("ts", parsed).filter(F.col("ts").isNotNull())


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their time as ``ts``; broken lines are skipped."""
    reader = spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED")
    return _with_time(reader.json(path))


def stream_logs(spark: SparkSession, directory: str) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED")
    return _with_time(reader.json(directory))


def query_logs(
    logs: DataFrame,
    level: str | None = None,
    start=None,
    end=None,
    limit: int | None = None,
    time_column: str = "ts",
    level_column: str = "level",
) -> DataFrame:
    """Level equals, time in the closed interval, first rows by time.

    The limit applies to tables only; on a stream leave it out.
    """
    if level is not None:
        logs = logs.filter(F.col(level_column) == level)
    ts = F.col(time_column)
    if start is not None:
        logs = logs.filter(ts >= F.lit(start).cast(logs.schema[time_column].dataType))
    if end is not None:
        logs = logs.filter(ts <= F.lit(end).cast(logs.schema[time_column].dataType))
    if limit is not None:
        rest = [c for c in logs.columns if c != time_column]
        logs = logs.orderBy(time_column, *rest).limit(limit)
    return logs
