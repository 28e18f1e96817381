"""Tables saved with a small metadata record beside them."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tablewright.errors import ReadError, WriteError
from tablewright.operators.checks import assert_table
from tablewright.sources.readers import read_csv
from tablewright.sources.writers import write_csv, write_parquet


def _is_csv(path: str) -> bool:
    return path.rstrip("/").endswith(".csv")


def save_artifact(df: DataFrame, path: str, metadata: Mapping | None = None, mode: str = "errorifexists") -> None:
    """CSV when the path ends in ``.csv``, else Parquet; metadata in ``<path>.meta``."""
    try:
        (write_csv if _is_csv(path) else write_parquet)(df, path, None, mode)
    except AnalysisException as e:
        raise WriteError(f"cannot save {path}: {e}") from e
    if metadata:
        one = df.sparkSession.createDataFrame([(json.dumps(dict(metadata)),)], "value string")
        one.write.mode(mode).text(f"{path}.meta")


def load_artifact(spark: SparkSession, path: str, validate: bool = True) -> tuple[DataFrame, dict | None]:
    try:
        df = read_csv(spark, path) if _is_csv(path) else spark.read.parquet(path)
    except AnalysisException as e:
        raise ReadError(f"artifact not found: {path}") from e
    if validate:
        assert_table(df, allow_nulls=True)
    try:
        stored = spark.read.text(f"{path}.meta").first()
    except AnalysisException:
        stored = None
    return df, None if stored is None else json.loads(stored[0])
