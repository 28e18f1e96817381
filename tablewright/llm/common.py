"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.session import shared_folder

# A word, as the corpus operators count them.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    return spark.read.schema(schema).parquet(path)


def per_worker(name: str, make: Callable):
    """An object made once in a Python worker and kept for its later tasks."""
    held = sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def give_back() -> None:
    """Hand a Python worker's freed memory back: Spark keeps idle workers for a while."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def portions(texts: list[str], characters: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of whole texts of about so many characters, so that a batch's tokens need little memory."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= characters:
            yield part
            part, size = [], 0
    if part:
        yield part


def smallest(df: DataFrame, per_group: int, rows: int) -> DataFrame:
    """(name, mark, rank): of a table (name, mark) each name's smallest marks, ``rows`` in all.

    Marks are hashes of rows, so this is a sample that depends on the rows alone, however
    often one of them is repeated and whatever its id. Every task keeps the ``per_group``
    smallest marks of each name it meets and passes on nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names = [n for n, marks in held.items() for _ in range(len(marks))]
            marks = np.concatenate([*held.values(), np.zeros(0, np.int64)])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(marks)], ["name", "mark"])

        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            at, marks = codes.indices.to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(len(codes.dictionary) + 1))
            for k, name in enumerate(codes.dictionary.to_pylist()):
                own = marks[order[edges[k] : edges[k + 1]]]
                held[name] = np.unique(np.concatenate([held[name], own]) if name in held else own)[:per_group]
            if len(held) > 10_000:  # names without end: ranked below
                yield out()
        yield out()

    found = df.mapInArrow(run, "name string, mark long").distinct()
    rank = F.row_number().over(Window.partitionBy("name").orderBy("mark"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= per_group)
    return ranked.orderBy("rank", "mark", "name").limit(rows)


BLOCK = 2_048  # numbers of a vector that travel as one row
VECTORS = "block long, part long, values array<double>"


def vector_rows(vector: np.ndarray, part: int) -> pa.RecordBatch:
    """A task's vector as rows (block, part, values)."""
    cut = [vector[at : at + BLOCK].astype(float) for at in range(0, len(vector), BLOCK)]
    columns = [pa.array(range(len(cut)), pa.int64()), pa.array([part] * len(cut), pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(cut, pa.list_(pa.float64()))], ["block", "part", "values"])


def added(vectors: DataFrame) -> np.ndarray:
    """Sum of the tasks' vectors, in the order of their parts; a group holds one block of each task."""

    def run(table: pa.Table) -> pa.Table:
        lists = table.sort_by("part").column("values").combine_chunks()
        total = lists.flatten().to_numpy().reshape(len(lists), -1).sum(axis=0)
        return pa.table({"block": table.column("block")[:1], "values": pa.array([total], pa.list_(pa.float64()))})

    found = vectors.groupBy("block").applyInArrow(run, "block long, values array<double>").toArrow().sort_by("block")
    return found.column("values").combine_chunks().flatten().to_numpy() if found.num_rows else np.zeros(0)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from every fit: crc32 of its id as text leaves 1 when divided by 3.

    A null id counts as the empty text.
    """
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(
    df: DataFrame, order: Sequence[Column], value: str, total: str, name: str
) -> DataFrame:
    """``df`` with ``total``: the sum of ``value`` in all rows before a row in ``order``.

    Rows are range-partitioned by ``order`` (it should tell all rows apart) and written
    with their partition's number; one number per partition gives the offsets, and a
    window inside each partition the rest. No task sees more than its range of rows.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, name)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: as many as the shuffle has partitions, whatever the data.
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(total, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_offset", "_inside")
    )
