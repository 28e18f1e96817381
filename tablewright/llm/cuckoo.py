"""Exact duplicates through a cuckoo-filter index.

Texts are named by the SHA-256 of their UTF-8 bytes and dealt into index buckets by
the head of that digest. A bucket holds a cuckoo filter of short fingerprints and the
full digests it was built from. A digest that misses the filter is new without any
look-up; a hit is verified against the bucket's stored digests, since fingerprints
collide. Live digests can be deleted again. When an insertion finds no place the
filter doubles and is rebuilt from the stored digests.

Copies are counted before the shuffle, so a text with a third of all rows reaches its
bucket as one row per task. Only digests and ids move, never texts.

Inputs: a null text counts as empty, and empty texts are copies of each other. A null
id ranks below all others. Rows that repeat an id and its text are both reported, with
the same values; ``drop_copies`` keeps one of them. Other columns are ignored by
``find_copies`` and returned unchanged by ``drop_copies``, except that none may start
with ``_copy``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import ref
from tablewright.llm.common import written

SLOTS = 4
KICKS = 200
DIGEST = np.dtype("S32")
NO_ID = np.iinfo(np.int64).min  # stands for a null id
ROWS = 20_000  # of a batch handed back to Spark


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class CuckooIndex:
    """Set of live 32-byte digests behind a cuckoo filter with 16-bit fingerprints."""

    def __init__(self, keys: np.ndarray | None = None, buckets: int = 256):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.keys = np.zeros((0, 4), np.uint64)  # stored digests, sorted by their first word
        self.resized = 0
        if keys is not None and len(keys):
            self.insert(keys)

    def __len__(self) -> int:
        return len(self.keys)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (_mix(keys[:, 2]) & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(prints, first)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(prints.astype(np.uint64) + np.uint64(1)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """What the filter says: no stored digest is missed, a few others hit."""
        prints, first, second = self._places(keys)
        seen = (self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])
        return seen.any(axis=1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Exact membership: filter hits are verified against the stored digests."""
        found = self.hits(keys)
        at = np.flatnonzero(found)
        found[at] = self.position(keys[at]) >= 0
        return found

    def position(self, keys: np.ndarray) -> np.ndarray:
        """Positions of digests in the store, -1 where absent."""
        where = np.full(len(keys), -1, np.int64)
        left = np.searchsorted(self.keys[:, 0], keys[:, 0], "left")
        pending = np.arange(len(keys))
        while len(pending):  # more than once only where first words collide
            at = left[pending]
            inside = at < len(self.keys)
            inside[inside] = self.keys[at[inside], 0] == keys[pending[inside], 0]
            pending, at = pending[inside], at[inside]
            same = (self.keys[at] == keys[pending]).all(axis=1)
            where[pending[same]] = at[same]
            pending = pending[~same]
            left[pending] += 1
        return where

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Add digests; returns which of them were new. Repeats within ``keys`` count once."""
        _, first = np.unique(keys.view(DIGEST).ravel(), return_index=True)
        new = np.zeros(len(keys), bool)
        new[first] = True
        new[first] &= ~self.contains(keys[first])
        added = keys[new]
        merged = np.concatenate([self.keys, added])
        self.keys = merged[np.argsort(merged[:, 0], kind="stable")]
        if len(self.keys) > 0.9 * self.buckets * SLOTS or not self._place(*self._places(added)[:2]):
            self._resize()
        return new

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Remove live digests; returns which of them were there."""
        _, first = np.unique(keys.view(DIGEST).ravel(), return_index=True)
        at = self.position(keys[first])
        there = np.zeros(len(keys), bool)
        there[first[at >= 0]] = True
        gone = np.sort(at[at >= 0])
        for prints, one, two in zip(*(x.tolist() for x in self._places(self.keys[gone]))):
            row = self.table[one]
            if not (row == prints).any():
                row = self.table[two]
            row[int(np.argmax(row == prints))] = 0
        self.keys = np.delete(self.keys, gone, axis=0)
        return there

    def _resize(self) -> None:
        placed = False
        while not placed:
            self.buckets *= 2
            if len(self.keys) <= 0.7 * self.buckets * SLOTS:
                self.table = np.zeros((self.buckets, SLOTS), np.uint16)
                placed = self._place(*self._places(self.keys)[:2])
        self.resized += 1

    def _place(self, prints: np.ndarray, bucket: np.ndarray) -> bool:
        """Put fingerprints into free slots, moving others on; False if some found none."""
        swap = 0
        for _ in range(KICKS + 8 * int(np.sqrt(len(prints)))):
            if not len(prints):
                return True
            _, turn = np.unique(bucket, return_index=True)  # one at a time per bucket
            rest = np.ones(len(prints), bool)
            rest[turn] = False
            own, at = prints[turn], bucket[turn]
            free = self.table[at] == 0
            slot, fits = free.argmax(axis=1), free.any(axis=1)
            self.table[at[fits], slot[fits]] = own[fits]
            own, at = own[~fits], at[~fits]
            there = self._other(own, at)  # full: the other bucket if it has room, else swap
            room = (self.table[there] == 0).any(axis=1)
            out, stay = own[room], there[room]
            own, at = own[~room], at[~room]
            evicted = self.table[at, swap % SLOTS].copy()
            self.table[at, swap % SLOTS] = own
            swap += 1
            prints = np.concatenate([prints[rest], out, evicted])
            bucket = np.concatenate([bucket[rest], stay, self._other(evicted, at)])
        return not len(prints)


def text_digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _as_batches(keys: np.ndarray, keep: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = pa.py_buffer(np.ascontiguousarray(keys).tobytes())
    ends = pa.py_buffer((np.arange(len(keys) + 1, dtype=np.int64) * 32).tobytes())
    digests = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, ends, flat])
    for at in range(0, len(keys), ROWS):
        part = slice(at, at + ROWS)
        yield pa.RecordBatch.from_arrays(
            [
                digests[part].cast(pa.binary()),
                pa.array(keep[part], mask=keep[part] == NO_ID),
                pa.array(size[part]),
            ],
            ["digest", "keep_id", "group_size"],
        )


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 4)
    return keys, batch.column(1).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a batch become one row before anything is shuffled."""
    for batch in batches:
        if batch.num_rows:
            keys, ids = _read(batch)
            _, first, group = np.unique(keys.view(DIGEST).ravel(), return_index=True, return_inverse=True)
            keep = np.full(len(first), NO_ID)
            np.maximum.at(keep, group, ids)
            yield from _as_batches(keys[first], keep, np.bincount(group).astype(np.int64))


def _index_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index bucket: what the filter calls new is stored, hits are verified and counted."""
    index = CuckooIndex()
    new_rows, repeats = [], []
    for batch in batches:
        if batch.num_rows:
            keys, ids = _read(batch)
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            new = index.insert(keys)
            new_rows.append((keys[new], ids[new], sizes[new]))
            repeats.append((keys[~new], ids[~new], sizes[~new]))
    if not new_rows:
        return
    keys, ids, sizes = (np.concatenate(x) for x in zip(*new_rows))
    keep, size = np.full(len(index), NO_ID), np.zeros(len(index), np.int64)
    for keys, ids, sizes in [(keys, ids, sizes), *repeats]:
        at = index.position(keys)
        np.maximum.at(keep, at, ids)
        np.add.at(size, at, sizes)
    yield from _as_batches(index.keys, keep, size)


def index_copies(digests: DataFrame) -> DataFrame:
    """One row per distinct digest: (digest, keep_id, group_size).

    ``digests`` has (digest binary, id long). Sums of each batch meet in the digest's
    index bucket.
    """
    partitions = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = "digest binary, keep_id long, group_size long"
    return (
        digests.select("digest", "id")
        .mapInArrow(_combine, columns)
        .repartition(partitions, "digest")
        .mapInArrow(_index_bucket, columns)
    )


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, digest, keep_id, group_size, kept)."""
    digests = docs.select(ref(doc_id).cast("long").alias("id"), text_digest(ref(text)).alias("digest"))
    digests = written(digests, "copies")
    return (
        digests.join(index_copies(digests), "digest")
        .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
        .select(F.col("id").alias("doc_id"), "digest", "keep_id", "group_size", "kept")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row for each text, the one with the largest id."""
    columns = [ref(c) for c in docs.columns]
    tagged = docs.withColumns({"_copy_digest": text_digest(ref(text)), "_copy_id": ref(doc_id).cast("long")})
    digests = tagged.select(F.col("_copy_digest").alias("digest"), F.col("_copy_id").alias("id"))
    keeps = index_copies(digests).select(
        F.col("digest").alias("_copy_digest"), F.col("keep_id").alias("_copy_keep")
    )
    survivors = tagged.join(keeps, "_copy_digest").filter(F.col("_copy_id").eqNullSafe(F.col("_copy_keep")))
    return survivors.dropDuplicates(["_copy_digest"]).select(*columns)
