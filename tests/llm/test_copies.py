"""Exact copies through the cuckoo index, against plain sets and dictionaries."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm.cuckoo import CuckooIndex, drop_copies, find_copies


def keys_of(numbers) -> np.ndarray:
    raw = b"".join(hashlib.sha256(str(n).encode()).digest() for n in numbers)
    return np.frombuffer(raw, np.uint64).reshape(-1, 4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.lists(st.integers(0, 400), min_size=1, max_size=150)), max_size=8))
def test_index_is_a_set(steps):
    index, live = CuckooIndex(buckets=4), set()
    for remove, numbers in steps:
        if remove:
            assert index.delete(keys_of(numbers)).sum() == len(live & set(numbers))
            live -= set(numbers)
        else:
            assert index.insert(keys_of(numbers)).sum() == len(set(numbers) - live)
            live |= set(numbers)
        assert len(index) == len(live)
        assert index.contains(keys_of(range(450))).tolist() == [n in live for n in range(450)]
        assert index.hits(index.keys).all()


def test_index_grows_and_hits_little():
    index = CuckooIndex(buckets=8)
    for at in range(0, 30_000, 5_000):
        index.insert(keys_of(range(at, at + 5_000)))
    assert index.resized > 3 and len(index) == 30_000
    assert index.contains(keys_of(range(30_000))).all()
    others = keys_of(range(30_000, 60_000))
    assert not index.contains(others).any()
    assert index.hits(others).mean() < 0.01
    index.delete(keys_of(range(10_000)))
    assert not index.contains(keys_of(range(10_000))).any()
    assert index.contains(keys_of(range(10_000, 30_000))).all()


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for key, text in rows:
        group = groups[text or ""]
        keep = max((k for k in group if k is not None), default=None)
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((key, keep, len(group), key == keep, digest))
    return sorted(out, key=repr)


def found(df):
    rows = find_copies(df).withColumn("digest", F.lower(F.hex("digest")))
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "digest")) for r in rows.collect()), key=repr)


def test_copies_against_brute_force(spark):
    draw = random.Random(3)
    texts = ["", None, " ", "a", "A", "é", "é", "long " * 60_000, "x\n", "x"]
    rows = [(draw.choice([k, k, k, None, 7]), draw.choice(texts)) for k in range(400)]
    rows += [(k, "hot") for k in range(1000, 1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clashing = df.withColumns({"digest": F.lit(1), "keep_id": F.lit(2), "id": F.lit(3), "kept": F.lit("x")})
    assert found(clashing) == brute(rows)


def test_copies_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert found(df) == []
    assert drop_copies(df).count() == 0


def test_drop_keeps_one_row_and_all_columns(spark):
    rows = [(1, "a", 0), (5, "a", 1), (5, "a", 1), (None, "b", 2), (None, "b", 2), (2, None, 3), (3, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    left = drop_copies(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(5, "a", 1), (None, "b", 2), (3, "", 4)], key=repr)
