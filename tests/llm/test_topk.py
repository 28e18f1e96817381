"""Top products against all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import topk


def brute(rows, every, k=5, scale=256):
    usable = {}
    for key, v in rows:
        if key is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.setdefault((key, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)), None)
    out = []
    for q, a in usable:
        if q % every == 0:
            found = [
                (-sum(x * y for x, y in zip(a, b)), key)
                for key, b in usable
                if key != q and len(a) == len(b)
            ]
            out += [(q, i + 1, key, -s) for i, (s, key) in enumerate(sorted(found)[:k])]
    return sorted(out)


def found(spark, rows, every, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    df = df.withColumns({c: F.lit("x") for c in ("id", "v", "dim", "class", "part", "label")})
    return sorted(tuple(r) for r in topk.top_products(df, F.col("id") % every == 0, **kw).collect())


def vectors(kind, n, dim, seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= np.exp(draw.normal(0, 1.5, (n, 1)))
    if kind == "close":  # tight clusters: cosines near 1, where coordinates tell
        x = x[draw.integers(0, 6, n)] + draw.normal(0, 0.004, (n, dim))
    if kind == "ties":
        x = np.round(x)
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("kind", ["unit", "lengths", "close", "ties"])
def test_against_all_products(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rows = vectors(kind, 700, 8, 1)
    assert found(spark, rows, 9) == brute(rows, 9)


def test_odd_vectors(spark):
    rows = vectors("unit", 60, 4, 2)
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (105, [float("inf")] * 4)]
    rows += [(None, [1.0] * 4), (110, [0.0] * 4), (120, [0.0] * 4), (110, [0.0] * 4), (130, [2.0, 1.0]), (131, [1.0, 1.0])]
    rows += [(k, [0.5] * 4) for k in range(200, 260)] + [(7, [3.0] * 4)]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_large_components_stay_exact(spark):
    draw = random.Random(3)
    rows = [(k, [draw.choice([-1, 1]) * draw.uniform(1e5, 1e6) for _ in range(3)]) for k in range(40)]
    assert found(spark, rows, 5) == brute(rows, 5)


def test_few_rows(spark):
    assert found(spark, [], 5) == []
    assert found(spark, [(5, [1.0])], 5) == []
    assert found(spark, [(5, [1.0]), (6, [2.0])], 5) == [(5, 1, 6, 256 * 512)]


def test_coordinates_prune_and_lose_nothing():
    draw = np.random.default_rng(5)
    centre = draw.normal(size=16)
    rows = np.round(1000 * (centre + draw.normal(0, 0.001, (50, 16)))).astype(np.int64)
    others = np.round(1000 * draw.normal(size=(3000, 16))).astype(np.int64)
    both = np.concatenate([rows, others])
    order = np.argsort(-(both**2).sum(axis=1))
    bucket = topk.Bucket(16, np.arange(3050).astype("<i8").tobytes(), both[order].astype("<i8").tobytes())
    query = rows[0].astype(float)
    norm = np.linalg.norm(query)
    kept = bucket.by_coordinate(query, norm, 0.999)
    assert kept is not None and len(kept) < 1500
    cosines = (bucket.rows @ query) / (bucket.norms * norm)
    assert set(np.flatnonzero(cosines >= 0.999)) <= set(kept.tolist())
