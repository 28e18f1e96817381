"""What the forest search asks for, and a small search run to its end."""

import random
from itertools import product
from types import SimpleNamespace

from pyspark.ml.tuning import CrossValidator

from tablewright.operators import features

SF = "/root/testdata/sf0.001"


def test_search_covers_the_declared_grid_in_all_folds(spark, monkeypatch):
    asked = []

    def fit(self, data):
        asked.append(self)
        return SimpleNamespace(avgMetrics=[0.5] * len(self.getEstimatorParamMaps()))

    monkeypatch.setattr(CrossValidator, "fit", fit)
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    model = features.forest_regression(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    settings = [tuple(m[p] for p in sorted(m, key=lambda p: p.name)) for m in asked[0].getEstimatorParamMaps()]
    declared = [features.FOREST_GRID[name] for name in sorted(features.FOREST_GRID)]
    assert sorted(settings) == sorted(product(*declared))
    assert asked[0].getNumFolds() == features.FOLDS == 5
    assert len(model.avgMetrics) == len(settings) == 27


def test_small_search_beats_the_mean(spark):
    draw = random.Random(3)
    rows = [(x, 10.0 if x > 50 else 0.0) for x in (draw.uniform(0, 100) for _ in range(120))]
    df = spark.createDataFrame(rows, "x double, y double")
    grid = {"numTrees": [3], "maxDepth": [1, 3], "minInstancesPerNode": [1]}
    model = features.forest_regression(df, ["x"], "y", grid, folds=2)
    assert len(model.avgMetrics) == 2 and min(model.avgMetrics) < 3
    best = model.getEstimatorParamMaps()[model.avgMetrics.index(min(model.avgMetrics))]
    assert model.bestModel.getOrDefault("maxDepth") in best.values()


def test_no_row_has_a_nearer_centre(spark):
    draw = random.Random(5)
    rows = []
    for i in range(400):
        a, b = draw.choice([(0, 0), (10, 0), (0, 10), (30, 30)])
        rows.append((i, a + draw.gauss(0, 1), b + draw.gauss(0, 1), draw.choice([None, float(a)])))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    found = {}
    for r in features.k_means_pairs(df, ["id"], ["a", "b", "c"], 4).collect():
        found.setdefault((r["column_a"], r["column_b"]), {})[r["id"]] = r["cluster"]
    values = {"a": 1, "b": 2, "c": 3}
    assert set(found) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), own in found.items():
        points = {r[0]: (r[values[x]], r[values[y]]) for r in rows if r[values[x]] is not None and r[values[y]] is not None}
        assert set(own) == set(points)
        centres = {}
        for k in set(own.values()):
            members = [points[i] for i, c in own.items() if c == k]
            centres[k] = tuple(sum(m[side] for m in members) / len(members) for side in (0, 1))
        away = lambda p, c: (p[0] - c[0]) ** 2 + (p[1] - c[1]) ** 2
        for i, k in own.items():
            assert away(points[i], centres[k]) <= min(away(points[i], c) for c in centres.values()) + 1e-9
    assert len(set(found["a", "b"].values())) == 4


def test_pairs_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, None, 2.0)], "id long, a double, b double")
    assert [r["cluster"] for r in features.k_means_pairs(df, ["id"], ["a", "b"], 3).collect()] == [0, 0]
    assert features.k_means_pairs(df.limit(0), ["id"], ["a", "b"], 3).count() == 0
