"""Sparse one-hot vectors, and preparations as stages of saved pipelines."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablewright.plans import preparing
from tablewright.plans.preparing import PrepSpec
from tablewright.plans.stages import PrepEstimator


def make(spark):
    rows = [(i, float(i % 7) if i % 5 else None, ["red", "blue", None][i % 3], float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, a double, `c.x` string, y double")


@pytest.mark.parametrize("method", ["onehot", "ordinal", "sparse"])
def test_stage_of_a_saved_pipeline(spark, tmp_path, method):
    df = make(spark)
    spec = PrepSpec(["a"], ["c.x"], encoding=method)
    pipeline = Pipeline(stages=[PrepEstimator(spec, "features"), LinearRegression(labelCol="y")])
    model = pipeline.fit(df)
    model.write().save(str(tmp_path / "model"))
    pipeline.write().save(str(tmp_path / "pipeline"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.stages[0].uid == model.stages[0].uid
    out = loaded.transform(make(spark.newSession()))
    wanted = preparing.fit(df, spec).transform(df, ["id", "y"])
    own = [f"`{c}`" for c in wanted.columns]
    assert sorted(map(repr, out.select(*own).collect())) == sorted(map(repr, wanted.select(*own).collect()))
    predicted = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert {r["id"]: r["prediction"] for r in out.collect()} == pytest.approx(predicted)
    fresh = Pipeline.load(str(tmp_path / "pipeline")).getStages()[0]
    assert fresh.spec == spec and fresh.features == "features"


def test_many_categories_as_sparse_vectors(spark):
    df = spark.range(100_000).select("id", F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("v"))
    fitted = preparing.fit(df, PrepSpec([], ["v"], encoding="sparse"))
    assert fitted.categories["v"] is None  # never on the driver
    odd = df.union(spark.createDataFrame([(-1, "unknown"), (-2, None)], "id long, v string"))
    cell = F.unwrap_udt("v")
    out = fitted.transform(odd, ["id"]).select("id", cell["size"].alias("size"), cell["indices"].alias("at"))
    assert out.filter("size <> 100000").isEmpty()
    assert out.filter("id >= 0 and at[0] <> id").isEmpty()
    assert out.filter("id < 0 and size(at) > 0").isEmpty()


def test_sparse_vectors_of_few_or_no_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    fitted = preparing.fit(df, PrepSpec([], ["c"], encoding="sparse"))
    assert sorted(r[0].toArray().tolist() for r in fitted.transform(df).collect()) == [[0, 0, 1], [0, 1, 0], [1, 0, 0]]
    empty = preparing.fit(df.limit(0), PrepSpec([], ["c"], encoding="sparse"))
    assert [r[0].numNonzeros() for r in empty.transform(df).collect()] == [0, 0, 0]
