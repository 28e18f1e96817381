"""Preparation as stages of Spark's own pipelines.

A :class:`PrepEstimator` fits a :class:`~tablewright.plans.preparing.PrepSpec`; its :class:`PrepModel` is a
stage of a saved ``PipelineModel`` that is loaded in another session and stands before any model of
Spark. Columns the specification does not name are carried along.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from tablewright.plans.preparing import FittedPrep, PrepSpec, fit, load_prep


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        told = {"spec": asdict(self.stage.spec), "features": self.stage.features}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, told)
        fitted = getattr(self.stage, "fitted", None)
        if fitted is not None:
            fitted.save(self.sparkSession, f"{path}/fitted")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        spec, features = PrepSpec(**told["spec"]), told["features"]
        if self.kind is PrepModel:
            stage = PrepModel(load_prep(self.sparkSession, f"{path}/fitted"), features)
        else:
            stage = PrepEstimator(spec, features)
        stage._resetUid(told["uid"])
        return stage


class _Stage(MLReadable, MLWritable):
    spec: PrepSpec
    features: str | None

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class PrepModel(Model, _Stage):
    """A fitted preparation; ``features`` names a vector of all prepared columns to add."""

    def __init__(self, fitted: FittedPrep, features: str | None = None):
        super().__init__()
        self.fitted, self.features = fitted, features

    @property
    def spec(self) -> PrepSpec:
        return self.fitted.spec

    def _transform(self, dataset: DataFrame) -> DataFrame:
        named = {*self.spec.numeric, *self.spec.categorical}
        rest = [c for c in dataset.columns if c not in named]
        out = self.fitted.transform(dataset, rest)
        if self.features is None:
            return out
        made = out.columns[len(rest) :]
        # names with dots or quotes mean nothing to an assembler
        plain = [f"_prepared{i}" for i in range(len(made))]
        vectors = VectorAssembler(inputCols=plain, outputCol=self.features, handleInvalid="keep")
        renamed = out.toDF(*out.columns[: len(rest)], *plain)
        return vectors.transform(renamed).toDF(*out.columns, self.features)


class PrepEstimator(Estimator, _Stage):
    def __init__(self, spec: PrepSpec, features: str | None = None):
        super().__init__()
        self.spec, self.features = spec, features

    def _fit(self, dataset: DataFrame) -> PrepModel:
        return PrepModel(fit(dataset, self.spec), self.features)


def load_model(spark: SparkSession, path: str) -> PrepModel:
    return PrepModel.read().session(spark).load(path)
