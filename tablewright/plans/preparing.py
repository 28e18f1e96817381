"""Preparation pipelines: impute and scale numbers, impute and encode categories."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.functions.kinds import number, ref
from tablewright.operators import encoding
from tablewright.operators.imputing import MISSING_CATEGORY, fit_fill
from tablewright.operators.neighbours import nearest_fill
from tablewright.operators.scaling import METHODS as SCALINGS
from tablewright.operators.scaling import fit_scaler, scaled
from tablewright.session import held

IMPUTATIONS = ("mean", "median", "most_frequent", "knn")


@dataclass(frozen=True)
class PrepSpec:
    """What to do with which columns; columns named nowhere are dropped."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    scaling: str = "standard"
    imputation: str = "mean"
    encoding: str = "onehot"

    def __post_init__(self):
        object.__setattr__(self, "numeric", tuple(self.numeric))
        object.__setattr__(self, "categorical", tuple(self.categorical))
        if self.scaling not in SCALINGS:
            raise PrepareError(f"unknown scaling method: {self.scaling}", {"available_methods": SCALINGS})
        if self.imputation not in IMPUTATIONS:
            raise PrepareError(
                f"unknown imputation method: {self.imputation}", {"available_methods": IMPUTATIONS}
            )
        encoding.check_method(self.encoding)


@dataclass
class FittedPrep:
    """Fitted parameters: a few numbers per column, plus tables where lists are long."""

    spec: PrepSpec
    fills: dict[str, float | None]
    scales: dict[str, dict]
    categories: dict[str, list[str] | None]
    code_tables: dict[str, DataFrame] = field(default_factory=dict)
    donors: DataFrame | None = None

    def transform(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        """Apply the fitted steps; ``keep`` names columns carried along unchanged.

        One ``select`` for all methods but nearest rows, so it also runs on streams.
        """
        spec, keep = self.spec, list(keep)
        carried = {f"_keep{i}": ref(c) for i, c in enumerate(keep)}
        df = df.select(
            *[c.alias(n) for n, c in carried.items()],
            *[number(df, c).alias(c) for c in spec.numeric],
            *[
                F.coalesce(ref(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(c)
                for c in spec.categorical
            ],
        )
        if spec.imputation == "knn" and spec.numeric:
            df = nearest_fill(df, spec.numeric, self.donors)
        strict = spec.encoding not in ("position", "sparse")
        coded = {}
        for i, name in enumerate(c for c in spec.categorical if self.categories[c] is None):
            coded[name] = f"_code{i}"
            df = encoding.with_codes(df, name, self.code_tables[name], coded[name], strict)
        out = [F.col(n).alias(c) for n, c in zip(carried, keep)]
        for name in spec.numeric:
            fill = self.fills.get(name)
            c = ref(name) if fill is None else F.coalesce(ref(name), F.lit(float(fill)))
            out.append(scaled(c, self.scales[name]).alias(name))
        for name in spec.categorical:
            label = f"{name}_position" if spec.encoding == "position" else name
            if spec.encoding == "onehot":
                out += encoding.one_hot(ref(name), name, self.categories[name])
            elif name in coded:
                out.append(F.col(coded[name]).alias(label))
            else:
                out.append(encoding.code(ref(name), self.categories[name], strict).alias(label))
        df = df.select(*out)
        if spec.encoding != "sparse":
            return df
        names = df.columns
        vectors = {}
        for i, name in enumerate(spec.categorical):  # codes give way to vectors, in the same place
            df = encoding.sparse_one_hot(df, name, self.size_of(name), f"_vector{i}")
            vectors[name] = F.col(f"_vector{i}")
        first = len(keep) + len(spec.numeric)
        return df.select(*[ref(c) if i < first else vectors[c].alias(c) for i, c in enumerate(names)])

    def size_of(self, name: str) -> int:
        """Number of categories of a column; a table is counted, never fetched."""
        listed = self.categories[name]
        return self.code_tables[name].count() if listed is None else len(listed)

    def parameters(self) -> dict:
        return {
            "spec": asdict(self.spec),
            "fills": self.fills,
            "scales": self.scales,
            "categories": self.categories,
        }

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        """Parameters as a one-row JSON dataset; tables beside it as Parquet."""
        text = json.dumps(self.parameters())
        spark.createDataFrame([(text,)], "value string").write.mode(mode).text(f"{path}/parameters")
        for i, (name, table) in enumerate(sorted(self.code_tables.items())):
            table.write.mode(mode).parquet(f"{path}/codes_{i}")
        if self.donors is not None:
            self.donors.write.mode(mode).parquet(f"{path}/donors")


def load_prep(spark: SparkSession, path: str) -> FittedPrep:
    stored = json.loads(spark.read.option("wholetext", True).text(f"{path}/parameters").first()[0])
    spec = PrepSpec(**stored["spec"])
    tables = sorted(n for n, v in stored["categories"].items() if v is None)
    return FittedPrep(
        spec,
        stored["fills"],
        stored["scales"],
        stored["categories"],
        {n: spark.read.parquet(f"{path}/codes_{i}") for i, n in enumerate(tables)},
        spark.read.parquet(f"{path}/donors") if spec.imputation == "knn" else None,
    )


def fit(df: DataFrame, spec: PrepSpec, inline_categories: int = encoding.INLINE_CATEGORIES) -> FittedPrep:
    """Fit the imputers, then the scalers on imputed values, then the encoders."""
    numbers = df.select(*[number(df, c).alias(c) for c in spec.numeric])
    donors = None
    fills: dict[str, float | None] = {}
    if spec.numeric:
        if spec.imputation == "knn":
            donors = numbers
            imputed = held(nearest_fill(numbers, spec.numeric))
        else:
            fills = fit_fill(numbers, spec.numeric, spec.imputation)
            imputed = numbers.select(
                *[
                    (ref(c) if fills[c] is None else F.coalesce(ref(c), F.lit(float(fills[c])))).alias(c)
                    for c in spec.numeric
                ]
            )
        scales = fit_scaler(imputed, spec.numeric, spec.scaling)
    else:
        scales = {}
    texts = df.select(
        *[
            F.coalesce(ref(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(c)
            for c in spec.categorical
        ]
    )
    # a column per category needs them all; codes may stay in a table
    inline = None if spec.encoding == "onehot" else inline_categories
    lists, tables = encoding.fit_categories(texts, spec.categorical, inline)
    return FittedPrep(spec, fills, scales, lists, tables, donors)


def fit_transform(
    df: DataFrame, spec: PrepSpec, keep: Iterable[str] = ()
) -> tuple[FittedPrep, DataFrame]:
    fitted = fit(df, spec)
    return fitted, fitted.transform(df, keep)


class PrepBook:
    """Pipelines by name, with a history of what was defined, fitted and applied."""

    def __init__(self):
        self.specs: dict[str, PrepSpec] = {}
        self.fitted: dict[str, FittedPrep] = {}
        self._history: list[tuple[str, str, int, int]] = []

    def define(self, name: str, spec: PrepSpec) -> None:
        self.specs[name] = spec
        self._history.append((name, "define", len(spec.numeric) + len(spec.categorical), 0))

    def fit_transform(self, name: str, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        if name not in self.specs:
            raise PrepareError(f"pipeline not found: {name}")
        self.fitted[name], out = fit_transform(df, self.specs[name], keep)
        self._history.append((name, "fit_transform", len(df.columns), len(out.columns)))
        return out

    def transform(self, name: str, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        if name not in self.fitted:
            raise PrepareError(f"pipeline not fitted: {name}")
        out = self.fitted[name].transform(df, keep)
        self._history.append((name, "transform", len(df.columns), len(out.columns)))
        return out

    def history(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, *entry) for i, entry in enumerate(self._history)]
        return spark.createDataFrame(
            rows, "position int, pipeline string, step string, columns_in int, columns_out int"
        )

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        for name, fitted in self.fitted.items():
            fitted.save(spark, f"{path}/{name}", mode)
        self.history(spark).write.mode(mode).json(f"{path}/_history")
        names = spark.createDataFrame([(n,) for n in self.fitted], "pipeline string")
        names.write.mode(mode).json(f"{path}/_names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PrepBook:
        book = cls()
        for row in spark.read.schema("pipeline string").json(f"{path}/_names").collect():
            name = row["pipeline"]
            book.fitted[name] = load_prep(spark, f"{path}/{name}")
            book.specs[name] = book.fitted[name].spec
        past = spark.read.schema(
            "position int, pipeline string, step string, columns_in int, columns_out int"
        ).json(f"{path}/_history")
        book._history = [tuple(r)[1:] for r in past.orderBy("position").collect()]
        return book
