"""Feature columns and small models named in configurations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.functions.kinds import number, ref
from tablewright.operators.correlate import _pair_correlations

# Defaults of the feature steps and models.
DEGREE = 2
TOP_FEATURES = 20
TRAIN_SIZE = 0.8
SEED = 42
CLUSTERS = 5
FOLDS = 5
ITERATIONS = 50
FIRST_POINTS = 2_000  # rows that starting centres are drawn from
# (30 is the deepest tree; a node splits down to these rows a child)
FOREST_GRID = {
    "numTrees": [100, 200, 300],
    "maxDepth": [10, 20, 30],
    "minInstancesPerNode": [1, 3, 5],
}


def _product(df: DataFrame, names: Iterable[str]):
    out = None
    for n in names:
        out = number(df, n) if out is None else out * number(df, n)
    return out


def polynomial(df: DataFrame, columns: Iterable[str], degree: int = DEGREE) -> DataFrame:
    """Add every product of up to ``degree`` columns, powers included."""
    names = list(columns)
    added = {}
    for size in range(2, degree + 1):
        for group in combinations_with_replacement(names, size):
            powers = {n: group.count(n) for n in dict.fromkeys(group)}
            label = "*".join(n if k == 1 else f"{n}^{k}" for n, k in powers.items())
            added[label] = _product(df, group)
    return df.withColumns(added)


def interactions(df: DataFrame, columns: Iterable[str], degree: int = DEGREE) -> DataFrame:
    """Add products of different columns."""
    names = list(columns)
    added = {
        "*".join(group): _product(df, group)
        for size in range(2, degree + 1)
        for group in combinations(names, size)
    }
    return df.withColumns(added)


def row_statistics(df: DataFrame, columns: Iterable[str], prefix: str = "row") -> DataFrame:
    """Mean, median and sample deviation over the columns of each row."""
    cells = F.array_compact(F.array(*[number(df, c) for c in columns]))
    n = F.size(cells)
    total = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, F.nullif(n, F.lit(0)).cast("double"))
    squares = F.aggregate(cells, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    ordered = F.array_sort(cells)
    middle = F.floor((n - 1) / 2).cast("int")
    upper = F.floor(n / 2).cast("int")
    median = (F.get(ordered, middle) + F.get(ordered, upper)) / 2.0
    return df.withColumns(
        {
            f"{prefix}_mean": mean,
            f"{prefix}_median": F.when(n > 0, median),
            f"{prefix}_std": F.when(n > 1, F.sqrt(squares / (n - 1))),
        }
    )


def regression_scores(df: DataFrame, features: Iterable[str], target: str) -> DataFrame:
    """F statistic of a one-feature linear regression on the target, best first."""
    names = list(features)
    complete = df.na.drop("any", subset=[*names, target])
    pairs = {(f, target): (number(complete, f), number(complete, target)) for f in names}
    r, n = _pair_correlations(complete, pairs, counts=True)
    rows = []
    for f in names:
        value, score = r[f, target], None
        if value is not None and n[f, target] > 2:
            # a feature that explains everything scores without limit
            square = value * value
            score = square / (1 - square) * (n[f, target] - 2) if square < 1 else float("inf")
        rows.append((f, value, score))
    scores = df.sparkSession.createDataFrame(rows, "feature string, correlation double, f_score double")
    return scores.orderBy(F.desc_nulls_last("f_score"), "feature")


def top_features(df: DataFrame, features: Iterable[str], target: str, k: int = TOP_FEATURES) -> DataFrame:
    return regression_scores(df, features, target).limit(k)


def split_mark(key: Iterable[str], seed: int = SEED):
    """A number in [0, 1) that depends on the key and the seed only."""
    text = F.concat_ws("|", *[ref(k).cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def train_test_split(
    df: DataFrame, key: str | Iterable[str], train_size: float = TRAIN_SIZE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Split by the hash of the key: the same rows on every run and partitioning."""
    keys = [key] if isinstance(key, str) else list(key)
    mark = split_mark(keys, seed)
    return df.filter(mark < train_size), df.filter(mark >= train_size)


def with_roles(df: DataFrame, target: str, numeric=(), categorical=(), unused=()) -> dict[str, DataFrame]:
    """Tables of the columns by role."""
    absent = [c for c in [target, *numeric, *categorical, *unused] if c not in df.columns]
    if absent:
        raise PrepareError(f"columns not found: {absent}")
    chosen = [c for c in [*numeric, *categorical] if c not in unused and c != target]
    return {
        "features": df.select(*[ref(c) for c in chosen]),
        "target": df.select(ref(target)),
        "modelled": df.select(*[ref(c) for c in chosen], ref(target)),
    }


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    doubles = df.withColumns({f"_f{i}": number(df, c) for i, c in enumerate(columns)})
    inputs = [f"_f{i}" for i in range(len(columns))]
    vectors = VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="skip")
    return vectors.transform(doubles).drop(*inputs)


def k_means(df: DataFrame, columns: Iterable[str], clusters: int = CLUSTERS, seed: int = SEED) -> DataFrame:
    """Add the ``cluster`` of each row; rows with a null are left out."""
    from pyspark.ml.clustering import KMeans

    data = _assembled(df, list(columns))
    model = KMeans(k=clusters, seed=seed, featuresCol="_features", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_features")


def _first_centres(df: DataFrame, pairs: list, clusters: int, seed: int) -> np.ndarray:
    """Starting centres of every pair, spread out over the ``FIRST_POINTS`` rows with the lowest hashes.

    Each next centre is a row drawn by its squared distance from those before it.
    """
    cells = F.array(*[c for pair in pairs for c in pair])
    mark = F.xxhash64(F.lit(seed), cells)
    rows = df.select(cells.alias("cells"), mark.alias("mark")).distinct().orderBy("mark").limit(FIRST_POINTS).collect()
    points = np.array([r["cells"] for r in rows], float).reshape(len(rows), len(pairs), 2)
    draw = np.random.default_rng(seed)
    out = np.full((len(pairs), clusters, 2), np.nan)
    for p in range(len(pairs)):
        own = np.unique(points[:, p], axis=0)
        own = own[~np.isnan(own).any(axis=1)]
        if not len(own):
            continue
        out[p, 0] = own[draw.integers(len(own))]
        for k in range(1, clusters):
            away = ((own[:, None] - out[p, None, :k]) ** 2).sum(axis=2).min(axis=1)
            if not away.any():
                break  # fewer different rows than clusters
            out[p, k] = own[draw.choice(len(own), p=away / away.sum())]
    return out


def _nearest(x: Column, y: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre, the first on ties; null for a null coordinate."""
    known = [(k, c) for k, c in enumerate(centres.tolist()) if c[0] == c[0]]
    if not known:
        return F.lit(None).cast("int")
    away = [F.struct(((x - F.lit(c[0])) ** 2 + (y - F.lit(c[1])) ** 2).alias("d"), F.lit(k).alias("k")) for k, c in known]
    best = away[0] if len(away) == 1 else F.least(*away)
    return F.when(x.isNotNull() & y.isNotNull(), best["k"])


def k_means_pairs(
    df: DataFrame, key: Iterable[str], columns: Iterable[str], clusters: int = CLUSTERS, seed: int = SEED,
    iterations: int = ITERATIONS,
) -> DataFrame:
    """Cluster every pair of columns on its own: ``(key..., column_a, column_b, cluster)``.

    One iteration is one scan for all pairs: rows choose their nearest centres, sums by pair and
    centre are combined in their tasks, and the new centres, a few numbers a pair, come back. It ends when
    no centre moves, or after ``iterations``. Rows with a null in a pair are left out of that pair.
    """
    names = list(combinations(list(columns), 2))
    pairs = [(number(df, a), number(df, b)) for a, b in names]
    centres = _first_centres(df, pairs, clusters, seed)

    def assigned(keep: list[Column]) -> DataFrame:
        cells = [
            F.struct(x.alias("x"), y.alias("y"), _nearest(x, y, own).alias("cluster")) for (x, y), own in zip(pairs, centres)
        ]
        return df.select(*keep, F.posexplode(F.array(*cells)).alias("pair", "cell")).filter("cell.cluster is not null")

    for _ in range(iterations):
        sums = assigned([]).groupBy("pair", "cell.cluster").agg(F.avg("cell.x").alias("x"), F.avg("cell.y").alias("y"))
        moved = centres.copy()  # a centre that lost its rows stays
        for r in sums.collect():  # pairs times clusters
            moved[r["pair"], r["cluster"]] = r["x"], r["y"]
        done = np.allclose(moved, centres, rtol=1e-12, atol=1e-12, equal_nan=True)
        centres = moved
        if done:
            break
    label = [F.array(*[F.lit(n[side]) for n in names])[F.col("pair")] for side in (0, 1)]
    return assigned([ref(k) for k in key]).select(
        *[ref(k) for k in key], label[0].alias("column_a"), label[1].alias("column_b"), F.col("cell.cluster").alias("cluster")
    )


def forest_regression(
    df: DataFrame,
    features: Iterable[str],
    target: str,
    grid: Mapping[str, list] | None = None,
    folds: int = FOLDS,
    draws: int | None = None,
    seed: int = SEED,
):
    """Random forest chosen by cross-validation over a grid, or over ``draws`` of it.

    The declared grid is adapted to what Spark's forests have: rows a child for rows a split,
    and 30, the deepest tree, for no limit. Rows with a null feature or target are left out.
    """
    import random

    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = _assembled(df.filter(ref(target).isNotNull()), list(features)).withColumn(
        "_label", ref(target).cast("double")
    )
    forest = RandomForestRegressor(
        featuresCol="_features", labelCol="_label", predictionCol="prediction", seed=seed
    )
    builder = ParamGridBuilder()
    for name, values in (grid or FOREST_GRID).items():
        builder = builder.addGrid(forest.getParam(name), values)
    maps = builder.build()
    if draws is not None and draws < len(maps):
        maps = random.Random(seed).sample(maps, draws)
    evaluator = RegressionEvaluator(labelCol="_label", predictionCol="prediction", metricName="rmse")
    search = CrossValidator(
        estimator=forest, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, seed=seed
    )
    return search.fit(data)
