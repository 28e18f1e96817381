"""Statistics on small hand-made frames, against pandas, numpy or brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import moments
from tablewright.operators import correlate, describe, frequencies, histogram, ranking
from tablewright.operators.outliers import detect_outliers
from tablewright.operators.quantiles import exact_quantiles
from tablewright.plans.profiling import profile


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    n = 5000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "a": rng.normal(size=n),
            "b": rng.integers(0, 12, n).astype(float),
            "c": np.where(rng.random(n) < 0.33, 5.0, rng.exponential(size=n)),
        }
    )
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "b"] = np.nan
    return spark.createDataFrame(pdf).persist(), pdf


def test_empty_table(spark):
    df = frame(spark, "a double, b string", [])
    row = describe.describe(df).first()
    assert row["count"] == 0 and row["mean"] is None and row["q50"] is None
    assert describe.missing_total(df).first()["total_missing"] == 0
    assert frequencies.value_counts(df).count() == 0
    assert histogram.histogram(df).count() == 0


def test_single_row(spark):
    row = describe.describe(frame(spark, "a double", [(4.0,)])).first()
    assert (row["count"], row["std"], row["min"], row["q25"], row["max"]) == (1, None, 4.0, 4.0, 4.0)
    assert describe.skewness(frame(spark, "a double", [(4.0,)])).first()["skewness"] is None


def test_all_null(spark):
    df = frame(spark, "a double, b string", [(None, None)] * 5)
    assert describe.describe(df).first()["count"] == 0
    assert {(r["mode"], r["count"]) for r in frequencies.modes(df).collect()} == {(None, 0)}
    assert {r["distinct_count"] for r in frequencies.distinct_counts(df).collect()} == {0}


def test_nan_counts_as_missing(spark):
    df = frame(spark, "a double", [(1.0,), (float("nan"),), (3.0,)])
    row = describe.describe(df).first()
    assert (row["count"], row["mean"], row["max"]) == (2, 2.0, 3.0)
    assert describe.missing_by_column(df).first()["missing"] == 1


def test_ties_take_the_smaller_value(spark):
    df = frame(spark, "v string", [("b",), ("a",), ("b",), ("a",)])
    assert frequencies.modes(df).first()["mode"] == "a"
    assert [r["value"] for r in frequencies.top_values(df).orderBy("rank").collect()] == ["a", "b"]


def test_numeric_ties_are_numeric(spark):
    df = frame(spark, "v int", [(10,), (9,), (10,), (9,)])
    assert frequencies.modes(df).first()["mode"] == "9"


def test_variation_of_zero_mean(spark):
    df = frame(spark, "a double", [(-1.0,), (0.0,), (1.0,)])
    assert describe.variation(df).first()["coefficient_variation"] is None


def test_constant_column(spark):
    df = frame(spark, "a double", [(2.0,)] * 6)
    assert describe.skewness(df).first()["skewness"] == 0
    assert describe.kurtosis(df).first()["kurtosis"] == 0
    bins = histogram.histogram(df).collect()
    assert [(r["left"], r["right"], r["count"]) for r in bins] == [(1.5, 2.5, 6)]
    both = df.withColumn("b", F.monotonically_increasing_id().cast("double"))
    values = {(r["column_a"], r["column_b"]): r["correlation"] for r in correlate.pearson(both).collect()}
    assert values["a", "b"] is None and values["a", "a"] is None and values["b", "b"] == pytest.approx(1)


def _score(spark, values, fn, aggregate):
    df = frame(spark, "a double", [(float(v),) for v in values])
    part = df.agg(F.count("a").cast("double").alias("n"), aggregate("a").alias("g"))
    return part.select(fn(F.col("n"), F.col("g")).alias("z")).first()["z"]


def test_normality_scores(spark):
    skew = lambda v: _score(spark, v, moments.skew_score, F.skewness)
    assert skew(range(1, 9)) == pytest.approx(1.0108048609, abs=1e-9)
    assert skew([2, 8, 0, 4, 1, 9, 9, 0]) == pytest.approx(0.4462638537, abs=1e-9)
    tail = _score(spark, range(20), moments.kurtosis_score, F.kurtosis)
    assert tail == pytest.approx(-1.7058104152, abs=1e-9)


def test_normality_needs_eight_values(spark):
    df = frame(spark, "a double", [(float(i),) for i in range(7)])
    assert describe.normality_test(df).first()["statistic"] is None


def test_describe_matches_pandas(numbers):
    df, pdf = numbers
    ours = describe.describe(df).toPandas().set_index("column")
    theirs = pdf.describe().T.rename(columns={"25%": "q25", "50%": "q50", "75%": "q75"})
    for metric in ("count", "mean", "std", "min", "q25", "q50", "q75", "max"):
        assert np.allclose(ours.loc[theirs.index, metric].astype(float), theirs[metric])
    skew = describe.skewness(df).toPandas().set_index("column")["skewness"]
    kurt = describe.kurtosis(df).toPandas().set_index("column")["kurtosis"]
    assert np.allclose(skew[pdf.columns], pdf.skew()) and np.allclose(kurt[pdf.columns], pdf.kurt())


@pytest.mark.parametrize("fetch", [40, 200_000])
def test_quantiles_whatever_fits_the_driver(numbers, fetch):
    df, pdf = numbers
    levels = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    found = exact_quantiles(df, {c: levels for c in "abc"}, fetch_rows=fetch)
    for c in "abc":
        assert [found[c][p] for p in levels] == pytest.approx(list(pdf[c].quantile(levels)))


def test_ranks_over_many_buckets(numbers, monkeypatch):
    df, pdf = numbers
    monkeypatch.setattr(ranking, "BUCKET_VALUES", 100)
    ranks = ranking.column_ranks(df, ["a", "b", "c"]).toPandas()
    for c in "abc":
        mine = ranks[ranks["column"] == c].set_index("value")["avg_rank"]
        theirs = pd.Series(pdf[c].rank().values, index=pdf[c].values).dropna()
        assert np.allclose(mine[theirs.index.unique()], theirs.groupby(level=0).first()[theirs.index.unique()])
        dense = ranks[ranks["column"] == c].sort_values("value")["dense"].tolist()
        assert dense == list(range(len(dense)))


def test_quantiles_by_group_over_many_buckets(numbers, monkeypatch):
    df, pdf = numbers
    monkeypatch.setattr(ranking, "BUCKET_VALUES", 100)
    got = ranking.grouped_quantiles(df, "c", [0.25, 0.5], ["b"]).toPandas().set_index("b")
    want = pdf.groupby("b", dropna=False)["c"].quantile([0.25, 0.5]).unstack()
    assert np.allclose(got.sort_index()["q0.25"], want.sort_index()[0.25])
    assert np.allclose(got.sort_index()["q0.5"], want.sort_index()[0.5])


def _square(table, names):
    return table.toPandas().pivot(index="column_a", columns="column_b", values="correlation").loc[names, names]


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize("native", [0, 100])
def test_correlations_match_pandas(numbers, monkeypatch, method, native):
    df, pdf = numbers
    monkeypatch.setattr(correlate, "NATIVE_PAIRS", native)
    names = ["a", "b", "c"]
    got = _square(correlate.correlations(df, names, [method]), names)
    assert np.allclose(got, pdf[names].corr(method=method))


def test_spearman_by_shuffle(numbers, monkeypatch):
    df, pdf = numbers
    monkeypatch.setattr(ranking, "is_small", lambda df: False)
    monkeypatch.setattr(ranking, "BUCKET_VALUES", 200)
    got = _square(correlate.spearman(df, ["a", "c"]), ["a", "c"])
    assert np.allclose(got, pdf[["a", "c"]].corr(method="spearman"))


def test_pearson_blocks(numbers):
    df, pdf = numbers
    names = ["a", "b", "c"]
    assert np.allclose(_square(correlate._pearson_blocks(df, names), names), pdf[names].corr())


@pytest.mark.parametrize("bucket", [50, 250_000])
def test_kendall_against_all_pairs(numbers, monkeypatch, bucket):
    df, pdf = numbers
    monkeypatch.setattr(ranking, "BUCKET_VALUES", bucket)
    part = pdf[pdf["id"] < 700].dropna()
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        dx = np.sign(part[x].values[:, None] - part[x].values[None, :])
        dy = np.sign(part[y].values[:, None] - part[y].values[None, :])
        want = (dx * dy).sum() / np.sqrt((dx != 0).sum() * float((dy != 0).sum()))
        got = correlate.kendall_tau(df.filter("id < 700").na.drop(), x, y)
        assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("rows", [60])
def test_kendall_in_blocks_of_values(spark, monkeypatch, rows):
    monkeypatch.setattr(correlate, "BLOCK_ROWS", rows)
    draw = np.random.default_rng(rows)
    heavy = np.where(draw.random(600) < 0.4, 7, draw.integers(0, 90, 600))
    columns = {"x": heavy, "y": draw.integers(0, 400, 600) + heavy, "z": draw.integers(0, 3, 600)}
    df = spark.createDataFrame(pd.DataFrame(columns))
    for x, y in (("x", "y"), ("y", "z")):
        dx, dy = (np.sign(columns[c][:, None] - columns[c][None, :]) for c in (x, y))
        want = (dx * dy).sum() / np.sqrt((dx != 0).sum() * float((dy != 0).sum()))
        assert correlate.kendall_tau(df, x, y) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("column", ["a", "c"])
def test_histogram_matches_numpy(numbers, column):
    df, pdf = numbers
    counts, edges = np.histogram(pdf[column].dropna(), bins="auto")
    got = histogram.histogram(df, [column]).orderBy("bin").toPandas()
    assert got["count"].tolist() == counts.tolist()
    assert np.allclose(got["left"], edges[:-1])


def test_outliers(numbers):
    df, pdf = numbers
    z = (pdf["a"] - pdf["a"].mean()).abs() / pdf["a"].std(ddof=0)
    got = detect_outliers(df, "id", ["a"], ["zscore"]).toPandas()
    assert set(got["id"]) == set(pdf.loc[z > 3, "id"])


def test_profile_honours_its_switches(numbers):
    df, _ = numbers
    off = {p: False for p in ("basic_stats", "distributions", "correlations", "outliers", "unique_values")}
    parts = profile(df, "id", off)
    assert set(parts) == {"missing", "missing_total", "types", "type_counts", "size"}
    parts = profile(df, "id", {"correlations": {"enabled": True, "methods": ["pearson"]}})
    assert {r["method"] for r in parts["correlations"].select("method").distinct().collect()} == {"pearson"}


def test_columns_with_awkward_names(spark):
    df = frame(spark, "`a.b` double, `c d` string, summary double", [(1.0, "x", 2.0), (2.0, "y", 4.0)])
    assert {r["column"] for r in describe.describe(df).collect()} == {"a.b", "summary"}
    assert frequencies.value_counts(df).count() == 6
    assert correlate.pearson(df).count() == 4
