"""Inputs at the edges of every path: both sides of each limit, gaps, ties and odd files."""

import gzip
import math
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.errors import PrepareError, ReadError, TablewrightError
from tablewright.functions import scalars
from tablewright.functions.scalars import parse_datetime
from tablewright.operators import casting, charts, checks, correlate, describe, features, frequencies, quantiles, scaling, values
from tablewright.plans.validation import latest
from tablewright.session import broadcast_if_small, is_small, shared_folder
from tablewright.sources import readers
from tablewright.streaming import monitor


# --- value lists ----------------------------------------------------------------


@pytest.mark.parametrize("n", [1_000, 1_001])
def test_value_lists_on_both_sides_of_the_limit(spark, n):
    df = spark.createDataFrame([(1.0, "1"), (2.5, "x"), (float(n - 1), "5"), (None, None)], "d double, t string")
    whole = list(range(n))
    assert {r["d"] for r in values.keep_allowed(df, "d", whole).collect()} == {1.0, float(n - 1)}
    assert {r["t"] for r in values.keep_allowed(df, "t", whole).collect()} == {"1", "5"}
    mixed = [*range(n - 3), "x", 2.5, None]
    assert {r["d"] for r in values.keep_allowed(df, "d", mixed).collect()} == {1.0, 2.5}
    swapped = values.replace_values(df, "d", {v: v + 0.5 for v in whole} | {None: -1})
    assert sorted(r["d"] for r in swapped.collect()) == [-1.0, 1.5, 2.5, n - 0.5]
    swapped = values.replace_values(df, "t", {v: "hit" for v in whole} | {"x": None})
    assert [r["t"] for r in swapped.collect()] == ["hit", None, "hit", None]


def test_unexpected_values_of_another_type(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "d double")
    assert [tuple(r) for r in checks.unexpected_values(df, "d", [1, "a", None]).collect()] == [(2.0, 2)]


# --- broadcasts and scratch folders ---------------------------------------------------


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(200).select("id", F.repeat(F.lit("x"), 10_000).alias("t"), F.array("id").alias("a"))
    assert is_small(wide) and not is_small(wide, size=1_000_000) and not is_small(wide, rows=100)
    assert "broadcast" not in broadcast_if_small(wide, size=1_000)._jdf.queryExecution().toString().lower()


def test_no_own_folder_where_others_cannot_see_it():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(TablewrightError):
        shared_folder(Session())


# --- correlations ------------------------------------------------------------------


def _numbers(spark, extra):
    draw = np.random.default_rng(1)
    rows = []
    for k in range(400):
        a = float(draw.normal())
        rows.append(
            (
                None if k % 11 == 0 else 1e9 + a,
                None if k % 7 == 0 else a + float(draw.normal()),
                math.inf if k == 5 else a,
                0.1,
                None if k % 2 else 3.0 + (k == 1),
            )
        )
    df = spark.createDataFrame(rows, "big double, near double, odd double, same double, gappy double").repartition(5)
    return df.select("*", *[(F.col("near") * i).alias(f"x{i}") for i in range(extra)])


def test_pearson_paths_agree(spark):
    some = ["big", "near", "odd", "same", "gappy"]
    found = []
    for extra in (0, 1, 196):
        df = _numbers(spark, extra)
        columns = some[:3] if not extra else df.columns
        cells = correlate.pearson(df, columns).filter(F.col("column_a").isin(some) & F.col("column_b").isin(some))
        found.append({(r["column_a"], r["column_b"]): r["correlation"] for r in cells.collect()})
    few, more, many = found
    assert more.keys() == many.keys() and len(more) == 25
    for pair, r in more.items():
        for other in (few.get(pair, r), many[pair]):
            assert (r is None) == (other is None), pair
            assert r is None or math.isclose(r, other, abs_tol=1e-7), pair
    assert more["odd", "near"] is None and more["odd", "odd"] is None and more["same", "big"] is None
    assert more["gappy", "gappy"] is None  # constant where it is present
    assert math.isclose(more["big", "big"], 1.0) and more["big", "near"] > 0.5


def test_perfect_feature_comes_first(spark):
    df = spark.range(200).select(
        (F.col("id") * 2.0).alias("perfect"), (F.sin("id") * 5).alias("noise"), F.lit(1.0).alias("flat"), F.col("id").cast("double").alias("y")
    )
    assert [r["feature"] for r in features.top_features(df, ["noise", "flat", "perfect"], "y", 3).collect()] == ["perfect", "noise", "flat"]
    assert features.regression_scores(df, ["perfect"], "y").first()["f_score"] == math.inf


# --- gaps, ties and empty tables ---------------------------------------------------------


def test_columns_without_values_have_a_row(spark):
    df = spark.createDataFrame([(None, None, 1)] * 3, "a double, b string, c int")
    found = {r["column"]: (r["mode"], r["count"]) for r in frequencies.modes(df).collect()}
    assert found == {"a": (None, 0), "b": (None, 0), "c": ("1", 3)}
    assert {r["column"]: r["mode"] for r in describe.numeric_modes(df).collect()} == {"a": None, "c": 1.0}


@pytest.mark.parametrize("n", [2, 13])
def test_normality_of_nothing(spark, n):
    df = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(n)))
    rows = describe.normality_test(df).collect()
    assert len(rows) == n and {r["n"] for r in rows} == {0}


def test_latest_records_of_one_time(spark):
    rows = [(1, "b", [2]), (1, "a", [1]), (1, "a", [0]), (0, "z", None)]
    df = spark.createDataFrame(rows, "t int, s string, a array<int>").repartition(4)
    assert [tuple(r) for r in latest(df, "t", 2).collect()] == [(1, "a", [0]), (1, "a", [1])]


def test_groups_without_spread_stay(spark):
    rows = [("one", 5.0), ("same", 2.0), ("same", 2.0), (None, 1.0), ("wide", 0.0), ("wide", 1.0), ("wide", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = charts.violin(df, "v", "g", 10).collect()
    single = {r["group"]: (r["x"], r["density"]) for r in found if r["group"] != "wide"}
    assert single == {"one": (5.0, None), "same": (2.0, None), None: (1.0, None)}
    curve = sorted((r["point"], r["x"], r["density"]) for r in found if r["group"] == "wide")
    h = statistics.stdev([0, 1, 4]) * 3 ** -0.2
    for point, x, height in curve:
        assert math.isclose(x, 4 * point / 9)
        expected = sum(math.exp(-((x - v) ** 2) / (2 * h * h)) for v in (0, 1, 4)) / (3 * h * math.sqrt(2 * math.pi))
        assert math.isclose(height, expected)
    assert len(curve) == 10


def test_charts_show_all_rows(spark):
    df = spark.range(3_000).select("id", F.col("id").alias("x"), F.col("id").alias("y"))
    assert charts.scatter(df, "id", "x", "y").count() == 3_000
    assert charts.scatter(df, "id", "x", "y", limit=10).count() == 10
    assert charts.scatter_matrix(df, "id", ["x", "y"]).count() == 3_000
    assert charts.parallel_coordinates(df, "id", ["x", "y"]).count() == 3_000


# --- quantiles and scalers ------------------------------------------------------------


def test_quantiles_of_brackets_too_full_to_fetch(spark):
    values = np.random.default_rng(3).permutation(60_000).astype(float)
    df = spark.createDataFrame([(float(v), float(v % 7)) for v in values], "a double, b double")
    found, _, _ = quantiles.quantiles_and_powers(df, {"a": (0.25, 0.5), "b": (0.5,)}, fetch_rows=100, powers=True)
    assert found == {"a": {0.25: 14999.75, 0.5: 29999.5}, "b": {0.5: 3.0}}


def test_quantiles_read_the_table_three_times_at_most(spark):
    n, seen = 20_000, spark.sparkContext.accumulator(0)
    draw = np.random.default_rng(2)
    data = {f"c{i}": draw.normal(size=n) * 10**i for i in range(6)} | {"c6": np.floor(draw.normal(size=n) * 3)}

    def tell(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame(data)).repartition(3)
    df = table.mapInPandas(tell, table.schema)
    levels = {c: (0.25, 0.5, 0.75) for c in df.columns}
    found, _, powers = quantiles.quantiles_and_powers(df, levels, fetch_rows=200, powers=True)
    assert seen.value <= 3 * n
    for c, v in data.items():
        for p in levels[c]:
            assert math.isclose(found[c][p], np.quantile(v, p), rel_tol=1e-12, abs_tol=1e-12)
        m2, m3, _ = powers[c].central()
        assert math.isclose(m2, ((v - v.mean()) ** 2).sum(), rel_tol=1e-9)
        assert math.isclose(m3, ((v - v.mean()) ** 3).sum(), rel_tol=1e-6, abs_tol=1e-6 * n * v.std() ** 3)


def test_power_of_values_far_from_zero(spark):
    """A spread of a thousandth around 1000, where plain powers cancel."""
    df = spark.range(500).select((1000 + 1 / (1 + F.col("id"))).alias("x"))
    params = scaling.fit_scaler(df, ["x"], "power")["x"]
    out = df.select(scaling.scaled(F.col("x"), params).alias("z")).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(out[0]) < 1e-6 and abs(out[1] - 1) < 1e-6


def test_power_gap_is_the_scaled_difference(spark):
    rows = [(c, m, lam) for c in (-3.0, -0.5, 0.0, 0.7, 40.0) for m in (-2.0, 0.0, 3.0) for lam in (-1.5, 0.0, 1.0, 2.0, 2.5)]
    df = spark.createDataFrame(rows, "c double, m double, lam double")
    gap = scaling.yeo_johnson_gap(F.col("c"), F.col("m"), F.col("lam"))
    plain = scaling.yeo_johnson(F.col("c"), F.col("lam")) - scaling.yeo_johnson(F.col("m"), F.col("lam"))
    plain = plain / F.exp(scaling._log_scale(F.col("m"), F.col("lam")))
    for r in df.select(gap.alias("gap"), plain.alias("plain")).collect():
        assert math.isclose(r["gap"], r["plain"], rel_tol=1e-9, abs_tol=1e-12)


def test_power_without_a_peak_is_told(spark, monkeypatch):
    monkeypatch.setattr(scaling, "POWER_REACH", 1.0)
    df = spark.range(500).select((1000 + 1 / (1 + F.col("id"))).alias("x"))
    with pytest.raises(PrepareError):
        scaling.fit_scaler(df, ["x"], "power")


def test_inverse_normal():
    p = np.r_[1e-7, 1e-4, np.linspace(0.001, 0.999, 999), 1 - 1e-4, 1 - 1e-7]
    exact = [statistics.NormalDist().inv_cdf(x) for x in p]
    assert np.allclose(scaling.inverse_normal(p), exact, rtol=1e-9, atol=1e-9)


# --- dates --------------------------------------------------------------------------


def test_date_layouts(spark):
    rows = [("01/31/2024", "Jan 5, 2024", "31/01/2024", "5.1.2024 10:30", "2024-01-05", "1/1/2024"), ("12/01/2023", "Dec 31, 2023", "01/12/2023", "31.12.2023 00:00:05", None, "x")]
    df = spark.createDataFrame(rows, "us string, words string, eu string, dots string, iso string, bad string")
    kinds = casting.inferred_types(df)
    assert kinds["us"] == "timestamp_ntz M/d/yyyy" and kinds["eu"] == "timestamp_ntz d/M/yyyy"
    assert kinds["iso"] == "timestamp_ntz" and kinds["bad"] == "string"
    first = casting.infer_and_convert(df).collect()[0]
    assert [str(first[c]) for c in ("us", "words", "eu", "dots", "iso")] == [
        "2024-01-31 00:00:00", "2024-01-05 00:00:00", "2024-01-31 00:00:00", "2024-01-05 10:30:00", "2024-01-05 00:00:00"
    ]
    assert df.select(parse_datetime(F.col("bad"), "M/d/yyyy")).collect()[1][0] is None


# --- files --------------------------------------------------------------------------


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,text\n1,"two\nlines, and ""quotes"""\n2,plain\n'.encode())
    (tmp_path / "b.csv").write_bytes('id,text\n3,caf\xe9\n4,"x\ny"\n'.encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("id,text\n5,né\n".encode())
    df = readers.read_csv(spark, str(tmp_path), escape='"')
    assert {r["id"]: r["text"] for r in df.collect()} == {1: 'two\nlines, and "quotes"', 2: "plain", 3: "café", 4: "x\ny", 5: "né"}
    forms = readers.files_by_form(spark, str(tmp_path))
    assert {k: len(v) for k, v in forms.items()} == {(True, True): 1, (False, True): 1, (True, False): 1}


def test_missing_texts_with_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\nNA,1\nx,NA\n")
    df = readers.read_csv(spark, str(tmp_path), schema="a string, b bigint")
    assert {tuple(r) for r in df.collect()} == {(None, 1), ("x", None)}


def test_broken_files_are_left_out_whole(spark, tmp_path):
    lines = "id\n" + "".join(f"{k}\n" for k in range(20_000))
    for k in range(5):
        (tmp_path / f"{k}.csv.gz").write_bytes(gzip.compress(lines.encode()))
    cut = tmp_path / "2.csv.gz"
    cut.write_bytes(cut.read_bytes()[:-2_000])
    df, failed = readers.read_many(spark, f"{tmp_path}/*.gz", "csv")
    assert df.groupBy("source").count().count() == 4 and df.count() == 80_000
    assert [p.rsplit("/", 1)[1] for p in failed] == ["2.csv.gz"] and all(failed.values())
    with pytest.raises(ReadError):
        readers.read_many(spark, str(cut), "csv")


# --- events -------------------------------------------------------------------------


@pytest.mark.parametrize("n", [5, 1_000, 1_500])
def test_latest_samples_of_a_hot_metric(spark, n):
    df = spark.range(20_000).select(
        "id",
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("m"), (F.col("id") % 70).cast("string"))).otherwise("hot").alias("metric"),
        (F.timestamp_seconds(F.col("id") * F.col("id") % 7919)).cast("timestamp_ntz").alias("ts"),
    )
    df = df.withColumn("ts", F.when(F.col("id") % 500 != 0, F.col("ts")))
    rows = [tuple(r) for r in df.select("metric", "ts", "id").collect()]
    wanted = set()
    for m in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == m), key=lambda r: (r[1] is not None, r[1], r[2]) if r[1] else (False, r[2], 0), reverse=True)
        wanted |= {r[2] for r in own[:n]}
    assert {r["id"] for r in monitor.last_samples(df, "metric", "ts", "id", n).collect()} == wanted


def test_operations_with_text_names_in_a_stream(spark, tmp_path):
    schema = "op string, kind string, ts timestamp_ntz, id long"
    batches = [
        [("load", "s", "2024-01-01 00:00:00", 1), ("save", "s", "2024-01-01 00:00:01", 2), ("load", "s", "2024-01-01 00:00:02", 3)],
        [("load", "e", "2024-01-01 00:00:05", 4), ("load", "e", "2024-01-01 00:00:06", 5), ("idle", "e", "2024-01-01 00:00:06", 6)],
        [("save", "e", "2024-01-01 00:01:01", 7), ("load", "s", "2024-01-01 00:02:00", 8), ("load", "e", "2024-01-01 00:02:30", 9)],
        [("other", "s", "2024-01-01 00:30:00", 10)],  # the watermark passes all marks before
    ]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "op string, kind string, ts string, id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tracked = monitor.track_operations(stream, "op", "kind", "s", "e", "ts", "id")
    monitor.append_to(tracked, str(tmp_path / "out"), str(tmp_path / "ck"))
    found = spark.read.parquet(str(tmp_path / "out")).filter("outcome = 'completed'")
    assert sorted((r["operation"], r["seconds"]) for r in found.collect()) == [("load", 3.0), ("load", 30.0), ("save", 60.0)]


def test_shapes_leave_the_right_layouts_open(spark):
    """Every layout finds its own dates, and words are never tried as dates."""
    days = ["2024-01-05", "2023-12-25", "2024-11-30"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("d"))
    made = df.select(*[F.date_format("d", x).alias(str(i)) for i, x in enumerate(scalars.DATE_LAYOUTS)])
    timed = df.select(*[F.date_format("d", x + " HH:mm").alias(str(i)) for i, x in enumerate(scalars.DATE_LAYOUTS)])
    first = "bigint"  # yyyyMMdd is a number first
    for table in (made, timed):
        kinds = casting.inferred_types(table)
        for i, layout in enumerate(scalars.DATE_LAYOUTS):
            last = layout == "yyyyMMdd" and table is made
            assert kinds[str(i)] == (first if last else f"timestamp_ntz {layout}")
    words = spark.createDataFrame([("hello world",), ("MACHINERY",), (None,)], "w string")
    assert casting.inferred_types(words) == {"w": "string"}
    assert [r[0] for r in words.select(casting.possible_layouts(F.col("w"))).collect()] == [0, 0, None]


def test_density_against_all_kernels(spark):
    """Far outliers, heavy repeats and a null group, to nearly all digits."""
    draw = np.random.default_rng(4)
    rows = [("a", float(v)) for v in draw.normal(0, 1, 500)] + [("a", 400.0)] + [("a", 0.5)] * 300
    rows += [(None, float(v)) for v in draw.integers(0, 5, 200)] + [("b", 1.0), ("b", 2.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {}
    for r in charts.density(df, "v", "g", 200).collect():
        got.setdefault(r["group"], []).append((r["point"], r["x"], r["density"]))
    for group, curve in got.items():
        v = np.array([x for g, x in rows if g == group and x is not None])
        h = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min(), v.max(), 200)
        wanted = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        points, x, y = (np.array(c) for c in zip(*sorted(curve)))
        assert points.tolist() == list(range(200)) and np.allclose(x, grid)
        assert np.allclose(y, wanted, rtol=1e-9, atol=1e-300)
    assert set(got) == {"a", "b", None}
