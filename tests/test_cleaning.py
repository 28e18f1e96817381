"""Cleaning, checks and preparation on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.errors import CheckError, PrepareError
from tablewright.functions import scalars
from tablewright.operators import casting, checks, duplicates, encoding, missing, neighbours, outliers, scaling, values
from tablewright.operators.nested import flatten
from tablewright.plans import cleaning, preparing, validation
from tablewright.plans.preparing import PrepBook, PrepSpec


def test_keep_options(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 3), (None, "c", 4), (None, "d", 5)], "k int, v string, t int")
    keep = lambda how: {r["t"] for r in duplicates.drop_duplicates(df, ["k"], how, ["t"]).collect()}
    assert keep("first") == {1, 3, 4}
    assert keep("last") == {2, 3, 5}
    assert keep("none") == keep(False) == {3}
    assert duplicates.repeated_rows(df, ["k"]).first()["duplicates"] == 2


def test_missing_values(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, None, "x"), (4, 2.0, None)], "a int, b double, c string")
    assert missing.drop_sparse_columns(df).columns == ["a", "c"]
    filled = missing.fill_missing(df).collect()
    assert [r["a"] for r in filled] == [1.0, 2.5, 4.0]
    assert [r["c"] for r in filled] == ["x", "x", "x"]
    kept = missing.fill_missing(df.withColumn("d", F.lit(None).cast("string")), {"c": "y"})
    assert kept.filter("d IS NULL").count() == 3
    assert kept.filter("c = 'y'").count() == 1


def test_whole_numbers_without_gaps_keep_their_type(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "a int, b double")
    assert dict(missing.fill_missing(df).dtypes) == {"a": "int", "b": "double"}


def test_casts_are_whole_or_not_at_all(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "3"), (None, None)], "a string, b string")
    out, kept = casting.cast_columns(df, {"a": "int64", "b": "int64", "z": "int64"})
    assert dict(out.dtypes) == {"a": "bigint", "b": "string"} and set(kept) == {"b"}


def test_inference(spark):
    rows = [("1", "1.5", "2024-01-02", "yes", "1d", "0x1p3", "x"), ("-20", "2e3", "2024-02-03", "N", "2", "1", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    assert casting.inferred_types(df) == {
        "a": "bigint", "b": "double", "c": "timestamp_ntz", "d": "boolean", "e": "string", "f": "string", "g": "string",
    }


def test_two_valued_text_is_no_boolean(spark):
    df = spark.createDataFrame([("red",), ("blue",)], "a string")
    assert casting.inferred_types(df) == {"a": "string"}


def test_outliers_one_column_after_another(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=500) ** 3, "b": rng.normal(size=500) ** 3})
    pdf.loc[::50, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    want = pdf
    for c in ("a", "b"):
        z = ((want[c] - want[c].mean()) / want[c].std()).abs()
        want = want[z <= 3]
    got = outliers.remove_outliers(df.withColumns({c: F.nanvl(c, F.lit(None)) for c in "ab"}))
    assert got.count() == len(want)
    want = pdf
    for c in ("a", "b"):
        q1, q3 = want[c].quantile(0.25), want[c].quantile(0.75)
        want = want[(want[c] >= q1 - 3 * (q3 - q1)) & (want[c] <= q3 + 3 * (q3 - q1))]
    assert outliers.remove_outliers(df, "iqr").count() == len(want)
    assert outliers.remove_outliers(df, columns=[]).count() == 500


def test_column_without_spread_only_loses_nulls(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "a double")
    assert outliers.remove_outliers(df).count() == 2


def test_text_clean_up(spark):
    df = spark.createDataFrame([("\t Big   RED\n",)], "a string")
    assert values.standardise_text(df).first()["a"] == "big red"


def test_value_rules_and_long_lists(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)] + [(None, None)], "a int, b string")
    assert values.keep_range(df, "a", 3, 5).count() == 3
    assert values.keep_pattern(df, "b", "1|2").count() == 22
    assert values.keep_allowed(df, "a", range(10, 5000)).count() == 40
    swapped = values.replace_values(df, "a", {i: i + 100 for i in range(0, 3000, 2)})
    assert swapped.filter("a >= 100").count() == 25 and swapped.filter("a IS NULL").count() == 1


def test_default_clean_does_not_touch_numbers_or_text(spark):
    df = spark.createDataFrame([(1.0, " A "), (1.0, " A "), (900.0, "b"), (None, "c")], "a double, b string")
    result = cleaning.clean(df)
    assert sorted(r["b"] for r in result.table.collect()) == [" A ", "b"]
    ledger = {r["step"]: r["step_removed"] for r in result.ledger().collect()}
    assert ledger["remove_duplicates"] == 1 and ledger["handle_missing_values"] == 1
    assert result.summary().first()["null_values_removed"] == 1


def test_disabled_steps_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "a double")
    config = {name: {"enabled": False} for name in cleaning.STEPS}
    assert cleaning.clean(df, config).table.count() == 2


def test_report(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    rules = {
        "value_ranges": {"a": {"min": 2, "max": 1}},
        "missing_values": {"max_percent": 50},
        "duplicates": {"unique_columns": ["a"]},
        "custom_rules": [{"name": "ok", "condition": "a > 0"}, {"name": "bad", "condition": "a >"}],
    }
    report = validation.validate(df, rules)
    found = {(r["check"], r["column"]): (r["passed"], r["count"]) for r in report.checks.collect()}
    assert not report.passed and report.skipped_rules == ["bad"]
    assert found["min_value", "a"] == (False, 1) and found["max_value", "a"] == (False, 2)
    assert found["missing_percent", "b"] == (False, 2)
    assert found["duplicate_rows", None] == (False, 1) and found["duplicate_values", "a"] == (False, 1)
    assert found["custom_rule", "ok"] == (True, 0)


def test_empty_table_fails(spark):
    assert not validation.validate(spark.createDataFrame([], "a int")).passed


def test_assertions(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "y")], "a double, b string")
    with pytest.raises(CheckError, match="null"):
        checks.assert_table(df)
    with pytest.raises(CheckError, match="NaN"):
        checks.assert_numeric_range(df, "a")
    with pytest.raises(CheckError, match="below"):
        checks.assert_numeric_range(df, "a", min_value=2, allow_nan=True)
    with pytest.raises(CheckError, match="outside"):
        checks.assert_categories(df, "b", ["x"])
    with pytest.raises(CheckError, match="more than"):
        checks.assert_categories(df, "b", max_categories=1)
    assert checks.assert_table(df, allow_nulls=True, numeric_columns=["a"]) is df
    with pytest.raises(CheckError, match="missing settings"):
        checks.assert_training_input(df.filter("b = 'x'"), ["a"], "b", {"model_type": "rf"})
    names = {r[0]: r[2] for r in checks.column_names(["a_x", "b_x"], suffix="_x", allowed_characters="ab_x")}
    assert all(names.values())


def test_human_sizes(spark):
    sizes = [0, 1023, 1536, 1024**2, 5 * 1024**3, 1024**5, 1024**6]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    got = [r[0] for r in df.select(scalars.human_size(F.col("s"))).collect()]
    assert got == ["0.00 B", "1023.00 B", "1.50 KB", "1.00 MB", "5.00 GB", "1.00 PB", "1024.00 PB"]


def test_flatten(spark):
    df = spark.createDataFrame([(((1, "x"), 2),)], "a struct<b: struct<c: int, d: string>, e: int>")
    assert flatten(df).columns == ["a.b.c", "a.b.d", "a.e"]
    assert flatten(df, "_").first().asDict() == {"a_b_c": 1, "a_b_d": "x", "a_e": 2}


# --- preparation ---------------------------------------------------------------


def _nearest(pdf, columns, k=5):
    x = pdf[columns].to_numpy(float)
    out, d = x.copy(), x.shape[1]
    for r in range(len(x)):
        for c in np.flatnonzero(np.isnan(x[r])):
            near = []
            for j in range(len(x)):
                shared = ~np.isnan(x[j]) & ~np.isnan(x[r])
                if not np.isnan(x[j, c]) and shared.any():
                    near.append((((x[j, shared] - x[r, shared]) ** 2).sum() * d / shared.sum(), x[j, c]))
            out[r, c] = np.mean([v for _, v in sorted(near)[:k]]) if near else np.nanmean(x[:, c])
    return out


@pytest.mark.parametrize("box, queries", [(20_000, 50_000), (20, 7)])
def test_nearest_rows_against_all_pairs(spark, monkeypatch, box, queries):
    monkeypatch.setattr(neighbours, "BOX_ROWS", box)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", queries)
    rng = np.random.default_rng(5)
    n = 250
    pdf = pd.DataFrame({"id": range(n), "a": rng.integers(0, 20, n) * 1.0, "b": rng.normal(size=n) * 9, "c": rng.integers(0, 3, n) * 5.0})
    # a third of the rows are copies of one
    pdf.loc[pdf["id"] % 3 == 0, ["a", "b", "c"]] = [4.0, np.nan, 5.0]
    for c, share in (("a", 0.1), ("b", 0.2), ("c", 0.15)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    got = neighbours.nearest_fill(spark.createDataFrame(pdf), ["a", "b", "c"]).orderBy("id").toPandas()
    assert np.allclose(got[["a", "b", "c"]], _nearest(pdf, ["a", "b", "c"]))


def test_power_lambda(spark):
    x = np.random.default_rng(2).exponential(size=3000) - 0.3
    fitted = scaling.fit_scaler(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"], "power")["x"]

    def likelihood(lam):
        up = ((np.maximum(x, 0) + 1) ** lam - 1) / lam
        down = -((1 - np.minimum(x, 0)) ** (2 - lam) - 1) / (2 - lam)
        t = np.where(x >= 0, up, down)
        return -len(x) / 2 * np.log(t.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    grid = np.linspace(-2.001, 1.999, 40001)
    assert fitted["lambda"] == pytest.approx(max(grid, key=likelihood), abs=2e-4)


def test_power_lambda_beyond_the_first_window(spark):
    x = np.log1p(np.random.default_rng(2).random(2000) * 0.01) + 1
    fitted = scaling.fit_scaler(spark.createDataFrame(pd.DataFrame({"x": x, "one": 1.0})), ["x", "one"], "power")
    assert np.isfinite(fitted["x"]["lambda"]) and fitted["one"]["lambda"] == 1.0


def test_quantile_landmarks_and_tails(spark):
    x = np.round(np.random.default_rng(2).normal(size=3000), 2)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    fitted = scaling.fit_scaler(df, ["x"], "quantile")["x"]
    assert np.allclose(fitted["landmarks"], np.quantile(x, np.linspace(0, 1, 1000)))
    z = df.select("x", scaling.scaled(F.col("x"), fitted).alias("z")).toPandas()
    assert z["z"].max() == pytest.approx(5.199337582, abs=1e-6)
    assert z.sort_values("x")["z"].is_monotonic_increasing
    assert abs(z["z"].median()) < 0.05


def test_few_rows_quantile(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,)], "x double")
    assert scaling.fit_scaler(df, ["x"], "quantile")["x"]["landmarks"] == [1.0, 2.0, 3.0]


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    for method in ("standard", "minmax", "robust", "power"):
        out = preparing.fit(df, PrepSpec(["x"], scaling=method)).transform(df).collect()
        assert [r["x"] for r in out] == [0.0, 0.0]


def test_unknown_categories(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    other = spark.createDataFrame([("z",)], "c string")
    hot = preparing.fit(df, PrepSpec([], ["c"])).transform(other).first().asDict()
    assert hot == {"c_a": 0.0, "c_b": 0.0, "c_missing": 0.0}
    with pytest.raises(Exception, match="unknown category"):
        preparing.fit(df, PrepSpec([], ["c"], encoding="ordinal")).transform(other).collect()
    with pytest.raises(Exception, match="unknown category"):
        preparing.fit(df, PrepSpec([], ["c"], encoding="ordinal"), inline_categories=1).transform(other).collect()


@pytest.mark.parametrize("n", [2, 998, 1_000, 1_500])
def test_one_hot_has_one_form(spark, n):
    df = spark.range(n).selectExpr("concat('v', format_string('%05d', id)) AS c")
    out = preparing.fit(df, PrepSpec([], ["c"]), inline_categories=2).transform(df.limit(1), ["c"])
    row = out.first().asDict()
    assert len(row) == n + 1 and sum(v for k, v in row.items() if k != "c") == 1.0
    assert row[f"c_{row['c']}"] == 1.0


@pytest.mark.parametrize("inline", [2, 999])
def test_position_is_the_sparse_form(spark, inline):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    fitted = preparing.fit(df, PrepSpec([], ["c"], encoding="position"), inline_categories=inline)
    out = fitted.transform(df.unionAll(spark.createDataFrame([("z",)], "c string")), ["c"])
    assert {r["c"]: r["c_position"] for r in out.collect()} == {"a": 0, "b": 1, "c": 2, "z": None}


def test_book(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, c string")
    book = PrepBook()
    with pytest.raises(PrepareError):
        book.fit_transform("p", df)
    for method in ("mean", "knn"):
        book.define(method, PrepSpec(["x"], ["c"], imputation=method, encoding="ordinal"))
        book.fit_transform(method, df)
    book.save(spark, str(tmp_path / "book"))
    loaded = PrepBook.load(spark, str(tmp_path / "book"))
    for method in ("mean", "knn"):
        before = sorted(map(tuple, book.transform(method, df).collect()))
        assert sorted(map(tuple, loaded.transform(method, df).collect())) == before
    with pytest.raises(PrepareError):
        PrepSpec(["x"], scaling="none")


def test_transform_runs_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "x double, c string")
    df.write.parquet(str(tmp_path / "in"))
    fitted = preparing.fit(df, PrepSpec(["x"], ["c"]))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        fitted.transform(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [-1.0, 1.0]


def test_encoders_check_their_name():
    with pytest.raises(PrepareError):
        encoding.check_method("hash")


def test_boxes_are_cut_along_what_queries_have():
    rng = np.random.default_rng(1)
    points = np.c_[rng.normal(0, 1e6, 2_000), rng.integers(0, 9, 2_000)]
    # the widest side is missing from every query: cutting along it would send each query to every box
    nodes = neighbours._cut(points, 4, np.array([False, True]))
    assert {n[0] for n in nodes} == {-1, 1}
    # where the useful side has one value only, boxes still stay small
    points[:, 1] = 3
    assert {n[0] for n in neighbours._cut(points, 4, np.array([False, True]))} == {-1, 0}


@pytest.mark.parametrize("values", [6, 10**6])
def test_cells_of_a_box_find_all_near_donors(values, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 5_000)
    rng = np.random.default_rng(values)
    donors = rng.integers(0, values, (3_000, 2)).astype(float)
    asked = rng.integers(-2, values + 2, (200, 2)).astype(float)
    met = {i: {} for i in range(len(asked))}
    for rows, found, distance in neighbours._nearest_in_cells(donors, asked, 5, (3, 2)):
        for i, j, x in zip(rows.tolist(), found.tolist(), distance.tolist()):
            assert met[i].setdefault(j, x) == x
    for i, row in enumerate(asked):
        apart = ((donors - row) ** 2).sum(axis=1) * 3 / 2
        reach = np.sort(apart)[4]
        # ties of the fifth donor included
        assert {j for j, x in met[i].items() if x <= reach} == set(np.flatnonzero(apart <= reach).tolist())
    if values > 6:  # without ties only a small part of the box is near
        assert sum(map(len, met.values())) < 0.05 * donors.shape[0] * len(asked)
