"""Physical plans: what must not appear at scale, and what must."""

import re

import pytest
from pyspark.sql import functions as F

from catalog.base import DUP_ROWS, derived, table
from tablewright.operators import charts, describe, duplicates, frequencies, values
from tablewright.streaming import monitor

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return {n: table(spark, SF, n) for n in ("lineitem", "orders", "events")}


def lazy_results(tables):
    ev, li, od = tables["events"], tables["lineitem"], tables["orders"]
    return {
        "keep_first": duplicates.drop_duplicates(ev, ["user_id"], "first", ["ts", "event_id"]),
        "keep_none": duplicates.drop_duplicates(od, ["o_custkey"], "none"),
        "repeats": duplicates.flag_repeats(ev, ["user_id"], ["ts", "event_id"]),
        "counts": frequencies.value_counts(od),
        "modes": frequencies.modes(li),
        "top": frequencies.top_values(li),
        "skewness": describe.skewness(li),
        "durations": monitor.operation_durations(ev, "user_id", "event_type", "click", "purchase", "ts", "event_id"),
        "samples": monitor.last_samples(ev, "event_type", "ts", "event_id", 5000),
        "scatter": charts.scatter(ev, "event_id", "user_id", "value"),
        "bars": charts.bars(li, "l_returnflag", "l_quantity"),
    }


def test_no_single_task_windows_or_cross_joins(tables):
    for name, df in lazy_results(tables).items():
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        if "Window" in text:
            assert "SinglePartition" not in text, name


def test_no_python_in_native_operators(tables):
    for name, df in lazy_results(tables).items():
        assert not re.search("Python|InPandas|ArrowEval", plan(df)), name


def test_keep_first_limits_before_the_shuffle(tables):
    text = plan(lazy_results(tables)["keep_first"])
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_top_values_limit_before_the_shuffle(tables):
    assert "WindowGroupLimit" in plan(lazy_results(tables)["top"])


def test_scatter_is_a_top_n(tables):
    assert "TakeOrderedAndProject" not in plan(charts.scatter(tables["events"], "event_id", "user_id", "value"))
    assert "TakeOrderedAndProject" in plan(charts.scatter(tables["events"], "event_id", "user_id", "value", limit=10))


def test_filters_reach_the_files(tables):
    text = plan(values.keep_range(tables["lineitem"], "l_quantity", 10, 20).select("l_orderkey"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(l_quantity,10", text)
    assert "struct<l_orderkey:bigint,l_quantity:double>" in text
    text = plan(values.keep_allowed(tables["orders"], "o_orderstatus", ["F"]))
    assert re.search(r"PushedFilters: \[.*o_orderstatus", text)


def test_only_needed_columns_are_read(tables):
    text = plan(describe.skewness(tables["lineitem"], ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text


def test_one_scan_for_all_columns(tables):
    assert plan(describe.skewness(tables["lineitem"])).count("FileScan") == 1
    assert plan(describe.missing_by_column(tables["lineitem"])).count("FileScan") == 1


def test_aggregates_combine_before_the_shuffle(spark, tables):
    for df in (lazy_results(tables)["bars"], duplicates.repeated_rows(derived(spark, SF, DUP_ROWS))):
        assert "partial_" in plan(df)


def test_wide_values_are_not_broadcast_unchecked(spark):
    from tablewright.session import broadcast_if_small

    assert "broadcast" in broadcast_if_small(spark.range(10), 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(spark.range(11), 10)._jdf.queryExecution().logical().toString().lower()


def test_facts_of_a_profile_equal_the_operators(spark):
    """Rows, gaps, extremes and types from one scan are those of the single operators."""
    from tablewright.operators import describe
    from tablewright.plans import profiling

    rows = [(1, 2.5, "é", None, [1, 2]), (2, float("nan"), None, None, None), (None, -1.0, "xyz", None, [3])]
    df = spark.createDataFrame(rows, "a int, b double, c string, d timestamp_ntz, e array<int>")
    for table in (df, df.limit(0)):
        facts = describe.table_facts(table)
        gaps, total = describe.missing_from(table, facts)

        def same(one, two):
            assert one.columns == two.columns
            assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))

        same(gaps, describe.missing_by_column(table))
        same(total, describe.missing_total(table))
        same(describe.types_from(table, facts), describe.type_profile(table))
        summary = describe.NumericSummary(table, ["a", "b"])
        same(describe.extremes_from(table, summary), describe.extremes(table, ["a", "b"]))
    parts = profiling.profile(df.drop("e"))
    assert parts["size"].first()["rows"] == 3
