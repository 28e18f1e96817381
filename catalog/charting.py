"""Chart tables."""

from __future__ import annotations

from catalog.base import as_cte, big, rd, register, table, tidy
from catalog.profiling import _pearson_cell, _square_sql, histogram_sql
from tablewright.operators import charts


@register(
    "f1_scatter",
    f"SELECT event_id, {rd('user_id')} AS x, {rd('value')} AS y, event_type AS color FROM events",
)
def f1_scatter(spark, sf_dir):
    out = charts.chart_data("scatter", table(spark, sf_dir, "events"), key="event_id", x="user_id", y="value", color="event_type")
    return tidy(out.withColumn("x", out["x"].cast("double")))


def _cell(c, bins):
    return f"least(floor(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / {bins})), {bins - 1})::BIGINT"


@register(
    "f1_scatter_bins",
    f"SELECT {_cell('l_quantity', 20)} AS x_bin, {_cell('l_extendedprice', 20)} AS y_bin, count(*) AS \"count\" FROM lineitem, "
    "(SELECT min(l_quantity) AS lo_l_quantity, max(l_quantity) AS hi_l_quantity, min(l_extendedprice) AS lo_l_extendedprice, "
    "max(l_extendedprice) AS hi_l_extendedprice FROM lineitem) GROUP BY 1, 2",
)
def f1_scatter_bins(spark, sf_dir):
    return charts.scatter_bins(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 20)


@register(
    "f2_lines",
    " UNION ALL ".join(
        f"SELECT l_shipdate AS x, '{c}' AS series, {rd(f'avg({c})')} AS value FROM lineitem GROUP BY l_shipdate"
        for c in ("l_quantity", "l_discount")
    ),
)
def f2_lines(spark, sf_dir):
    return tidy(charts.chart_data("line", table(spark, sf_dir, "lineitem"), x="l_shipdate", y=["l_quantity", "l_discount"]))


@register(
    "f3_bars",
    f"SELECT l_returnflag AS x, l_linestatus AS color, {rd('sum(l_quantity)', 2)} AS height FROM lineitem GROUP BY 1, 2",
)
def f3_bars(spark, sf_dir):
    out = charts.chart_data("bar", table(spark, sf_dir, "lineitem"), x="l_returnflag", y="l_quantity", color="l_linestatus")
    return tidy(out, 2)


@register("f4_histogram", histogram_sql("l_extendedprice", "lineitem", False, 40))
def f4_histogram(spark, sf_dir):
    return tidy(charts.chart_data("histogram", table(spark, sf_dir, "lineitem"), column="l_extendedprice", bins=40))


def _box_sql(value, by, source):
    group = by or "'all'"
    return f"""
    WITH v AS (SELECT {group} AS "group", {value} AS value FROM {source} WHERE {value} IS NOT NULL),
    q AS (SELECT "group", count(*) AS n, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
          quantile_cont(value, 0.75) AS q75 FROM v GROUP BY "group")
    SELECT q."group", any_value(n) AS n, {rd('any_value(q25)')} AS q25, {rd('any_value(median)')} AS median,
           {rd('any_value(q75)')} AS q75,
           {rd('min(value) FILTER (value BETWEEN q25 - 1.5*(q75-q25) AND q75 + 1.5*(q75-q25))')} AS low_whisker,
           {rd('max(value) FILTER (value BETWEEN q25 - 1.5*(q75-q25) AND q75 + 1.5*(q75-q25))')} AS high_whisker,
           count(*) FILTER (value NOT BETWEEN q25 - 1.5*(q75-q25) AND q75 + 1.5*(q75-q25)) AS outliers
    FROM v JOIN q ON v."group" = q."group" GROUP BY q."group"
    """


@register("f5_box", _box_sql("value", "event_type", "events"))
def f5_box(spark, sf_dir):
    return tidy(charts.chart_data("box", table(spark, sf_dir, "events"), column="value", by="event_type"))


@register("f5_box_whole", _box_sql("n_chars", None, "documents"))
def f5_box_whole(spark, sf_dir):
    return tidy(charts.chart_data("box", table(spark, sf_dir, "documents"), column="n_chars"))


def _density_sql(value, by, source, points):
    group = by or "'all'"
    return f"""
    WITH v AS (SELECT {group} AS "group", {value}::DOUBLE AS value, count(*) AS w FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT {group} AS "group", count(*)::DOUBLE AS n, min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi,
          stddev_samp({value}) * pow(count(*)::DOUBLE, -0.2) AS h FROM {source} WHERE {value} IS NOT NULL GROUP BY 1),
    g AS (SELECT f.*, p::BIGINT AS point, lo + p * ((hi - lo) / {points - 1}.0) AS x FROM f, range({points}) r(p))
    SELECT g."group", point, {rd('any_value(x)')} AS x,
           {rd('sum(w * exp(-0.5 * ((x - value) / h) * ((x - value) / h))) / any_value(n * h * sqrt(2 * pi()))', 8)} AS density
    FROM g JOIN v ON g."group" = v."group" GROUP BY g."group", point
    """


@register("f6_violin", _density_sql("value", "event_type", "events", 100))
def f6_violin(spark, sf_dir):
    out = charts.chart_data("violin", table(spark, sf_dir, "events"), column="value", by="event_type", points=100)
    return tidy(out, density=8)


@register("f9_density", _density_sql("l_quantity", None, "lineitem", 500))
def f9_density(spark, sf_dir):
    return tidy(charts.chart_data("density", table(spark, sf_dir, "lineitem"), column="l_quantity"), density=8)


_HEAT = ["l_quantity", "l_extendedprice", "l_discount"]


@register(
    "f7_heatmap",
    "SELECT column_a, column_b, correlation FROM (" + _square_sql("pearson", _HEAT, _pearson_cell, "lineitem") + ")",
)
def f7_heatmap(spark, sf_dir):
    return tidy(charts.chart_data("heatmap", table(spark, sf_dir, "lineitem"), columns=_HEAT), 6)


@register(
    "f7_heatmap_wide",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", " + ", ".join(f"{rd(f'corr({a}, {b})', 6)} AS {b}" for b in _HEAT) + " FROM lineitem"
        for a in _HEAT
    ),
)
def f7_heatmap_wide(spark, sf_dir):
    return tidy(charts.chart_data("heatmap", table(spark, sf_dir, "lineitem"), columns=_HEAT, wide=True), 6)


@register(
    "f8_pie",
    f"SELECT o_orderpriority AS name, {rd('sum(o_totalprice)', 2)} AS value, "
    f"{rd('sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders)', 6)} AS share FROM orders GROUP BY 1",
)
def f8_pie(spark, sf_dir):
    out = charts.chart_data("pie", table(spark, sf_dir, "orders"), names="o_orderpriority", values="o_totalprice")
    return tidy(out, value=2, share=6)


_SM = ["o_orderkey", "o_custkey", "o_totalprice"]


@register(
    "f10_scatter_matrix",
    " UNION ALL ".join(
        f"SELECT o_orderkey, '{a}' AS x_column, '{b}' AS y_column, {rd(a)} AS x, {rd(b)} AS y FROM orders"
        for i, a in enumerate(_SM)
        for b in _SM[i + 1 :]
    ),
)
def f10_scatter_matrix(spark, sf_dir):
    return tidy(charts.chart_data("scatter_matrix", table(spark, sf_dir, "orders"), key="o_orderkey", columns=_SM))


@register(
    "f11_parallel_coordinates",
    "SELECT o_orderkey, color, "
    + ", ".join(rd(f"({c} - lo_{c}) / (hi_{c} - lo_{c})::DOUBLE", 6) + f" AS {c}" for c in ("o_custkey", "o_totalprice"))
    + " FROM (SELECT *, o_orderstatus AS color FROM orders), (SELECT "
    + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in ("o_custkey", "o_totalprice"))
    + " FROM orders)",
)
def f11_parallel_coordinates(spark, sf_dir):
    out = charts.chart_data(
        "parallel_coordinates", table(spark, sf_dir, "orders"), key="o_orderkey",
        columns=["o_custkey", "o_totalprice"], color="o_orderstatus",
    )
    return tidy(out, 6)


@register(
    "f12_filters",
    f"SELECT event_id, user_id, event_type, {rd('value')} AS value FROM events WHERE event_type = 'click' AND value >= 20 AND user_id IN (1, 2, 3, 4, 5)",
)
def f12_filters(spark, sf_dir):
    out = charts.apply_filters(
        table(spark, sf_dir, "events"),
        [
            {"column": "event_type", "type": "select", "value": "click"},
            {"column": "user_id", "type": "multiselect", "value": [1, 2, 3, 4, 5]},
            {"column": "value", "type": "slider", "value": 20},
            {"column": "value", "type": "multiselect", "value": []},
        ],
    )
    return tidy(out.select("event_id", "user_id", "event_type", "value"))


@register(
    "w7_first_rows",
    "SELECT least(count(*), 100) AS shown FROM orders",
)
def w7_first_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    return charts.first_rows(table(spark, sf_dir, "orders")).agg(F.count(F.lit(1)).alias("shown"))
