"""Descriptive statistics, frequencies, distributions, correlations, outliers."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import (
    NULLS_NUMERIC, NULLS_PAIR, NULLS_TEXT, as_cte, big, derived, rd, register, scratch, table, tidy,
)
from tablewright.operators import correlate, describe, frequencies, histogram, outliers, ranking
from tablewright.plans import profiling

LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def per_column(columns, select: str, source: str) -> str:
    """UNION ALL of one row per column; ``{c}`` is the column."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {select.replace('{c}', c)} FROM {source}" for c in columns
    )


# --- D1 to D7 ------------------------------------------------------------------

_DESCRIBE = (
    f"{big('count({c})')} AS \"count\", {rd('avg({c})')} AS mean, {rd('stddev_samp({c})')} AS std, "
    f"{rd('min({c})')} AS min, {rd('quantile_cont({c}, 0.25)')} AS q25, "
    f"{rd('quantile_cont({c}, 0.5)')} AS q50, {rd('quantile_cont({c}, 0.75)')} AS q75, "
    f"{rd('max({c})')} AS max"
)


@register("d1_describe", per_column(LINEITEM_NUMBERS, _DESCRIBE, "lineitem"))
def d1_describe(spark, sf_dir):
    return tidy(describe.describe(table(spark, sf_dir, "lineitem")))


@register("d1_describe_nulls", as_cte(NULLS_NUMERIC) + per_column(["qty", "mostly_null"], _DESCRIBE, "t"))
def d1_describe_nulls(spark, sf_dir):
    return tidy(describe.describe(derived(spark, sf_dir, NULLS_NUMERIC), ["qty", "mostly_null"]))


@register(
    "d1_describe_by_group",
    " UNION ALL ".join(
        f"SELECT event_type, '{c}' AS \"column\", {_DESCRIBE.replace('{c}', c)} FROM events GROUP BY event_type"
        for c in ("value", "user_id")
    ),
)
def d1_describe_by_group(spark, sf_dir):
    return tidy(describe.describe(table(spark, sf_dir, "events"), ["value", "user_id"], ["event_type"]))


@register("d2_skewness", per_column(LINEITEM_NUMBERS, f"{rd('skewness({c})')} AS skewness", "lineitem"))
def d2_skewness(spark, sf_dir):
    return tidy(describe.skewness(table(spark, sf_dir, "lineitem")))


@register("d3_kurtosis", per_column(LINEITEM_NUMBERS, f"{rd('kurtosis({c})')} AS kurtosis", "lineitem"))
def d3_kurtosis(spark, sf_dir):
    return tidy(describe.kurtosis(table(spark, sf_dir, "lineitem")))


def _mode_sql(columns, source, cast="DOUBLE"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT CAST({c} AS {cast}) FROM {source} WHERE {c} IS NOT NULL "
        f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode"
        for c in columns
    )


@register("d4_numeric_mode", _mode_sql(LINEITEM_NUMBERS, "lineitem"))
def d4_numeric_mode(spark, sf_dir):
    return describe.numeric_modes(table(spark, sf_dir, "lineitem"))


@register("d5_range", per_column(LINEITEM_NUMBERS, f"{rd('max({c}) - min({c})')} AS range", "lineitem"))
def d5_range(spark, sf_dir):
    return tidy(describe.spans(table(spark, sf_dir, "lineitem")))


@register(
    "d6_iqr",
    per_column(
        LINEITEM_NUMBERS,
        f"{rd('quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} AS iqr",
        "lineitem",
    ),
)
def d6_iqr(spark, sf_dir):
    return tidy(describe.interquartile_range(table(spark, sf_dir, "lineitem")))


@register(
    "d7_variation",
    as_cte("SELECT o_totalprice, o_custkey, o_totalprice * 0.0 AS zero FROM orders")
    + per_column(
        ["o_totalprice", "o_custkey", "zero"],
        f"{rd('stddev_samp({c}) / nullif(avg({c}), 0)')} AS coefficient_variation",
        "t",
    ),
)
def d7_variation(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr("o_totalprice", "o_custkey", "o_totalprice * 0.0D AS zero")
    return tidy(describe.variation(df))


# --- D8 to D11 -----------------------------------------------------------------

_CATEGORIES = ["priority", "o_orderstatus"]


@register(
    "d8_distinct_count",
    as_cte(NULLS_TEXT) + per_column(_CATEGORIES, f"{big('count(DISTINCT {c})')} AS distinct_count", "t"),
)
def d8_distinct_count(spark, sf_dir):
    return frequencies.distinct_counts(derived(spark, sf_dir, NULLS_TEXT), _CATEGORIES).drop("distinct_percent")


@register("d9_category_mode", as_cte(NULLS_TEXT) + _mode_sql(_CATEGORIES, "t", "VARCHAR"))
def d9_category_mode(spark, sf_dir):
    return frequencies.modes(derived(spark, sf_dir, NULLS_TEXT), _CATEGORIES).drop("count")


def _counts_sql(columns, source, extra="", group_extra=""):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS \"count\"{extra} "
        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


_EVERY_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("d10_frequencies", as_cte("SELECT * FROM orders") + _counts_sql(_EVERY_ORDERS, "t"))
def d10_frequencies(spark, sf_dir):
    return frequencies.value_counts(table(spark, sf_dir, "orders"))


@register(
    "d11_proportions",
    as_cte(NULLS_TEXT)
    + _counts_sql(_CATEGORIES, "t", ", " + rd("count(*) / (SELECT count(*)::DOUBLE FROM t)", 6) + " AS proportion"),
)
def d11_proportions(spark, sf_dir):
    return tidy(frequencies.value_proportions(derived(spark, sf_dir, NULLS_TEXT), _CATEGORIES), 6)


# --- D12 to D14 ----------------------------------------------------------------


def biased_skewness(c: str) -> str:
    return f"(skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)))"


def normality_cte(columns, source, name="k"):
    """n, g1 and b2 per column, then the two scores by the published formulas."""
    base = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c})::DOUBLE AS n, {biased_skewness(c)} AS g1, "
        f"kurtosis_pop({c}) + 3 AS b2 FROM {source}"
        for c in columns
    )
    return f"""
    base AS ({base}),
    s1 AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y,
        3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS beta,
        3*(n-1)/(n+1) AS e, 24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5)) AS v,
        6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM base),
    s2 AS (SELECT *, sqrt(2*(beta-1))-1 AS w2, (b2-e)/sqrt(v) AS x,
        6+8/s*(2/s+sqrt(1+4/(s*s))) AS a FROM s1),
    s3 AS (SELECT *, 1/sqrt(0.5*ln(w2)) AS delta, sqrt(2/(w2-1)) AS alpha,
        1+x*sqrt(2/(a-4)) AS d FROM s2),
    s4 AS (SELECT *, delta*asinh((CASE WHEN y = 0 THEN 1 ELSE y END)/alpha) AS z1,
        (1-2/(9*a)-sign(d)*pow((1-2/a)/abs(d), 1.0/3.0))/sqrt(2/(9*a)) AS z2 FROM s3),
    {name} AS (SELECT "column", n, z1*z1+z2*z2 AS statistic, exp(-(z1*z1+z2*z2)/2) AS p_value FROM s4)
    """


_EVENT_NUMBERS = ["event_id", "user_id", "value"]


@register(
    "d12_distributions",
    per_column(
        _EVENT_NUMBERS,
        f"{rd('avg({c})')} AS mean, {rd('quantile_cont({c}, 0.5)')} AS median, "
        f"{rd('stddev_samp({c})')} AS std, {rd(biased_skewness('{c}'))} AS skewness, "
        f"{rd('kurtosis_pop({c})')} AS kurtosis",
        "events",
    ),
)
def d12_distributions(spark, sf_dir):
    out = describe.distributions(table(spark, sf_dir, "events"))
    return tidy(out.select("column", "mean", "median", "std", "skewness", "kurtosis"))


@register(
    "d13_normality",
    f"WITH {normality_cte(_EVENT_NUMBERS, 'events')} "
    f"SELECT \"column\", {big('n')} AS n, {rd('statistic', 2)} AS statistic, {rd('p_value', 6)} AS p_value FROM k",
)
def d13_normality(spark, sf_dir):
    return tidy(describe.normality_test(table(spark, sf_dir, "events")), statistic=2, p_value=6)


def histogram_sql(c: str, source: str, integral: bool, bins: int | None = None) -> str:
    """Bin counts with empty bins, by the automatic rule or a given number."""
    width = "least(greatest(2*iqr*pow(n, -1.0/3.0), (hi-lo)/sqrt(n)/2), (hi-lo)/(log2(n)+1))"
    if integral:
        width = f"greatest({width}, 1.0)"
    count = str(bins) if bins else f"greatest(ceil((hi-lo)/({width})), 1)"
    return f"""
    SELECT '{c}' AS "column", b.bin, {rd('lo + b.bin*w')} AS "left",
           {rd('CASE WHEN b.bin = nb-1 THEN hi ELSE lo + (b.bin+1)*w END')} AS "right",
           coalesce(cnt, 0)::BIGINT AS "count"
    FROM (SELECT unnest(range(0, nb::BIGINT)) AS bin, lo, hi, nb, w FROM
            (SELECT *, (hi-lo)/nb AS w FROM
              (SELECT *, {count} AS nb FROM
                (SELECT count({c})::DOUBLE AS n, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
                        quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {source})))) b
    LEFT JOIN (
      SELECT least(floor(({c} - lo)/((hi-lo)/nb)), nb-1)::BIGINT AS bin, count(*) AS cnt
      FROM {source}, (SELECT *, {count} AS nb FROM
                (SELECT count({c})::DOUBLE AS n, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi,
                        quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM {source})) f
      WHERE {c} IS NOT NULL GROUP BY 1) h ON h.bin = b.bin
    """


@register(
    "d14_histogram",
    f"{histogram_sql('value', 'events', False)} UNION ALL {histogram_sql('user_id', 'events', True)}",
)
def d14_histogram(spark, sf_dir):
    return tidy(histogram.histogram(table(spark, sf_dir, "events"), ["value", "user_id"]))


# --- D15 to D17, D27 -----------------------------------------------------------


def _square_sql(method, columns, cell, source):
    return " UNION ALL ".join(
        f"SELECT '{method}' AS method, '{a}' AS column_a, '{b}' AS column_b, {cell(a, b, source)} AS correlation"
        for a in columns
        for b in columns
    )


def _pearson_cell(a, b, source):
    return f"(SELECT {rd(f'corr({a}, {b})', 6)} FROM {source})"


def _spearman_cell(a, b, source):
    def rank(c):
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"

    return (
        f"(SELECT {rd('corr(ra, rb)', 6)} FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"
    )


@register("d15_pearson", _square_sql("pearson", LINEITEM_NUMBERS, _pearson_cell, "lineitem"))
def d15_pearson(spark, sf_dir):
    return tidy(correlate.pearson(table(spark, sf_dir, "lineitem")), 6)


_PAIR = ["price", "cust", "slot"]


@register("d15_pearson_nulls", as_cte(NULLS_PAIR) + _square_sql("pearson", _PAIR, _pearson_cell, "t"))
def d15_pearson_nulls(spark, sf_dir):
    return tidy(correlate.pearson(derived(spark, sf_dir, NULLS_PAIR), _PAIR), 6)


_WIDE = [f"v{i}" for i in range(18)]
_WIDE_SQL = (
    "SELECT "
    + ", ".join(
        f"CASE WHEN (l_orderkey + {i}) % 17 = 0 THEN NULL ELSE "
        f"{['l_quantity', 'l_extendedprice', 'l_tax'][i % 3]} * {i + 1} + l_discount * (l_linenumber + {i}) END AS v{i}"
        for i in range(18)
    )
    + " FROM lineitem"
)


@register("d15_pearson_wide", as_cte(_WIDE_SQL) + _square_sql("pearson", _WIDE, _pearson_cell, "t"))
def d15_pearson_wide(spark, sf_dir):
    return tidy(correlate.pearson(derived(spark, sf_dir, _WIDE_SQL)), 6)


_SPEARMAN = ["l_partkey", "l_quantity", "l_extendedprice", "l_tax"]


@register("d16_spearman", _square_sql("spearman", _SPEARMAN, _spearman_cell, "lineitem"))
def d16_spearman(spark, sf_dir):
    return tidy(correlate.spearman(table(spark, sf_dir, "lineitem"), _SPEARMAN), 6)


@register("d16_spearman_nulls", as_cte(NULLS_PAIR) + _square_sql("spearman", _PAIR, _spearman_cell, "t"))
def d16_spearman_nulls(spark, sf_dir):
    return tidy(correlate.spearman(derived(spark, sf_dir, NULLS_PAIR), _PAIR), 6)


@register(
    "d17_kendall",
    f"""
    WITH p AS (SELECT l_quantity AS x, l_tax AS y, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
    s AS (SELECT sum(a.w*b.w*sign(a.x-b.x)*sign(a.y-b.y)) AS cd,
                 sum(a.w*b.w*abs(sign(a.x-b.x))) AS nx, sum(a.w*b.w*abs(sign(a.y-b.y))) AS ny
          FROM p a, p b),
    m AS (SELECT 'l_quantity' AS column_a, 'l_tax' AS column_b, cd/sqrt(nx*ny) AS r FROM s
          UNION ALL SELECT 'l_tax', 'l_quantity', cd/sqrt(nx*ny) FROM s
          UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_tax', 'l_tax', 1.0)
    SELECT 'kendall' AS method, column_a, column_b, {rd('r', 6)} AS correlation FROM m
    """,
)
def d17_kendall(spark, sf_dir):
    return tidy(correlate.kendall(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]), 6)


@register(
    "d17_kendall_continuous",
    f"""
    WITH s AS (SELECT sum(sign(a.o_custkey - b.o_custkey) * sign(a.o_totalprice - b.o_totalprice)) AS cd,
                      sum(abs(sign(a.o_custkey - b.o_custkey))) AS nx, sum(abs(sign(a.o_totalprice - b.o_totalprice))) AS ny
               FROM orders a, orders b),
    m AS (SELECT 'o_custkey' AS column_a, 'o_totalprice' AS column_b, cd/sqrt(nx*ny) AS r FROM s
          UNION ALL SELECT 'o_totalprice', 'o_custkey', cd/sqrt(nx*ny) FROM s
          UNION ALL SELECT 'o_custkey', 'o_custkey', 1.0 UNION ALL SELECT 'o_totalprice', 'o_totalprice', 1.0)
    SELECT 'kendall' AS method, column_a, column_b, {rd('r', 6)} AS correlation FROM m
    """,
)
def d17_kendall_continuous(spark, sf_dir):
    return tidy(correlate.kendall(table(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"]), 6)


_HIGH = "SELECT l_quantity, l_quantity * 2 + l_tax AS twice, l_extendedprice, 100 - l_quantity AS rest FROM lineitem"


@register(
    "d27_high_correlation",
    as_cte(_HIGH)
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {_pearson_cell(a, b, 't')} AS correlation"
        for a, b in combinations(["l_quantity", "twice", "l_extendedprice", "rest"], 2)
    )
    + ") WHERE abs(correlation) > 0.9",
)
def d27_high_correlation(spark, sf_dir):
    return tidy(correlate.high_correlations(derived(spark, sf_dir, _HIGH)), 6)


# --- D18 to D25 ----------------------------------------------------------------


@register(
    "d18_outliers_zscore",
    f"SELECT event_id, 'value' AS \"column\", 'zscore' AS method, {rd('value')} AS value FROM events, "
    "(SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs((value - m) / s) > 3",
)
def d18_outliers_zscore(spark, sf_dir):
    return tidy(outliers.detect_outliers(table(spark, sf_dir, "events"), "event_id", ["value"], ["zscore"]))


@register(
    "d19_outliers_iqr",
    " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS \"column\", 'iqr' AS method, {rd(c)} AS value FROM documents, "
        f"(SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM documents) "
        f"WHERE {c} < a - 1.5*(b-a) OR {c} > b + 1.5*(b-a)"
        for c in ("doc_id", "n_chars")
    ),
)
def d19_outliers_iqr(spark, sf_dir):
    return tidy(outliers.detect_outliers(table(spark, sf_dir, "documents"), "doc_id", methods=["iqr"]))


_NULL_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag",
    "qty", "mostly_null",
]


@register(
    "d20_missing_total",
    as_cte(NULLS_NUMERIC)
    + "SELECT sum(m)::BIGINT AS total_missing, "
    + rd("sum(m) * 100.0 / (count(*) * 8)")
    + " AS missing_percent FROM (SELECT "
    + " + ".join(f"({c} IS NULL)::INT" for c in _NULL_COLUMNS)
    + " AS m FROM t)",
)
def d20_missing_total(spark, sf_dir):
    return tidy(describe.missing_total(derived(spark, sf_dir, NULLS_NUMERIC)))


@register(
    "d21_missing_by_column",
    as_cte(NULLS_NUMERIC)
    + per_column(
        _NULL_COLUMNS,
        f"{big('count(*) - count({c})')} AS missing, {rd('(count(*) - count({c})) * 100.0 / count(*)')} AS missing_percent",
        "t",
    ),
)
def d21_missing_by_column(spark, sf_dir):
    return tidy(describe.missing_by_column(derived(spark, sf_dir, NULLS_NUMERIC)))


@register(
    "d22_distinct_percent",
    per_column(
        _EVERY_ORDERS,
        f"{big('count(DISTINCT {c})')} AS distinct_count, "
        f"{rd('count(DISTINCT {c}) * 100.0 / count(*)')} AS distinct_percent",
        "orders",
    ),
)
def d22_distinct_percent(spark, sf_dir):
    return tidy(frequencies.distinct_counts(table(spark, sf_dir, "orders")))


@register(
    "d23_top_values",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", rank, CAST(v AS VARCHAR) AS value, n AS \"count\" FROM "
        f"(SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank "
        f"FROM orders GROUP BY {c}) WHERE rank <= 5"
        for c in _EVERY_ORDERS
    ),
)
def d23_top_values(spark, sf_dir):
    return tidy(frequencies.top_values(table(spark, sf_dir, "orders")))


@register(
    "d24_extremes",
    per_column(LINEITEM_NUMBERS, f"{rd('min({c})')} AS min, {rd('max({c})')} AS max", "lineitem"),
)
def d24_extremes(spark, sf_dir):
    return tidy(describe.extremes(table(spark, sf_dir, "lineitem")))


def _type_row(c, dtype, size, numeric, categorical, datetime):
    return (
        f"SELECT '{c}' AS \"column\", '{dtype}' AS data_type, {big(size)} AS bytes, "
        f"{numeric} AS is_numeric, {categorical} AS is_categorical, {datetime} AS is_datetime FROM orders"
    )


@register(
    "d25_types",
    " UNION ALL ".join(
        [
            _type_row("o_orderkey", "bigint", "count(*) * 8", True, False, False),
            _type_row("o_custkey", "bigint", "count(*) * 8", True, False, False),
            _type_row("o_orderstatus", "string", "sum(strlen(o_orderstatus))", False, True, False),
            _type_row("o_totalprice", "double", "count(*) * 8", True, False, False),
            _type_row("o_orderdate", "timestamp_ntz", "count(*) * 8", False, False, True),
            _type_row("o_orderpriority", "string", "sum(strlen(o_orderpriority))", False, True, False),
        ]
    ),
)
def d25_types(spark, sf_dir):
    return describe.type_profile(table(spark, sf_dir, "orders"))


@register(
    "d25_type_counts",
    "SELECT data_type, count(*) AS columns FROM (SELECT CASE data_type WHEN 'VARCHAR' THEN 'string' "
    "WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type "
    "FROM information_schema.columns WHERE table_name = 'orders') GROUP BY data_type",
)
def d25_type_counts(spark, sf_dir):
    return describe.type_counts(table(spark, sf_dir, "orders"))


# --- D26, D28 --------------------------------------------------------------------

_PROFILE_PARTS = {
    "describe": ["count", "mean", "std", "min", "q25", "q50", "q75", "max"],
    "shape": ["skewness", "kurtosis", "range", "iqr", "coefficient_variation"],
    "distributions": ["median", "normality_statistic"],
    "missing": ["missing"],
    "distinct": ["distinct_count", "distinct_percent"],
    "extremes": ["min", "max"],
    "numeric_modes": ["mode"],
}


def profile_metrics(parts):
    """The per-column parts of a profile as ``(part, column, metric, value)``."""
    out = None
    for part, metrics in _PROFILE_PARTS.items():
        rows = parts[part].select("column", *[F.col(m).cast("double").alias(m) for m in metrics])
        long = rows.unpivot(["column"], metrics, "metric", "value").select(
            F.lit(part).alias("part"), "column", "metric", "value"
        )
        out = long if out is None else out.unionByName(long)
    none, text = F.lit(""), lambda *c: F.concat_ws(" ", *c)
    others = {
        "size": (none, F.lit("rows"), "rows"),
        "missing_total": (none, F.lit("missing"), "total_missing"),
        "type_counts": (none, F.col("data_type"), "columns"),
        "types": (F.col("column"), F.col("data_type"), "bytes"),
        "correlations": (F.col("column_a"), text("method", "column_b"), "correlation"),
        "histograms": (F.col("column"), text(F.lit("bin"), "bin"), "count"),
        "top_values": (F.col("column"), text(F.lit("top"), "rank", "value"), "count"),
        "categories": (F.col("column"), text(F.lit("mode"), "mode"), "count"),
        "frequencies": (F.col("column"), text(F.lit("value"), "value"), "count"),
    }
    for part, (column, metric, value) in others.items():
        rows = parts[part].select(
            F.lit(part).alias("part"), column.alias("column"), metric.alias("metric"),
            F.col(value).cast("double").alias("value"),
        )
        out = out.unionByName(rows)
    outliers = parts["outliers"].groupBy("column", "method").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return out.unionByName(
        outliers.select(F.lit("outliers").alias("part"), "column", F.col("method").alias("metric"), "value")
    )


def _profile_sql(source, types):
    """``types``: Spark's type and the bytes as SQL of every column; no nulls in the table."""
    numbers = [c for c, (k, _) in types.items() if k in ("int", "bigint", "double")]
    texts = [c for c, (k, _) in types.items() if k == "string"]
    others = [c for c in types if c not in numbers]
    rows = []
    for c in numbers:
        metrics = {
            ("describe", "count"): f"count({c})", ("describe", "mean"): f"avg({c})",
            ("describe", "std"): f"stddev_samp({c})", ("describe", "min"): f"min({c})",
            ("describe", "q25"): f"quantile_cont({c}, 0.25)", ("describe", "q50"): f"quantile_cont({c}, 0.5)",
            ("describe", "q75"): f"quantile_cont({c}, 0.75)", ("describe", "max"): f"max({c})",
            ("shape", "skewness"): f"skewness({c})", ("shape", "kurtosis"): f"kurtosis({c})",
            ("shape", "range"): f"max({c}) - min({c})",
            ("shape", "iqr"): f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)",
            ("shape", "coefficient_variation"): f"stddev_samp({c}) / nullif(avg({c}), 0)",
            ("distributions", "median"): f"quantile_cont({c}, 0.5)",
        }
        rows += [
            f"SELECT '{p}' AS part, '{c}' AS \"column\", '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {source}"
            for (p, m), e in metrics.items()
        ]
    for c in [*numbers, *others]:
        for p, m, e in (
            ("missing", "missing", f"count(*) - count({c})"),
            ("distinct", "distinct_count", f"count(DISTINCT {c})"),
            ("distinct", "distinct_percent", f"count(DISTINCT {c}) * 100.0 / count(*)"),
        ):
            rows.append(f"SELECT '{p}', '{c}', '{m}', CAST({e} AS DOUBLE) FROM {source}")
        n = f"(SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM {source} GROUP BY {c})"
        rows.append(f"SELECT 'top_values', '{c}', 'top ' || r || ' ' || v, n FROM {n} WHERE r <= 5")
        if c in numbers:
            rows.append(f"SELECT 'numeric_modes', '{c}', 'mode', v FROM {n} WHERE r = 1")
        elif c in texts:
            rows.append(f"SELECT 'categories', '{c}', 'mode ' || v, n FROM {n} WHERE r = 1")
            rows.append(f"SELECT 'frequencies', '{c}', 'value ' || v, n FROM {n}")
        kind, size = types[c]
        rows.append(f"SELECT 'types', '{c}', '{kind}', {size} FROM {source}")
    rows.append(
        "SELECT 'distributions', \"column\", 'normality_statistic', statistic FROM k"
    )
    rows += [f"SELECT 'type_counts', '', '{k}', {n}" for k, n in Counter(k for k, _ in types.values()).items()]
    for c in numbers:
        rows += [f"SELECT 'extremes', '{c}', '{f}', {f}({c}) FROM {source}" for f in ("min", "max")]
        bins = histogram_sql(c, source, types[c][0] in ("int", "bigint"))
        rows.append(f"SELECT 'histograms', \"column\", 'bin ' || bin, \"count\" FROM ({bins})")
        mean, iqr = f"(SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {source})", (
            f"(SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {source})"
        )
        rows.append(f"SELECT 'outliers', '{c}', 'zscore', count(*) FROM {source}, {mean} WHERE abs(({c} - m) / s) > 3 HAVING count(*) > 0")
        rows.append(
            f"SELECT 'outliers', '{c}', 'iqr', count(*) FROM {source}, {iqr} "
            f"WHERE {c} < a - 1.5*(b-a) OR {c} > b + 1.5*(b-a) HAVING count(*) > 0"
        )
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in numbers
    )
    for a in numbers:
        for b in numbers:
            rows.append(f"SELECT 'correlations', '{a}', 'pearson {b}', corr({a}, {b}) FROM {source}")
            rows.append(f"SELECT 'correlations', '{a}', 'spearman {b}', corr(r_{a}, r_{b}) FROM ranked")
    missing = " + ".join(f"count(*) - count({c})" for c in [*numbers, *others])
    rows.append(f"SELECT 'missing_total', '', 'missing', {missing} FROM {source}")
    rows.append(f"SELECT 'size', '', 'rows', count(*)::DOUBLE FROM {source}")
    body = " UNION ALL ".join(rows)
    return (
        f"WITH {normality_cte(numbers, source)}, ranked AS (SELECT {ranks} FROM {source}) SELECT part, \"column\", metric, "
        f"{rd('value', 2)} AS value FROM ({body})"
    )


@register(
    "d26_profile",
    _profile_sql(
        "lineitem",
        {
            **{c: ("bigint", "count(*) * 8") for c in ("l_orderkey", "l_partkey", "l_suppkey")},
            "l_linenumber": ("int", "count(*) * 4"),
            **{c: ("double", "count(*) * 8") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")},
            **{c: ("string", f"sum(strlen({c}))") for c in ("l_returnflag", "l_linestatus")},
            "l_shipdate": ("timestamp_ntz", "count(*) * 8"),
        },
    ),
)
def d26_profile(spark, sf_dir):
    parts = profiling.profile(table(spark, sf_dir, "lineitem"))
    return tidy(profile_metrics(parts), 2)


@register(
    "d26_profile_outliers",
    " UNION ALL ".join(
        f"SELECT event_id, '{c}' AS \"column\", '{m}' AS method, {rd(c)} AS value FROM events, "
        f"(SELECT avg({c}) AS m, stddev_pop({c}) AS s, quantile_cont({c}, 0.25) AS a, "
        f"quantile_cont({c}, 0.75) AS b FROM events) WHERE {rule}"
        for c in ("event_id", "user_id", "value")
        for m, rule in (
            ("zscore", f"abs(({c} - m) / s) > 3"),
            ("iqr", f"{c} < a - 1.5*(b-a) OR {c} > b + 1.5*(b-a)"),
        )
    ),
)
def d26_profile_outliers(spark, sf_dir):
    parts = profiling.profile(table(spark, sf_dir, "events"), "event_id")
    return tidy(parts["outliers"])


@register(
    "d28_run_history",
    "SELECT 'run-' || event_type AS run_id, '{\"rows\": ' || count(*) || '}' AS configuration "
    "FROM events GROUP BY event_type",
)
def d28_run_history(spark, sf_dir):
    path = scratch(spark, "runs")
    counts = table(spark, sf_dir, "events").groupBy("event_type").count().collect()
    for r in counts:
        profiling.record_run(spark, path, f"run-{r['event_type']}", {"rows": r["count"]})
    return spark.read.parquet(path).select("run_id", "configuration")


# --- W3, W4 ----------------------------------------------------------------------


@register(
    "w3_average_rank",
    "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS average_rank FROM orders",
)
def w3_average_rank(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    ranks = ranking.column_ranks(df, ["o_totalprice"])
    out = ranking.attach(df, "o_totalprice", ranks, "avg_rank", "average_rank")
    return tidy(out.select("o_orderkey", "average_rank"))


@register(
    "w4_value_counts",
    "SELECT event_type AS value, count(*) AS \"count\" FROM events GROUP BY event_type ORDER BY 2 DESC, 1",
)
def w4_value_counts(spark, sf_dir):
    counts = frequencies.value_counts(table(spark, sf_dir, "events"), ["event_type"])
    return counts.select("value", "count").orderBy(F.desc("count"), "value")
