"""Checks, assertions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DUP_ROWS, NON_FINITE, NULLS_NUMERIC, NULLS_TEXT, as_cte, big, derived, rd, register, scratch, table, tidy
from tablewright.errors import CheckError
from tablewright.operators import checks as C
from tablewright.plans import validation

_COLUMNS = ["check", "column", "passed", "severity", "observed", "expected", "count"]


def _row(check, column, passed, severity, observed, expected, count):
    """One report row as SQL; arguments are SQL expressions but the plain names."""
    column = "NULL" if column is None else f"'{column}'"
    return (
        f"SELECT '{check}' AS \"check\", {column} AS \"column\", {passed} AS passed, '{severity}' AS severity, "
        f"CAST({observed} AS VARCHAR) AS observed, CAST({expected} AS VARCHAR) AS expected, CAST({count} AS BIGINT) AS \"count\""
    )


def _fused(df, add, *args):
    checks = C.ValueChecks(df)
    add(checks, *args)
    return C.report(df, checks.rows())


@register(
    "c1_basic",
    _row("not_empty", None, "count(*) > 0", "error", "count(*)", "'>= 1'", "count(*)") + " FROM lineitem UNION ALL "
    + _row("has_columns", None, "true", "error", "11", "'>= 1'", "11"),
)
def c1_basic(spark, sf_dir):
    return _fused(table(spark, sf_dir, "lineitem"), C.add_basic)


@register(
    "c2_required_columns",
    " UNION ALL ".join(
        f"SELECT 'required_column' AS \"check\", '{c}' AS \"column\", n > 0 AS passed, 'error' AS severity, "
        f"CASE WHEN n > 0 THEN 'True' ELSE 'False' END AS observed, 'True' AS expected, (1 - n)::BIGINT AS \"count\" "
        f"FROM (SELECT count(*) AS n FROM information_schema.columns WHERE table_name = 'orders' AND column_name = '{c}')"
        for c in ("o_orderkey", "o_comment", "o_totalprice")
    ),
)
def c2_required_columns(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return C.report(df, C.required_columns(df, ["o_orderkey", "o_comment", "o_totalprice"]))


@register(
    "c3_column_pattern",
    "SELECT 'column_pattern' AS \"check\", column_name AS \"column\", regexp_matches(column_name, '^o_order') AS passed, "
    "'warning' AS severity, column_name AS observed, 'o_order' AS expected, "
    "(NOT regexp_matches(column_name, '^o_order'))::BIGINT AS \"count\" FROM information_schema.columns WHERE table_name = 'orders'",
)
def c3_column_pattern(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return C.report(df, C.column_names_match(df, "o_order"))


@register(
    "c4_column_types",
    "SELECT 'column_type' AS \"check\", column_name AS \"column\", actual = wanted AS passed, 'warning' AS severity, "
    "actual AS observed, shown AS expected, (actual <> wanted)::BIGINT AS \"count\" FROM "
    "(SELECT column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS actual "
    "FROM information_schema.columns WHERE table_name = 'orders') c JOIN "
    "(VALUES ('o_orderkey', 'bigint', 'int64'), ('o_totalprice', 'string', 'string'), ('o_orderstatus', 'string', 'object')) w(name, wanted, shown) ON name = column_name",
)
def c4_column_types(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    wanted = {"o_orderkey": "int64", "o_totalprice": "string", "o_orderstatus": "object", "absent": "int"}
    return C.report(df, C.column_types(df, wanted))


@register(
    "c5_c6_value_ranges",
    _row("min_value", "l_quantity", "count_if(l_quantity < 5) = 0", "error", "min(l_quantity)", "5", "count_if(l_quantity < 5)") + " FROM lineitem UNION ALL "
    + _row("max_value", "l_quantity", "count_if(l_quantity > 49) = 0", "error", "max(l_quantity)", "49", "count_if(l_quantity > 49)") + " FROM lineitem UNION ALL "
    + _row("min_value", "l_linenumber", "count_if(l_linenumber < 1) = 0", "error", "min(l_linenumber)", "1", "count_if(l_linenumber < 1)") + " FROM lineitem",
)
def c5_c6_value_ranges(spark, sf_dir):
    rules = {"l_quantity": {"min": 5, "max": 49}, "l_linenumber": {"min": 1}, "l_returnflag": {"min": 0}}
    return _fused(table(spark, sf_dir, "lineitem"), C.add_ranges, rules)


@register(
    "c7_missing_percent",
    as_cte(NULLS_NUMERIC)
    + " UNION ALL ".join(
        _row(
            "missing_percent", c, f"100.0 * (count(*) - count({c})) / count(*) <= 50", "warning",
            f"printf('%.2f', 100.0 * (count(*) - count({c})) / count(*))", "'<= 50.00'", f"count(*) - count({c})",
        )
        + " FROM t"
        for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag", "qty", "mostly_null"]
    ),
)
def c7_missing_percent(spark, sf_dir):
    return _fused(derived(spark, sf_dir, NULLS_NUMERIC), C.add_missing)


_REPEATS = "(SELECT count(*) - count(DISTINCT {c}) AS n FROM t)"


@register(
    "c8_duplicate_rows",
    as_cte(DUP_ROWS) + _row("duplicate_rows", None, "n = 0", "warning", "n", "0", "n")
    + " FROM (SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n)",
)
def c8_duplicate_rows(spark, sf_dir):
    df = derived(spark, sf_dir, DUP_ROWS)
    return C.report(df, C.duplicate_rows(df))


@register(
    "c9_duplicate_values",
    as_cte(NULLS_TEXT) + _row("duplicate_values", "priority", "n = 0", "warning", "n", "0", "n")
    + " FROM (SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT priority FROM t)) AS n)",
)
def c9_duplicate_values(spark, sf_dir):
    df = derived(spark, sf_dir, NULLS_TEXT)
    return C.report(df, C.duplicate_rows(df, ["priority"]))


_CUSTOM = [
    {"name": "price per unit", "condition": "l_extendedprice / l_quantity > 1000"},
    {"name": "discount set", "condition": "l_discount >= 0"},
    {"name": "broken", "condition": "no_such_column > 1"},
    {"name": "null is failing", "condition": "nullif(l_tax, 0) > 0"},
]


@register(
    "c10_custom_rules",
    " UNION ALL ".join(
        _row("custom_rule", r["name"], f"count_if(NOT coalesce({r['condition']}, false)) = 0", "warning", "NULL",
             f"'{r['condition']}'", f"count_if(NOT coalesce({r['condition']}, false))") + " FROM lineitem"
        for r in _CUSTOM if r["name"] != "broken"
    ),
)
def c10_custom_rules(spark, sf_dir):
    return _fused(table(spark, sf_dir, "lineitem"), C.add_custom, _CUSTOM)


@register(
    "u1_rule_as_function",
    _row("custom_rule", "late", "count_if(NOT coalesce(l_shipdate >= TIMESTAMP '1995-01-01', false)) = 0", "warning", "NULL", "'late'",
         "count_if(NOT coalesce(l_shipdate >= TIMESTAMP '1995-01-01', false))") + " FROM lineitem",
)
def u1_rule_as_function(spark, sf_dir):
    def late(df):
        return df["l_shipdate"] >= F.lit("1995-01-01").cast("timestamp_ntz")

    return _fused(table(spark, sf_dir, "lineitem"), C.add_custom, [{"name": "late", "condition": late}])


def _number_stats(c, bytes_):
    return (
        f"SELECT '{c}' AS \"column\", {big('count(*) - count(' + c + ')')} AS missing, {bytes_} AS bytes, count({c}) AS \"count\", {rd(f'avg({c})')} AS mean, "
        f"{rd(f'stddev_samp({c})')} AS std, {rd(f'min({c})')} AS min, {rd(f'quantile_cont({c}, 0.25)')} AS q25, "
        f"{rd(f'quantile_cont({c}, 0.5)')} AS q50, {rd(f'quantile_cont({c}, 0.75)')} AS q75, {rd(f'max({c})')} AS max FROM orders"
    )


@register(
    "c11_statistics",
    " UNION ALL ".join(_number_stats(c, "count(*) * 8") for c in ("o_orderkey", "o_custkey", "o_totalprice"))
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', {big('count(*) - count(' + c + ')')}, {size}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders"
        for c, size in (
            ("o_orderstatus", "sum(strlen(o_orderstatus))::BIGINT"),
            ("o_orderpriority", "sum(strlen(o_orderpriority))::BIGINT"),
            ("o_orderdate", "count(*) * 8"),
        )
    ),
)
def c11_statistics(spark, sf_dir):
    return tidy(C.table_statistics(table(spark, sf_dir, "orders")).drop("data_type"))


_RULES = {
    "required_columns": ["o_orderkey", "o_clerk"],
    "value_ranges": {"o_totalprice": {"min": 0, "max": 1000000}},
    "missing_values": {"max_percent": 10},
    "duplicates": {"check_full_rows": True, "unique_columns": ["o_orderkey"]},
    "custom_rules": [{"name": "known status", "condition": "o_orderstatus IN ('F', 'O', 'P')"}],
}


@register(
    "c12_report",
    as_cte(NULLS_TEXT)
    + "SELECT \"check\", \"column\", passed, severity, \"count\" FROM ("
    + " UNION ALL ".join(
        [
            _row("required_column", "o_orderkey", "true", "error", "1", "1", "0"),
            _row("required_column", "o_clerk", "false", "error", "1", "1", "1"),
            _row("not_empty", None, "count(*) > 0", "error", "1", "1", "count(*)") + " FROM t",
            _row("has_columns", None, "true", "error", "1", "1", "4"),
            _row("min_value", "o_totalprice", "count_if(o_totalprice < 0) = 0", "error", "1", "1", "count_if(o_totalprice < 0)") + " FROM t",
            _row("max_value", "o_totalprice", "count_if(o_totalprice > 1000000) = 0", "error", "1", "1", "count_if(o_totalprice > 1000000)") + " FROM t",
            *[
                _row("missing_percent", c, f"100.0 * (count(*) - count({c})) / count(*) <= 10", "warning", "1", "1", f"count(*) - count({c})") + " FROM t"
                for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "priority")
            ],
            _row("custom_rule", "known status", "count_if(NOT coalesce(o_orderstatus IN ('F','O','P'), false)) = 0", "warning", "1", "1", "count_if(NOT coalesce(o_orderstatus IN ('F','O','P'), false))") + " FROM t",
            _row("duplicate_rows", None, "n = 0", "warning", "1", "1", "n") + " FROM (SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n)",
            _row("duplicate_values", "o_orderkey", "n = 0", "warning", "1", "1", "n") + " FROM (SELECT count(*) - count(DISTINCT o_orderkey) AS n FROM t)",
        ]
    )
    + ")",
)
def c12_report(spark, sf_dir):
    report = validation.validate(derived(spark, sf_dir, NULLS_TEXT), _RULES, "orders")
    return report.checks.select("check", "column", "passed", "severity", "count")


@register(
    "c12_summary",
    "SELECT 3::BIGINT AS total_validations, 1::BIGINT + (SELECT (count_if(l_quantity > 49) = 0)::BIGINT FROM lineitem) "
    "+ (SELECT (min(c_acctbal) >= 0)::BIGINT FROM customer) AS passed_validations",
)
def c12_summary(spark, sf_dir):
    path = scratch(spark, "reports")
    runs = [
        ("orders", None),
        ("lineitem", {"value_ranges": {"l_quantity": {"max": 49}}}),
        ("customer", {"value_ranges": {"c_acctbal": {"min": 0}}}),
    ]
    for name, rules in runs:
        validation.save_report(validation.validate(table(spark, sf_dir, name), rules, name), path)
    return validation.summarise_reports(spark.read.parquet(f"{path}/headers"))


@register(
    "w6_latest_records",
    f"SELECT event_id, event_type, {rd('value')} AS value FROM events ORDER BY ts DESC LIMIT 5",
)
def w6_latest_records(spark, sf_dir):
    return tidy(validation.latest(table(spark, sf_dir, "events"), "ts").select("event_id", "event_type", "value"))


def outcome(spark, run) -> str:
    try:
        run()
        return "passed"
    except CheckError as e:
        return str(e)


@register(
    "c13_assert_table",
    as_cte(NULLS_TEXT)
    + "SELECT 'clean' AS case_name, CASE WHEN (SELECT count(*) FROM orders) >= 100 THEN 'passed' END AS outcome "
    "UNION ALL SELECT 'nulls', CASE WHEN (SELECT count(*) - count(priority) FROM t) > 0 THEN 'null values found' ELSE 'passed' END "
    "UNION ALL SELECT 'not numeric', 'column is not numeric: o_orderstatus' "
    "UNION ALL SELECT 'too many', (SELECT count(*) || ' rows, more than 10' FROM orders)",
)
def c13_assert_table(spark, sf_dir):
    orders, gaps = table(spark, sf_dir, "orders"), derived(spark, sf_dir, NULLS_TEXT)
    cases = [
        ("clean", lambda: C.assert_table(orders, ["o_orderkey"], ["o_totalprice"], ["o_orderstatus"], min_rows=100)),
        ("nulls", lambda: C.assert_table(gaps)),
        ("not numeric", lambda: C.assert_table(orders, numeric_columns=["o_orderstatus"])),
        ("too many", lambda: C.assert_table(orders, max_rows=10)),
    ]
    rows = [(name, outcome(spark, run)) for name, run in cases]
    return spark.createDataFrame(rows, "case_name string, outcome string")


@register(
    "c14_column_names",
    "SELECT rule AS \"check\", column_name AS \"column\", ok AS passed FROM ("
    "SELECT 'name_unique' AS rule, column_name, true AS ok FROM information_schema.columns WHERE table_name = 'orders' UNION ALL "
    "SELECT 'name_length', column_name, length(column_name) <= 11 FROM information_schema.columns WHERE table_name = 'orders' UNION ALL "
    "SELECT 'name_prefix', column_name, starts_with(column_name, 'o_order') FROM information_schema.columns WHERE table_name = 'orders' UNION ALL "
    "SELECT 'name_suffix', column_name, ends_with(column_name, 'key') FROM information_schema.columns WHERE table_name = 'orders' UNION ALL "
    "SELECT 'names_present', NULL, true)",
)
def c14_column_names(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    rows = C.column_names(df.columns, max_length=11, prefix="o_order", suffix="key")
    return C.report(df, rows).select("check", "column", "passed")


@register(
    "c15_numeric_range",
    as_cte(NON_FINITE)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count_if(isnan({c}))::BIGINT AS nan_count, count_if(isinf({c}))::BIGINT AS infinite_count, "
        f"count_if(NOT isnan({c}) AND {c} < 0.05)::BIGINT AS below_count, count_if(NOT isnan({c}) AND {c} > 40)::BIGINT AS above_count FROM t"
        for c in ("l_discount", "q")
    ),
)
def c15_numeric_range(spark, sf_dir):
    return C.numeric_range(derived(spark, sf_dir, NON_FINITE), ["l_discount", "q"], 0.05, 40)


@register(
    "x7_finite",
    as_cte(NON_FINITE) + "SELECT isnan(q) AS is_nan, isinf(q) AS is_infinite, count(*) AS n FROM t GROUP BY 1, 2",
)
def x7_finite(spark, sf_dir):
    df = derived(spark, sf_dir, NON_FINITE)
    infinite = F.abs("q") == F.lit(float("inf"))
    return df.groupBy(F.isnan("q").alias("is_nan"), infinite.alias("is_infinite")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "c16_categories",
    as_cte(NULLS_TEXT)
    + "SELECT (count(*) - count(priority))::BIGINT AS null_count, count(DISTINCT priority) AS category_count, "
    "count(DISTINCT CASE WHEN priority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN priority END) AS unexpected_count FROM t",
)
def c16_categories(spark, sf_dir):
    return C.category_facts(derived(spark, sf_dir, NULLS_TEXT), "priority", ["1-URGENT", "2-HIGH", "5-LOW"])


@register(
    "s3_unexpected_values",
    "SELECT p_brand AS value, count(*) AS \"count\" FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY p_brand",
)
def s3_unexpected_values(spark, sf_dir):
    return C.unexpected_values(table(spark, sf_dir, "part"), "p_brand", ["Brand#1", "Brand#2", "Brand#3"])


@register(
    "c17_clustering_input",
    "SELECT 'fine' AS case_name, CASE WHEN (SELECT count(*) FROM events) > 0 THEN 'passed' END AS outcome UNION ALL "
    "SELECT 'text column', 'column is not numeric: event_type' UNION ALL "
    "SELECT 'unknown method', 'unknown clustering method for value: Ward' UNION ALL "
    "SELECT 'absent column', 'missing required columns: [''load'']'",
)
def c17_clustering_input(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    cases = [
        ("fine", {"value": {"method": "KMeans", "columns": ["value", "user_id"]}}),
        ("text column", {"value": {"method": "KMeans", "columns": ["event_type"]}}),
        ("unknown method", {"value": {"method": "Ward", "columns": ["value"]}}),
        ("absent column", {"value": {"method": "DBSCAN", "columns": ["load"]}}),
    ]
    rows = [(name, outcome(spark, lambda c=c: C.assert_clustering_input(df, c))) for name, c in cases]
    return spark.createDataFrame(rows, "case_name string, outcome string")


@register(
    "c18_training_input",
    as_cte(NULLS_NUMERIC)
    + "SELECT count(*) AS rows, count(qty) AS target_rows, "
    "sum((l_discount IS NULL)::INT + (mostly_null IS NULL)::INT)::BIGINT AS missing_cells FROM t",
)
def c18_training_input(spark, sf_dir):
    return C.training_facts(derived(spark, sf_dir, NULLS_NUMERIC), ["l_discount", "mostly_null"], "qty")


@register(
    "u2_own_checks",
    "SELECT 'enough customers' AS case_name, CASE WHEN count(*) >= 10 THEN 'passed' ELSE 'too few' END AS outcome FROM customer "
    "UNION ALL SELECT 'no debts', CASE WHEN count_if(c_acctbal < 0) = 0 THEN 'passed' ELSE 'debts found' END FROM customer",
)
def u2_own_checks(spark, sf_dir):
    df = table(spark, sf_dir, "customer")

    def enough(t):
        if t.limit(10).count() < 10:
            raise CheckError("too few")

    def no_debts(t):
        if t.filter("c_acctbal < 0").limit(1).count():
            raise CheckError("debts found")

    rows = [
        (name, outcome(spark, lambda test=test: df.transform(C.checked(test))))
        for name, test in (("enough customers", enough), ("no debts", no_debts))
    ]
    return spark.createDataFrame(rows, "case_name string, outcome string")
