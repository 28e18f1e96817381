"""Cleaning steps, the clean pipeline, scalar functions and nested fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    DIRTY_TEXT, DUP_ROWS, NULLS_NUMERIC, NULLS_TEXT, TYPED_TEXT, as_cte, big, derived, rd, register,
    table, tidy,
)
from tablewright.functions import scalars, text
from tablewright.functions.kinds import ref
from tablewright.operators import casting, duplicates, missing, nested, outliers, values
from tablewright.plans import cleaning

# --- B2, W1, W2 ------------------------------------------------------------------

_EVENT = "event_id, user_id, event_type, value"


def _first_sql(order):
    return (
        f"SELECT {_EVENT.replace('value', rd('value') + ' AS value')} FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY user_id, event_type ORDER BY {order}) AS rn FROM events) WHERE rn = 1"
    )


@register("b2_keep_first", _first_sql("ts, event_id"))
def b2_keep_first(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    out = duplicates.drop_duplicates(df, ["user_id", "event_type"], "first", ["ts", "event_id"])
    return tidy(out.selectExpr(*_EVENT.split(", ")))


@register("b2_keep_last", _first_sql("ts DESC, event_id DESC"))
def b2_keep_last(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    out = duplicates.drop_duplicates(df, ["user_id", "event_type"], "last", ["ts", "event_id"])
    return tidy(out.selectExpr(*_EVENT.split(", ")))


@register(
    "b2_keep_none",
    as_cte(DUP_ROWS)
    + "SELECT o_orderkey, o_orderstatus, "
    + rd("o_totalprice")
    + " AS o_totalprice FROM t QUALIFY count(*) OVER (PARTITION BY o_orderkey) = 1",
)
def b2_keep_none(spark, sf_dir):
    out = duplicates.drop_duplicates(derived(spark, sf_dir, DUP_ROWS), ["o_orderkey"], "none")
    return tidy(out.select("o_orderkey", "o_orderstatus", "o_totalprice"))


@register(
    "b2_whole_rows",
    as_cte(DUP_ROWS)
    + f"SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, {rd('o_totalprice')} AS o_totalprice, "
    "o_orderdate, o_orderpriority FROM t",
)
def b2_whole_rows(spark, sf_dir):
    return tidy(duplicates.drop_duplicates(derived(spark, sf_dir, DUP_ROWS)))


@register(
    "w2_repeat_flag",
    "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type "
    "ORDER BY ts, event_id) > 1 AS is_repeat FROM events",
)
def w2_repeat_flag(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return duplicates.flag_repeats(df, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


# --- B3 to B7 ----------------------------------------------------------------------

_KEPT = "l_orderkey, l_linenumber, l_partkey, l_returnflag, qty"


@register(
    "b3_drop_sparse_columns",
    as_cte(NULLS_NUMERIC)
    + f"SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, {rd('l_extendedprice')} AS l_extendedprice, "
    f"{rd('l_discount')} AS l_discount, l_returnflag, {rd('qty')} AS qty FROM t",
)
def b3_drop_sparse_columns(spark, sf_dir):
    return tidy(missing.drop_sparse_columns(derived(spark, sf_dir, NULLS_NUMERIC)))


@register(
    "b4_drop_incomplete_rows",
    as_cte(NULLS_TEXT)
    + f"SELECT o_orderkey, o_orderstatus, {rd('o_totalprice')} AS o_totalprice, priority FROM t WHERE priority IS NOT NULL",
)
def b4_drop_incomplete_rows(spark, sf_dir):
    return tidy(missing.drop_incomplete_rows(derived(spark, sf_dir, NULLS_TEXT)))


@register(
    "b5_fill_given",
    as_cte(NULLS_TEXT)
    + f"SELECT o_orderkey, o_orderstatus, {rd('o_totalprice')} AS o_totalprice, coalesce(priority, 'unknown') AS priority FROM t",
)
def b5_fill_given(spark, sf_dir):
    return tidy(missing.fill_values(derived(spark, sf_dir, NULLS_TEXT), {"priority": "unknown"}))


_WHOLE_GAPS = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS qty,
       CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_suppkey END AS supp,
       l_extendedprice FROM lineitem
"""


@register(
    "b6_fill_mean",
    as_cte(_WHOLE_GAPS)
    + f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {rd('coalesce(qty, (SELECT avg(qty) FROM t))')} AS qty, "
    f"{rd('coalesce(supp::DOUBLE, (SELECT avg(supp) FROM t))')} AS supp, {rd('l_extendedprice')} AS l_extendedprice FROM t",
)
def b6_fill_mean(spark, sf_dir):
    return tidy(missing.fill_missing(derived(spark, sf_dir, _WHOLE_GAPS)))


@register(
    "b7_fill_mode",
    as_cte(NULLS_TEXT)
    + f"SELECT o_orderkey, o_orderstatus, {rd('o_totalprice')} AS o_totalprice, coalesce(priority, "
    "(SELECT priority FROM t WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM t",
)
def b7_fill_mode(spark, sf_dir):
    return tidy(missing.fill_missing(derived(spark, sf_dir, NULLS_TEXT)))


# --- B8, B9, X5 ----------------------------------------------------------------------


@register(
    "b8_cast",
    as_cte(TYPED_TEXT)
    + f"SELECT o_orderkey, whole_text::BIGINT AS whole_text, {rd('decimal_text')} AS decimal_text, "
    "mixed_text, 'mixed_text' AS kept FROM t",
)
def b8_cast(spark, sf_dir):
    df = derived(spark, sf_dir, TYPED_TEXT).drop("date_text", "flag_text")
    out, kept = casting.cast_columns(df, {"whole_text": "int64", "decimal_text": "float64", "mixed_text": "int64"})
    return tidy(out.withColumn("kept", F.lit(",".join(sorted(kept)))))


@register(
    "b9_infer_types",
    as_cte(TYPED_TEXT)
    + f"SELECT o_orderkey, whole_text::BIGINT AS whole_text, {rd('decimal_text')} AS decimal_text, "
    "date_text::TIMESTAMP AS date_text, lower(flag_text) = 'yes' AS flag_text, mixed_text FROM t",
)
def b9_infer_types(spark, sf_dir):
    return tidy(casting.infer_and_convert(derived(spark, sf_dir, TYPED_TEXT)))


@register(
    "x5_parse",
    as_cte(TYPED_TEXT)
    + f"SELECT o_orderkey, {rd('TRY_CAST(mixed_text AS DOUBLE)')} AS as_number, TRY_CAST(date_text AS TIMESTAMP) AS as_time, "
    "CASE WHEN lower(flag_text) = 'yes' THEN true ELSE false END AS as_boolean, "
    "CAST(o_orderkey AS VARCHAR) AS as_text FROM t",
)
def x5_parse(spark, sf_dir):
    df = derived(spark, sf_dir, TYPED_TEXT)
    return tidy(
        df.select(
            "o_orderkey",
            scalars.parse_number(F.col("mixed_text")).alias("as_number"),
            scalars.parse_datetime(F.col("date_text")).alias("as_time"),
            scalars.parse_boolean(F.col("flag_text")).alias("as_boolean"),
            F.col("o_orderkey").cast("string").alias("as_text"),
        )
    )


# --- B10, B11 --------------------------------------------------------------------------


@register(
    "b10_remove_zscore",
    f"""
    WITH t AS (SELECT event_id, value, value * value AS square FROM events),
    a AS (SELECT t.* FROM t, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM t) WHERE abs((value - m) / s) <= 3),
    b AS (SELECT a.* FROM a, (SELECT avg(square) AS m, stddev_samp(square) AS s FROM a) WHERE abs((square - m) / s) <= 3)
    SELECT event_id, {rd('value')} AS value, {rd('square')} AS square FROM b
    """,
)
def b10_remove_zscore(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "value", "value * value AS square")
    return tidy(outliers.remove_outliers(df, "zscore", 3, ["value", "square"]))


def _fence(c, k):
    return (
        f"SELECT s.* FROM {{0}} s, (SELECT quantile_cont({c}, 0.25) AS lo, quantile_cont({c}, 0.75) AS hi FROM {{0}}) "
        f"WHERE {c} BETWEEN lo - {k} * (hi - lo) AND hi + {k} * (hi - lo)"
    )


@register(
    "b11_remove_iqr",
    f"""
    WITH t AS (SELECT event_id, value, value * value AS square FROM events),
    a AS ({_fence('value', 3).format('t')}), b AS ({_fence('square', 3).format('a')})
    SELECT event_id, {rd('value')} AS value, {rd('square')} AS square FROM b
    """,
)
def b11_remove_iqr(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "value", "value * value AS square")
    return tidy(outliers.remove_outliers(df, "iqr", columns=["value", "square"]))


# --- B12 to B18, X1 to X4 -------------------------------------------------------------


def _text_query(name, operations, sql):
    @register(name, as_cte(DIRTY_TEXT) + f"SELECT p_partkey, {sql} AS dirty, p_type FROM t")
    def query(spark, sf_dir):
        return values.standardise_text(derived(spark, sf_dir, DIRTY_TEXT), ["dirty"], operations)


_text_query("b12_lowercase", ["lowercase"], "lower(dirty)")
_text_query("b13_strip", ["strip"], "regexp_replace(dirty, '^\\s+|\\s+$', '', 'g')")
_text_query("b14_collapse_spaces", ["spaces"], "regexp_replace(dirty, '\\s+', ' ', 'g')")
_text_query(
    "x1_standardise_text",
    ["lowercase", "strip", "spaces"],
    "regexp_replace(regexp_replace(lower(dirty), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')",
)


@register(
    "b15_keep_range",
    f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {rd('l_quantity')} AS l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
)
def b15_keep_range(spark, sf_dir):
    out = values.keep_range(table(spark, sf_dir, "lineitem"), "l_quantity", 10, 20)
    return tidy(out.select("l_orderkey", "l_linenumber", "l_quantity"))


@register(
    "b16_keep_pattern",
    "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^(?:https://[a-z.]+/(en|fr))')",
)
def b16_keep_pattern(spark, sf_dir):
    out = values.keep_pattern(table(spark, sf_dir, "pages"), "url", r"https://[a-z.]+/(en|fr)")
    return out.select("page_id", "url")


@register(
    "x2_match_from_start",
    "SELECT p_partkey, p_name, regexp_matches(p_name, '^(?:red|b)') AS matches FROM part",
)
def x2_match_from_start(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", "p_name", text.matches_from_start(F.col("p_name"), "red|b").alias("matches"))


@register(
    "b17_keep_allowed",
    as_cte(NULLS_TEXT)
    + f"SELECT o_orderkey, o_orderstatus, {rd('o_totalprice')} AS o_totalprice, priority FROM t WHERE priority IN ('1-URGENT', '2-HIGH')",
)
def b17_keep_allowed(spark, sf_dir):
    return tidy(values.keep_allowed(derived(spark, sf_dir, NULLS_TEXT), "priority", ["1-URGENT", "2-HIGH"]))


@register(
    "b17_keep_allowed_long",
    f"SELECT c_custkey, {rd('c_acctbal')} AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_custkey < 6000",
)
def b17_keep_allowed_long(spark, sf_dir):
    out = values.keep_allowed(table(spark, sf_dir, "customer"), "c_custkey", range(0, 6000, 3))
    return tidy(out.select("c_custkey", "c_acctbal"))


@register(
    "x3_membership",
    "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_urgent FROM orders",
)
def x3_membership(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_urgent"))


@register(
    "b18_replace",
    as_cte(NULLS_TEXT)
    + f"SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, "
    f"{rd('o_totalprice')} AS o_totalprice, CASE priority WHEN '4-NOT SPECIFIED' THEN 'none' ELSE priority END AS priority FROM t",
)
def b18_replace(spark, sf_dir):
    rules = {"o_orderstatus": {"F": "O", "O": "F"}, "priority": {"4-NOT SPECIFIED": "none"}}
    return tidy(values.apply_replacements(derived(spark, sf_dir, NULLS_TEXT), rules))


@register(
    "x4_map_values",
    "SELECT c_custkey, CASE WHEN c_custkey < 3000 AND c_custkey % 2 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS mapped FROM customer",
)
def x4_map_values(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey AS mapped")
    return values.replace_values(df, "mapped", {k: k + 1_000_000 for k in range(0, 3000, 2)})


# --- B1, B19, B20 -------------------------------------------------------------------------

_MESSY = f"""
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 10 <> 0 THEN NULL ELSE o_totalprice END AS sparse,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price,
       concat('  ', o_orderpriority, '  ') AS priority,
       CAST(o_custkey AS VARCHAR(40)) AS cust_text
FROM ({DUP_ROWS})
"""

_CLEAN_CONFIG = {
    "remove_duplicates": {"keep": "first"},
    "handle_missing_values": {"strategy": "remove", "threshold": 0.5},
    "fix_datatypes": {"infer_types": True},
    "handle_outliers": {"method": "zscore", "threshold": 1.5, "columns": ["price"]},
    "standardize_text": {"operations": ["lowercase", "strip", "spaces"]},
    "validate_values": {"validations": {"o_custkey": {"range": [10, 100000]}, "priority": {"pattern": "[1-4]-"}}},
    "fix_inconsistencies": {"replacements": {"priority": {"4-not specified": "none"}}},
}

_CLEAN_STEPS = f"""
WITH t AS ({_MESSY.replace('VARCHAR(40)', 'VARCHAR')}),
s1 AS (SELECT DISTINCT * FROM t),
s2 AS (SELECT o_orderkey, o_custkey, price, priority, cust_text FROM s1 WHERE price IS NOT NULL),
s3 AS (SELECT * REPLACE (cust_text::BIGINT AS cust_text) FROM s2),
s4 AS (SELECT s3.* FROM s3, (SELECT avg(price) AS m, stddev_samp(price) AS s FROM s3) WHERE abs((price - m) / s) <= 1.5),
s5 AS (SELECT * REPLACE (trim(lower(priority)) AS priority) FROM s4),
s6 AS (SELECT * FROM s5 WHERE o_custkey BETWEEN 10 AND 100000 AND regexp_matches(priority, '^[1-4]-')),
s7 AS (SELECT * REPLACE (CASE priority WHEN '4-not specified' THEN 'none' ELSE priority END AS priority) FROM s6)
"""


def _cleaned(spark, sf_dir):
    return cleaning.clean(derived(spark, sf_dir, _MESSY), _CLEAN_CONFIG)


@register(
    "b1_clean",
    _CLEAN_STEPS + f"SELECT o_orderkey, o_custkey, {rd('price')} AS price, priority, cust_text FROM s7",
)
def b1_clean(spark, sf_dir):
    return tidy(_cleaned(spark, sf_dir).table)


_STEP_NAMES = [
    "remove_duplicates", "handle_missing_values", "fix_datatypes", "handle_outliers",
    "standardize_text", "validate_values", "fix_inconsistencies",
]


@register(
    "b19_step_ledger",
    _CLEAN_STEPS
    + " UNION ALL ".join(
        f"SELECT {i + 1}::BIGINT AS position, '{name}' AS step, (SELECT count(*) FROM t) AS initial_rows, "
        f"(SELECT count(*) FROM s{i + 1}) AS final_rows, "
        f"(SELECT count(*) FROM t) - (SELECT count(*) FROM s{i + 1}) AS rows_removed, "
        f"(SELECT count(*) FROM {'t' if i == 0 else f's{i}'}) - (SELECT count(*) FROM s{i + 1}) AS step_removed"
        for i, name in enumerate(_STEP_NAMES)
    ),
)
def b19_step_ledger(spark, sf_dir):
    return tidy(_cleaned(spark, sf_dir).ledger())


@register(
    "b20_clean_summary",
    _CLEAN_STEPS
    + "SELECT (SELECT count(*) FROM t) AS initial_rows, (SELECT count(*) FROM s7) AS final_rows, "
    "(SELECT count(*) FROM t) - (SELECT count(*) FROM s7) AS rows_removed, 6::BIGINT AS initial_columns, "
    "5::BIGINT AS final_columns, 1::BIGINT AS columns_removed, "
    "(SELECT sum((sparse IS NULL)::BIGINT + (price IS NULL)::BIGINT)::BIGINT FROM t) AS null_values_removed, 7::BIGINT AS cleaning_steps",
)
def b20_clean_summary(spark, sf_dir):
    return tidy(_cleaned(spark, sf_dir).summary())


@register(
    "b1_clean_default",
    as_cte(NULLS_TEXT)
    + f"SELECT o_orderkey, o_orderstatus, {rd('o_totalprice')} AS o_totalprice, priority FROM t WHERE priority IS NOT NULL",
)
def b1_clean_default(spark, sf_dir):
    return tidy(cleaning.clean(derived(spark, sf_dir, NULLS_TEXT)).table)


@register(
    "x6_null_test",
    as_cte(NULLS_TEXT)
    + f"SELECT o_orderstatus, count_if(priority IS NULL)::BIGINT AS nulls, {rd('100.0 * count_if(priority IS NULL) / count(*)')} AS null_percent FROM t GROUP BY 1",
)
def x6_null_test(spark, sf_dir):
    df = derived(spark, sf_dir, NULLS_TEXT)
    return tidy(
        df.groupBy("o_orderstatus").agg(
            F.count_if(F.col("priority").isNull()).alias("nulls"),
            F.avg(F.when(F.col("priority").isNull(), 100.0).otherwise(0.0)).alias("null_percent"),
        )
    )


# --- X8 to X11, H1 ------------------------------------------------------------------------------


@register(
    "x8_zscore",
    f"SELECT event_id, {rd('abs((value - m) / s)', 6)} AS distance FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)",
)
def x8_zscore(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    m, s = df.agg(F.avg("value"), F.stddev_samp("value")).first()
    return tidy(df.select("event_id", F.abs((F.col("value") - m) / s).alias("distance")), 6)


@register(
    "x9_display_width",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (greatest(max(length({c}::VARCHAR)), {len(c)}) + 2)::BIGINT AS width FROM part"
        for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    ),
)
def x9_display_width(spark, sf_dir):
    from tablewright.operators.fused import per_column

    df = table(spark, sf_dir, "part").drop("p_retailprice")
    return tidy(per_column(df, df.columns, {"width": scalars.display_width}))


@register(
    "x10_human_size",
    "SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.2f B', s) WHEN s < 1048576 THEN printf('%.2f KB', s / 1024) "
    "WHEN s < 1073741824 THEN printf('%.2f MB', s / 1048576) ELSE printf('%.2f GB', s / 1073741824) END AS size_text "
    "FROM (SELECT doc_id, (n_chars * n_chars)::DOUBLE AS s FROM documents)",
)
def x10_human_size(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", scalars.human_size(F.col("n_chars") * F.col("n_chars")).alias("size_text"))


@register("x11_time_stamp", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def x11_time_stamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.stamp(F.col("ts")).alias("stamp"))


@register(
    "h1_flatten",
    f"SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"info_props_k\", event_type AS \"info_kind\", {rd('value')} AS value FROM events",
)
def h1_flatten(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(F.from_json("props", "k bigint").alias("props"), F.col("event_type").alias("kind")).alias("info"),
        "value",
    )
    return tidy(nested.flatten(df, "_"))


@register("s1_union_all", f"SELECT o_orderstatus, count(*) AS n, {rd('sum(o_totalprice)', 2)} AS total FROM ({DUP_ROWS}) GROUP BY o_orderstatus")
def s1_union_all(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    both = orders.unionByName(orders.filter("o_orderkey % 50 = 0"))
    return tidy(both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)
