"""Imputing, scaling, encoding, and the features and models of configurations."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from catalog.base import KNN_ROWS, NULLS_NUMERIC, NULLS_TEXT, as_cte, big, derived, rd, register, scratch, table, tidy
from tablewright.operators import features
from tablewright.operators.neighbours import nearest_fill
from tablewright.plans import preparing
from tablewright.plans.preparing import PrepBook, PrepSpec
from tablewright.plans.stages import PrepEstimator

# --- E1 to E4 ------------------------------------------------------------------

_ITEM = "l_orderkey, l_linenumber::BIGINT AS l_linenumber"


def _imputed(spark, sf_dir, method, scaling="minmax"):
    df = derived(spark, sf_dir, NULLS_NUMERIC)
    spec = PrepSpec(["qty", "l_discount"], imputation=method, scaling=scaling)
    fitted = preparing.fit(df, spec)
    return tidy(fitted.transform(df, ["l_orderkey", "l_linenumber"]), 6)


def _minmax(fill):
    return (
        as_cte(NULLS_NUMERIC)
        + f", f AS (SELECT l_orderkey, l_linenumber, coalesce(qty, ({fill})) AS qty, l_discount FROM t) "
        + f"SELECT {_ITEM}, {rd('(qty - (SELECT min(qty) FROM f)) / (SELECT max(qty) - min(qty) FROM f)', 6)} AS qty, "
        + f"{rd('(l_discount - (SELECT min(l_discount) FROM f)) / (SELECT max(l_discount) - min(l_discount) FROM f)', 6)} AS l_discount FROM f"
    )


_MODE = "SELECT qty FROM t WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1"


@register("e1_impute_mean", _minmax("SELECT avg(qty) FROM t"))
def e1_impute_mean(spark, sf_dir):
    return _imputed(spark, sf_dir, "mean")


@register("e2_impute_median", _minmax("SELECT quantile_cont(qty, 0.5) FROM t"))
def e2_impute_median(spark, sf_dir):
    return _imputed(spark, sf_dir, "median")


@register("e3_impute_most_frequent", _minmax(_MODE))
def e3_impute_most_frequent(spark, sf_dir):
    return _imputed(spark, sf_dir, "most_frequent")


def nearest_sql(cte, key, target, others):
    """Nearest five rows that have the target, over the other columns (no nulls there)."""
    n = len(others) + 1
    distance = " + ".join(f"(q.{c} - d.{c}) * (q.{c} - d.{c})" for c in others)
    return (
        cte
        + f", near AS (SELECT q.{key} AS k, d.{target} AS v, row_number() OVER (PARTITION BY q.{key} "
        f"ORDER BY ({distance}) * {n}.0 / {len(others)}, d.{target}) AS place FROM t q, t d "
        f"WHERE q.{target} IS NULL AND d.{target} IS NOT NULL) "
        f"SELECT t.{key}, {', '.join(rd('t.' + c) + ' AS ' + c for c in others)}, "
        f"{rd(f't_fill.{target}')} AS {target} FROM t JOIN (SELECT t.{key} AS k, coalesce(any_value(t.{target}), avg(v)) AS {target} "
        f"FROM t LEFT JOIN near ON near.k = t.{key} AND place <= 5 GROUP BY t.{key}) t_fill ON t_fill.k = t.{key}"
    )


@register("e4_impute_nearest", nearest_sql(as_cte(KNN_ROWS), "s_suppkey", "acctbal", ["s_nationkey"]))
def e4_impute_nearest(spark, sf_dir):
    df = derived(spark, sf_dir, KNN_ROWS)
    return tidy(nearest_fill(df, ["s_nationkey", "acctbal"]))


_KNN_EVENTS = """
SELECT event_id, CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS value,
       CAST(user_id AS DOUBLE) AS user_id, CAST(event_id % 997 AS DOUBLE) AS phase FROM events
"""


@register("e4_impute_nearest_events", nearest_sql(as_cte(_KNN_EVENTS), "event_id", "value", ["user_id", "phase"]))
def e4_impute_nearest_events(spark, sf_dir):
    return tidy(nearest_fill(derived(spark, sf_dir, _KNN_EVENTS), ["value", "user_id", "phase"]))


# --- E5, E11 to E13 --------------------------------------------------------------

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "missing"]


def _encoded(spark, sf_dir, method):
    df = derived(spark, sf_dir, NULLS_TEXT)
    fitted = preparing.fit(df, PrepSpec([], ["priority"], encoding=method))
    return tidy(fitted.transform(df, ["o_orderkey"]))


def _codes(c="coalesce(priority, 'missing')"):
    return "CASE " + c + " " + " ".join(f"WHEN '{v}' THEN {float(i)}" for i, v in enumerate(_PRIORITIES)) + " END::DOUBLE"


@register(
    "e5_e11_one_hot",
    as_cte(NULLS_TEXT)
    + "SELECT o_orderkey, "
    + ", ".join(f"(coalesce(priority, 'missing') = '{v}')::INT::DOUBLE AS \"priority_{v}\"" for v in _PRIORITIES)
    + " FROM t",
)
def e5_e11_one_hot(spark, sf_dir):
    return _encoded(spark, sf_dir, "onehot")


@register("e12_label", as_cte(NULLS_TEXT) + f"SELECT o_orderkey, {_codes()} AS priority FROM t")
def e12_label(spark, sf_dir):
    return _encoded(spark, sf_dir, "label")


@register("e13_ordinal", as_cte(NULLS_TEXT) + f"SELECT o_orderkey, {_codes()} AS priority FROM t")
def e13_ordinal(spark, sf_dir):
    return _encoded(spark, sf_dir, "ordinal")


@register(
    "e13_ordinal_many",
    "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::DOUBLE AS c_name FROM customer",
)
def e13_ordinal_many(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    fitted = preparing.fit(df, PrepSpec([], ["c_name"], encoding="ordinal"), inline_categories=50)
    return tidy(fitted.transform(df, ["c_custkey"]))


@register(
    "e11_sparse_one_hot",
    "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::INTEGER AS slot, 1.0::DOUBLE AS value, "
    "(SELECT count(DISTINCT c_name) FROM customer)::INTEGER AS size FROM customer",
)
def e11_sparse_one_hot(spark, sf_dir):
    # a slot per name: the names stay in their table
    df = table(spark, sf_dir, "customer")
    fitted = preparing.fit(df, PrepSpec([], ["c_name"], encoding="sparse"))
    cell = F.unwrap_udt("c_name")
    return fitted.transform(df, ["c_custkey"]).select(
        "c_custkey", cell["indices"][0].alias("slot"), cell["values"][0].alias("value"), cell["size"].alias("size")
    )


# --- E6 to E10 ---------------------------------------------------------------------


def _scaled(spark, sf_dir, method):
    df = table(spark, sf_dir, "events")
    spec = PrepSpec(["value", "user_id"], scaling=method)
    return tidy(preparing.fit(df, spec).transform(df, ["event_id"]), 6)


def _scaled_sql(cell):
    return "SELECT event_id, " + ", ".join(f"{rd(cell(c), 6)} AS {c}" for c in ("value", "user_id")) + " FROM events"


@register("e6_standard_scale", _scaled_sql(lambda c: f"({c} - (SELECT avg({c}) FROM events)) / (SELECT stddev_pop({c}) FROM events)"))
def e6_standard_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@register("e7_minmax_scale", _scaled_sql(lambda c: f"({c} - (SELECT min({c}) FROM events)) / (SELECT (max({c}) - min({c}))::DOUBLE FROM events)"))
def e7_minmax_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@register(
    "e8_robust_scale",
    _scaled_sql(
        lambda c: f"({c} - (SELECT quantile_cont({c}, 0.5) FROM events)) / "
        f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM events)"
    ),
)
def e8_robust_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


@register(
    "e7_constant_column",
    "SELECT event_id, 0.0::DOUBLE AS one FROM events",
)
def e7_constant_column(spark, sf_dir):
    df = table(spark, sf_dir, "events").selectExpr("event_id", "1.0D AS one")
    return tidy(preparing.fit(df, PrepSpec(["one"], scaling="minmax")).transform(df, ["event_id"]))


def _power_cell(x, lam):
    def part(base, power):
        return f"CASE WHEN abs({power}) < 1e-12 THEN ln({base}) ELSE (pow({base}, {power}) - 1) / ({power}) END"

    return f"CASE WHEN {x} >= 0 THEN {part(f'(1 + {x})', lam)} ELSE -({part(f'(1 - {x})', f'(2 - {lam})')}) END"


def _power_sql(columns, key, source):
    """Lambda of the largest likelihood on grids ever finer, and the top of the parabola through the last three."""
    ctes, shown = [], []
    for c in columns:
        ctes.append(f"v_{c} AS (SELECT {key}, {c}::DOUBLE AS x FROM {source})")
        ctes.append(f"b_{c} AS (SELECT count(x) AS n, sum(sign(x) * ln(1 + abs(x))) AS slope FROM v_{c})")
        grid, step, rounds = "SELECT -2 + 0.5::DOUBLE * k AS lam FROM range(13) r(k)", 0.5, 0
        while True:
            ctes.append(f"g_{c}_{rounds} AS ({grid})")
            ctes.append(
                f"s_{c}_{rounds} AS (SELECT lam, -any_value(n) / 2.0::DOUBLE * ln(var_pop({_power_cell('x', 'lam')})) + (lam - 1) * any_value(slope) AS score "
                f"FROM v_{c}, b_{c}, g_{c}_{rounds} GROUP BY lam)"
            )
            if step <= 0.0005:
                break
            step, rounds = step / 4, rounds + 1
            grid = f"SELECT best + (k - 4) * {step!r}::DOUBLE AS lam FROM (SELECT arg_max(lam, score) AS best FROM s_{c}_{rounds - 1}), range(9) r(k)"
        ctes.append(
            f"t_{c} AS (SELECT lam, score, lag(score) OVER w AS below, lead(score) OVER w AS above FROM s_{c}_{rounds} WINDOW w AS (ORDER BY lam))"
        )
        ctes.append(
            f"m_{c} AS (SELECT lam + {step!r}::DOUBLE * (below - above) / (2 * (below - 2 * score + above)) AS lam FROM t_{c} ORDER BY score DESC LIMIT 1)"
        )
        ctes.append(f"y_{c} AS (SELECT {key}, {_power_cell('x', 'lam')} AS y FROM v_{c}, m_{c})")
        shown.append(
            f"(SELECT {key}, {rd('(y - avg(y) OVER ()) / stddev_pop(y) OVER ()', 6)} AS {c} FROM y_{c})"
        )
    return f"WITH {', '.join(ctes)} SELECT * FROM {shown[0]}" + "".join(f" JOIN {t} USING ({key})" for t in shown[1:])


@register("e9_power_scale", _power_sql(["value", "user_id"], "event_id", "events"))
def e9_power_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, "power")


# A rational approximation of the normal quantile, middle and tail, good to 1e-9.
_MIDDLE_OVER = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239]
_MIDDLE_UNDER = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
_TAIL_OVER = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
_TAIL_UNDER = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]


def _polynomial(terms, x):
    out = f"({terms[0]!r})::DOUBLE"
    for t in terms[1:]:
        out = f"({out} * {x} + ({t!r})::DOUBLE)"
    return out


def _quantile_sql(columns, key, source):
    """Positions between landmarks, then the normal quantile: an approximation and two Newton steps."""
    ctes = []
    middle, tail = "(p - 0.5)", "sqrt(-2 * ln(least(p, 1 - p)))"
    square = f"({middle} * {middle})"
    guess = (
        f"CASE WHEN p BETWEEN 0.02425 AND 0.97575 THEN {_polynomial(_MIDDLE_OVER, square)} * {middle} / {_polynomial(_MIDDLE_UNDER, square)} "
        f"ELSE sign(0.5 - p) * {_polynomial(_TAIL_OVER, tail)} / {_polynomial(_TAIL_UNDER, tail)} END"
    )
    series = (
        "list_reduce(list_transform(range(1, 90), lambda k: {'k': k::DOUBLE, 't': 0::DOUBLE, 's': 0::DOUBLE}), "
        "lambda a, e: {'k': e.k, 't': a.t * z * z / (2 * e.k + 1), 's': a.s + a.t * z * z / (2 * e.k + 1)}, "
        "{'k': 0::DOUBLE, 't': z, 's': z}).s"
    )
    newton = f"z - (0.5 + exp(-0.5 * z * z) / sqrt(2 * pi()) * {series} - p) / (exp(-0.5 * z * z) / sqrt(2 * pi()))"
    for c in columns:
        ctes.append(f"""
        o_{c} AS (SELECT list({c}::DOUBLE ORDER BY {c}) AS s, count({c}) AS n, least(count({c}), 1000) AS size FROM {source} WHERE {c} IS NOT NULL),
        i_{c} AS (SELECT s, n, unnest(list_transform(range(size), lambda i: i::DOUBLE / (size - 1)::DOUBLE)) AS level FROM o_{c}),
        j_{c} AS (SELECT level, (n - 1) * level AS place, least(floor((n - 1) * level), n - 1)::BIGINT AS f, s, n FROM i_{c}),
        k_{c} AS (SELECT level, s[f + 1] + (s[least(f + 2, n)] - s[f + 1]) * (place - f) AS m FROM j_{c}),
        l_{c} AS (
            SELECT *, lead(m) OVER w AS next_m, lead(least_level) OVER w AS next_level, min(m) OVER () AS low, max(m) OVER () AS high
            FROM (SELECT m, min(level) AS least_level, max(level) AS last_level FROM k_{c} GROUP BY m) WINDOW w AS (ORDER BY m)),
        p_{c} AS (
            SELECT x, least(greatest(CASE WHEN x - 1e-7 < low THEN 0 WHEN x + 1e-7 > high THEN 1
                WHEN x = m THEN (least_level + last_level) / 2
                ELSE last_level + (x - m) / (next_m - m) * (next_level - last_level) END, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p
            FROM (SELECT DISTINCT {c}::DOUBLE AS x FROM {source}) v ASOF JOIN l_{c} l ON v.x >= l.m),
        q_{c} AS (SELECT x, {newton} AS y FROM (SELECT x, p, {newton} AS z FROM (SELECT x, p, {guess} AS z FROM p_{c})))""")
    joins = " ".join(f"LEFT JOIN q_{c} ON q_{c}.x = {source}.{c}::DOUBLE" for c in columns)
    shown = ", ".join(f"{rd(f'q_{c}.y', 6)} AS {c}" for c in columns)
    return f"WITH {', '.join(ctes)} SELECT {key}, {shown} FROM {source} {joins}"


@register("e10_quantile_scale", _quantile_sql(["value", "user_id"], "event_id", "events"))
def e10_quantile_scale(spark, sf_dir):
    return _scaled(spark, sf_dir, "quantile")


# --- E14, E15 ---------------------------------------------------------------------------

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_GAPPY_CUSTOMERS = """
SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS acctbal, c_mktsegment FROM customer
"""
_PIPELINE_SQL = (
    as_cte(_GAPPY_CUSTOMERS)
    + ", f AS (SELECT * REPLACE (coalesce(acctbal, (SELECT avg(acctbal) FROM t)) AS acctbal) FROM t) SELECT c_custkey, "
    + ", ".join(
        f"{rd(f'({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f)', 6)} AS {c}"
        for c in ("acctbal", "c_nationkey")
    )
    + ", "
    + ", ".join(f"(c_mktsegment = '{v}')::INT::DOUBLE AS \"c_mktsegment_{v}\"" for v in _SEGMENTS)
    + " FROM f"
)


def _customer_spec():
    return PrepSpec(["acctbal", "c_nationkey"], ["c_mktsegment"])


@register("e14_pipeline", _PIPELINE_SQL)
def e14_pipeline(spark, sf_dir):
    book = PrepBook()
    book.define("customers", _customer_spec())
    return tidy(book.fit_transform("customers", derived(spark, sf_dir, _GAPPY_CUSTOMERS), ["c_custkey"]), 6)


@register("e15_save_load", _PIPELINE_SQL)
def e15_save_load(spark, sf_dir):
    df = derived(spark, sf_dir, _GAPPY_CUSTOMERS)
    book = PrepBook()
    book.define("customers", _customer_spec())
    book.fit_transform("customers", df)
    path = scratch(spark, "prep")
    book.save(spark, path)
    return tidy(PrepBook.load(spark, path).transform("customers", df, ["c_custkey"]), 6)


@register("e15_pipeline_stage", _PIPELINE_SQL)
def e15_pipeline_stage(spark, sf_dir):
    """The same as a stage of a pipeline of Spark's, saved and loaded."""
    df = derived(spark, sf_dir, _GAPPY_CUSTOMERS)
    path = scratch(spark, "stages")
    Pipeline(stages=[PrepEstimator(_customer_spec())]).fit(df).write().save(path)
    out = PipelineModel.load(path).transform(df)
    return tidy(out.select("c_custkey", "acctbal", "c_nationkey", *[f"c_mktsegment_{v}" for v in _SEGMENTS]), 6)


# --- M1 to M8 -----------------------------------------------------------------------------

_NUMBERS = ["l_quantity", "l_discount", "l_tax"]


@register(
    "m1_polynomial",
    f"SELECT {_ITEM}, {rd('l_quantity * l_quantity')} AS \"l_quantity^2\", {rd('l_quantity * l_discount')} AS \"l_quantity*l_discount\", "
    f"{rd('l_discount * l_discount')} AS \"l_discount^2\" FROM lineitem",
)
def m1_polynomial(spark, sf_dir):
    out = features.polynomial(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return tidy(out.select("l_orderkey", "l_linenumber", "`l_quantity^2`", "`l_quantity*l_discount`", "`l_discount^2`"))


@register(
    "m2_interactions",
    f"SELECT {_ITEM}, {rd('l_quantity * l_discount')} AS \"l_quantity*l_discount\", {rd('l_quantity * l_tax')} AS \"l_quantity*l_tax\", "
    f"{rd('l_discount * l_tax')} AS \"l_discount*l_tax\" FROM lineitem",
)
def m2_interactions(spark, sf_dir):
    out = features.interactions(table(spark, sf_dir, "lineitem"), _NUMBERS)
    return tidy(out.select("l_orderkey", "l_linenumber", "`l_quantity*l_discount`", "`l_quantity*l_tax`", "`l_discount*l_tax`"))


@register(
    "m3_row_statistics",
    f"SELECT {_ITEM}, {rd('list_avg([l_quantity, l_discount, l_tax])', 6)} AS row_mean, "
    f"{rd('list_median([l_quantity, l_discount, l_tax])', 6)} AS row_median, "
    f"{rd('list_stddev_samp([l_quantity, l_discount, l_tax])', 6)} AS row_std FROM lineitem",
)
def m3_row_statistics(spark, sf_dir):
    out = features.row_statistics(table(spark, sf_dir, "lineitem"), _NUMBERS)
    return tidy(out.select("l_orderkey", "l_linenumber", "row_mean", "row_median", "row_std"), 6)


@register(
    "m4_top_features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {rd('r', 6)} AS correlation, {rd('r*r/(1-r*r)*(n-2)')} AS f_score "
        f"FROM (SELECT corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem)"
        for c in ["l_partkey", "l_suppkey", *_NUMBERS]
    )
    + " ORDER BY f_score DESC LIMIT 3",
)
def m4_top_features(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = features.top_features(df, ["l_partkey", "l_suppkey", *_NUMBERS], "l_extendedprice", 3)
    return tidy(out, correlation=6)


@register(
    "m5_split",
    "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR || '|42'), 1, 8))::BIGINT / 4294967296.0 < 0.8 "
    "THEN 'train' ELSE 'test' END AS part FROM orders",
)
def m5_split(spark, sf_dir):
    train, test = features.train_test_split(table(spark, sf_dir, "orders"), "o_orderkey")
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        test.select("o_orderkey", F.lit("test").alias("part"))
    )


@register("m6_k_means")
def m6_k_means(spark, sf_dir):
    # no SQL: iterative
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return features.k_means(df, ["user_id", "value"]).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("m6_k_means_pairs")
def m6_k_means_pairs(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    out = features.k_means_pairs(df, ["p_partkey"], ["p_partkey", "p_size", "p_retailprice"], 3)
    return out.groupBy("column_a", "column_b", "cluster").agg(F.count(F.lit(1)).alias("n"))


@register(
    "m8_roles",
    f"SELECT c_acctbal::DOUBLE AS c_acctbal, c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM customer",
)
def m8_roles(spark, sf_dir):
    roles = features.with_roles(table(spark, sf_dir, "customer"), "c_nationkey", ["c_acctbal", "c_custkey"], ["c_mktsegment"], ["c_custkey"])
    return tidy(roles["modelled"])
