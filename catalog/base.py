"""Shared helpers of the query catalogue.

A query is registered with :func:`register`; its name starts with the row of
the operator inventory it shows. The SQL runs on the same tables elsewhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import ref
from tablewright.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Digits that results are rounded to on both sides.
DIGITS = 4


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = DIGITS, **by_column: int) -> DataFrame:
    """Round doubles and widen whole numbers, so that both sides compare equal."""
    out = []
    for field in df.schema.fields:
        c = ref(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            rounded = F.round(c.cast("double"), by_column.get(field.name, digits)) + F.lit(0.0)
            out.append(rounded.alias(field.name))
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(c.cast("bigint").alias(field.name))
        else:
            out.append(c.alias(field.name))
    return df.select(*out)


def rd(expression: str, digits: int = DIGITS) -> str:
    """The SQL counterpart of rounding in :func:`tidy`."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- derived inputs, the same expressions in Spark and in SQL -----------------

NULLS_NUMERIC = """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_returnflag,
       CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS qty,
       CASE WHEN l_partkey % 3 <> 0 THEN NULL ELSE l_tax END AS mostly_null
FROM lineitem
"""

NULLS_TEXT = """
SELECT o_orderkey, o_orderstatus, o_totalprice,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority
FROM orders
"""

NULLS_PAIR = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust,
       CAST(o_orderkey % 100 AS DOUBLE) AS slot
FROM orders
"""

KNN_ROWS = """
SELECT s_suppkey, s_nationkey,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_acctbal END AS acctbal
FROM supplier
"""

DUP_ROWS = """
SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0
"""

DIRTY_TEXT = """
SELECT p_partkey,
       concat('  ', upper(replace(p_name, ' ', concat(chr(9), ' '))), '   x ') AS dirty,
       p_type
FROM part
"""

TYPED_TEXT = """
SELECT o_orderkey,
       CAST(o_orderkey AS VARCHAR(40)) AS whole_text,
       CAST(o_totalprice AS VARCHAR(40)) AS decimal_text,
       substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10) AS date_text,
       CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'No' END AS flag_text,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR(40)) ELSE o_orderpriority END AS mixed_text
FROM orders
"""

NON_FINITE = """
SELECT l_orderkey, l_linenumber, l_discount,
       CASE WHEN l_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN l_orderkey % 13 = 0 THEN CAST('Infinity' AS DOUBLE)
            ELSE l_quantity END AS q
FROM lineitem
"""

OP_LOG = """
SELECT event_id, ts, user_id, event_type, value FROM events
"""


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a derivation over the Parquet tables without registering views."""
    import re

    for name in ("lineitem", "orders", "supplier", "part", "events", "customer"):
        sql = re.sub(rf"\bFROM {name}\b", f"FROM parquet.`{sf_dir}/{name}.parquet`", sql)
    df = spark.sql(sql.replace("VARCHAR(40)", "STRING"))
    return df


def as_cte(sql: str, name: str = "t") -> str:
    return f"WITH {name} AS ({sql.replace('VARCHAR(40)', 'VARCHAR')})"
