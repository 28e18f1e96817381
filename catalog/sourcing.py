"""Readers, writers, ledgers, artifacts, logs and inventories.

Queries that write use a new path below the shared folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import big, rd, register, scratch, table, tidy
from tablewright.sources import artifacts, logs, readers, writers

_ORDERS_SQL = (
    f"SELECT o_orderstatus, count(*) AS n, {rd('sum(o_totalprice)', 2)} AS total, "
    "min(o_orderpriority) AS first_priority FROM orders GROUP BY o_orderstatus"
)


def _orders(df):
    return tidy(
        df.groupBy("o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("o_totalprice").alias("total"),
            F.min("o_orderpriority").alias("first_priority"),
        ),
        2,
    )


@register(
    "a1_read_csv_encodings",
    "SELECT doc_id, lang, md5(text) AS text_md5, n_chars FROM documents",
)
def a1_read_csv_encodings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    path = scratch(spark, "csv")
    quoting = {"escape": '"', "quoteAll": True}
    latin = F.col("lang").isin("fr", "de")
    docs.filter(~latin).write.options(header=True, **quoting).csv(f"{path}/utf8")
    docs.filter(latin).write.options(header=True, encoding="ISO-8859-1", **quoting).csv(f"{path}/latin")
    # blanks at the ends of a quoted text belong to it
    out = readers.read_csv(
        spark, [f"{path}/utf8", f"{path}/latin"], escape='"',
        schema="doc_id bigint, lang string, text string, n_chars bigint",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return out.select("doc_id", "lang", F.md5("text").alias("text_md5"), "n_chars")


@register(
    "a1_read_csv_types",
    f"SELECT o_orderkey, o_custkey, o_orderstatus, {rd('o_totalprice')} AS o_totalprice, "
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS gappy, o_orderkey % 2 = 0 AS even FROM orders",
)
def a1_read_csv_types(spark, sf_dir):
    path = scratch(spark, "csv")
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'NA' ELSE CAST(o_custkey AS STRING) END AS gappy",
        "o_orderkey % 2 = 0 AS even",
    )
    writers.write_table(df, path, "csv")
    return tidy(readers.read_csv(spark, path))


@register("a2_read_parquet", _ORDERS_SQL)
def a2_read_parquet(spark, sf_dir):
    return _orders(readers.read_parquet(spark, f"{sf_dir}/orders.parquet"))


@register("a3_a10_json", _ORDERS_SQL)
def a3_a10_json(spark, sf_dir):
    path = scratch(spark, "json")
    writers.write_table(table(spark, sf_dir, "orders"), path, "json", "gzip")
    return _orders(readers.read_json(spark, path))


_SUPPLIERS_SQL = f"SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, {rd('s_acctbal')} AS s_acctbal FROM supplier"


@register("a4_a11_yaml", _SUPPLIERS_SQL)
def a4_a11_yaml(spark, sf_dir):
    path = scratch(spark, "yaml")
    writers.write_table(table(spark, sf_dir, "supplier"), path, "yaml")
    schema = "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double"
    return tidy(readers.read_yaml(spark, path, schema))


@register(
    "a5_read_table",
    " UNION ALL ".join(
        f"SELECT '{f}' AS format, count(*) AS n, min(c_name) AS first_name, {rd('sum(c_acctbal)', 2)} AS balance FROM customer"
        for f in ("csv", "json", "parquet", "yaml")
    ),
)
def a5_read_table(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    out = None
    for fmt in ("csv", "json", "parquet", "yaml"):
        path = scratch(spark, "customer") + f".{fmt}"
        writers.write_table(df, path, fmt)
        one = readers.read_table(spark, path, schema=schema).agg(
            F.count(F.lit(1)).alias("n"), F.min("c_name").alias("first_name"), F.sum("c_acctbal").alias("balance")
        )
        one = one.select(F.lit(fmt).alias("format"), "*")
        out = one if out is None else out.unionByName(one)
    return tidy(out, 2)


@register(
    "a6_read_many",
    "SELECT o_orderstatus AS part, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
)
def a6_read_many(spark, sf_dir):
    path = scratch(spark, "parts")
    orders = table(spark, sf_dir, "orders")
    for status in ("F", "O", "P"):
        orders.filter(F.col("o_orderstatus") == status).write.json(f"{path}/part-{status}")
    many, _ = readers.read_many(spark, f"{path}/part-[FO]", "json")
    part = F.regexp_extract("source", "/part-([A-Z])/", 1).alias("part")
    return readers.file_stats(many).groupBy(part).agg(F.sum("rows").alias("n"))


@register(
    "a7_load_in_chunks",
    f"SELECT event_type, count(*) AS n, {rd('sum(value)', 2)} AS total FROM events GROUP BY event_type",
)
def a7_load_in_chunks(spark, sf_dir):
    path = scratch(spark, "chunks")
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    df.repartition(6, "event_id").write.option("header", True).csv(f"{path}/in")
    loaded = readers.load_in_chunks(
        spark, f"{path}/in", df.schema, f"{path}/out", f"{path}/checkpoint", files_per_trigger=2
    )
    return tidy(loaded.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 2)


@register(
    "a8_table_info",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS data_type, count(*) AS rows, {big(f'count(*) - count({c})')} AS missing FROM customer"
        for c, t in (
            ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("c_mktsegment", "string"),
        )
    ),
)
def a8_table_info(spark, sf_dir):
    return readers.table_info(table(spark, sf_dir, "customer"))


@register(
    "a8_loading_stats",
    "SELECT 3::BIGINT AS total_files, ((SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + "
    "(SELECT count(*) FROM part))::BIGINT AS total_rows, 17::BIGINT AS total_columns",
)
def a8_loading_stats(spark, sf_dir):
    return readers.loading_stats({n: table(spark, sf_dir, n) for n in ("orders", "customer", "part")})


@register("a9_write_csv", _ORDERS_SQL)
def a9_write_csv(spark, sf_dir):
    path = scratch(spark, "csv")
    df = table(spark, sf_dir, "orders")
    writers.write_table(df, path, "csv", "bz2")
    return _orders(readers.read_csv(spark, path, schema=df.schema, encoding="UTF-8"))


@register("a12_write_parquet", _ORDERS_SQL)
def a12_write_parquet(spark, sf_dir):
    path = scratch(spark, "parquet")
    writers.write_table(table(spark, sf_dir, "orders"), path, "parquet")
    return _orders(readers.read_table(spark, path, "parquet"))


@register(
    "a13_write_tables",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS written, count(*) AS rows FROM {t}" for t in ("customer", "part", "supplier")),
)
def a13_write_tables(spark, sf_dir):
    path = scratch(spark, "tables")
    written = writers.write_tables({t: table(spark, sf_dir, t) for t in ("customer", "part", "supplier")}, path, "parquet")
    out = None
    for name, rows in written.items():
        one = readers.read_table(spark, f"{path}/{name}", "parquet").agg(F.count(F.lit(1)).alias("rows"))
        one = one.select(F.lit(name).alias("name"), F.lit(rows).cast("bigint").alias("written"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _exports(spark, sf_dir):
    path = scratch(spark, "exports")
    for name, fmt, compression in (
        ("orders", "csv", "gzip"), ("customer", "json", None), ("part", "parquet", None), ("supplier", "csv", None),
    ):
        writers.write_table(table(spark, sf_dir, name), f"{path}/{name}", fmt, compression, ledger=f"{path}/ledger")
    return spark.read.parquet(f"{path}/ledger")


@register(
    "a14_a15_export_summary",
    "SELECT 4::BIGINT AS total_exports, ((SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + "
    "(SELECT count(*) FROM part) + (SELECT count(*) FROM supplier))::BIGINT AS total_rows, 'csv,json,parquet' AS formats",
)
def a14_a15_export_summary(spark, sf_dir):
    return writers.export_summary(_exports(spark, sf_dir))


@register(
    "a15_latest_exports",
    "SELECT 'supplier' AS name, 'csv' AS format, NULL::VARCHAR AS compression, count(*) AS rows, 4::BIGINT AS columns FROM supplier UNION ALL "
    "SELECT 'part', 'parquet', NULL, count(*), 6 FROM part UNION ALL SELECT 'customer', 'json', NULL, count(*), 5 FROM customer",
)
def a15_latest_exports(spark, sf_dir):
    latest = writers.latest_exports(_exports(spark, sf_dir), n=3)
    return tidy(latest.select(F.element_at(F.split("path", "/"), -1).alias("name"), "format", "compression", "rows", "columns"))


@register("a16_artifact", _SUPPLIERS_SQL.replace(" FROM", ", 'suppliers' AS title FROM"))
def a16_artifact(spark, sf_dir):
    path = scratch(spark, "artifact")
    artifacts.save_artifact(table(spark, sf_dir, "supplier"), path, {"title": "suppliers"})
    df, metadata = artifacts.load_artifact(spark, path)
    return tidy(df.withColumn("title", F.lit(metadata["title"])))


def _log_lines(spark, sf_dir):
    """Events as JSON log lines, with broken lines in between."""
    events = table(spark, sf_dir, "events")
    line = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS").alias("timestamp"),
            F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
            F.lit("app").alias("logger"),
            F.col("event_id").cast("string").alias("message"),
            F.col("event_type").alias("module"),
            F.lit("run").alias("function"),
            F.col("user_id").cast("int").alias("line"),
        )
    )
    broken = events.filter("event_id % 10 = 0").select(F.lit('{"timestamp": "2024').alias("value"))
    path = scratch(spark, "logs")
    events.select(line.alias("value")).unionByName(broken).write.text(path)
    return logs.read_logs(spark, path)


@register(
    "a17_query_logs",
    "SELECT event_id::VARCHAR AS message, event_type AS module, user_id AS line FROM events WHERE event_type = 'error' "
    "AND date_trunc('milliseconds', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
)
def a17_query_logs(spark, sf_dir):
    found = logs.query_logs(_log_lines(spark, sf_dir), "ERROR", "2024-01-05", "2024-01-20")
    return tidy(found.select("message", "module", "line"))


@register(
    "a17_first_logs",
    "SELECT message, module FROM (SELECT event_id::VARCHAR AS message, event_type AS module, date_trunc('milliseconds', ts) AS t, "
    "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events) ORDER BY t, level, message LIMIT 25",
)
def a17_first_logs(spark, sf_dir):
    found = logs.query_logs(
        _log_lines(spark, sf_dir).select("ts", "level", "message", "module"), limit=25
    )
    return found.select("message", "module")


@register("u3_own_format", _ORDERS_SQL)
def u3_own_format(spark, sf_dir):
    readers.register_reader("orc", lambda spark, path, **options: spark.read.options(**options).orc(path))
    writers.register_writer(
        "orc", lambda df, path, compression, mode, **options: df.write.mode(mode).options(**options).orc(path)
    )
    path = scratch(spark, "orders") + ".orc"
    writers.write_table(table(spark, sf_dir, "orders"), path, "orc")
    return _orders(readers.read_table(spark, path))
