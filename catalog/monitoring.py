"""Event summaries, over the table and as streams over the same file."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import big, rd, register, scratch, table, tidy
from tablewright.streaming import monitor


def _stream(spark, sf_dir):
    # window edges do not move with the zone of the machine
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run(spark, stream):
    path = scratch(spark, "stream")
    monitor.append_to(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


_SUMMARY = (
    f"{rd('max_by(value, (ts, event_id))')} AS current, {rd('avg(value)', 8)} AS average, "
    f"{rd('max(value)')} AS maximum, {rd('min(value)')} AS minimum"
)


def _latest(n):
    return (
        f"SELECT event_type AS metric, {_SUMMARY} FROM (SELECT *, row_number() OVER (PARTITION BY event_type "
        f"ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= {n} GROUP BY event_type"
    )


@register("g1_metric_summary", _latest(1000))
def g1_metric_summary(spark, sf_dir):
    return tidy(monitor.metric_summary(table(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id"), average=8)


@register("g1_metric_summary_long", _latest(1500))
def g1_metric_summary_long(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return tidy(monitor.metric_summary(df, "event_type", "value", "ts", "event_id", 1500), average=8)


_WINDOWS = (
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, "
    f"event_type AS metric, count(*) AS samples, {_SUMMARY} FROM events GROUP BY 1, 2, 3"
)
# a window is final once event time has passed its end by the delay
_FINAL = " HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '10 minutes' FROM events)"


@register("g1_metric_windows", _WINDOWS)
def g1_metric_windows(spark, sf_dir):
    return tidy(monitor.metric_windows(table(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id", "1 hour"), average=8)


@register("g1_metric_windows_stream", _WINDOWS + _FINAL)
def g1_metric_windows_stream(spark, sf_dir):
    stream = _stream(spark, sf_dir)
    return tidy(_run(spark, monitor.metric_windows(stream, "event_type", "value", "ts", "event_id", "1 hour", "10 minutes")), average=8)


_ERRORS = "json_extract_string(props, '$.k')"


def _errors(df):
    return df.filter("event_type = 'error'").withColumn("code", F.get_json_object("props", "$.k"))


@register(
    "g2_error_counts",
    f"SELECT {_ERRORS} AS error_type, count(*) AS \"count\" FROM events WHERE event_type = 'error' GROUP BY 1",
)
def g2_error_counts(spark, sf_dir):
    return monitor.error_counts(_errors(table(spark, sf_dir, "events")), "code")


@register(
    "g2_error_summary",
    f"WITH c AS (SELECT {_ERRORS} AS e, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) "
    "SELECT sum(n)::BIGINT AS total_errors, count(*) AS error_types, (SELECT e FROM c ORDER BY n DESC, e LIMIT 1) AS most_common, "
    "max(n) AS most_common_count FROM c",
)
def g2_error_summary(spark, sf_dir):
    return monitor.error_summary(_errors(table(spark, sf_dir, "events")), "code")


@register(
    "g2_error_windows_stream",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, "
    "event_type AS error_type, count(*) AS \"count\" FROM events GROUP BY 1, 2, 3" + _FINAL,
)
def g2_error_windows_stream(spark, sf_dir):
    return _run(spark, monitor.error_windows(_stream(spark, sf_dir), "event_type", "ts", "1 hour", "10 minutes"))


@register(
    "g2_error_counts_stream",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, "
    f"{_ERRORS} AS error_type, count(*) AS \"count\" FROM events WHERE event_type = 'error' GROUP BY 1, 2, 3",
)
def g2_error_counts_stream(spark, sf_dir):
    # windows that are still open included
    path = scratch(spark, "counts")
    counts = monitor.error_windows(_errors(_stream(spark, sf_dir)), "code", "ts", "1 hour", "10 minutes")
    monitor.update_to(counts, path, f"{path}/checkpoint")
    return monitor.updated(spark, path, ["window_start", "window_end", "error_type"])


@register(
    "g3_change_counts",
    "SELECT user_id AS component, event_type AS change_type, count(*) AS changes FROM events GROUP BY 1, 2",
)
def g3_change_counts(spark, sf_dir):
    return monitor.change_counts(table(spark, sf_dir, "events"), "user_id", "event_type")


@register("g3_distinct_changes_stream", "SELECT event_type, count(DISTINCT event_id) AS changes FROM events GROUP BY 1")
def g3_distinct_changes_stream(spark, sf_dir):
    stream = _stream(spark, sf_dir)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    seen = _run(spark, monitor.distinct_changes(twice, "event_id", "ts", "10 minutes"))
    return seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("changes"))


_MARKS = (
    "SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS before, lag(ts) OVER w AS started "
    "FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
)
_DURATIONS = (
    f"SELECT user_id AS operation, started, ts AS ended, {rd('epoch_us(ts - started) / 1e6', 6)} AS seconds FROM ({_MARKS}) "
    "WHERE event_type = 'purchase' AND before = 'click'"
)
_OPERATION = ("user_id", "event_type", "click", "purchase", "ts", "event_id")


@register("g4_operation_durations", _DURATIONS)
def g4_operation_durations(spark, sf_dir):
    return tidy(monitor.operation_durations(table(spark, sf_dir, "events"), *_OPERATION), 6)


# a mark is final once the watermark, ten minutes behind the newest mark, has passed its millisecond
_PASSED = "(SELECT max(epoch_us(ts)) // 1000 - 600000 FROM events WHERE event_type IN ('click', 'purchase'))"


@register("g4_operation_durations_stream", f"{_DURATIONS} AND ceil(epoch_us(ts) / 1000.0) < {_PASSED}")
def g4_operation_durations_stream(spark, sf_dir):
    found = _run(spark, monitor.track_operations(_stream(spark, sf_dir), *_OPERATION)).filter("outcome = 'completed'")
    return tidy(
        found.select(
            "operation", F.col("started").cast("timestamp_ntz").alias("started"),
            F.col("ended").cast("timestamp_ntz").alias("ended"), "seconds",
        ),
        6,
    )


_OPEN = (
    "SELECT user_id AS operation, max(ts) AS started, epoch_us((SELECT max(ts) FROM events) - max(ts)) / 1e6 AS s "
    "FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id "
    "HAVING max_by(event_type, (ts, event_id)) = 'click'"
)


@register(
    "g5_open_operations",
    f"SELECT operation, started, {rd('s', 6)} AS seconds FROM ({_OPEN}) WHERE s > 3600",
)
def g5_open_operations(spark, sf_dir):
    return tidy(monitor.open_operations(table(spark, sf_dir, "events"), *_OPERATION), 6)


@register(
    "g5_open_operations_stream",
    # open for longer than an hour, as far as the watermark tells
    f"SELECT user_id AS operation, ts AS started FROM ({_MARKS.replace('lag(ts) OVER w AS started', 'lead(ts) OVER w AS following')}) "
    f"WHERE event_type = 'click' AND ceil((epoch_us(ts) + 3600000000) / 1000.0) < {_PASSED} "
    "AND (following IS NULL OR epoch_us(following) - epoch_us(ts) > 3600000000)",
)
def g5_open_operations_stream(spark, sf_dir):
    found = _run(spark, monitor.track_operations(_stream(spark, sf_dir), *_OPERATION)).filter("outcome = 'long_running'")
    return found.select("operation", F.col("started").cast("timestamp_ntz").alias("started"))


@register(
    "g6_report",
    f"SELECT count(*) AS events, {rd('epoch_us(max(ts) - min(ts)) / 1e6', 6)} AS uptime_seconds, "
    "count_if(event_type = 'error')::BIGINT AS total_errors, (SELECT count(*) FROM (SELECT user_id FROM events "
    "WHERE event_type IN ('click', 'purchase') GROUP BY user_id HAVING max_by(event_type, (ts, event_id)) = 'click')) AS active_operations FROM events",
)
def g6_report(spark, sf_dir):
    path = scratch(spark, "report")
    report = monitor.performance_report(
        table(spark, sf_dir, "events"), "event_type", "error", "ts", "user_id", "click", "purchase", "event_id"
    )
    monitor.save_report(report, path)
    return tidy(spark.read.parquet(path).drop("reported_at"), 6)


def _kept_report(spark, sf_dir):
    path = scratch(spark, "report")
    stream = _stream(spark, sf_dir).withColumn("code", F.get_json_object("props", "$.k"))
    monitor.report_to(
        stream, path, f"{path}/checkpoint", "event_type", "error", "code", "ts", "user_id", "click", "purchase",
        "event_id", "event_type", "value",
    )
    return monitor.kept_report(spark, path)


@register(
    "g6_report_stream",
    f"WITH c AS (SELECT {_ERRORS} AS e, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) "
    f"SELECT count(*) AS events, {rd('epoch_us(max(ts) - min(ts)) / 1e6', 6)} AS uptime_seconds, "
    "count_if(event_type = 'error')::BIGINT AS total_errors, (SELECT count(*) FROM (SELECT user_id FROM events "
    "WHERE event_type IN ('click', 'purchase') GROUP BY user_id HAVING max_by(event_type, (ts, event_id)) = 'click')) AS active_operations, "
    "(SELECT count(*) FROM c) AS error_types, (SELECT e FROM c ORDER BY n DESC, e LIMIT 1) AS most_common FROM events",
)
def g6_report_stream(spark, sf_dir):
    kept = _kept_report(spark, sf_dir)
    kinds = kept["error_summary"].select("error_types", "most_common")
    return tidy(kept["totals"].crossJoin(kinds), 6)  # one row each


@register("g6_report_metrics_stream", _latest(1000))
def g6_report_metrics_stream(spark, sf_dir):
    return tidy(_kept_report(spark, sf_dir)["metrics"], average=8)


@register(
    "g7_call_ledger",
    f"SELECT user_id AS function, count(*) AS calls, {rd('avg(value)', 8)} AS average_seconds, {rd('max(value)')} AS longest_seconds, "
    "count_if(event_type = 'error')::BIGINT AS failures FROM events GROUP BY user_id",
)
def g7_call_ledger(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return tidy(monitor.call_ledger(df, "user_id", "value", df["event_type"] != "error"), average_seconds=8)
