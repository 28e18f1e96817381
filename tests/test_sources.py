"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright.errors import CheckError, ReadError, WriteError
from tablewright.sources import artifacts, inventory, logs, readers, writers
from tablewright.streaming import monitor


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,café\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("id,name\n2,café\n3,NA\n".encode("latin-1"))
    df = readers.read_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string"}
    assert {r["id"]: r["name"] for r in df.collect()} == {1: "café", 2: "café", 3: None}


def test_csv_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c,d\n1,1.5,True,x\n,NaN,False,2\n")
    df = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string"]


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert readers.read_json(spark, str(tmp_path / "a.json"), records=True).count() == 2


def test_yaml_files_are_cut_at_their_records(spark, tmp_path):
    rows = "".join(f'- {{"a": {i}, "b": "text {i}"}}\n' for i in range(60_000))
    files = {
        "plain": "---\n# list\n" + rows,
        "quoted": '- {"a": -1, "b": "x\n- y"}\n- a: -2\n  b: last',
        "linked": "- &first {a: -3, b: x}\n- <<: *first\n  a: -4\n",
        "block": "-\n  a: -5\n  b: |\n    one\n    - two\n- {a: -6}\n",
        "flow": '[{"a": -7},\n {"a": -8}]',
        "wide": "- {a: -9, b: é}\r\n- {a: -10, c: 3}\r\n",
        "empty": "",
    }
    for name, body in files.items():
        (tmp_path / f"{name}.yaml").write_bytes(body.encode())
    (tmp_path / "sixteen.yaml").write_bytes("- {a: -11}\n- {a: -12}\n".encode("utf-16"))
    df = readers.read_yaml(spark, f"{tmp_path}/*.yaml", "a int, b string")
    found = {r["a"]: r["b"] for r in df.filter("a < 0").collect()}
    assert found == {
        -1: "x - y", -2: "last", -3: "x", -4: "x", -5: "one\n- two\n", -6: None,
        -7: None, -8: None, -9: "é", -10: None, -11: None, -12: None,
    }
    assert df.count() == 60_012 and df.filter("a >= 0 and b = concat('text ', a)").count() == 60_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:  # a file is read by several tasks
        cut = readers.read_yaml(spark, f"{tmp_path}/plain.yaml", "a int, b string")
        assert cut.rdd.getNumPartitions() > 1 and cut.count() == 60_000
        assert cut.agg({"a": "sum"}).first()[0] == sum(range(60_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_yaml_round_trip(spark, tmp_path):
    import yaml

    df = spark.createDataFrame([(1, 'a "b": #'), (2, None)], "a int, b string")
    writers.write_table(df.coalesce(1), str(tmp_path / "out"), "yaml")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert yaml.safe_load(text) == [{"a": 1, "b": 'a "b": #'}, {"a": 2, "b": None}]
    back = readers.read_yaml(spark, str(tmp_path / "out"), "a int, b string")
    assert sorted(map(tuple, back.collect())) == [(1, 'a "b": #'), (2, None)]
    with pytest.raises(ReadError):
        readers.read_yaml(spark, str(tmp_path / "out"))


def test_unknown_formats(spark, tmp_path):
    with pytest.raises(ReadError):
        readers.read_table(spark, "x.pkl")
    df = spark.range(3)
    with pytest.raises(WriteError):
        writers.write_table(df, str(tmp_path / "x"), "html")
    for name in ("zip", "xz", "rar"):
        with pytest.raises(WriteError):
            writers.write_table(df, str(tmp_path / "x"), "csv", name)


def test_registered_formats(spark, tmp_path):
    readers.register_reader("orc", lambda spark, path, **o: spark.read.orc(path))
    writers.register_writer("orc", lambda df, path, compression, mode, **o: df.write.mode(mode).orc(path))
    assert writers.write_table(spark.range(5), str(tmp_path / "t.orc"), "orc") == 5
    assert readers.read_table(spark, str(tmp_path / "t.orc")).count() == 5


def test_empty_tables_are_refused(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "t.parquet"))
    with pytest.raises(CheckError):
        readers.read_table(spark, str(tmp_path / "t.parquet"))
    assert readers.read_table(spark, str(tmp_path / "t.parquet"), validate=False).count() == 0


def test_failing_files_do_not_stop_the_others(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "a.parquet"))
    tables, failed = readers.read_each(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")])
    assert [t.count() for t in tables.values()] == [4] and list(failed) == [str(tmp_path / "b.parquet")]


def test_artifact_errors(spark, tmp_path):
    with pytest.raises(ReadError):
        artifacts.load_artifact(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([(1, "a")], "x bigint, y string")
    artifacts.save_artifact(df, str(tmp_path / "t.csv"))
    with pytest.raises(WriteError):
        artifacts.save_artifact(df, str(tmp_path / "t.csv"))
    back, metadata = artifacts.load_artifact(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in back.collect()] == [(1, "a")] and metadata is None


LINES = [
    {"timestamp": "2024-01-01 10:00:00,250", "level": "INFO", "message": "a"},
    {"timestamp": "2024-01-01 11:00:00", "level": "ERROR", "message": "b"},
    {"timestamp": "2024-01-01 12:00:00,000", "level": "ERROR", "message": "c"},
]


def test_logs(spark, tmp_path):
    text = "\n".join([json.dumps(x) for x in LINES] + ['{"timestamp": "2024'])
    (tmp_path / "app.log").write_text(text)
    found = logs.read_logs(spark, str(tmp_path))
    assert found.count() == 3
    assert [r["message"] for r in logs.query_logs(found, "ERROR", limit=1).collect()] == ["b"]
    assert logs.query_logs(found, start="2024-01-01 10:30:00", end="2024-01-01 11:00:00").count() == 1
    stream = logs.query_logs(logs.stream_logs(spark, str(tmp_path)), "ERROR")
    monitor.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x" * 2048)
    (tmp_path / "b.exe").write_text("x")
    rows = {r["suffix"]: r for r in inventory.inventory(spark, str(tmp_path), ["csv"], 1024).collect()}
    assert rows["csv"]["size_text"] == "2.00 KB" and not rows["csv"]["size_allowed"]
    assert not rows["exe"]["suffix_allowed"]
    with pytest.raises(CheckError):
        inventory.assert_files(spark, str(tmp_path), ["csv"])


EVENTS = "id long, at string, op long, kind string"


def test_operations_across_slices(spark):
    rows = [
        (1, "2024-01-01 23:00:00", 1, "start"),
        (2, "2024-01-03 01:00:00", 1, "end"),  # two slices later
        (3, "2024-01-03 02:00:00", 1, "end"),  # no start
        (4, "2024-01-03 03:00:00", 1, "start"),
        (5, "2024-01-03 04:00:00", 1, "start"),  # replaces the first
        (6, "2024-01-03 04:30:00", 1, "end"),
        (7, "2024-01-03 04:30:00", 2, "start"),
        (8, "2024-01-03 09:00:00", 3, "start"),
    ]
    df = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("at").cast("timestamp_ntz"))
    args = ("op", "kind", "start", "end", "ts", "id")
    done = monitor.operation_durations(df, *args).orderBy("started").collect()
    assert [(r["operation"], r["seconds"]) for r in done] == [(1, 26 * 3600.0), (1, 1800.0)]
    still = monitor.open_operations(df, *args).collect()
    assert [(r["operation"], r["seconds"]) for r in still] == [(2, 4.5 * 3600)]


def test_stream_pairs_across_batches(spark, tmp_path):
    first = [(1, "2024-01-01 10:00:00", 1, "start"), (2, "2024-01-01 10:00:00", 2, "start")]
    second = [(3, "2024-01-01 10:20:00", 1, "end"), (4, "2024-01-01 20:00:00", 9, "start")]
    for i, rows in enumerate((first, second)):
        df = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("at").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        tracked = monitor.track_operations(stream, "op", "kind", "start", "end", "ts", "id")
        monitor.append_to(tracked, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["operation"], r["outcome"]): r["seconds"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "completed"): 1200.0, (2, "long_running"): 3600.0}


def test_empty_stream_summary(spark):
    df = spark.createDataFrame([], "kind string")
    row = monitor.error_summary(df, "kind").first()
    assert row["total_errors"] == 0 and row["most_common"] is None
