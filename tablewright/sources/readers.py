"""Read tables from CSV, Parquet, JSON and YAML files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import ReadError
from tablewright.functions.kinds import present, ref
from tablewright.functions.scalars import parse_number
from tablewright.operators.checks import assert_table
from tablewright.operators.fused import per_column, scalars
from tablewright.session import held

# Encodings tried in order.
ENCODINGS = ("UTF-8", "ISO-8859-1")
# Texts read as missing in CSV files.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
BOOLEAN_TEXTS = {"True": True, "TRUE": True, "true": True, "False": False, "FALSE": False, "false": False}


def _paths(path: str | Iterable[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def files_by_form(spark: SparkSession, path: str | Iterable[str]) -> dict[tuple[bool, bool], list[str]]:
    """Files by (valid UTF-8, a quoted field goes on in the next line); one scan.

    An odd number of quotes in a line tells of such a field.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    lines = spark.read.text(_paths(path)).select(
        F.col("_metadata.file_path").alias("file"),
        F.is_valid_utf8("value").alias("valid"),
        (quotes % 2 == 1).alias("open"),
    )
    found: dict[tuple[bool, bool], list[str]] = {}
    files = lines.groupBy("file").agg(F.min("valid").alias("valid"), F.max("open").alias("open"))
    for r in files.orderBy("file").collect():
        found.setdefault((r["valid"], r["open"]), []).append(r["file"])
    return found


def _csv(spark, paths, encoding, schema, options) -> DataFrame:
    reader = spark.read.options(**{"header": True, "encoding": encoding, **options})
    return (reader.schema(schema) if schema is not None else reader).csv(paths)


def read_csv(
    spark: SparkSession,
    path: str | Iterable[str],
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
    missing: Iterable[str] = tuple(MISSING_TEXTS),
    **options,
) -> DataFrame:
    """CSV with a header; files that are not UTF-8 are read as Latin-1.

    Files with line breaks inside quotes are read whole by one task each, the others in
    splits. Texts in ``missing`` become null. Without a schema the columns become
    numbers or booleans where all their values are, in one more scan. A given
    ``encoding`` together with ``multiLine`` spares the check of the files, a given
    ``schema`` the inference.
    """
    if encoding is not None and "multiLine" in options:
        parts = [(_paths(path), encoding, options["multiLine"])]
    else:
        forms = files_by_form(spark, path)
        parts = [
            (files, encoding or ENCODINGS[0 if valid else 1], options.get("multiLine", goes_on))
            for (valid, goes_on), files in sorted(forms.items(), reverse=True)
        ] or [(_paths(path), encoding or ENCODINGS[0], False)]
        if len(parts) == 1:
            parts = [(_paths(path), *parts[0][1:])]
    table = None
    for files, name, goes_on in parts:
        part = _csv(spark, files, name, schema, {**options, "multiLine": goes_on})
        table = part if table is None else table.unionByName(part, allowMissingColumns=True)
    tokens = [t for t in missing if t]
    cleaned = table.select(
        *[
            F.when(~ref(f.name).isin(tokens), ref(f.name)).alias(f.name)
            if tokens and isinstance(f.dataType, T.StringType)
            else ref(f.name)
            for f in table.schema.fields
        ]
    )
    return cleaned if schema is not None else _plain_types(cleaned)


def _plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers, decimal numbers and booleans, decided for all columns at once."""
    tests = {}
    for c in df.columns:
        value = parse_number(ref(c))
        tests[c, "values"] = F.count(ref(c))
        tests[c, "numbers"] = F.count(value)
        tests[c, "whole"] = F.count_if(ref(c).rlike(r"^\s*[+-]?\d{1,18}\s*$"))
        tests[c, "booleans"] = F.count_if(ref(c).isin(list(BOOLEAN_TEXTS)))
    if not tests:
        return df
    got = scalars(df, tests)
    casts = {}
    for c in df.columns:
        n = got[c, "values"]
        if n and got[c, "whole"] == n:
            casts[c] = F.trim(ref(c)).try_cast("bigint")
        elif n and got[c, "numbers"] == n:
            casts[c] = parse_number(ref(c))
        elif n and got[c, "booleans"] == n:
            casts[c] = F.lower(ref(c)).try_cast("boolean")
    return df.withColumns(casts) if casts else df


def read_parquet(spark: SparkSession, path, schema=None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).parquet(*_paths(path))


def read_json(spark: SparkSession, path, schema=None, records: bool = False, **options) -> DataFrame:
    """JSON lines, or arrays of records with ``records=True``."""
    reader = spark.read.options(**{"multiLine": records, **options})
    return (reader.schema(schema) if schema is not None else reader).json(_paths(path))


# Bytes of YAML records parsed at a time.
YAML_PORTION = 1 << 20


def _yaml_records(raw: bytes) -> list | None:
    """The records of a part of a YAML list; none if it is not a list of mappings by itself."""
    import yaml

    if b"\0" in raw or b"\n..." in raw or raw.startswith((b"...", b"\xff\xfe", b"\xfe\xff")):
        return None  # another encoding, or an end of document
    try:
        records = yaml.load(raw, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError):
        return None
    records = [] if records is None else records
    return records if isinstance(records, list) and all(isinstance(r, dict) for r in records) else None


def read_yaml(spark: SparkSession, path, schema=None, **options) -> DataFrame:
    """YAML files, each a list of records.

    Files are cut where a line begins a record of the list, and the parts parsed by many
    tasks. A file of which a part is no list by itself (a quoted text or flow goes across such a
    line, or a record refers to an earlier one) is parsed whole by one task. Fields outside
    the schema are left out, fields a record lacks are null.
    """
    if schema is None:
        raise ReadError("a YAML source needs a schema")
    try:
        import yaml  # noqa: F401
    except ImportError as e:
        raise ReadError("reading YAML needs the yaml package on the executors") from e
    structure = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = structure.fieldNames()

    def rows(records):
        import pandas as pd

        return pd.DataFrame([{n: r.get(n) for n in names} for r in records], columns=names)

    def parse_parts(batches):
        last = None
        for batch in batches:
            part, file = [], None

            def parsed():
                records = _yaml_records(b"".join(part))
                found = rows(records or [])
                if records is None:
                    found.loc[0] = [None] * len(names)
                return found.assign(**{"_file": file, "_whole": records is None})

            size = 0
            for raw, source, start in zip(batch["content"], batch["file"], batch["start"]):
                first = start == 0 and (source, start) != last
                last = (source, start)
                if part and (source != file or size > YAML_PORTION):
                    yield parsed()
                    part, size = [], 0
                file = source
                part.append((b"" if first else b"- ") + raw + b"\n")
                size += len(raw)
            if part:
                yield parsed()

    def parse_whole(batches):
        import yaml

        for batch in batches:
            for content in batch["content"]:
                yield rows(yaml.safe_load(content) or [])

    def contents(reader, column):
        return reader.load(_paths(path)).select(
            ref(column).cast("binary").alias("content"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
        )

    cut = contents(spark.read.format("text").options(**options, lineSep="\n- "), "value")
    nullable = [T.StructField(f.name, f.dataType) for f in structure.fields]
    kinds = T.StructType([*nullable, T.StructField("_file", T.StringType()), T.StructField("_whole", T.BooleanType())])
    parts = held(cut.mapInPandas(parse_parts, kinds))
    whole = [r["_file"] for r in parts.filter("_whole").select("_file").distinct().collect()]  # such files
    if not whole:
        return parts.select(*map(ref, names))
    rest = parts.filter(~F.col("_file").isin(whole)).select(*map(ref, names))
    files = contents(spark.read.format("binaryFile").options(**options), "content")
    return rest.unionByName(files.filter(F.col("file").isin(whole)).mapInPandas(parse_whole, structure))


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv,
    "parquet": read_parquet,
    "json": read_json,
    "yaml": read_yaml,
    "yml": read_yaml,
}


def register_reader(name: str, reader: Callable[..., DataFrame]) -> None:
    """Make a reader ``f(spark, path, **options)`` known by a format or suffix."""
    READERS[name.lower().lstrip(".")] = reader


def format_of(path: str) -> str:
    suffix = os.path.splitext(str(path).rstrip("/"))[1].lstrip(".").lower()
    if not suffix:
        raise ReadError(f"no suffix to tell the format from: {path}")
    return suffix


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    validate: bool = True,
    **options,
) -> DataFrame:
    """Read by format or suffix; ``validate`` makes sure that there are rows."""
    name = (fmt or format_of(path)).lower()
    if name not in READERS:
        raise ReadError(f"unsupported format: {name}", {"supported_formats": sorted(READERS)})
    df = READERS[name](spark, path, **options)
    return assert_table(df, allow_nulls=True) if validate else df


def whole_files(reader, files: list[str]) -> tuple[list[str], dict[str, str]]:
    """Files that can be read to their end, and the reason for each of the others.

    A group of files is read as a whole; a group that fails is halved, so ``k`` broken
    files of ``n`` take about ``k log n`` jobs, none of which brings rows to the driver.
    """
    good, failed, groups = [], {}, [files] if files else []
    while groups:
        group = groups.pop()
        try:
            reader.load(group).write.format("noop").mode("overwrite").save()
            good += group
        except Exception as e:  # any reader's own kind of failure
            if len(group) == 1:
                failed[group[0]] = str(e).splitlines()[0] if str(e) else type(e).__name__
            else:
                half = len(group) // 2
                groups += [group[:half], group[half:]]
    return sorted(good), failed


def read_many(
    spark: SparkSession, patterns: str | Iterable[str], fmt: str, **options
) -> tuple[DataFrame, dict[str, str]]:
    """All files matching the patterns as one table, with their path as ``source``.

    Files that cannot be read to their end are left out whole; the second result names
    them with the reason.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
    listed = spark.read.format("binaryFile").load(_paths(patterns)).select("path")
    good, failed = whole_files(reader, sorted(r["path"] for r in listed.collect()))  # the listing
    if not good:
        raise ReadError("no file could be read", failed)
    return reader.load(good).select("*", F.col("_metadata.file_path").alias("source")), failed


def read_each(spark: SparkSession, paths: Iterable[str], **options) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """A table per path, and the reason for every path that failed."""
    tables, failed = {}, {}
    for path in paths:
        try:
            tables[path] = read_table(spark, path, **options)
        except Exception as e:  # a failing file must not stop the others
            failed[path] = str(e).splitlines()[0] if str(e) else type(e).__name__
    return tables, failed


def read_stream(
    spark: SparkSession, directory: str, schema, fmt: str = "csv", files_per_trigger: int = 100, **options
) -> DataFrame:
    """A growing directory as a stream, a bounded number of files at a time."""
    reader = spark.readStream.schema(schema).options(
        **{"maxFilesPerTrigger": files_per_trigger, "header": True, **options}
    )
    return reader.format(fmt).load(directory)


def load_in_chunks(
    spark: SparkSession, directory: str, schema, target: str, checkpoint: str,
    fmt: str = "csv", files_per_trigger: int = 100, **options,
) -> DataFrame:
    """Read a directory chunk by chunk into a Parquet table; a rerun goes on
    where the last one stopped."""
    stream = read_stream(spark, directory, schema, fmt, files_per_trigger, **options)
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)


def table_info(df: DataFrame) -> DataFrame:
    """``(column, data_type, rows, missing)`` of a table in one scan."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return per_column(
        df,
        df.columns,
        {
            "data_type": lambda c: F.lit(types[c]),
            "rows": lambda c: F.count(F.lit(1)),
            "missing": lambda c: F.count_if(present(df, c).isNull()),
        },
    )


def loading_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row: number of sources, their rows and columns added up."""
    union = None
    for df in tables.values():
        one = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))
        union = one if union is None else union.unionAll(one)
    if union is None:
        raise ReadError("no tables given")
    return union.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("rows").alias("total_rows"),
        F.sum("columns").alias("total_columns"),
    )


def file_stats(df: DataFrame) -> DataFrame:
    """Rows per file of a table read with :func:`read_many`."""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
