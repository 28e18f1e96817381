"""Compare catalogue queries with their SQL: ``python tests/oracle.py sf_dir [name...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return repr([_cell(x) for x in v])
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(con, df, sql: str) -> str | None:
    """``None`` when equal, else what differs."""
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    differing = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if differing:
        return f"{len(differing)} rows differ, first: {differing[0][0]} != {differing[0][1]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tablewright.session import local_session, release

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(con, df, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows only ({len(df.collect())})"
        except Exception as e:  # report and go on
            state = "ERROR " + str(e)[:600]
        release()
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:34s} {time.time() - began:6.2f}s {state}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
