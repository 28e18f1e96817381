"""Widespread lines against plain counting, and a plan without Python."""

import random

from pyspark.sql import functions as F

from tablewright.llm.linespread import drop_spread_lines

BLANKS = " \t\r\x0b\x0c"


def brute(rows, min_sites):
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            name = line.strip(BLANKS)
            if name:
                sites.setdefault(name, set()).update(set() if site is None else {site})
    gone = {n for n, s in sites.items() if len(s) >= min_sites}
    out = []
    for key, text, _ in rows:
        if text is None:
            out.append((key, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(BLANKS) not in gone]
        out.append((key, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(df, min_sites):
    rows = drop_spread_lines(df, min_sites).select("doc_id", "text", "n_lines", "n_removed")
    return sorted(map(tuple, rows.collect()), key=repr)


def make(seed):
    draw = random.Random(seed)
    rows = []
    for k in range(500):
        lines = [draw.choice([f"own {draw.randrange(4000)}", f"near {draw.randrange(60)}", "hot", "", "  ", f"\tfar {draw.randrange(3)} "]) for _ in range(draw.randrange(6))]
        rows.append((k, "\n".join(lines), draw.choice([None, "big", "big", *(f"s{i}" for i in range(60))])))
    rows += [(600, None, "s1"), (601, "", "s1"), (None, "hot\nmine", "s2"), (7, "hot\n" * 30_000 + "x", "s3"), (8, "a", "s1"), (8, "a", "s1")]
    return rows


def test_against_counting(spark):
    rows = make(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    df = df.withColumns({"h1": F.lit(1), "sites": F.lit(2), "line": F.lit(3), "n_lines": F.lit("x")})
    for min_sites in (1, 2, 5, 20, 40):
        assert found(df, min_sites) == brute(rows, min_sites)


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string").withColumn("more", F.lit(5))
    assert drop_spread_lines(df).columns == ["doc_id", "text", "source", "more", "n_lines", "n_removed"]


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string, source string"), 5) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = drop_spread_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
