"""Fair mixing against a queue simulated in plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from tablewright.llm import mixing

WEIGHTS, REPEATS = (1.0, 2.0, 3.0), 3


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, budget):
    """Targets by sharing excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(budget)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= REPEATS * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = float(REPEATS * sizes[s])
            left -= target[s]
        open_ -= full
    return target | {s: weight[s] * level for s in open_}, weight


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def make(seed, docs=400):
    draw = random.Random(seed)
    sources = ["a", "b", "Z", "é", None, "hot", "hot", "hot", "tiny"]
    rows = []
    for k in range(docs):
        source = draw.choice(sources)
        words = 0 if draw.random() < 0.1 else draw.randrange(1, 60)
        rows.append((k, draw.choice([" ", "\t", "\n"]).join(["w x"] * words) or draw.choice([None, "", " "]), source))
    return [r for r in rows if r[2] != "tiny" or r[0] % 4 == 0]


def test_targets_sizes_and_cut(spark):
    rows = make(5)
    found = mixing.mix(table(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    budget = sum(sizes.values())
    target, weight = water(sizes, budget)
    by_id = {r["doc_id"]: r for r in found}
    for key, text, source in rows:
        r = by_id[key]
        assert (r["size"], r["source_size"], r["source"]) == (size_of(text), sizes[source], source)
        assert math.isclose(r["target"], target[source], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= REPEATS
    assert math.isclose(sum(target.values()), budget, rel_tol=1e-9)
    taken = {s: sum(r["taken"] for r in found if r["source"] == s) for s in sizes}
    assert budget - 60 <= sum(taken.values()) <= budget
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 60 + 1


def test_cut_is_the_merged_order(spark):
    """Every copy taken finishes no later than any copy left out."""
    rows = make(9, 200)
    df = table(spark, rows)
    found = mixing.mix(df).collect()
    order = df.select(
        "doc_id", F.xxhash64(F.lit(17), F.col("doc_id"), F.xxhash64("text")).bitwiseAND(F.lit(2**63 - 1)).alias("p")
    )
    place = {r["doc_id"]: r["p"] for r in order.collect()}
    _, weight = water({r["source"]: r["source_size"] for r in found}, sum(r["size"] for r in found))
    taken, left = [], []
    for s in weight:
        upto = 0
        for r in sorted((r for r in found if r["source"] == s), key=lambda r: place[r["doc_id"]]):
            upto += r["size"]
            if r["size"]:
                for k in range(REPEATS):
                    finish = (k * r["source_size"] + upto) / weight[s]
                    (taken if k < r["copies"] else left).append(finish)
    assert max(taken) <= min(left)


def test_reruns_and_layouts_agree(spark):
    rows = make(2)
    one = {tuple(r) for r in mixing.mix(table(spark, rows)).collect()}
    random.Random(1).shuffle(rows)
    two = {tuple(r) for r in mixing.mix(table(spark, rows).repartition(7)).collect()}
    assert one == two


def test_odd_inputs(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    empty = mixing.mix(table(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2
    same = [(None, "a b", "s")] * 5 + [(3, "c " * 50_000, "t")]
    clashing = table(spark, same).withColumns({c: F.lit(1) for c in ("queue", "size", "place", "slice", "weight")})
    found = mixing.mix(clashing).collect()
    assert len(found) == 6
    assert sum(r["taken"] for r in found) <= 50_010


def test_take_repeats_rows(spark):
    rows = make(4, 120) + [(7, "same words", "a")] * 2
    df = table(spark, rows).withColumn("copies", F.lit("kept"))
    mixed = mixing.mix(df)
    taken = mixing.take(df, mixed)
    assert taken.columns == df.columns
    counted = {r["doc_id"]: r["count"] for r in taken.filter("doc_id <> 7").groupBy("doc_id").count().collect()}
    wanted = {r["doc_id"]: r["copies"] for r in mixed.filter("doc_id <> 7 and copies > 0").collect()}
    assert counted == wanted
