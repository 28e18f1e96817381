"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(key, Counter(terms(t)), len(terms(t))) for key, t in docs]
    total, size = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, own, _ in held for t in own)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in set(items):
        found = []
        for key, own, n in held:
            m = 25 + 75 * n * total // size if size else 0
            score = sum(weight[t] * (1_000_000_000 * own[t] // (1000 * own[t] + 8 * m)) for t in terms(text) if t in own)
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    d = d.withColumns({c: F.lit("x") for c in ("score", "rank", "query", "terms", "item_id")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "query": F.lit(2)})
    return sorted((tuple(r) for r in lexical.search(d, i, k).collect()), key=repr)


def make(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{int(draw.paretovariate(0.6))}" for _ in range(400)] + ["É", "é", "ab_c", "x-Y", "K", "ı", "😀"]
    docs = [(i, draw.choice([" ", "\n", ",_"]).join(draw.choices(vocabulary, k=draw.choice([0, 3, 20, 200])))) for i in range(n)]
    docs += [(None, "w1 w2 w3"), (None, None), (5, "W1 w2"), (5, "w1 W2"), (7, "w1 " * 50_000), (8, "")]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(40)))) for i in range(25)]
    copies = [(1000 + i, items[3][1]) for i in range(15)]  # more equal documents than there is room for
    items += [(3, items[3][1]), (4, "another text w9"), (None, "w3 w3 w2"), (90, None), (91, ""), (92, "nowhere"), (93, "\x00w1\x7fw2")]
    return docs + copies, items


@pytest.mark.parametrize("k", [1, 10])
def test_against_scoring_all(spark, k):
    docs, items = make(k, 400)
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_accumulators_end_early(spark, monkeypatch):
    """Rare terms settle the best; documents of common terms alone get no accumulator."""
    docs = [(i, "of the rare" + " x" * i if i < 5 else "of the of the") for i in range(300)]
    items = [(1, "of the rare")]
    seen = []
    search = lexical._search
    monkeypatch.setattr(
        lexical, "_search", lambda *a: seen.append((a[-1], a[1].value.made.tolist())) or search(*a)
    )
    monkeypatch.setattr(lexical, "FIRST", 1)
    assert found(spark, docs, items, 3) == brute(docs, items, 3)
    assert seen[-1] == (True, [1])


def test_blocks_of_queries(spark, monkeypatch):
    docs, items = make(5, 120)
    whole = found(spark, docs, items, 4)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 7)
    assert found(spark, docs, items, 4) == whole


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")], 5) == []
    assert found(spark, [(1, "a b")], [], 5) == []
    assert found(spark, [(1, None), (2, "--")], [(1, "a"), (2, None)], 5) == []
