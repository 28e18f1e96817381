"""Personal data and disclosing terms against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import disclosure

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TERM = re.compile(r"[^\W_]+")


def digits(found):
    return [int(c) for c in found if c in "0123456789"]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def valid(kind, found):
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits(found)) <= 19 and luhn(digits(found))
    return kind != "phone" or 8 <= len(digits(found)) <= 15


def base(text):
    """(kind, start, end, found), and the gaps around each match of its kind."""
    out = []
    for kind, pattern in PLAIN.items():
        matches = [m for m in pattern.finditer(text)]
        if kind == "card":  # only matches of 16 to 19 digits end a context
            matches = [m for m in matches if 16 <= len(digits(m[0])) <= 19]
        edges = [0, *[x for m in matches for x in m.span()], len(text)]
        for i, m in enumerate(matches):
            if valid(kind, m[0]):
                out.append((kind, *m.span(), m[0], text[edges[2 * i] : m.start()], text[m.end() : edges[2 * i + 3]]))
    return out


def terms(text):
    plain = PLAIN["email"].sub(" ", text).lower()
    return [m[0] for m in TERM.finditer(plain) if m[0][0].isalpha() and len(m[0]) >= 3]


def context(before, after, reach):
    left = re.sub(r"^[^\W_]+", "", before[-reach:]) if len(before) > reach else before
    right = re.sub(r"[^\W_]+$", "", after[:reach]) if len(after) > reach else after
    return left + " " + right


def disclosing(texts, reach, contexts, bits):
    near = defaultdict(Counter)
    for text in texts:
        for kind, _, _, found, before, after in base(text):
            value = found.lower() if kind == "email" else found if kind == "ip" else tuple(digits(found))
            near[kind, value][context(before, after, reach)] += 1
    counts = Counter(t for text in texts for t in terms(text))
    heads = Counter()
    for t, n in counts.items():
        heads[t[:3]] += n
    told = defaultdict(list)
    for held in near.values():
        together, seen, by_head = Counter(), Counter(), Counter()
        for c, n in held.items():
            for t in terms(c):
                together[t] += n
                by_head[t[:3]] += n
            seen.update(set(terms(c)))
        for t in together:
            if seen[t] >= contexts and math.log2(counts[t] / together[t]) <= bits:
                told[t].append(math.log2(heads[t[:3]] / by_head[t[:3]]))
    return {t: min(opened) > bits for t, opened in told.items()}


def expected(text, told):
    spans = [s[:3] for s in base(text)]
    for m in TERM.finditer(text):
        inside = any(a < m.end() and m.start() < b for _, a, b in spans[: len(base(text))])
        if m[0].lower() in told and not inside:
            spans.append(("term", *m.span()))
    own = [f"{k}:{a}:{b}" for k, a, b in spans]
    plain = ",".join(x for x in own if not x.startswith("term"))
    return hashlib.sha256(plain.encode()).hexdigest(), ",".join(own)


def make(seed, n=300):
    draw = random.Random(seed)
    common = ["The", "street", "größe", "of", "naïve", "running", "a", "Übung", "x1y", "😀", "7"]
    entities = ["ann.lee@mail.org", "+49 (30) 123-4567", "10.0.0.255", "4111 1111 1111 1111", "b_c%d@x-y.co.uk"]
    aliases = ["Annabel", "Quentin", "hostname", "Visaholder", "Zebediah"]
    texts = []
    for _ in range(n):
        words = draw.choices(common, k=draw.randrange(60))
        for e, alias in zip(entities, aliases):
            if draw.random() < 0.12:
                at = draw.randrange(len(words) + 1)
                words[at:at] = [draw.choice([alias, alias.upper(), "of"]), e] if draw.random() < 0.8 else [e, alias]
            elif alias == "Quentin" and draw.random() < 0.3:
                words.append(alias)
        texts.append(draw.choice([" ", "\n", "  "]).join(words) + draw.choice(["", ".", "Runtime running"]))
    pieces = ["1", "2", "255", "256", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "_", "é", "4111111111111111", "00", "\n"]
    texts += ["".join(draw.choices(pieces, k=draw.randrange(40))) for _ in range(1500)]
    return texts


def run(spark, texts, **kw):
    rows = list(enumerate(texts)) + [(None, None), (5, None), (5, texts[0]), (5, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumns({"spans": F.lit(3), "term": F.lit("x"), "near": F.lit("y"), "n_ip": F.lit(0.5)})
    found = disclosure.report(disclosure.find_private(df, **kw)).collect()
    told = disclosing([t or "" for _, t in rows], 80, 3, kw.get("unknown_bits", 0.5))
    assert len(found) == len(rows)
    for r in found:
        assert (r["base_sha256"], r["spans"]) == expected(r["text"] or "", told), r["text"]
        own = Counter(s[0] for s in base(r["text"] or ""))
        assert [r[f"n_{k}"] for k in disclosure.KINDS] == [own[k] for k in disclosure.KINDS]
    return told


def test_against_plain_python(spark):
    told = run(spark, make(1))
    assert "annabel" in told and "street" not in told and "quentin" not in told
    assert run(spark, make(2), unknown_bits=2.5) != told


def test_long_texts(spark):
    texts = ["a" * 5_000, "1" * 5_000, "1 " * 3_000, "+1" + "(" * 5_000, "a@b." * 2_000, "é x@y.zz " * 1_000]
    texts += ["." * 3_000 + "@", "0" * 2_000 + ".0.0.0", "1.2.3." * 2_000, "4111111111111111\n" * 500]
    run(spark, texts)


def test_long_runs_are_entered_once(spark):
    """The plain patterns would take minutes over these."""
    texts = ["a" * 2_000_000, "1" * 2_000_000, "1 " * 1_000_000, "+1" + "(" * 2_000_000, "." * 2_000_000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = disclosure.report(disclosure.find_private(df)).agg(F.sum(F.length("spans"))).first()
    assert found[0] == 0


def test_one_text_copied_is_one_context(spark):
    rows = [(i, "Rareword writes to me@here.org today") for i in range(200)] + [(900, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert disclosure.disclosing_terms(df).count() == 0


def test_sanitised_text(spark):
    rows = [(i, f"Mr Zebulon{'!' * i} wrote to zeb@here.org, call +49 30 1234567 ({i})") for i in range(4)]
    rows += [(10, "Zebulon zebra zebras zebroid"), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit(1))
    out = disclosure.sanitise(df)
    assert out.columns == df.columns
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "<email>" in found[0] and "<phone>" in found[0] and "zeb@" not in found[0]
    assert found[11] is None and found[12] == ""
    told = {r["term"]: r["generalised"] for r in disclosure.disclosing_terms(df).collect()}
    assert told["zebulon"] is True and told["wrote"] is False
    assert found[10] == "Zeb* zebra zebras zebroid" and " wrote " not in found[1] and "Zeb*" in found[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert disclosure.report(disclosure.find_private(df)).count() == 0
    assert disclosure.sanitise(df).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a me@here.org")], "doc_id long, text string")
    plan = disclosure.report(disclosure.find_private(df))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


@pytest.mark.parametrize("text,count", [("a@b.c_d@e.f", 2), ("x@y", 0), ("a@b@c.d", 1), ("@b.c", 0), ("a@b..c", 0)])
def test_addresses_side_by_side(spark, text, count):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert disclosure.report(disclosure.find_private(df)).first()["n_email"] == count == len(base(text))


def test_sql_of_the_query_equals_plain_python():
    import duckdb
    import pandas as pd

    from tablewright.llm.queries import ORACLES

    texts = make(1) + ["a@b." * 200, "é x@y.zz " * 100, "1.2.3." * 200, ""]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    told = disclosing(texts, 80, 3, 0.5)
    assert told
    for row in con.execute(ORACLES["op13_disclosure"]).fetchall():
        assert (row[5], row[6]) == expected(texts[row[0]], told)
