"""Repair of conversations against trying all edits."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tablewright.llm import turns

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    """(conv, turn, role, text) after damage, in order; conversations of the rows before it."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)

    def place(row):
        named = f"{len(row[1])}:{row[1]}{row[2]}"
        return row[0] is not None, row[0] or 0, row[1].encode(), hashlib.sha256(named.encode()).digest()

    return {conv: sorted(own, key=place) for conv, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANKS)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def audits(rows, marks):
    """Cheapest and least (cost, audit, rows) by strings kept whole, all states of all prefixes."""
    state = {"": (0, "", ())}  # role initials so far, folded by what may follow
    fold = lambda s: s if len(s) < 3 else s[: len(s) % 2 + 2] if s[0] != "s" else s[: 2 + len(s) % 2]

    def better(into, key, offer):
        if key not in into or offer[:2] < into[key][:2]:
            into[key] = offer

    def inserts(state):
        for _ in range(2):
            new = dict(state)
            for s, (cost, audit, kept) in state.items():
                for role in ("user", "assistant"):
                    if re.fullmatch("s?(ua)*u?", s + role[0]):
                        better(new, fold(s + role[0]), (cost + 3, audit + "I", kept + ((role, ""),)))
            state = new
        return state

    for (_, role, text), mark in zip(rows, marks):
        new = {}
        for s, (cost, audit, kept) in inserts(state).items():
            better(new, s, (cost + 4, audit + "D", kept))
            if mark not in ("blank", "duplicate"):
                more = 3 * (mark == "truncated")
                for letter, r, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if r and re.fullmatch("s?(ua)*u?", s + r[0]):
                        better(new, fold(s + r[0]), (cost + price + more, audit + letter, kept + ((r, text),)))
        state = new
    return min(v for s, v in inserts(state).items() if re.fullmatch("(s?(ua)+)?", s))


def expected(rows):
    out = []
    for conv, own in damage(rows).items():
        marks = faults(own)
        known = [t for t, *_ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = audits(own, marks)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def frame(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    return df.withColumns({c: F.lit("x") for c in ("key", "run", "copies", "cost", "first", "facts")})


def found(df):
    return sorted((tuple(r) for r in turns.repair(turns.damaged(df), copies="copies").collect()), key=repr)


def make(seed, conversations=250):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \n", "cut ", "Ok. ", "é.", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", "sass", None]
    rows = []
    for conv in range(conversations):
        n = draw.choice([1, 2, 4, 9, 15])
        for turn in range(n):
            own = draw.choice(roles) if draw.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, draw.choice([turn, turn, turn, 2 * turn, None]), own, draw.choice(texts) if draw.random() < 0.5 else f"t{turn}."))
    rows += [(None, t, "user", "a.") for t in range(4)] + [(None, None, None, None)] + rows[:40] + rows[:5]
    return rows


def tried(rows, marks):
    """All edits of a few rows, one by one."""
    best = None

    def go(at, roles, cost, audit, inserted):
        nonlocal best
        if (best is not None and cost > best[0]) or not re.fullmatch("s?(ua)*u?", roles):
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserted < 3:
            for role in "ua":
                go(at, roles + role, cost + 3, audit + "I", inserted + 1)
        if at < len(rows):
            go(at + 1, roles, cost + 4, audit + "D", 0)
            if marks[at] not in ("blank", "duplicate"):
                more = 3 * (marks[at] == "truncated")
                go(at + 1, roles + rows[at], cost + more, audit + "K", 0)
                for role in "ua":
                    go(at + 1, roles + role, cost + 3 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def whole(symbols):
    run = turns.Whole()
    run.add([(0, *p) for p in turns.cheapest(symbols, 0)])
    return run.end()


def test_against_all_edits():
    draw = random.Random(3)
    for _ in range(400):
        symbols = "".join(draw.choices("suaxSUAXD", k=draw.randrange(5)))
        marks = ["blank" if s == "D" else "truncated" if s.isupper() else "" for s in symbols]
        assert whole(symbols) == tried(symbols.lower(), marks), symbols


def test_runs_put_together_are_the_whole():
    draw = random.Random(4)
    for n in (3, 40, 300):
        symbols = "".join(draw.choices("suaxSUAXDua", k=n))
        for cut in (1, 2, 7):
            run = turns.Whole()
            for at in range(0, n, cut):
                run.add([(q, *p) for q in range(4) for p in turns.cheapest(symbols[at : at + cut], q)])
            assert run.end() == whole(symbols)


@pytest.mark.parametrize("modulus", [turns.MODULUS, 7, 1])
def test_order_of_audits(modulus, monkeypatch):
    """Also where most hashes, or all of them, collide."""
    monkeypatch.setattr(turns, "MODULUS", modulus)
    draw, tree = random.Random(5), turns.Audits()
    nodes, texts = [0], [""]
    for _ in range(300):
        at = draw.randrange(max(0, len(nodes) - 40), len(nodes))
        letter = draw.choice("DIKR")
        nodes.append(tree.add(nodes[at], letter))
        texts.append(texts[at] + letter)
    for _ in range(3_000):
        a, b = draw.randrange(len(nodes)), draw.randrange(len(nodes))
        assert tree.less(nodes[a], nodes[b]) == (texts[a] < texts[b])
        assert tree.text(nodes[a]) == texts[a]


def test_against_whole_strings(spark, monkeypatch):
    rows = make(1)
    assert found(frame(spark, rows)) == expected(rows)


def test_conversation_over_many_tasks(spark):
    draw = random.Random(6)
    rows = [(1, t // 2 if t % 9 else None, draw.choice(["user", "assistant", "tool"]), draw.choice(["a.", "b", f"{t}?"])) for t in range(6_000)]
    rows += [(1, 77, "user", "same.")] * 9_000 + [(2, 1, "user", "x."), (0, 1, "user", "x.")]
    assert found(frame(spark, rows)) == expected(rows)


def test_repaired_rows(spark):
    rows = make(2, 60)
    out = {}
    listed = turns.repaired_rows(turns.damaged(frame(spark, rows)), copies="copies").collect()
    for r in sorted(listed, key=lambda r: (repr(r["conv_id"]), r["position"])):
        out.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    empty = hashlib.sha256(b"").hexdigest()
    for conv, *_, digest in expected(rows):
        assert digest == (hashlib.sha256("\n".join(out[conv]).encode()).hexdigest() if conv in out else empty)


def test_all_dropped_and_empty(spark):
    dropped = [c for c in range(200) if zlib.crc32(f"{c}:1".encode()) % 20 == 0][:3]
    rows = [(c, 1, "user", "a.") for c in dropped]
    empty = hashlib.sha256(b"").hexdigest()
    assert found(frame(spark, rows)) == sorted(((c, 0, 0, 0, 0, 0, 0, "", empty) for c in dropped), key=repr)
    assert found(frame(spark, [])) == []


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(df) == expected(rows)


@pytest.mark.parametrize("seed", [1, 9])
def test_sql_of_the_query_equals_plain_python(seed):
    import duckdb
    import pyarrow as pa

    from tablewright.llm.queries import ORACLES

    rows = make(seed)
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    con = duckdb.connect()
    con.register("conversations", pa.table({n: pa.array(v, k) for (n, k), v in zip(kinds.items(), zip(*rows))}))
    assert sorted(con.execute(ORACLES["op11_turn_repair"]).fetchall(), key=repr) == expected(rows)
