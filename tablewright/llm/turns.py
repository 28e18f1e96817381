"""Conversations brought into turn order by the cheapest edits.

Roles must read ``(s?(ua)+)?`` by their initials. A row is kept (K, 0), reroled to user or
assistant (R, 3) or deleted (D, 4; blank rows and repeats must go), an empty row is inserted
anywhere (I, 3), and a truncated row that stays adds 3. The audit is the edits' initials in order,
the ASCII-least of the cheapest.

A dynamic programme runs over (rows read, state of the pattern). Audits are nodes of a
tree that share their prefixes, with ancestors at powers of two and a rolling hash of
the letters. Of two equally cheap audits the longest common prefix is searched by these, and verified
letter by letter down to the first shared node, so a collision of hashes cannot matter. Two
audits of equal cost for the same rows and states are never one the other's prefix, as every further
letter costs or reads a row; so the least one of a part of the rows stays the least of the whole.

Rows go through Spark without their texts first: equal rows are counted together, the first of a role and text is found
by grouping, and a range sort deals the rows of all conversations out, a long one over many
tasks. Each task sums a run of at most ``BLOCK`` rows up as the cheapest audits
from every state to every state; then the few runs of a conversation are put together.
Texts are shuffled once, to their conversation, and streamed in order
through the edits, never held: the digest of a repaired conversation is one sequence by
nature, and so is its audit, a letter per row.

Inputs: null roles and texts count as one space. Rows are taken by turn, nulls first; rows of one turn by
role, then by the SHA-256 of role and text; equal rows stand side by side. Rows with a null conversation
are one conversation. ``copies`` says how often a row stands there; a conversation whose rows all stand there
0 times has zeros, an empty audit and the digest of an empty text. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import ref

BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 4_096  # rows whose edits are summed up at a time
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# States of (s?(ua)+)?: nothing yet, after s, after u, after a.
STATES = 4
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
GONE = "D"  # a row that must be deleted
SLICE = 256  # rows turned into Python objects at a time
MODULUS, BASE = (1 << 61) - 1, 1_000_003


# --- audits -----------------------------------------------------------------------


class Audits:
    """Strings that share prefixes: a node is a parent and a letter."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        up = [parent]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(letter)) % MODULUS)
        self.up.append(tuple(up))
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        over = self.depth[node] - depth
        while over:
            k = over.bit_length() - 1
            node = self.up[node][k]
            over -= 1 << k
        return node

    def less(self, x: int, y: int) -> bool:
        """Whether the text of x comes before that of y."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        # Up to the first letters behind the longest common prefix, as far as hashes tell.
        if self.hash[a] != self.hash[b]:
            for k in reversed(range(len(self.up[a]))):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
        differ = None
        while a != b:  # equal hashes above may still hide a difference
            if self.letter[a] != self.letter[b]:
                differ = self.letter[a] < self.letter[b]
            a, b = self.up[a][0], self.up[b][0]
        return self.depth[x] < self.depth[y] if differ is None else differ

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _least(audits: Audits, offers: list[tuple[int, int, str]]) -> tuple[int, int] | None:
    """The cheapest of (cost, parent, letter), by text where equal; an empty letter is the parent itself."""
    if not offers:
        return None
    cost = min(o[0] for o in offers)
    best = None
    for _, parent, letter in {o for o in offers if o[0] == cost}:
        node = audits.add(parent, letter) if letter else parent
        if best is None or audits.less(node, best):
            best = node
    return cost, best


def _inserted(audits: Audits, reached: list) -> list:
    """States after any number of insertions; more than two in a row never pay."""
    for to, roles in ((2, (0, 1, 3)), (3, (2,))):
        offers = [(reached[q][0] + INSERT, reached[q][1], "I") for q in roles if reached[q]]
        if reached[to]:
            offers.append((*reached[to], ""))
        reached = [_least(audits, offers) if q == to else r for q, r in enumerate(reached)]
    return reached


@lru_cache(maxsize=1 << 14)
def cheapest(rows: str, entry: int) -> tuple[tuple[int, int, str], ...]:
    """(state, cost, audit) of the cheapest edits of some rows, from one state to every other.

    A row is its role's initial, x for any other, in upper case if truncated, or D.
    """
    audits = Audits()
    reached: list = [None] * STATES
    reached[entry] = (0, 0)
    for row in rows:
        reached = _inserted(audits, reached)
        offers: list[list] = [[] for _ in range(STATES)]
        extra = TRUNCATED if row.isupper() else 0
        for q, known in enumerate(reached):
            if known is None:
                continue
            cost, node = known
            offers[q].append((cost + DELETE, node, "D"))
            if row != GONE:
                if (q, row.lower()) in STEP:
                    offers[STEP[q, row.lower()]].append((cost + extra, node, "K"))
                for role in "ua":
                    if (q, role) in STEP:
                        offers[STEP[q, role]].append((cost + REROLE + extra, node, "R"))
        reached = [_least(audits, o) for o in offers]
    return tuple((q, known[0], audits.text(known[1])) for q, known in enumerate(reached) if known)


class Whole:
    """Runs of one conversation put together: per state the cost and a chain of audit pieces."""

    def __init__(self):
        self.reached: dict[int, tuple[int, tuple]] = {0: (0, ())}

    @staticmethod
    def _text_before(x: tuple, y: tuple) -> bool:
        """Whether chain x, as (parent, piece), comes before y; both have as many pieces."""
        left, right = [], []
        while x is not y:
            left.append(x[1])
            right.append(y[1])
            x, y = x[0], y[0]
        return "".join(reversed(left)) < "".join(reversed(right))

    def add(self, pieces: list[tuple[int, int, int, str]]) -> None:
        """(from state, to state, cost, audit) of the next run."""
        found: dict[int, tuple[int, tuple]] = {}
        for start, end, cost, audit in pieces:
            if start not in self.reached:
                continue
            before, chain = self.reached[start]
            offer = (before + cost, (chain, audit))
            known = found.get(end)
            if known is None or offer[0] < known[0] or (offer[0] == known[0] and self._text_before(offer[1], known[1])):
                found[end] = offer
        self.reached = found

    def end(self) -> tuple[int, str]:
        closing = []
        for q in self.reached:
            audits = Audits()
            start: list = [None] * STATES
            start[q] = (0, 0)
            closing += [(q, to, k[0], audits.text(k[1])) for to, k in enumerate(_inserted(audits, start)) if k]
        self.add(closing)
        ends = [(cost, chain) for q, (cost, chain) in self.reached.items() if q in ENDS]
        best = ends[0]
        for other in ends[1:]:
            if other[0] < best[0] or (other[0] == best[0] and self._text_before(other[1], best[1])):
                best = other
        pieces, chain = [], best[1]
        while chain:
            pieces.append(chain[1])
            chain = chain[0]
        return best[0], "".join(reversed(pieces))


# --- runs of rows -------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal", "rows")
RUN = T.StructType(
    [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField(c, T.StringType()) for c in ("first", "last")]
    + [T.StructField(c, T.LongType()) for c in ("low", "high", "turns")]
    + [T.StructField("edges", T.ArrayType(T.IntegerType())), T.StructField("costs", T.ArrayType(T.LongType()))]
    + [T.StructField("audits", T.ArrayType(T.StringType()))]
)


def _joined(one: dict | None, two: dict) -> dict:
    """Counts of two runs next to each other."""
    if one is None:
        return two
    out = {c: one[c] + two[c] for c in COUNTS}
    if one["rows"] and two["rows"]:
        out["illegal"] += one["last"] + two["first"] not in LEGAL
    out["first"] = one["first"] if one["rows"] else two["first"]
    out["last"] = two["last"] if two["rows"] else one["last"]
    out["turns"] = one["turns"] + two["turns"]
    if one["high"] is not None and one["high"] == two["low"]:
        out["turns"] -= 1  # turns come in order: only the edge can be shared
    out["low"] = two["low"] if one["low"] is None else one["low"]
    out["high"] = one["high"] if two["high"] is None else two["high"]
    return out


def _row_run(turn, initial: str, blank: bool, truncated: bool, first: bool, copies: int) -> tuple[dict, str]:
    """Counts of equal rows side by side, and their symbols."""
    kept = copies > 0 and first and not blank
    counts = {
        "blank": copies if blank else 0,
        "duplicate": 0 if blank else copies - kept,
        "truncated": int(kept and truncated),
        "illegal": max(0, copies - 1),
        "rows": copies,
        "first": initial,
        "last": initial,
        "low": turn if copies else None,
        "high": turn if copies else None,
        "turns": int(copies > 0 and turn is not None),
    }
    symbol = initial.upper() if truncated else initial
    return counts, (symbol if kept else "") + GONE * (copies - kept)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from batch.slice(at, SLICE).to_pylist()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole and cut conversations into runs."""
    part = TaskContext.get().partitionId()
    done: list[dict] = []
    state = {"key": None, "number": 0, "counts": None, "symbols": "", "first": True, "opened": False}

    def close() -> None:
        symbols = state["symbols"]
        # What stands before the first rows of a task, or behind a cut, is not known here.
        entries = range(STATES) if state["first"] or state["number"] else (0,)
        paths = [(q * STATES + to, cost, audit) for q in entries for to, cost, audit in cheapest(symbols, q)]
        run = state["counts"] | {
            "edges": [p[0] for p in paths],
            "costs": [p[1] for p in paths],
            "audits": [p[2] for p in paths],
        }
        done.append({"key": state["key"], "part": part, "number": state["number"], "run": run})
        state.update(number=state["number"] + 1, counts=None, symbols="")

    def batch() -> pa.RecordBatch:
        schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("run", _arrow(RUN))])
        out = pa.RecordBatch.from_pylist(done, schema)
        done.clear()
        return out

    for row in _sliced(batches):
        if row["key"] != state["key"] or not state["opened"]:
            if state["opened"]:
                if state["counts"] is not None:
                    close()
                state["first"] = False
            state.update(key=row["key"], number=0, counts=None, symbols="", opened=True)
        left, fresh = row["copies"], row["first"]
        while True:  # many equal rows are cut as well
            take = min(left, BLOCK - len(state["symbols"]))
            counts, symbols = _row_run(row["turn"], row["initial"], row["blank"], row["truncated"], fresh, take)
            state["counts"] = _joined(state["counts"], counts)
            state["symbols"] += symbols
            left, fresh = left - take, fresh and not take
            if len(state["symbols"]) >= BLOCK:
                close()
            if not left:
                break
        if len(done) >= 1_000:
            yield batch()
    if state["counts"] is not None:
        close()
    yield batch()


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[kind]


# --- whole conversations --------------------------------------------------------------


class Editor:
    """Applies an audit to rows in their order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _made(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = STEP[self.state, role[0]]
        return role

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands in place of a row and of what is put before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEP[self.state, role[0]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._made(), text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict, int, str, Iterator]]:
    """(key, counts, cost, audit, repaired rows) of each conversation of a sorted stream."""
    rows = _sliced(batches)
    row = next(rows, None)
    while row is not None:
        key, counts, whole = row["key"], None, Whole()
        while row is not None and row["key"] == key and row["run"] is not None:
            run = row["run"]
            counts = _joined(counts, {c: run[c] for c in run if c not in ("edges", "costs", "audits")})
            whole.add([(e // STATES, e % STATES, c, a) for e, c, a in zip(run["edges"], run["costs"], run["audits"])])
            row = next(rows, None)
        cost, audit = whole.end()
        editor = Editor(audit)

        def repaired() -> Iterator[tuple[str, str, str]]:
            nonlocal row
            while row is not None and row["key"] == key:
                for _ in range(row["copies"]):
                    yield from editor.row(row["role"], row["text"])
                row = next(rows, None)
            yield from editor.inserted()

        yield key, counts, cost, audit, repaired()


REPORT = (
    "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    done: list[tuple] = []
    for key, n, cost, audit, rows in _conversations(batches):
        digest, between = hashlib.sha256(), b""
        for _, role, text in rows:
            digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            between = b"\n"
        gaps = 0 if n["low"] is None else n["high"] - n["low"] + 1 - n["turns"]
        done.append((key, gaps, *(n[c] for c in COUNTS[:4]), cost, audit, digest.hexdigest()))
        if len(done) >= 1_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
            done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, done = ["key", "position", "edit", "role", "text"], []
    for key, *_, rows in _conversations(batches):
        for position, (edit, role, text) in enumerate(rows):
            done.append((key, position, edit, role, text))
            if len(done) >= SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
                done = []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)


# --- operators ----------------------------------------------------------------------


def _keyed(rows: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    role_text = [F.coalesce(ref(c).cast("string"), F.lit(" ")) for c in (role, text)]
    named = F.concat(F.length(role_text[0]).cast("string"), F.lit(":"), *role_text)
    return rows.select(
        F.coalesce(F.concat(F.lit("="), ref(conv).cast("string")), F.lit("")).alias("key"),
        ref(turn).isNotNull().alias("known"),
        F.coalesce(ref(turn).cast("long"), F.lit(0)).alias("turn"),
        role_text[0].alias("role"),
        role_text[1].alias("text"),
        F.unhex(F.sha2(named.cast("binary"), 256)).alias("digest"),
        (ref(copies).cast("long") if copies else F.lit(1).cast("long")).alias("copies"),
    )


def _streamed(keyed: DataFrame) -> DataFrame:
    """Runs and rows of every conversation, in order, each conversation in one task."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    facts = F.struct(
        F.col("role"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")).alias("initial"),
        (body == "").alias("blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    place = ["key", "known", "turn", "digest"]
    light = keyed.groupBy(*place).agg(F.max(facts).alias("facts"), F.sum("copies").alias("copies"))
    seen = keyed.filter("copies > 0").groupBy("key", "digest").agg(F.min(F.struct("known", "turn")).alias("at"))
    seen = seen.select("key", "at.known", "at.turn", "digest", F.lit(True).alias("first"))
    order = ["key", "known", "turn", "facts.role", "digest"]
    runs = (
        light.join(seen, place, "left")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "key",
            F.when(F.col("known"), F.col("turn")).alias("turn"),
            "facts.initial",
            "facts.blank",
            "facts.truncated",
            F.coalesce("first", F.lit(False)).alias("first"),
            "copies",
        )
        .mapInArrow(_runs, f"key string, part long, number long, run {RUN.simpleString()}")
    )
    columns = ["key", "kind", "known", "turn", "number", "role", "digest", "text", "copies", "run"]
    none = F.lit(None)
    runs = runs.select(
        "key", F.lit(0).alias("kind"), F.lit(True).alias("known"), F.col("part").alias("turn"), "number",
        F.lit("").alias("role"), F.lit(b"").alias("digest"), none.cast("string").alias("text"),
        F.lit(0).cast("long").alias("copies"), "run",
    )
    texts = keyed.filter("copies > 0").withColumns(
        {"kind": F.lit(1), "number": F.lit(0).cast("long"), "run": none.cast(RUN)}
    )
    together = runs.unionByName(texts.select(*columns))
    return together.repartition("key").sortWithinPartitions(*columns[:7]).select("key", "role", "text", "copies", "run")


def _conv(kind: T.DataType) -> Column:
    """The conversation a key stands for."""
    return F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind)


def repair(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: str | None = None,
) -> DataFrame:
    """Per conversation: gaps, faults, cost, audit and the digest of its repaired rows."""
    found = _streamed(_keyed(rows, conv, turn, role, text, copies)).mapInArrow(_reports, REPORT)
    return found.select(_conv(rows.schema[conv].dataType).alias(conv), *[c for c in found.columns if c != "key"])


def repaired_rows(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    copies: str | None = None,
) -> DataFrame:
    """(conversation, position, edit, role, text): the conversations as repaired."""
    found = _streamed(_keyed(rows, conv, turn, role, text, copies)).mapInArrow(
        _repaired, "key string, position long, edit string, role string, text string"
    )
    return found.select(_conv(rows.schema[conv].dataType).alias(conv), "position", "edit", "role", "text")


def damaged(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conversation, turn, role, text, copies): rows spoilt by crc32 of ``conversation:turn``, modulo 20.

    0 drops a row (0 copies), 1 empties its text, 2 takes ``.!?`` from it, 3 repeats it, 4 makes its role user.
    Nulls count as one space, but in the two columns that name the row they stay null.
    """
    filled = {c: F.coalesce(ref(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)}
    lot = F.crc32(F.concat(filled[conv], F.lit(":"), filled[turn]).cast("binary")) % 20
    return rows.select(
        ref(conv),
        ref(turn),
        F.when(lot == 4, F.lit("user")).otherwise(filled[role]).alias(role),
        F.when(lot == 1, F.lit(""))
        .when(lot == 2, F.translate(filled[text], ".!?", ""))
        .otherwise(filled[text])
        .alias(text),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).alias("copies"),
    )
