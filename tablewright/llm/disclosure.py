"""Personal data, and the terms that give it away.

Base entities are e-mail addresses, IP addresses, card and phone numbers. Their patterns
are written so that no text makes a match slow: a run of characters is entered at its
first character only. Positions are code points.

Around every entity lies a context: the whole words within ``reach`` characters on
either side, no further than the next entity of its kind. Over all documents, a term t
reveals an entity c by its pointwise mutual information, PMI(c;t) = log2(p(c,t) / p(c)p(t)),
against all there is to know, IC(c) = -log2 p(c). What stays unknown is IC - PMI =
log2(n(t) / n(c,t)) bits, with n(t) the occurrences of the term in the corpus and n(c,t)
those in contexts of c. A term with at most ``unknown_bits`` left, seen in at
least ``contexts`` different contexts of that entity, discloses it. It is generalised to
its first letters if these leave more than that open, and removed if they do not.

Everything is DataFrame operations: no Python on the executors. Occurrences are counted
in their tasks before anything is shuffled; texts are never shuffled unless the list of
documents with disclosing terms was measured too large to broadcast. A copied text is
one context, however often it occurs.

Inputs: a null text counts as empty and has no spans. Repeated rows, and rows without an
id, get the spans of their own text. Very long texts are read whole. An empty table gives an
empty result. Extra columns stay; the new ones take the place of columns of the same
name, and none may start with ``_pii``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.kinds import ref
from tablewright.llm.common import written
from tablewright.session import broadcast_if_small

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
# Leftmost matches of the plain patterns; a run is entered at its start or where a match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for its pattern to be tried at all.
GUARDS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda text: F.regexp_like(text, F.lit(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
    "phone": lambda text: F.contains(text, F.lit("+")),
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}"
REVEALING = "term"
HEAD = 3  # letters that a generalised term keeps
PART = 64  # matches whose positions are summed at a time
SPAN = "array<struct<start:int,end:int,found:string,near:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _context(before: Column, after: Column, reach: int) -> Column:
    """Whole words at the end of one text and the beginning of the other."""
    left = F.when(
        F.length(before) > reach,
        F.regexp_replace(F.right(before, F.lit(reach)), r"^[\p{L}\p{N}]+", ""),
    ).otherwise(before)
    right = F.when(
        F.length(after) > reach, F.regexp_replace(F.left(after, F.lit(reach)), r"[\p{L}\p{N}]+$", "")
    ).otherwise(after)
    return F.concat(left, F.lit(" "), right)


def _placed(steps: Column) -> Column:
    """Spans from (gap, size, found, near): running sums, a part of the array at a time."""
    empty = F.array().cast(SPAN)

    def one(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), (start + s["size"]).alias("end"), s["found"].alias("found"), s["near"].alias("near"))
        return F.struct((start + s["size"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def part(acc: Column, steps: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), empty.alias("spans"))
        return let(
            F.aggregate(steps, begin, one),
            lambda done: F.struct(done["at"].alias("at"), F.concat(acc["parts"], F.array(done["spans"])).alias("parts")),
        )

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PART).cast("int")),
        lambda i: F.slice(steps, i * PART + 1, F.lit(PART)),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts"))
    return F.when(
        F.size(steps) > 0, F.aggregate(parts, zero, part, lambda acc: F.flatten(acc["parts"]))
    ).otherwise(F.array().cast(SPAN))


def located(text: Column, pattern: str, reach: int = 0) -> Column:
    """Matches of a pattern with their places, and with their context if one is asked for."""

    def steps(found: Column, gaps: Column) -> Column:
        def step(m: Column, i: Column) -> Column:
            near = _context(F.get(gaps, i), F.get(gaps, i + 1), reach) if reach else F.lit("")
            return F.struct(
                F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), m.alias("found"), near.alias("near")
            )

        return F.transform(found, step)

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: let(F.split(text, pattern, -1), lambda gaps: let(steps(found, gaps), _placed)),
    )


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    digits = F.split(F.reverse(_digits(found)), "")

    def weight(c: Column, i: Column) -> Column:
        twice = c.cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(digits, weight), F.lit(0), lambda a, b: a + b) % 10 == 0


VALID = {
    "email": lambda found: F.lit(True),
    "ip": lambda found: F.regexp_like(found, F.lit(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")),
    "card": _luhn,
    "phone": lambda found: F.length(_digits(found)).between(8, 15),
}


def base_spans(text: Column, kind: str, reach: int = 0) -> Column:
    """Places of one kind of entity in a text without nulls."""
    spans = F.filter(located(text, PATTERNS[kind], reach), lambda s: VALID[kind](s["found"]))
    return F.when(GUARDS[kind](text), spans).otherwise(F.array().cast(SPAN))


def terms(text: Column) -> Column:
    """Lower-cased terms of a text, those inside e-mail addresses left out."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0))


def _value(kind: str, found: Column) -> Column:
    return F.lower(found) if kind == "email" else found if kind == "ip" else _digits(found)


def disclosing_terms(
    docs: DataFrame, text: str = "text", reach: int = 80, contexts: int = 3, unknown_bits: float = 0.5
) -> DataFrame:
    """(term, unknown_bits, generalised): the terms that give an entity of ``docs`` away."""
    whole = F.coalesce(ref(text), F.lit(""))

    def entity(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            F.lit(kind).alias("kind"), _value(kind, s["found"]).alias("value"), s["near"].alias("near")
        )

    entities = F.concat(*[F.transform(base_spans(whole, kind, reach), entity(kind)) for kind in KINDS])
    found = written(
        docs.select(F.explode(entities).alias("e"))
        .groupBy(F.xxhash64("e.kind", "e.value").alias("entity"), F.col("e.near").alias("near"))
        .agg(F.count(F.lit(1)).alias("times")),
        "pii-contexts",
    )
    # A context may hold a term twice.
    in_context = found.select(
        "entity", "times", F.explode(terms(F.col("near"))).alias("term"), F.xxhash64("near").alias("context")
    )
    pairs = written(
        in_context.groupBy("entity", "term", "context")
        .agg(F.sum("times").alias("times"))
        .groupBy("entity", "term")
        .agg(F.sum("times").alias("together"), F.count(F.lit(1)).alias("contexts"))
        .withColumn("head", F.left("term", F.lit(HEAD))),
        "pii-pairs",
    )
    heads = pairs.groupBy("entity", "head").agg(F.sum("together").alias("head_together"))
    likely = written(
        pairs.filter(F.col("contexts") >= contexts).join(heads, ["entity", "head"]), "pii-likely"
    )
    wanted = broadcast_if_small(likely.select("head").distinct())
    counts = written(
        docs.select(F.explode(terms(whole)).alias("term"))
        .withColumn("head", F.left("term", F.lit(HEAD)))
        .join(wanted, "head")
        .groupBy("head", "term")
        .agg(F.count(F.lit(1)).alias("times")),
        "pii-counts",
    )
    of_head = counts.groupBy("head").agg(F.sum("times").alias("head_times"))
    left_open = F.log2(F.col("times") / F.col("together"))
    head_open = F.log2(F.col("head_times") / F.col("head_together"))
    return (
        likely.join(counts, ["head", "term"])
        .filter(left_open <= unknown_bits)
        .join(of_head, "head")
        .groupBy("term")
        .agg(F.min(left_open).alias("unknown_bits"), (F.min(head_open) > unknown_bits).alias("generalised"))
    )


def find_private(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    disclosing: DataFrame | None = None,
    **thresholds,
) -> DataFrame:
    """``docs`` with _pii_email, _pii_ip, _pii_card, _pii_phone and _pii_term: arrays of spans.

    A span is (start, end, found, near); for a term ``near`` is what takes its place.
    """
    if disclosing is None:
        disclosing = disclosing_terms(docs, text, **thresholds)
    chosen = written(disclosing.select("term", "generalised"), "pii-terms")
    key = {"_pii_id": F.coalesce(ref(doc_id).cast("string"), F.lit("")), "_pii_hash": F.xxhash64(ref(text))}
    whole = F.coalesce(ref(text), F.lit(""))
    held = (
        docs.select(*[c.alias(n) for n, c in key.items()], F.explode(F.array_distinct(terms(whole))).alias("term"))
        .join(broadcast_if_small(chosen), "term")
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_set(F.struct("term", "generalised"))).alias("_pii_terms"))
    )
    held = broadcast_if_small(written(held, "pii-held"))
    spans = docs.withColumns(key | {f"_pii_{k}": base_spans(whole, k) for k in KINDS}).join(held, list(key), "left")
    base = F.concat(*[F.col(f"_pii_{k}") for k in KINDS])

    def revealing(base: Column) -> Column:
        def told(s: Column) -> Column:
            inside = F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            return F.map_contains_key(F.col("_pii_terms"), F.lower(s["found"])) & ~inside

        def replaced(s: Column) -> Column:
            general = F.concat(F.left(s["found"], F.lit(HEAD)), F.lit("*"))
            kept = F.try_element_at(F.col("_pii_terms"), F.lower(s["found"]))
            return s.withField("near", F.when(kept, general).otherwise(F.lit("")))

        return F.transform(F.filter(located(whole, TERM), told), replaced)

    found = F.when(F.col("_pii_terms").isNotNull(), let(base, revealing)).otherwise(F.array().cast(SPAN))
    return spans.withColumn("_pii_term", found).drop("_pii_id", "_pii_hash", "_pii_terms")


def _told(kind: str) -> Column:
    place = lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])
    return F.transform(F.col(f"_pii_{kind}"), place)


def report(found: DataFrame) -> DataFrame:
    """Spans as text: n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    base = F.array_join(F.concat(*[_told(k) for k in KINDS]), ",")
    counts = {f"n_{k}": F.size(f"_pii_{k}").cast("long") for k in (*KINDS, REVEALING)}
    made = counts | {
        "base_sha256": F.sha2(base.cast("binary"), 256),
        "spans": F.array_join(F.concat(*[_told(k) for k in (*KINDS, REVEALING)]), ","),
    }
    kept = [ref(c) for c in found.columns if c not in made and not c.startswith("_pii")]
    return found.select(*kept, *[c.alias(n) for n, c in made.items()])


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **thresholds) -> DataFrame:
    """``docs`` with entities replaced by their kind, disclosing terms generalised or removed.

    Of overlapping spans the first takes its name, and all of them go. A null text stays null.
    """
    found = find_private(docs, text, doc_id, **thresholds)

    def named(kind: str) -> Column:
        return F.transform(F.col(f"_pii_{kind}"), lambda s: s.withField("near", F.lit(f"<{kind}>")))

    # Sorted by start, then the longer span.
    spans = F.array_sort(
        F.transform(
            F.concat(*[named(k) for k in KINDS], F.col("_pii_term")),
            lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["near"].alias("near")),
        )
    )

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(ref(text), acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], kept, s["near"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], -s["last"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(ref(text), acc["at"] + 1, F.length(ref(text))))
    clean = F.when(ref(text).isNotNull(), F.aggregate(spans, zero, step, rest))
    return found.select(*[clean.alias(c) if c == text else ref(c) for c in docs.columns])
