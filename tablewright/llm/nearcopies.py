"""Near copies by one-permutation MinHash, exact on the candidates.

A document's set holds the hashes of its distinct word shingles. One hash per shingle
serves the whole signature: its high part names a bin, the smallest hash of a bin is
the bin's value, and an empty bin borrows from a bin that a second hash of (bin,
attempt) draws, tried until it is not empty (optimal densification), the same draws for
all documents. Groups of ``ROWS`` bins make ``BANDS`` band keys; documents that share
a key are candidates.

Equal sets are one node from the start, so exact copies cost nothing further. In a
bucket every node is paired with the bucket's smallest node only (a star), which keeps
pairs linear in the rows. Pairs are confirmed on the full sets and linked by connected
components. A star can miss a link between two of its points, so buckets that still
span several components are worked up again: the members outside a bucket's largest
component are compared with the members of its other components, about ``CENTRES`` of
them a round, until all have been. A pair is taken in the first band it shares only.
Nothing in a bucket remains untested but what is already in one component.

Before texts are read again, pairs whose sketches differ too much are dropped. Up to
``ODD`` shingles a sketch tells which of ``BITS`` places hold an odd number of the set's
shingles: a place that differs needs a shingle that only one of the sets has, and a link
has few of these, so no link is dropped. In larger sets it holds one bit for each of
``BITS`` bins, in which a link of similarity 0.8 differs in a tenth of the bits. A pair of a
larger and a smaller set is compared in full.

A link with similarity 0.8 has no common band with a probability of 2e-7. Between sets
of more than ``ODD`` shingles it is dropped by its sketch with one of 3e-7. Below 80
percent there are more bands, and the limit of sketches is wider, for the same
probabilities. Between sets of very few shingles a link is missed more often there, as
two shingles of a set may fall into one bin: at 50 percent, of links between a set of one
and a set of two, about 1 in 700 by calculation.

Inputs: a null text, or one without words, has an empty set and is linked with nothing.
A text with fewer words than a shingle has one shingle, the whole sequence. A null id
is no smaller than any other: a group has a null component id only if all its ids are
null. Rows that repeat an id and its text are reported each; ``drop_near_copies``
keeps one of them. Other columns are ignored, or returned unchanged by
``drop_near_copies``; none may start with ``_near``. Whole texts count, whatever their
length. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.functions.kinds import ref
from tablewright.llm.common import per_worker, portions, written
from tablewright.session import broadcast_if_small

BANDS = 40
ROWS = 5
BINS = BANDS * ROWS
CENTRES = 1024
BITS = 2048
FEW = 64  # filled bins up to which draws are looked up instead of made
ODD = 2048  # shingles up to which a sketch loses no link


def different(percent: int) -> int:
    """Bits that may differ in sketches of larger sets: half of what sets may, and five standard deviations."""
    share = (100 - percent) / 200
    return int(share * BITS + 5 * (share * (1 - share) * BITS) ** 0.5)


DIFFERENT = different(80)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
POWER = 0x9E3779B97F4A7C15 | 1


# --- shingle sets ---------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of word shingles; words are lower-cased (A-Z) and parted by ASCII white space."""

    def __init__(self, words: int):
        self.words = words
        letters = np.arange(256, dtype=np.uint64)
        lowered = np.where((letters >= 65) & (letters <= 90), letters + np.uint64(32), letters)
        self.values = _mix(lowered + np.uint64(1))
        blank = np.zeros(256, bool)
        blank[[0x20, *range(0x09, 0x0E)]] = True
        self.blank = blank
        self.powers = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            step = np.full(size, POWER, np.uint64)
            back = np.full(size, pow(POWER, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.powers, self.inverse = np.cumprod(step), np.cumprod(back)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        # A blank between texts; sums of letter values times powers give a hash of any span.
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self._grow(len(raw) + 1)
        blank = self.blank[raw]
        edge = np.diff(np.r_[True, blank].astype(np.int8))
        starts = np.flatnonzero(edge == -1)
        ends = np.flatnonzero(edge == 1)
        sums = np.r_[np.uint64(0), np.cumsum(self.values[raw] * self.powers[: len(raw)])]
        hashes = _mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        limits = np.cumsum([len(t) + 1 for t in texts])
        word_ends = np.searchsorted(starts, limits)
        k = self.words
        rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for at in range(k):
            rolled = rolled * np.uint64(POWER) + hashes[at : at + len(rolled)]
        rolled = _mix(rolled)
        out = []
        for a, b in zip(np.r_[0, word_ends[:-1]].tolist(), word_ends.tolist()):
            if b - a >= k:
                own = np.sort(rolled[a : b - k + 1])
                out.append(own[np.r_[True, own[1:] != own[:-1]]])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for at in range(a, b):
                    whole = _mix(whole * np.uint64(POWER) + hashes[at : at + 1])
                out.append(whole)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _draw(bins: np.ndarray, attempt: int, size: int) -> np.ndarray:
    """The bin that each of ``bins`` draws in an attempt."""
    return (_mix(bins.astype(np.uint64) + np.uint64(attempt * size)) % np.uint64(size)).astype(np.int64)


def _first_draws(size: int) -> np.ndarray:
    """For every bin, the attempt that first draws each other bin.

    Bins not drawn in so many attempts follow in an order of their own.
    """
    every = np.arange(size)
    attempts = 16 * size
    order = _mix(every[:, None].astype(np.uint64) * np.uint64(POWER) + every.astype(np.uint64))
    table = attempts + 1 + (order >> np.uint64(40)).astype(np.int32)
    for attempt in range(attempts, 0, -1):
        table[every, _draw(every, attempt, size)] = attempt
    return table


def bin_values(sets: list[np.ndarray], size: int = BINS) -> np.ndarray:
    """The smallest hash of each bin, empty bins filled by densification; no set may be empty."""
    values = np.full((len(sets), size), EMPTY)
    for row, own in zip(values, sets):
        bins = ((own >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        first = np.r_[True, bins[1:] != bins[:-1]]  # sorted hashes have sorted bins
        row[bins[first].astype(np.int64)] = own[first]
    filled = values != EMPTY
    out = values.copy()
    few = filled.sum(axis=1) <= FEW
    if few.any():  # these would draw in vain many times: look up which of their bins comes first
        table = per_worker(f"draws:{size}", lambda: _first_draws(size))
        for row in np.flatnonzero(few).tolist():
            own = np.flatnonzero(filled[row])
            borrowed = values[row, own[table[:, own].argmin(axis=1)]]
            out[row] = np.where(filled[row], values[row], borrowed)
    rows, bins = np.nonzero(~filled & ~few[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        drawn = _draw(bins, attempt, size)
        found = filled[rows, drawn]
        out[rows[found], bins[found]] = values[rows[found], drawn[found]]
        rows, bins = rows[~found], bins[~found]
    return out


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows) in which a link shares a band as surely as one of 80 percent does in BANDS and ROWS."""
    if not 0 < percent <= 100:
        raise PrepareError(f"percent must be from 1 to 100, not {percent}")
    if percent >= 80:
        return BANDS, ROWS
    missed = BANDS * math.log1p(-(0.8**ROWS))
    needed = {rows: math.ceil(missed / math.log1p(-((percent / 100) ** rows))) for rows in range(1, ROWS + 1)}
    rows = max((r for r, n in needed.items() if n <= 4 * BANDS), default=1)
    return needed[rows], rows


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    keys = np.tile(np.arange(values.shape[1] // rows, dtype=np.uint64), (len(values), 1))
    for at in range(rows):
        keys = _mix(keys * np.uint64(POWER) + values[:, at::rows])
    return keys


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A bit per bin, of the bin's value and number, as 64-bit words."""
    values = bin_values(sets, BITS)
    bits = _mix(values * np.uint64(POWER) + np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)


def odd_places(sets: list[np.ndarray]) -> np.ndarray:
    """A bit per place, whether an odd number of the set's hashes fall there, as 64-bit words."""
    bits = np.zeros((len(sets), BITS), np.uint8)
    for row, own in zip(bits, sets):
        row[:] = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _sketched(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sketch of each set, of the kind that its size asks for."""
    small = iter(odd_places([s for s in sets if len(s) <= ODD]))
    large = [s for s in sets if len(s) > ODD]
    bits = iter(sketches(large)) if large else iter(())
    return [next(small) if len(s) <= ODD else next(bits) for s in sets]


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _each(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Portions of a batch's texts with the row each starts at."""
    at = 0
    for part in portions([t or b"" for t in batch.column(column).to_pylist()], 1_000_000):
        yield at, part
        at += len(part)


def signatures(docs: DataFrame, words: int, percent: int = 80) -> DataFrame:
    """(id, text_hash, n_shingles, digest, bands, sketch) of (id, text_hash, text binary)."""
    bands, rows = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at, part in _each(batch, 2):
                sets = shingler.sets(part)
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(bin_values(full, bands * rows), rows)) if full else iter(())
                bits = iter(_sketched(full))
                none = np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)),
                        batch.column(1).slice(at, len(part)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        _lists([next(keys) if len(s) else none for s in sets]),
                        _lists([next(bits) if len(s) else none for s in sets]),
                    ],
                    ["id", "text_hash", "n_shingles", "digest", "bands", "sketch"],
                )

    columns = "id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch array<long>"
    return docs.mapInArrow(run, columns)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(digest, shingles) of (text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for _, part in _each(batch, 0):
                sets = shingler.sets(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()), _lists(sets)],
                    ["digest", "shingles"],
                )

    return docs.mapInArrow(run, "digest binary, shingles array<long>")


# --- links ----------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the smallest node each can reach.

    Large-star and small-star steps in turn until nothing changes; every step is an
    aggregate and a join, and only a checksum comes to the driver.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        "near-edges",
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        edges = written(small, "near-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)


def _alike(one: str, other: str, n_one: str, n_other: str, percent: int) -> Column:
    """Whether two sketches, of sets of ``n_one`` and ``n_other`` shingles, may belong to a link."""
    words = range(BITS // 64)
    apart = sum((F.bit_count(F.col(one)[k].bitwiseXOR(F.col(other)[k])) for k in words), F.lit(0))
    # Of a link's shingles, counted in both sets, this share at most is in one set only.
    few = apart * (100 + percent) <= (F.col(n_one) + F.col(n_other)) * (100 - percent)
    small = F.greatest(n_one, n_other) <= ODD
    return F.when(small, few).otherwise((F.least(n_one, n_other) <= ODD) | (apart <= different(percent)))


def _near_in_size(one: str, other: str, percent: int) -> Column:
    """A similarity needs sizes that far apart at most."""
    return F.least(one, other) * 100 >= F.greatest(one, other) * percent


def _sized(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that may be links, as (a, b, n_a, n_b)."""
    facts = nodes.select("digest", "n_shingles", "sketch")
    return (
        pairs.join(facts.toDF("a", "n_a", "k_a"), "a")
        .join(facts.toDF("b", "n_b", "k_b"), "b")
        .filter(_near_in_size("n_a", "n_b", percent) & _alike("k_a", "k_b", "n_a", "n_b", percent))
        .select("a", "b", "n_a", "n_b")
    )


def _confirmed(sized: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``sized`` (a, b, n_a, n_b) whose full sets are similar enough."""
    sized = written(sized, "near-pairs")
    needed = sized.select("a").union(sized.select("b")).toDF("digest").distinct()
    owners = written(nodes.join(needed, "digest").select("owner", "text_hash"), "near-owners")
    texts = docs.join(broadcast_if_small(owners), ["owner", "text_hash"], "left_semi").select("text")
    sets = written(shingle_sets(texts, words).dropDuplicates(["digest"]), "near-sets")
    return (
        sized.join(sets.toDF("a", "s_a"), "a")
        .join(sets.toDF("b", "s_b"), "b")
        .withColumn("common", F.size(F.array_intersect("s_a", "s_b")).cast("long"))
        .filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent)
        .select("a", "b")
    )


def _stars(buckets: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's smallest."""
    heads = buckets.groupBy("key").agg(F.min("digest").alias("head"), F.max("digest").alias("other"))
    heads = heads.filter("head <> other").select("key", "head")
    return (
        buckets.join(heads, "key")
        .filter("digest <> head")
        .select(F.col("head").alias("a"), F.col("digest").alias("b"))
        .distinct()
    )


def _left_over(buckets: DataFrame, found: DataFrame, nodes: DataFrame, percent: int) -> Iterator[DataFrame]:
    """Rounds of pairs (a, b, n_a, n_b) that share a bucket but no component and may be links."""
    placed = buckets.join(found.toDF("digest", "component"), "digest", "left")
    placed = placed.withColumn("component", F.coalesce("component", "digest"))
    groups = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    open_ = groups.groupBy("key").agg(
        F.max(F.struct("rows", "component")).alias("largest"), F.sum("rows").alias("rows")
    )
    open_ = open_.filter(F.col("rows") > F.col("largest.rows")).select(
        "key",
        F.col("largest.component").alias("main"),
        F.ceil((F.col("rows") - F.col("largest.rows")) / CENTRES).alias("turns"),
    )
    facts = nodes.select("digest", "n_shingles", "bands", "sketch")
    members = written(placed.join(open_, "key").join(facts, "digest"), "near-open")
    turns = members.agg(F.max("turns")).first()[0] or 0
    for turn in range(turns):
        mine = F.pmod(F.xxhash64("key", "digest"), F.col("turns")) == turn
        centres = members.filter((F.col("component") != F.col("main")) & mine)
        centres = centres.select("key", *[F.col(c).alias(f"c_{c}") for c in ("digest", "component", "n_shingles", "bands", "sketch")])
        first_band = F.array_min(F.array_intersect("bands", "c_bands")) == F.col("m.key")
        apart = (
            (F.col("m.key") == F.col("c.key"))
            & (F.col("component") != F.col("c_component"))
            & _near_in_size("n_shingles", "c_n_shingles", percent)
            & _alike("sketch", "c_sketch", "n_shingles", "c_n_shingles", percent)
            & first_band
        )
        pairs = members.alias("m").join(centres.alias("c"), apart)
        one, other = F.struct("digest", "n_shingles"), F.struct(F.col("c_digest").alias("digest"), F.col("c_n_shingles").alias("n_shingles"))
        ordered = pairs.select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).distinct()
        yield ordered.select("x.digest", "y.digest", "x.n_shingles", "y.n_shingles").toDF("a", "b", "n_a", "n_b")


def _owner(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, text_hash, n_shingles, component_id) of (id, text_hash, text binary, owner)."""
    marked = written(signatures(docs.select("id", "text_hash", "text"), words, percent), "near-signatures")
    some = F.min_by(F.struct("id", "text_hash"), F.struct(F.col("id").isNull(), "id", "text_hash"))
    nodes = (
        marked.filter("digest is not null")
        .groupBy("digest")
        .agg(some.alias("one"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")])
        .select("digest", "one.id", "one.text_hash", "n_shingles", "bands", "sketch")
        .withColumn("owner", _owner(F.col("id")))
    )
    nodes = written(nodes, "near-nodes")
    bands = nodes.select("digest", F.explode("bands").alias("key"))
    counted = bands.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    shared = counted.filter("low <> high").select("key")
    buckets = written(bands.join(shared, "key").distinct(), "near-buckets")

    links = _sized(_stars(buckets), nodes, percent)
    links = written(_confirmed(links, nodes, docs, words, percent), "near-links")
    found = written(components(links), "near-components")
    more = None
    for pairs in _left_over(buckets, found, nodes, percent):
        part = written(_confirmed(pairs, nodes, docs, words, percent), "near-links")
        more = part if more is None else more.unionByName(part)
    if more is not None and not more.isEmpty():
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = written(components(known.unionByName(more)), "near-components")

    names = found.join(nodes.select(F.col("digest").alias("node"), "id"), "node")
    least = names.groupBy("component").agg(F.min("id").alias("component_id"))
    of_node = (
        nodes.join(found.select(F.col("node").alias("digest"), "component"), "digest", "left")
        .join(least, "component", "left")
        .select("digest", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    )
    rows = marked.select("id", "text_hash", "n_shingles", "digest").join(of_node, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return rows.select("id", "text_hash", "n_shingles", own.alias("component_id"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        ref(doc_id).cast("long").alias("id"),
        F.xxhash64(ref(text)).alias("text_hash"),
        ref(text).cast("binary").alias("text"),
        _owner(ref(doc_id).cast("long")).alias("owner"),
    )


def find_near_copies(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per document: (doc_id, n_shingles, component_id, kept)."""
    grouped = _grouped(_keyed(docs, doc_id, text), words, percent)
    return grouped.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one with the smallest id.

    Rows without words are in no group and stay.
    """
    columns = [ref(c) for c in docs.columns]
    grouped = _grouped(_keyed(docs, doc_id, text), words, percent)
    kept = grouped.filter(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0))
    kept = kept.select(_owner(F.col("id")).alias("_near_id"), F.col("text_hash").alias("_near_hash")).distinct()
    keyed = docs.withColumns(
        {"_near_id": _owner(ref(doc_id).cast("long")), "_near_hash": F.xxhash64(ref(text))}
    )
    wordless = ~F.coalesce(F.regexp_like(ref(text), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    stay = keyed.filter(~wordless).join(kept, ["_near_id", "_near_hash"], "left_semi")
    stay = stay.dropDuplicates(["_near_id", "_near_hash"]).select(*columns)
    return stay.unionByName(docs.filter(wordless))
