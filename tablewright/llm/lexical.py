"""Ranked lexical search: term at a time, with a limit on accumulators.

Documents are read once into a compact table of the queries' terms: per document its
length, and the numbers and counts of the query terms it holds, in two flat lists. All that
follows works on it, a batch of documents in a task at a time.

A query takes its terms rarest first. After each round every query learns, over all
tasks, the k-th best partial score, and what the terms left could add at most, from the
largest share each of them has in any document. Once what is left cannot lift a document
without an accumulator to the k-th partial score, the query makes no new ones;
the next round looks at twice the terms for the queries still open. A last pass makes the
accumulators of each query's first terms, adds the other terms to those exactly, and keeps
the k best of each task before the final ranking. Partial scores never fall, so
the k-th of them is a safe limit; a tie is never cut off. Accumulators are those of
one query and one batch of documents at a time, so memory is bounded whatever their number.

Queries are the caller's stated set: their terms are numbered in the driver and broadcast
after their size was measured, in blocks of ``QUERY_BLOCK`` queries a pass.

Inputs: a null text has no terms. Rows with equal ids and texts of ``items`` are one query;
two texts under one id are two queries, ranked each. Rows of ``docs`` count each
by themselves; equal scores come by ascending id, a null id last. A query without terms, or without
a document above 0, gives no row. Extra columns are ignored. Empty tables give an empty
result. Long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.errors import TablewrightError
from tablewright.functions.kinds import ref
from tablewright.llm.common import written
from tablewright.session import is_small

# Of the UTF-8 bytes of a text: letters and digits, and all that is not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
QUERY_BLOCK = 4_096
FIRST = 2  # terms in the first round


def split_terms(text: str | None) -> list[bytes]:
    """Terms with A-Z in lower case: bytes above 127 belong to no ASCII character."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _counted(numbers: dict[bytes, int], text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    words = split_terms(text)
    held = [n for n in map(numbers.get, words) if n is not None]
    terms, counts = np.unique(np.array(held, np.int32), return_counts=True)
    return len(words), terms, counts.astype(np.int32)


def _postings(docs: DataFrame, numbers, doc_id: str, text: str) -> DataFrame:
    """(doc_id, length, terms, counts) of every document with at least one term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_counted(numbers.value, t.as_py()) for t in batch.column(1)]
            at = np.flatnonzero([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array([rows[i][0] for i in at], pa.int64()),
                    pa.array([rows[i][1] for i in at], pa.list_(pa.int32())),
                    pa.array([rows[i][2] for i in at], pa.list_(pa.int32())),
                ],
                ["doc_id", "length", "terms", "counts"],
            )

    chosen = docs.select(ref(doc_id).cast("long").alias("doc_id"), ref(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, length long, terms array<int>, counts array<int>")


@dataclass
class Batch:
    """Postings of a run of documents, sorted by term."""

    ids: np.ndarray
    known: np.ndarray  # whether the id is not null
    starts: np.ndarray  # of each term, one more at the end
    rows: np.ndarray
    share: np.ndarray  # of a term in a document, before its weight


def _batches(batches: Iterator[pa.RecordBatch], terms: int, total: int, size: int) -> Iterator[Batch]:
    """``total`` documents hold ``size`` terms altogether."""
    for batch in batches:
        lists = batch.column(2)
        per = np.diff(lists.offsets.to_numpy())
        term = lists.flatten().to_numpy().astype(np.int64)
        count = batch.column(3).flatten().to_numpy().astype(np.int64)
        length = batch.column(1).to_numpy().astype(np.int64)
        m = 25 + 75 * length * total // size
        rows = np.repeat(np.arange(len(per)), per)
        share = 1_000_000_000 * count // (1000 * count + 8 * m[rows])
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(terms + 1))
        ids = batch.column(0)
        yield Batch(
            ids.fill_null(0).to_numpy(zero_copy_only=False),
            ids.is_valid().to_numpy(zero_copy_only=False),
            starts,
            rows[order],
            share[order],
        )


@dataclass
class Queries:
    """Terms of each query, rarest first, with weight times repeats and what is left after each."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    left: list[np.ndarray]  # left[p]: most that terms from position p on can add
    made: np.ndarray  # terms that make accumulators


def _partial(batch: Batch, queries: Queries, q: int, first: int, last: int, scores: np.ndarray) -> None:
    """Add the terms of positions ``first`` to ``last`` of a query to one row of scores."""
    for term, weight in zip(queries.terms[q][first:last].tolist(), queries.weights[q][first:last].tolist()):
        span = slice(batch.starts[term], batch.starts[term + 1])
        # A document has one posting of a term at most.
        scores[batch.rows[span]] += weight * batch.share[span]


class Best:
    """The k best (score, id) of each query so far; ties by id, a null id last."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if q in self.held:
            own = self.held[q]
            if len(own[0]) == self.k:
                good = scores >= own[0][-1]
                scores, ids, known = scores[good], ids[good], known[good]
            scores, ids, known = (np.concatenate(p) for p in zip(own, (scores, ids, known)))
        elif len(scores) > 4 * self.k:
            good = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids, known = scores[good], ids[good], known[good]
        order = np.lexsort((ids, ~known, -scores))[: self.k]
        self.held[q] = (scores[order], ids[order], known[order])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for q, (scores, ids, known) in self.held.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(scores), q, np.int64)),
                        pa.array(ids, pa.int64(), mask=~known),
                        pa.array(scores, pa.int64()),
                    ],
                    ["query", "doc_id", "score"],
                )


def _search(postings: DataFrame, shared, chosen: list[int], k: int, n_terms: int, size: tuple[int, int], whole: bool) -> DataFrame:
    """(query, doc_id, score): each task's best, by all terms or by those that make accumulators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = Best(k)
        for batch in _batches(batches, n_terms, *size):
            scores = np.zeros(len(batch.ids), np.int64)
            for q in chosen:
                made = int(queries.made[q])
                _partial(batch, queries, q, 0, made, scores)
                held = np.flatnonzero(scores)
                if whole and len(held):
                    # Survivors only: documents without an accumulator gain nothing.
                    without = scores == 0
                    _partial(batch, queries, q, made, len(queries.terms[q]), scores)
                    scores[without] = 0
                if len(held):
                    best.add(q, scores[held], batch.ids[held], batch.known[held])
                scores[:] = 0
        yield from best.rows()

    return postings.mapInArrow(run, "query long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _facts(postings: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Documents that hold each term, documents, and terms of them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, np.int64)
        total = size = 0
        for batch in batches:
            held += np.bincount(batch.column(2).flatten().to_numpy(), minlength=n_terms)
            total += batch.num_rows
            size += int(batch.column(1).to_numpy().sum())
        seen = np.flatnonzero(held)
        term = np.r_[seen, -1, -2]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.r_[held[seen], total, size])], ["term", "n"])

    rows = postings.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}  # as many as the queries have terms
    return np.array([found.get(t, 0) for t in range(n_terms)], np.int64), found.get(-1, 0), found.get(-2, 0)


def _largest(postings: DataFrame, n_terms: int, size: tuple[int, int]) -> np.ndarray:
    """The largest share each term has in any document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(n_terms, np.int64)
        for batch in _batches(batches, n_terms, *size):
            seen = np.flatnonzero(np.diff(batch.starts))
            if len(seen):
                top[seen] = np.maximum(top[seen], np.maximum.reduceat(batch.share, batch.starts[seen]))
        seen = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(top[seen])], ["term", "n"])

    rows = postings.mapInArrow(run, "term long, n long").groupBy("term").agg(F.max("n").alias("n")).collect()
    top = np.zeros(n_terms, np.int64)
    for r in rows:
        top[r["term"]] = r["n"]
    return top


def _ordered(own: list[np.ndarray], held: np.ndarray, weight: np.ndarray, top: np.ndarray) -> Queries:
    terms, weights, left = [], [], []
    for numbers in own:
        distinct, repeats = np.unique(numbers, return_counts=True)
        rare = np.lexsort((distinct, held[distinct]))
        distinct, repeats = distinct[rare], repeats[rare]
        found = held[distinct] > 0
        distinct, repeats = distinct[found], repeats[found]
        w = weight[distinct] * repeats
        terms.append(distinct)
        weights.append(w)
        left.append(np.r_[np.cumsum((w * top[distinct])[::-1])[::-1], 0])
    return Queries(terms, weights, left, np.zeros(len(own), np.int64))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    asked = items.select(ref(item_id).alias("item_id"), ref(item_text).alias("text")).distinct()
    if not is_small(asked):
        raise TablewrightError("the queries are the stated set of a search; split a larger table by rows")
    asked = asked.orderBy("item_id", "text").collect()
    numbers: dict[bytes, int] = {}
    own = [
        np.array([numbers.setdefault(t, len(numbers)) for t in split_terms(r["text"])], np.int64) for r in asked
    ]
    n_terms = len(numbers)
    postings = written(_postings(docs, spark.sparkContext.broadcast(numbers), doc_id, text), "postings")
    held, total, length = _facts(postings, n_terms)
    size = (total, max(1, length))
    weight = np.floor(1000 * np.log((2 * total + 2) / (2 * held + 1))).astype(np.int64)
    queries = _ordered(own, held, weight, _largest(postings, n_terms, size))
    parts = []
    for begin in range(0, len(own), QUERY_BLOCK):
        block = range(begin, min(begin + QUERY_BLOCK, len(own)))
        still = [q for q in block if len(queries.terms[q])]
        made = FIRST
        while still:
            for q in still:
                queries.made[q] = min(made, len(queries.terms[q]))
            still = [q for q in still if queries.made[q] < len(queries.terms[q])]
            if still:
                shared = spark.sparkContext.broadcast(queries)
                rows = _ranked(_search(postings, shared, still, k, n_terms, size, False), k)
                kth = {r["query"]: r["score"] for r in rows.filter(F.col("rank") == k).collect()}
                # Whoever has nothing yet could at most get what is left; a tie might still win by its id.
                still = [q for q in still if queries.left[q][queries.made[q]] >= kth.get(q, 0)]
            made *= 2
        chosen = [q for q in block if len(queries.terms[q])]
        if chosen:
            shared = spark.sparkContext.broadcast(queries)
            parts.append(_ranked(_search(postings, shared, chosen, k, n_terms, size, True), k))
    schema = items.select(ref(item_id).alias("item_id")).schema
    names = spark.createDataFrame(
        [(q, r["item_id"]) for q, r in enumerate(asked)], f"query long, item_id {schema[0].dataType.simpleString()}"
    )
    if not parts:
        return names.limit(0).select(
            "item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")
        )
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
