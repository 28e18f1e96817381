"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, of the word and of its first characters, so
that unseen endings still tell something. Filters of several widths slide over a whole
text, each keeps its largest response, and a logistic layer weighs them. Embeddings
start with one coordinate set to how much more often a cell occurs in toxic training
texts; everything is then trained by Adam on the executors.

Thresholds are calibrated by language: a part of the labelled rows that the network
never saw tells, for each language, which response parts the labels best, and scores
are shifted so that this is 0.7. The language is guessed from the text alone by the
string-kernel model, so a score depends on nothing but the text.

Training reads every labelled row, whole texts of any length; rows equal in id, text and
label count once. Three quarters, told apart by a hash, train the network: they are dealt by
hash into parts of bounded size, every part is trained on from the common network by a task
of its own, and the parts' changes are averaged, an embedding by how often each part has its
cell. This is done ``ROUNDS`` times, once where one part holds all; every round visits every row. The other quarter gives
the thresholds, from counts of its responses in steps of 1/256. The language model, too, is fitted to
all training rows. The driver sees sums and counts only. Scoring reads all rows and whole texts.

Inputs: a null text counts as empty; empty texts get the score of a text without words.
Labels of unknown documents and null labels are ignored. Without labels of both kinds
every score is 0. Repeated rows get equal scores, an empty table an empty result. Only
the columns named in ``keep`` are carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import ref
from tablewright.llm import langid
from tablewright.llm.common import VECTORS, added, portions, vector_rows, written
from tablewright.session import broadcast_if_small

CELLS = 1 << 15  # of each embedding table; cell 0 is the gap between texts
HEAD = 4  # characters that stand for a word's beginning
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
GAP = max(WIDTHS) - 1
LEVEL = 0.7
STRIP = ".,;:!?\"'()[]|"
KNOWN_WORDS = 400_000
TRAIN_WORDS = 50_000  # words whose responses are held at a time
BATCH = 64
ROUNDS = 3
PART_ROWS = 10_000  # rows and words that a task trains on
PART_WORDS = 8_000_000
STEPS_OF_ONE = 256  # steps of responses when thresholds are chosen


# --- words ----------------------------------------------------------------------


class Words:
    """Cells of words, kept for the words met before."""

    def __init__(self):
        self.known: dict[str, int] = {}

    @staticmethod
    def _cells(word: str) -> int:
        plain = word.strip(STRIP)
        whole = zlib.crc32(plain.encode("utf-8", "replace")) % (CELLS - 1) + 1
        head = zlib.crc32(b"head " + plain[:HEAD].encode("utf-8", "replace")) % (CELLS - 1) + 1
        return whole << 16 | head

    def of(self, text: str) -> np.ndarray:
        """A pair of cells per word, packed into one number."""
        words = text.lower().split()
        cells = list(map(self.known.get, words))
        missing = [i for i, c in enumerate(cells) if c is None]
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        for i in missing:
            cells[i] = self.known[words[i]] = self._cells(words[i])
        return np.array(cells, np.int64)


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another with gaps; where each starts, and its number of windows."""
    sizes = np.array([max(1, len(t)) for t in texts])
    starts = np.cumsum(sizes + GAP) - sizes - GAP
    flat = np.zeros(int(starts[-1] + sizes[-1] + GAP + 1), np.int64)
    for at, t in zip(starts.tolist(), texts):
        flat[at : at + len(t)] = t
    return flat, starts, sizes


# --- the network ----------------------------------------------------------------


@dataclass
class Network:
    words: np.ndarray  # (cells, size)
    heads: np.ndarray
    filters: list[np.ndarray]  # per width: (width, size, filters)
    bias: np.ndarray  # (widths * filters)
    out: np.ndarray
    shift: np.ndarray  # of the output, one number

    @classmethod
    def fresh(cls, lean_words: np.ndarray, lean_heads: np.ndarray, seed: int) -> "Network":
        draw = np.random.default_rng(seed)
        tables = [(draw.normal(0, 0.1, (CELLS, SIZE))).astype(np.float32) for _ in range(2)]
        for table, lean in zip(tables, (lean_words, lean_heads)):
            table[:, 0] = lean
            table[0] = 0
        filters = [draw.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0, :] = np.abs(f[:, 0, :]) + 0.2
        n = len(WIDTHS) * FILTERS
        return cls(
            *tables,
            filters,
            np.zeros(n, np.float32),
            np.abs(draw.normal(0, 0.3, n)).astype(np.float32),
            np.zeros(1, np.float32),
        )

    def embed(self, flat: np.ndarray) -> np.ndarray:
        return self.words[flat >> 16] + self.heads[flat & 0xFFFF]

    def pooled(self, flat, starts, sizes):
        """Largest response of each filter in each text, before the rectifier; the embedded words."""
        words = self.embed(flat)
        room = len(flat) - GAP
        out = []
        for f in self.filters:
            response = words[:room] @ f[0]
            for j in range(1, len(f)):
                response += words[j : j + room] @ f[j]
            out.append(response)
        responses = np.concatenate(out, axis=1)
        # A text's windows start at its words; what follows up to the next text is left out.
        edges = np.stack([starts, starts + sizes], axis=1).ravel()
        top = np.maximum.reduceat(responses, edges, axis=0)[::2]
        return top, responses, words

    def outputs(self, texts: list[np.ndarray]) -> np.ndarray:
        flat, starts, sizes = laid_out(texts)
        top, _, _ = self.pooled(flat, starts, sizes)
        return np.maximum(top + self.bias, 0) @ self.out + self.shift[0]

    def parameters(self) -> list[np.ndarray]:
        return [self.words, self.heads, *self.filters, self.bias, self.out, self.shift]

    def gradients(
        self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, total: float | None = None
    ) -> list[np.ndarray]:
        """Of the weighted logistic loss; only the window that won a maximum learns.

        ``total`` is the weight of all texts where these are a part of them.
        """
        flat, starts, sizes = laid_out(texts)
        top, responses, words = self.pooled(flat, starts, sizes)
        active = np.maximum(top + self.bias, 0)
        logits = active @ self.out + self.shift[0]
        error = ((1 / (1 + np.exp(-logits)) - labels) * weights / (total or weights.sum())).astype(np.float32)
        inner = error[:, None] * self.out * (active > 0)
        d_words, d_heads = np.zeros_like(self.words), np.zeros_like(self.heads)
        d_filters = [np.zeros_like(f) for f in self.filters]
        spans = zip(starts.tolist(), sizes.tolist())
        winners = np.stack([responses[a : a + n].argmax(axis=0) + a for a, n in spans])
        for k, f in enumerate(self.filters):
            row, m = np.nonzero(inner[:, k * FILTERS : (k + 1) * FILTERS])
            step = inner[row, k * FILTERS + m][:, None, None]
            span = winners[row, k * FILTERS + m][:, None] + np.arange(len(f))
            np.add.at(d_filters[k].transpose(2, 0, 1), m, step * words[span])
            back = step * f.transpose(2, 0, 1)[m]
            np.add.at(d_words, flat[span] >> 16, back)
            np.add.at(d_heads, flat[span] & 0xFFFF, back)
        d_words[0] = d_heads[0] = 0  # the gap stays empty
        return [d_words, d_heads, *d_filters, inner.sum(axis=0), error @ active, error.sum(keepdims=True)]


def _parts(rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Rows in runs of about ``TRAIN_WORDS`` words."""
    total = np.cumsum(sizes[rows]) // TRAIN_WORDS
    return np.split(rows, np.flatnonzero(np.diff(total)) + 1)


def descend(
    network: Network, texts: list[np.ndarray], labels: np.ndarray, weigh: np.ndarray, steps: int, seed: int, rate: float
) -> None:
    """Adam over small batches: so many steps, and every text at least once."""
    parameters = network.parameters()
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    draw = np.random.default_rng(seed)
    sizes = np.array([len(t) for t in texts])
    step = 0
    while step < steps:
        order = draw.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            step += 1
            found = None
            for few in _parts(part, sizes):
                own = network.gradients([texts[i] for i in few], labels[few], weigh[few], weigh[part].sum())
                found = own if found is None else [a + b for a, b in zip(found, own)]
            for p, g, m, v in zip(parameters, found, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy() for v in column]


def _leans(rows: DataFrame, totals: np.ndarray) -> list[np.ndarray]:
    """Of words and heads: how much more often a cell occurs in toxic texts, from -1 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2, CELLS))
        for batch in batches:
            for label, own in zip(batch.column(0).to_pylist(), _lists(batch.column(1))):
                counts[0, int(label), np.unique(own >> 16)] += 1
                counts[1, int(label), np.unique(own & 0xFFFF)] += 1
        if counts.any():
            yield vector_rows(counts.ravel(), TaskContext.get().partitionId())

    found = added(rows.select("name", "cells").mapInArrow(run, VECTORS))
    if not len(found):  # no text has a word
        return [np.zeros(CELLS, np.float32)] * 2
    out = []
    for counts in found.reshape(2, 2, CELLS):
        logs = np.log((counts + 0.5) / (totals[:, None] + 1))
        out.append(np.clip((logs[1] - logs[0]) * (counts.sum(axis=0) > 1), -3, 3).astype(np.float32) / 3)
    return out


def _trained_on(network: Network, parts: DataFrame, weights: np.ndarray, steps: int, seed: int, rate: float) -> None:
    """One round: each part (part, name, mark, cells) trains a copy, and the copies are averaged."""
    shared = parts.sparkSession.sparkContext.broadcast(network)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("mark", "ascending"), ("name", "ascending")])
        texts = [v.astype(np.int64) for c in table.column("cells").chunks for v in _lists(c)]
        labels = np.array(table.column("name").to_pylist(), float)
        before = shared.value.parameters()
        own = Network(*(p.copy() for p in before[:2]), [p.copy() for p in before[2:-3]], *(p.copy() for p in before[-3:]))
        part = key[0].as_py()
        descend(own, texts, labels, weights[labels.astype(int)], steps, seed + part, rate)
        words = np.concatenate([*texts, np.zeros(0, np.int64)])
        change = [a.astype(float) - b for a, b in zip(own.parameters(), before)]
        # Embeddings weigh by their cell's occurrences, everything else by texts.
        times = [np.bincount(c, minlength=CELLS) for c in (words >> 16, words & 0xFFFF)]
        moved = [(c * t[:, None]).ravel() for c, t in zip(change, times)]
        rest = [c.ravel() * len(texts) for c in change[2:]]
        return pa.Table.from_batches([vector_rows(np.concatenate([*times, *moved, *rest, [len(texts)]]), part)])

    found = added(parts.groupBy("part").applyInArrow(run, VECTORS))
    parameters = network.parameters()
    edges = np.cumsum([CELLS, CELLS, *(p.size for p in parameters)])
    *times, rows = np.split(found, edges)
    for t, p, moved in zip(times[:2], parameters, times[2:]):
        p += (moved.reshape(p.shape) / np.maximum(t, 1)[:, None]).astype(np.float32)
    for p, moved in zip(parameters[2:], times[4:]):
        p += (moved.reshape(p.shape) / rows[0]).astype(np.float32)


# --- the classifier -------------------------------------------------------------


@dataclass
class ToxicModel:
    network: Network | None
    languages: langid.LanguageModel
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.0


def _threshold(responses: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Between the two neighbouring responses that part the labels with the fewest errors."""
    counts = np.ones(len(labels)) if counts is None else counts
    z, place = np.unique(responses, return_inverse=True)
    toxic = np.bincount(place, labels * counts, len(z))
    other = np.bincount(place, (1 - labels) * counts, len(z))
    # Errors when everything from position i on counts as toxic.
    errors = np.r_[0, np.cumsum(toxic)] + np.r_[np.cumsum(other[::-1])[::-1], 0]
    best = np.flatnonzero(errors == errors.min())
    padded = np.r_[z[0] - 1, z, z[-1] + 1]
    widest = best[np.argmax(padded[best + 1] - padded[best])]
    return float((padded[widest] + padded[widest + 1]) / 2)


def _celled(rows: DataFrame, languages: langid.LanguageModel) -> DataFrame:
    """(name, mark, cells, language) of labelled texts."""
    shared = rows.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, spectrum = Words(), langid.Spectrum()
        for batch in batches:
            cells = pa.array([words.of(t.as_py()).astype(np.int32) for t in batch.column(2)], pa.list_(pa.int32()))
            named, _ = langid.guess(shared.value, spectrum, batch.column(3).to_pylist())
            columns = [batch.column(0), batch.column(1), cells, pa.array(named, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["name", "mark", "cells", "language"])

    chosen = rows.select("name", "mark", "text", "prepared")
    return chosen.mapInArrow(run, "name string, mark long, cells array<int>, language string")


def _responses(rows: DataFrame, network: Network) -> pa.Table:
    """(language, name, step, count): how often the network responds so to texts of a language and label."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.astype(np.int64) for v in _lists(batch.column(2))]
            few = _parts(np.arange(len(texts)), np.array([len(t) for t in texts])) if texts else []
            found = np.concatenate([*(shared.value.outputs([texts[i] for i in part]) for part in few), np.zeros(0)])
            steps = pa.array(np.round(found * STEPS_OF_ONE).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), steps], ["language", "name", "step"])

    steps = rows.select("language", "name", "cells").mapInArrow(run, "language string, name string, step long")
    return steps.groupBy("language", "name", "step").agg(F.count(F.lit(1)).alias("count")).toArrow()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: Column,
    steps: int = 500,
    seed: int = 11,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "toxic",
    part_rows: int = PART_ROWS,
) -> ToxicModel:
    """Learn from all labelled rows of ``docs`` where ``train_rows`` holds.

    ``steps`` are the least a part takes in all rounds together, ``part_rows`` its rows.
    """
    languages = langid.fit(docs, train_rows, doc_id=doc_id, text=text, lang=lang, every=True)
    told = labels.select(ref(doc_id).alias("_id"), ref(label).cast("int").alias("_toxic"))
    told = told.filter("_id is not null and _toxic in (0, 1)").distinct()
    rows = docs.filter(train_rows).select(ref(doc_id).alias("_id"), F.coalesce(ref(text), F.lit("")).alias("text"))
    rows = rows.join(broadcast_if_small(told), "_id")
    rows = rows.select(F.col("_toxic").cast("string").alias("name"), F.xxhash64("_id", "text").alias("mark"), "text")
    unseen = F.pmod(F.col("mark"), F.lit(4)) == 3
    rows = rows.withColumn("prepared", F.when(unseen, langid.prepared(F.col("text"))))
    whole = written(_celled(rows, languages).dropDuplicates(["name", "mark"]), "toxic-rows")
    counts = np.zeros((2, 2), np.int64)
    words = 0
    sizes = whole.groupBy("name", unseen.alias("unseen")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("words"))
    for r in sizes.collect():  # four rows at most
        counts[int(r["unseen"]), int(r["name"])] = r["n"]
        words += r["words"]
    if not counts.sum(axis=0).all():
        return ToxicModel(None, languages)
    if counts[0].all():
        seen, judged = whole.filter(~unseen), whole.filter(unseen)
    else:
        seen, judged, counts = whole, whole.limit(0), np.stack([counts.sum(axis=0), [0, 0]])
    network = Network.fresh(*_leans(seen, counts[0]), seed)
    parts = int(max(1, -(-counts[0].sum() // part_rows), -(-words // PART_WORDS)))
    dealt = seen.withColumn("part", F.pmod(F.xxhash64("mark"), F.lit(parts)).cast("long"))
    dealt = dealt.select("part", "name", "mark", "cells").repartition(parts, "part")
    weights = counts[0].sum() / (2 * counts[0])
    rounds = ROUNDS if parts > 1 else 1
    for k in range(rounds):
        _trained_on(network, dealt, weights, -(-steps // rounds), seed + 1_000_003 * k, 0.01 * 0.5**k)
    calibrating = counts[1].sum() > 0
    found = _responses(judged if calibrating else seen, network)
    z = found.column("step").to_numpy() / STEPS_OF_ONE
    y = np.array(found.column("name").to_pylist(), float)
    n = found.column("count").to_numpy()
    model = ToxicModel(network, languages, {}, _threshold(z, y, n))
    named = np.array(found.column("language").to_pylist(), object)
    for language in sorted(set(named)) if calibrating else []:
        own = named == language
        if min((y * n)[own].sum(), ((1 - y) * n)[own].sum()) >= 5:
            model.thresholds[language] = _threshold(z[own], y[own], n[own])
    return model


def score(docs: DataFrame, model: ToxicModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the tables' sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        words, spectrum = Words(), langid.Spectrum()
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 2).to_pylist()]
            if own.network is None:
                found = np.zeros(len(texts))
            else:
                named, _ = langid.guess(own.languages, spectrum, batch.column(batch.num_columns - 1).to_pylist())
                limits = np.array([own.thresholds.get(n, own.common) for n in named])
                parts = [own.network.outputs([words.of(t) for t in part]) for part in portions(texts, 400_000)]
                found = 1 / (1 + np.exp(-(np.concatenate(parts) - limits + np.log(LEVEL / (1 - LEVEL)))))
            columns = [*batch.columns[:-2], pa.array(np.clip(found, 0, 1).astype(float))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "score"])

    chosen = docs.select(*[ref(c) for c in keep], ref(text).alias("_text"), langid.prepared(ref(text)).alias("_prepared"))
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep] + [T.StructField("score", T.DoubleType())]
    return chosen.mapInArrow(run, T.StructType(fields))
