"""Language by string kernels: blended spectra, Nyström landmarks, kernel ridge regression.

Two texts are as similar as the byte n-grams they share: for each length n the number
of n-grams present in both, divided by the root of the product of their numbers, then
averaged over the lengths. Landmarks are training texts; each language has a ridge
regression, this language against the rest, in the space the landmarks span. As the
kernel is an inner product of n-gram presences, landmarks and coefficients multiply out
to one weight matrix, and a batch of texts is scored by one sparse matrix product.

Training reads a bounded sample: ``per_language`` rows of each language and ``rows`` in
all, those with the smallest hashes of id and text; equal rows count once. It leaves the
rows given as held out untouched. Kernels are computed on the executors; n-grams of the
landmarks and one kernel value per row and landmark come to the driver, never a text.
With ``every`` only the landmarks are a sample: the regression is over every row, repeated
ones as often as they occur, and tasks add up its normal equations.

Inputs: a text that is null or has no letter is ``und`` with score 0; so is every text
if there is nothing to learn from. Whole texts are read. Rows with a null language are
not learned from. Extra columns are carried along unchanged; the new ones take the
place of columns of the same name. Repeated rows get equal results, an empty table an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.kinds import ref
from tablewright.llm.common import VECTORS, added, give_back, smallest, vector_rows, written

LENGTHS = (1, 2, 3)
SPACE = 1 << 16  # of n-grams of one length; longer ones are hashed into it
UNKNOWN = "und"
ROWS = 500  # of a batch whose texts are held at a time


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (length, n-gram, language)


class Spectrum:
    """Which n-grams a text has."""

    def __init__(self):
        self.flags = np.zeros(SPACE, bool)

    def of(self, text: bytes) -> list[np.ndarray]:
        raw = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
        out = []
        codes = raw
        for n in LENGTHS:
            if n > 1:
                codes = codes[: len(raw) - n + 1] << np.uint32(8) | raw[n - 1 :]
            cells = codes if n <= 2 else (codes * np.uint32(0x9E3779B1)) >> np.uint32(16)
            self.flags[cells] = True
            present = np.flatnonzero(self.flags)
            self.flags[present] = False
            out.append(present)
        return out


def prepared(text: Column) -> Column:
    """Lower-cased UTF-8, null where there is no letter to judge by."""
    return F.when(F.regexp_like(text, F.lit(r"\p{L}")), F.lower(text).cast("binary"))


def _sample(docs: DataFrame, per_language: int, rows: int) -> DataFrame:
    """(lang, mark, rank, text): a bounded sample that depends on the rows alone."""
    marked = docs.withColumns({"mark": F.xxhash64("doc_id", "text"), "text": prepared(F.col("text"))})
    marked = marked.filter("text is not null")
    chosen = smallest(marked.select("lang", "mark"), per_language, rows).withColumnRenamed("name", "lang")
    return (
        marked.join(F.broadcast(chosen), ["lang", "mark"])  # no more than ``rows``
        .groupBy("lang", "mark")
        .agg(F.min("rank").alias("rank"), F.min("text").alias("text"))
    )


class Landmarks:
    """N-grams of the landmarks, one after another."""

    def __init__(self, spectra: list[list[np.ndarray]]):
        self.count = len(spectra)
        self.sizes = [np.array([len(s[k]) for s in spectra]) for k in range(len(LENGTHS))]
        self.cells = [np.concatenate([s[k] for s in spectra]) for k in range(len(LENGTHS))]

    def kernel(self, own: list[np.ndarray], flags: np.ndarray) -> np.ndarray:
        """Kernel values of one text with all landmarks."""
        out = np.zeros(self.count)
        for cells, sizes, present in zip(self.cells, self.sizes, own):
            flags[present] = True
            shared = np.add.reduceat(flags[cells].astype(np.int32), np.cumsum(sizes) - sizes)
            flags[present] = False
            out += shared / np.sqrt(sizes * len(present)) / len(LENGTHS)
        return out

    def dense(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length: a row's number for every n-gram, and rows of what it adds to the kernel with each landmark."""
        out = []
        for cells, sizes in zip(self.cells, self.sizes):
            met, row = np.unique(cells, return_inverse=True)
            place = np.zeros(SPACE, np.int32)
            place[met] = np.arange(1, len(met) + 1)
            adds = np.zeros((len(met) + 1, self.count), np.float32)
            owner = np.repeat(np.arange(self.count), sizes)
            adds[row + 1, owner] = (1 / np.sqrt(sizes) / len(LENGTHS))[owner]
            out.append((place, adds))
        return out

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        """Weights of the n-grams: coefficients of the landmarks that have them."""
        weights = np.zeros((len(LENGTHS), SPACE, alpha.shape[1]), np.float32)
        for k, (cells, sizes) in enumerate(zip(self.cells, self.sizes)):
            scale = alpha / np.sqrt(sizes)[:, None] / len(LENGTHS)
            at = np.cumsum(sizes) - sizes
            for row, (a, n) in enumerate(zip(at.tolist(), sizes.tolist())):
                weights[k, cells[a : a + n]] += scale[row]  # a landmark has an n-gram once
        return weights


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spectrum = Spectrum()
    for batch in batches:
        rows = [spectrum.of(t.as_py()) for t in batch.column(1)]
        columns = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in range(len(LENGTHS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["place", *(f"g{n}" for n in LENGTHS)])


def _kernels(sample: DataFrame, points: Landmarks) -> pa.Table:
    """(lang, place, values): kernel values of every row of the sample with the landmarks."""
    shared = sample.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, flags = Spectrum(), np.zeros(SPACE, bool)
        for batch in batches:
            values = [shared.value.kernel(spectrum.of(t.as_py()), flags) for t in batch.column(2)]
            lists = pa.array(values, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["lang", "place", "values"])

    return sample.select("lang", "place", "text").mapInArrow(run, "lang string, place string, values array<double>").toArrow()


def _equations(rows: DataFrame, points: Landmarks, weigh: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted normal equations of the regression over all ``rows`` (lang, text)."""
    shared = rows.sparkSession.sparkContext.broadcast((points, sorted(weigh), [weigh[x] for x in sorted(weigh)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, languages, weights = shared.value
        code = {x: k for k, x in enumerate(languages)}
        spectrum, dense, weights = Spectrum(), points.dense(), np.array(weights)
        left, right = np.zeros((points.count, points.count)), np.zeros((points.count, len(languages)))
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kernel = np.zeros((part.num_rows, points.count))
                for row, t in zip(kernel, part.column(1)):
                    for (place, adds), present in zip(dense, spectrum.of(t.as_py())):
                        met = place[present]
                        row += adds[met[met > 0]].sum(axis=0) / np.sqrt(len(present))
                own = np.array([code[x] for x in part.column(0).to_pylist()], np.int64)
                weighted = kernel * weights[own][:, None]
                left += kernel.T @ weighted
                target = np.full((len(own), len(languages)), -1.0)
                target[np.arange(len(own)), own] = 1.0
                right += weighted.T @ target
                rows += len(own)
        if rows:
            yield vector_rows(np.r_[left.ravel(), right.ravel()], TaskContext.get().partitionId())

    found = added(rows.select("lang", "text").mapInArrow(run, VECTORS))
    left, right = np.split(found, [points.count**2])
    return left.reshape(points.count, -1), right.reshape(points.count, -1)


def fit(
    docs: DataFrame,
    train: Column,
    per_language: int = 400,
    rows: int = 3_000,
    landmarks: int = 300,
    ridge: float = 1e-2,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    every: bool = False,
) -> LanguageModel:
    """Learn from the rows of ``docs`` where ``train`` holds, with ``every`` from each of them."""
    usable = docs.filter(train).select(
        ref(doc_id).alias("doc_id"), ref(lang).cast("string").alias("lang"), ref(text).alias("text")
    )
    sample = _sample(usable.filter("lang is not null"), per_language, rows)
    # The sample takes languages in turn, and so do the landmarks; no two rows have one place.
    place = F.format_string("%08d %016x %s", "rank", "mark", "lang")
    sample = written(sample.withColumn("place", place), "language-sample")
    columns = "place string, " + ", ".join(f"g{n} array<int>" for n in LENGTHS)
    picked = sample.orderBy("place").limit(landmarks).select("place", "text")
    own = picked.mapInArrow(_spectra, columns).toArrow().sort_by("place")
    if not own.num_rows:
        return LanguageModel([], np.zeros((len(LENGTHS), SPACE, 0), np.float32))
    spectra = list(zip(*[[v.values.to_numpy() for v in own.column(f"g{n}")] for n in LENGTHS]))
    points = Landmarks(spectra)
    flags = np.zeros(SPACE, bool)
    small = np.stack([points.kernel(s, flags) for s in spectra])
    if every:
        whole = usable.join(F.broadcast(sample.select("lang").distinct()), "lang")  # no more than ``rows``
        whole = whole.withColumn("text", prepared(F.col("text"))).filter("text is not null")
        counts = {r["lang"]: r["n"] for r in whole.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(counts.values())
        left, right = _equations(whole, points, {x: total / (len(counts) * n) for x, n in counts.items()})
        return LanguageModel(sorted(counts), points.folded(_solved(left, right, small, total, ridge)))
    found = _kernels(sample, points).sort_by("place")
    named = found.column("lang").to_pylist()
    kernel = found.column("values").combine_chunks().flatten().to_numpy().reshape(len(named), points.count)
    languages, alpha = regression(kernel, small, named, ridge)
    return LanguageModel(languages, points.folded(alpha))


def regression(kernel: np.ndarray, small: np.ndarray, named: list[str], ridge: float) -> tuple[list[str], np.ndarray]:
    """Languages, and the landmarks' coefficients for each: this one against the rest.

    ``kernel`` holds rows of the sample against landmarks, ``small`` landmarks against landmarks.
    """
    languages = sorted(set(named))
    target = np.where(np.array(named)[:, None] == np.array(languages), 1.0, -1.0)
    # Languages weigh the same, however many rows the sample has of each.
    counts = np.array([named.count(x) for x in named], float)
    weigh = (len(named) / (len(languages) * counts))[:, None]
    return languages, _solved(kernel.T @ (weigh * kernel), kernel.T @ (weigh * target), small, len(named), ridge)


def _solved(left: np.ndarray, right: np.ndarray, small: np.ndarray, rows: int, ridge: float) -> np.ndarray:
    """Coefficients from the normal equations of so many rows."""
    return np.linalg.lstsq(left + ridge * rows * (small + 1e-8 * np.eye(len(small))), right, rcond=None)[0]


def scores(model: LanguageModel, spectrum: Spectrum, texts: list[bytes]) -> np.ndarray:
    """Regression outputs, a row per text and a column per language."""
    out = np.zeros((len(texts), len(model.languages)), np.float32)
    spectra = [spectrum.of(t) for t in texts]
    for k in range(len(LENGTHS)):
        sizes = np.array([len(s[k]) for s in spectra])
        cells = np.concatenate([s[k] for s in spectra])
        starts = np.cumsum(sizes) - sizes
        # Each text has at least the n-grams of the blanks around it.
        out += np.add.reduceat(model.weights[k][cells], starts, axis=0) / np.sqrt(sizes)[:, None]
    return out


def _blocks(texts: list, size: int = 64) -> Iterator[tuple[list[int], list[bytes]]]:
    at = [i for i, t in enumerate(texts) if t is not None]
    for k in range(0, len(at), size):
        yield at[k : k + size], [texts[i] for i in at[k : k + size]]


def guess(model: LanguageModel, spectrum: Spectrum, texts: list) -> tuple[list[str], np.ndarray]:
    """Language and score of prepared texts."""
    names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model.languages:
        for at, block in _blocks(texts):
            found = scores(model, spectrum, block)
            top = found.argmax(axis=1)
            best[at] = np.clip((found[np.arange(len(at)), top] + 1) / 2, 0, 1)
            for i, k in zip(at, top.tolist()):
                names[i] = model.languages[k]
    return names, best


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    keep: list[str] | None = None,
    into: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``docs``, or its columns ``keep``, with the language and its score in the columns ``into``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the n-gram space
    kept = [c for c in (docs.columns if keep is None else keep) if c not in into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, best = guess(shared.value, spectrum, part.column(part.num_columns - 1).to_pylist())
                columns = [*part.columns[:-1], pa.array(names, pa.string()), pa.array(best)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *into])
        give_back()

    chosen = docs.select(*[ref(c) for c in kept], prepared(ref(text)).alias("_language_text"))
    fields = [T.StructField(c, docs.schema[c].dataType) for c in kept]
    fields += [T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())]
    return chosen.mapInArrow(run, T.StructType(fields))
