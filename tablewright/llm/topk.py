"""Exact largest inner products by norm buckets.

Vectors are grouped by length into classes that differ by a fixed ratio, and large
classes are cut into buckets of about ``BUCKET`` rows. Queries come in blocks of about
``BLOCK`` rows. Every query first meets one bucket of the longest class, which gives it
a running threshold: its k-th best score so far. A query needs a bucket only if its
length times the bucket's largest reaches that threshold; blocks skip buckets that none
of their queries needs. Inside, the threshold divided by both lengths is a cosine that
a partner must reach. From it the bucket's pruning is chosen per query: by coordinate,
where the angle leaves a narrow range of some coordinate of the normalised vectors, or by
length, where it does not. What is left is verified by exact integer products.

Buckets and blocks are rows of packed matrices; a task holds one pair at a time, and a
query's best rows of all buckets are merged by a windowed rank that Spark limits before
its shuffle.

Inputs: vectors that are null or empty, or hold a null or a value that is not finite,
take no part, neither do rows without an id. Vectors are compared with those of the same
number of components. Rows that repeat an id and its vector count once; other rows with
a query's id are not its partners. Ties go to the smaller id. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.kinds import ref
from tablewright.llm.common import written

RATIO = 1.05  # between the lengths of neighbouring classes
BUCKET = 4096
BLOCK = 1024
FOCUS = 3  # coordinates tried per query
SPARSE = 0.1  # share of a bucket up to which coordinate pruning pays
SLACK = 1e-9
EXACT = 2.0**53

PACKED = "dim int, class int, part int, rows int, longest double, ids binary, vectors binary"


def whole_vectors(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): usable vectors with components floor(scale * x)."""
    v = ref(embedding)
    usable = (
        ref(vec_id).isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    )
    cells = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(ref(vec_id).cast("long").alias("id"), cells.alias("v"))


def _classed(rows: DataFrame) -> DataFrame:
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    steps = F.floor(F.log(F.greatest(F.sqrt(squares), F.lit(1e-3))) / float(np.log(RATIO)))
    return rows.withColumns({"dim": F.size("v"), "class": steps.cast("int")})


def _dealt(rows: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """``rows`` with ``part``, so that about ``size`` rows share keys and part."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    # At most as many rows as length classes and dimensions occur.
    dealt = rows.join(counts, keys).withColumn("part", F.pmod(F.xxhash64("id"), "_parts").cast("int"))
    return dealt.drop("_parts")


def _pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its distinct rows as matrices, longest vector first."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        cells = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        both = np.unique(np.column_stack([ids, cells]), axis=0)
        ids, cells = both[:, 0], both[:, 1:]
        norms = np.sqrt((cells.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        named = {n: k.as_py() for n, k in zip(keys, key)}
        return pa.table(
            {
                "dim": pa.array([cells.shape[1]], pa.int32()),
                "class": pa.array([named.get("class", 0)], pa.int32()),
                "part": pa.array([named["part"]], pa.int32()),
                "rows": pa.array([len(ids)], pa.int32()),
                "longest": pa.array([norms.max()]),
                "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()),
                "vectors": pa.array([cells[order].astype("<i8").tobytes()], pa.binary()),
            }
        )

    return rows.groupBy(*keys).applyInArrow(run, PACKED)


def _products(queries: np.ndarray, rows: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products; in doubles where every sum stays below 2 ** 53."""
    if bound < EXACT:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def _best(ids: np.ndarray, found: np.ndarray, own: int, k: int, least: int) -> np.ndarray:
    """Positions of the k best rows that reach ``least``, the query's own id left out."""
    usable = np.flatnonzero((found >= least) & (ids != own))
    if len(usable) > k:
        kth = np.partition(found[usable], -k)[-k]
        usable = usable[found[usable] >= kth]
    return usable[np.lexsort((ids[usable], -found[usable]))][:k]


class Bucket:
    """One bucket's rows, longest first, with sorted coordinates made when needed."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.rows = np.frombuffer(vectors, "<i8").reshape(-1, dim)
        self.norms = np.sqrt((self.rows.astype(float) ** 2).sum(axis=1))
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            unit = self.rows[:, f] / np.maximum(self.norms, 1e-12)
            order = np.argsort(unit, kind="stable")
            self.sorted[f] = order, unit[order]
        return self.sorted[f]

    def by_coordinate(self, query: np.ndarray, norm: float, cosine: float) -> np.ndarray | None:
        """Rows within the angle along the most telling coordinate; None if they are too many."""
        unit = query / norm
        reach = np.arccos(min(1.0, cosine))
        best = None
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low = np.cos(min(np.pi, angle + reach)) - SLACK
            high = np.cos(max(0.0, angle - reach)) + SLACK
            order, values = self._coordinate(f)
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if best is None or b - a < best[1] - best[0]:
                best = a, b, order
        a, b, order = best
        return order[a:b] if b - a <= SPARSE * len(order) else None

    def search(self, own: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        """(query position, row position, score) of each query's best rows."""
        norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        longest = float(self.norms[0])
        bound = float(norms.max(initial=0)) * longest * 1.01
        # A score reaches ``least`` only if the lengths' product does.
        needed = np.flatnonzero(norms * longest * (1 + SLACK) + SLACK >= least)
        wide = []
        for q in needed.tolist():
            cosine = least[q] / (norms[q] * longest) if norms[q] * longest > 0 else -1.0
            rows = self.by_coordinate(queries[q], norms[q], cosine * (1 - SLACK)) if cosine > 0.5 else None
            if rows is None:
                wide.append(q)
                continue
            found = _products(queries[q : q + 1], self.rows[rows], bound)[0]
            for i in _best(self.ids[rows], found, own[q], k, least[q]).tolist():
                yield q, rows[i], found[i]
        # By length: the rows long enough are the first ones.
        for at in range(0, len(wide), 256):
            part = np.array(wide[at : at + 256])
            with np.errstate(divide="ignore", invalid="ignore"):
                short = np.where(least[part] > 0, least[part] / norms[part] * (1 - SLACK), 0.0)
            upto = int(np.searchsorted(-self.norms, -float(short.min()), "right"))
            found = _products(queries[part], self.rows[:upto], bound)
            for j, q in enumerate(part.tolist()):
                for i in _best(self.ids[:upto], found[j], own[q], k, least[q]).tolist():
                    yield q, i, found[j, i]


FOUND = "query_id long, vec_id long, score long"
NO_SCORE = -(2**62)


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of pairs of a block (ids, vectors, least) and a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, q_ids, q_vectors, q_least, ids, vectors = (c[row].as_py() for c in batch.columns)
                own = np.frombuffer(q_ids, "<i8")
                queries = np.frombuffer(q_vectors, "<i8").reshape(-1, dim)
                least = np.frombuffer(q_least, "<i8") if q_least else np.full(len(own), NO_SCORE)
                bucket = Bucket(dim, ids, vectors)
                found = list(bucket.search(own, queries, least, k))
                if found:
                    q, r, s = (np.array(x, np.int64) for x in zip(*found))
                    columns = [pa.array(own[q]), pa.array(bucket.ids[r]), pa.array(s)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    chosen = pairs.select("dim", "q_ids", "q_vectors", "q_least", "ids", "vectors")
    return chosen.mapInArrow(run, FOUND)


def _merge(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _with_thresholds(blocks: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Blocks with the k-th score of each query so far, and the shortest row any query still needs."""
    kth = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    kth = kth.filter(F.col("n") >= k).select(F.col("query_id").alias("id"), "kth")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), dim, np.int32)),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(np.arange(len(ids), dtype=np.int32)),
                        pa.array(ids),
                    ],
                    ["dim", "q_part", "at", "id"],
                )

    places = blocks.select("dim", "q_part", "q_ids").mapInArrow(ids_of, "dim int, q_part int, at int, id long")
    least = places.join(kth, "id", "left").groupBy("dim", "q_part")
    least = least.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("kth", F.lit(NO_SCORE)).alias("kth")))).alias("q"))
    joined = blocks.join(least.select("dim", "q_part", F.col("q.kth").alias("kth")), ["dim", "q_part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, ids, vectors, kth in zip(*(c.to_pylist() for c in batch.columns)):
                least = np.array(kth, np.int64)
                queries = np.frombuffer(vectors, "<i8").reshape(-1, dim).astype(float)
                norms = np.sqrt((queries**2).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(least > 0, least / norms * (1 - SLACK) - SLACK, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dim], pa.int32()),
                        pa.array([part], pa.int32()),
                        pa.array([ids], pa.binary()),
                        pa.array([vectors], pa.binary()),
                        pa.array([least.astype("<i8").tobytes()], pa.binary()),
                        pa.array([float(need.min())]),
                    ],
                    ["dim", "q_part", "q_ids", "q_vectors", "q_least", "need"],
                )

    columns = "dim int, q_part int, q_ids binary, q_vectors binary, q_least binary, need double"
    return joined.select("dim", "q_part", "q_ids", "q_vectors", "kth").mapInArrow(add, columns)


def top_products(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row where ``queries`` holds.

    ``queries`` is a condition on the integer ``id``.
    """
    rows = _classed(whole_vectors(vectors, scale, vec_id, embedding))
    rows = written(_dealt(rows, BUCKET, ["dim", "class"]), "topk-rows")
    buckets = written(_pack(rows, ["dim", "class", "part"]), "topk-buckets")
    asked = _dealt(rows.filter(queries).drop("class", "part"), BLOCK, ["dim"])
    blocks = _pack(asked, ["dim", "part"]).select(
        "dim",
        F.col("part").alias("q_part"),
        F.col("ids").alias("q_ids"),
        F.col("vectors").alias("q_vectors"),
        F.lit(None).cast("binary").alias("q_least"),
    )
    blocks = written(blocks, "topk-blocks")

    marks = buckets.select("dim", "class", "part", "longest")
    longest = marks.groupBy("dim").agg(F.max(F.struct("class", "part")).alias("seed"))
    seeds = buckets.join(longest, "dim").filter(F.struct("class", "part") == F.col("seed")).drop("seed")
    first = written(_merge(_search(blocks.join(seeds, "dim"), k), k).drop("rank"), "topk-seeds")

    ready = written(_with_thresholds(blocks, first, k), "topk-thresholds")
    # Which bucket a block still needs is settled on numbers; matrices join by key.
    rest = marks.join(longest, "dim").filter(F.struct("class", "part") != F.col("seed"))
    pairs = ready.select("dim", "q_part", "need").join(rest.drop("seed"), "dim").filter("longest >= need")
    pairs = pairs.select("dim", "q_part", "class", "part")
    joined = pairs.join(ready.drop("need"), ["dim", "q_part"]).join(buckets.drop("longest", "rows"), ["dim", "class", "part"])
    found = _search(joined, k).unionByName(first)
    return _merge(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
