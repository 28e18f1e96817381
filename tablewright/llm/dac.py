"""Token ids as directly addressable codes, in binary files.

An id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every id, level 1
the next chunk of the ids that need one, and so on; a bitmap per level tells which ids
go on, and a rank directory (set bits before every 512-bit block) finds an id's place
on the next level. Any range of tokens is read without decoding what lies before it.

A shard is one file: a header, the documents' ids and token counts, then each level's
chunks, bitmap and directory. Shards hold whole documents in ascending id order (null
ids first, equal ids by text) and ``shard_tokens`` tokens, more only where a single
document has more. Spark's own committer writes the files, one row a file, so a
lost task leaves nothing behind; they end with one line feed that the header's length
leaves out.

Encoding cuts texts at blanks and line breaks, across which the vocabulary's tokens
never go, and asks the library for chunks a worker has not met yet.

Inputs: a null text counts as empty and has only the end id; repeated rows are written
each; an empty table gives no files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import PrepareError
from tablewright.functions.kinds import ref
from tablewright.llm.common import per_worker, running_total

MAGIC = b"DACTOK01"
BLOCK = 512  # bits that one entry of a rank directory stands for
LEVELS = 4
HEAD = "<8sQQQ"  # magic, bytes of the shard, documents, tokens
NULL_ID = -(2**63)
CACHED_CHUNKS = 300_000  # as met in texts
CACHED_WORDS = 700_000  # without their punctuation
# A word of letters that compose and lower-case one by one, and the punctuation that may follow it.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
PUNCTUATION = string.punctuation
PORTION = 4 << 20  # bytes of texts whose chunks are numbered at a time
READ_TOKENS = 500_000  # decoded at a time
PROBES = ("two words", "Two, ÉTÉ!! it's***", " a  b\nc ", "don't <|endoftext|> 12 é́", "")
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


# --- the codes ------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    parts = []
    rest = ids.astype(np.uint32)
    for _ in range(LEVELS):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += bytes(-len(bits) % (BLOCK // 8))
        ones = POPCOUNT[np.frombuffer(bits, np.uint8)].reshape(-1, BLOCK // 8).sum(axis=1)
        ranks = np.r_[0, np.cumsum(ones)].astype("<u4").tobytes()
        parts += [struct.pack("<QQ", len(rest), len(bits)), (rest & 0xFF).astype(np.uint8).tobytes(), bits, ranks]
        rest = rest[more] >> 8
    return b"".join(parts)


class Codes:
    """Random access into packed ids; nothing is decoded but what is asked for."""

    def __init__(self, raw: memoryview):
        self.levels = []
        at = 0
        for _ in range(LEVELS):
            count, width = struct.unpack_from("<QQ", raw, at)
            at += 16
            chunks = np.frombuffer(raw, np.uint8, count, at)
            bits = np.frombuffer(raw, np.uint8, width, at + count)
            entries = width * 8 // BLOCK + 1
            ranks = np.frombuffer(raw[at + count + width : at + count + width + 4 * entries], "<u4")
            self.levels.append((chunks, bits, ranks))
            at += count + width + 4 * entries

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(level, at: int) -> int:
        """Set bits before ``at``: the directory's entry and the bytes since."""
        _, bits, ranks = level
        block = at // BLOCK
        first = block * (BLOCK // 8)
        total = int(ranks[block]) + int(POPCOUNT[bits[first : at // 8]].sum())
        return total + bin(int(bits[at // 8]) & ((1 << at % 8) - 1)).count("1") if at % 8 else total

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``."""
        ids = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for k, level in enumerate(self.levels):
            if stop <= start:
                break
            chunks, bits, _ = level
            ids[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            span = np.unpackbits(bits[start // 8 : (stop + 7) // 8], bitorder="little")
            more = span[start % 8 : start % 8 + stop - start].astype(bool)
            where = where[more]
            start = self._rank(level, start)
            stop = start + len(where)
        return ids

    def __getitem__(self, at: int) -> int:
        return int(self.read(at, at + 1)[0])


def pack_shard(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    body = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    body += np.array(counts, "<u4").tobytes() + pack(ids)
    return struct.pack(HEAD, MAGIC, struct.calcsize(HEAD) + len(body), len(doc_ids), len(ids)) + body


def open_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, Codes]:
    """Document ids, token counts, codes."""
    magic, length, docs, _ = struct.unpack_from(HEAD, raw)
    if magic != MAGIC or length > len(raw):
        raise PrepareError("not a whole token shard", {"bytes": len(raw)})
    view = memoryview(raw)[struct.calcsize(HEAD) : length]
    return (
        np.frombuffer(view, "<i8", docs),
        np.frombuffer(view, "<u4", docs, 8 * docs),
        Codes(view[12 * docs :]),
    )


# --- encoding -------------------------------------------------------------------


class ChunkTokenizer:
    """A tokenizer whose tokens never go across blanks, with a cache of encoded chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}  # lower-cased words and runs of punctuation
        for probe in PROBES:
            whole = self.library.encode(probe, add_special_tokens=False).ids
            if np.frombuffer(self.encode_batch([probe])[0], "<u4").tolist() != whole:
                raise PrepareError("the tokenizer's tokens go across blanks", {"probe": probe})

    def _alone(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(chunks), 20_000):
            part = chunks[at : at + 20_000]
            encoded = self.library.encode_batch_fast(part, add_special_tokens=False)
            yield from ((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(part, encoded))

    def _learn(self, words: list[str]) -> None:
        """Plain words go to the library many at a time, and come apart at their ends of word."""
        groups = [words[at : at + 200] for at in range(0, len(words), 200)]
        encoded = self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, encoded):
            ids = np.array(found.ids, "<u4")
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            if len(ends) == len(group):
                raw = ids.tobytes()
                self.words.update(zip(group, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            else:
                self.words.update(self._alone(group))

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """A chunk is a word and the punctuation behind it, or is encoded as it is."""
        if len(self.words) > CACHED_WORDS:
            self.words = {"": b""}
        known = self.words
        words = [c.rstrip(PUNCTUATION) for c in chunks]
        tails = [c[len(w) :] for c, w in zip(chunks, words)]
        words = [w.lower() for w in words]
        fresh = {w for w in words if w not in known}
        self._learn([w for w in fresh if PLAIN.fullmatch(w)])
        known.update(self._alone([t for t in set(tails) if t not in known]))
        found = {c: known[w] + known[t] for c, w, t in zip(chunks, words, tails) if w in known}
        found.update(self._alone([c for c, w in zip(chunks, words) if w not in known]))
        return found

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Chunks of many texts are numbered at once; only distinct ones are looked up, and ids gathered
        by number.
        """
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // PORTION
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        for first, last in zip(edges, edges[1:]):
            blank = pc.replace_substring(texts.slice(first, last - first), "\n", " ")
            lists = pc.split_pattern(blank, " ")
            numbered = lists.flatten().dictionary_encode()
            # by way of numpy, which takes a seventh of the time of to_pylist
            distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
            raws = list(map(self.cache.get, distinct))
            if None in raws:
                missing = [c for c, raw in zip(distinct, raws) if raw is None]
                found = self._encode_chunks(missing)
                raws = [found[c] if raw is None else raw for c, raw in zip(distinct, raws)]
                if len(self.cache) + len(found) > CACHED_CHUNKS:
                    self.cache = {"": b""}
                self.cache.update(found)
            pool = np.frombuffer(b"".join(raws), "<u4")
            lengths = np.fromiter(map(len, raws), np.int64, len(raws)) >> 2
            codes = numbered.indices.to_numpy()
            n = lengths[codes]
            ends = np.cumsum(n)
            ids = pool[np.repeat((np.cumsum(lengths) - lengths)[codes] - ends + n, n) + np.arange(len(n) and ends[-1])]
            # A text has one chunk at least, the empty one.
            cuts = [0, *ends[np.cumsum(np.diff(lists.offsets.to_numpy())) - 1].tolist()]
            yield from (ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return list(self.encode_column(pa.array(texts, pa.string())))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    shard_tokens: int = 4_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode whole texts and write them below ``path``, documents in ascending id order.

    ``tokenizer`` is a path on every machine; ``end_id`` is put behind each document.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(f"tokens:{tokenizer}", lambda: ChunkTokenizer(tokenizer))
        names: list[int | None] = []
        raws: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raws), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([pack_shard(names, [len(r) // 4 for r in raws], ids)], pa.binary())], ["shard"]
            )

        for batch in batches:
            encoded = encoder.encode_column(batch.column(1).fill_null(""))
            for name, raw in zip(batch.column(0).to_pylist(), encoded):
                names.append(name)
                raws.append(raw + end)
                held += len(raws[-1]) // 4
                if held >= shard_tokens:
                    yield shard()
                    names, raws, held = [], [], 0
        if names:
            yield shard()

    chosen = docs.select(ref(doc_id).cast("long").alias("doc_id"), ref(text).alias("text"))
    ranged = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ranged.mapInArrow(run, "shard binary")
    # The text writer copies bytes as they are; each row becomes a file of its own.
    shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def _stretches(ends: np.ndarray, tokens: int) -> list[tuple[int, int]]:
    """Runs of documents of about so many tokens each, at least a document."""
    edges = [0, *(np.flatnonzero(np.diff(ends // tokens)) + 1).tolist(), len(ends)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """What the shards hold: (doc_id, start, n_tokens, ids_crc32), a row per document.

    ``start`` counts the tokens of all documents before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not raw.strip(b"\n"):
                    continue  # of an empty table
                docs, counts, codes = open_shard(raw)
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts
                sums = []
                # whole stretches of documents are decoded at a time
                for a, b in _stretches(ends, READ_TOKENS):
                    first = int(starts[a])
                    ids = codes.read(first, int(ends[b - 1])).astype("<u4", copy=False).view(np.uint8)
                    cuts = zip(((starts[a:b] - first) * 4).tolist(), ((ends[a:b] - first) * 4).tolist())
                    sums += [zlib.crc32(ids[i:j]) for i, j in cuts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(docs), pa.string()),
                        pa.array(np.full(len(docs), docs[0])),
                        pa.array(np.full(len(docs), len(codes))),
                        pa.array(docs, mask=docs == NULL_ID),
                        pa.array(starts),
                        pa.array(counts.astype(np.int64)),
                        pa.array(sums, pa.int64()),
                    ],
                    ["path", "first_id", "shard_tokens", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    columns = "path string, first_id long, shard_tokens long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, columns)
    # A row per shard, in the order of the documents: ids first, then the files' numbers.
    heads = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_heads, HEADS)
    order = [F.col("first_id"), F.col("last_id"), F.col("path")]
    starts = running_total(heads, order, "tokens", "before", "token-shards").select("path", "before")
    return rows.join(starts, "path").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


HEADS = "path string, first_id long, last_id long, tokens long"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if raw.strip(b"\n"):
                docs, _, codes = open_shard(raw)
                found.append((name, int(docs[0]), int(docs[-1]), len(codes)))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in zip(*found)], ["path", "first_id", "last_id", "tokens"]
            )


def read_range(spark: SparkSession, path: str, doc_id: int, start: int, stop: int) -> list[list[int]]:
    """Tokens ``start`` to ``stop`` of every document of that id, by random access."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if raw.strip(b"\n"):
                    docs, counts, codes = open_shard(raw)
                    ends = np.cumsum(counts.astype(np.int64))
                    hits = np.flatnonzero(docs == doc_id)
                    spans = [(int(ends[i]) - int(counts[i]), int(ends[i])) for i in hits]
                    found = [codes.read(a + start, max(a + start, min(b, a + stop))).tolist() for a, b in spans]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return [r["ids"] for r in files.mapInArrow(run, "ids array<long>").collect()]
