"""Both tokenizers against their libraries, the token files against what went in."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.errors import PrepareError
from tablewright.llm import dac, pieces
from tablewright.llm.common import scratch

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(seed=1, count=1500):
    draw = random.Random(seed)
    pools = [
        "aabb  ab\n\tthe▁éñ日本ﬁ😀͸ing tion\u0000<s>0x0A",
        "abc ",
        "=-_*#.!/ ",
        "'s 'll dON'T \x1c\x85 İ̸≯12",
    ]
    texts = ["", " ", "  ", "\n", "▁", "<|endoftext|> <s> </s>", " " * 3000, "a" * 5000, "word " * 40_000]
    for k in range(count):
        texts.append("".join(draw.choice(pools[k % 4]) for _ in range(draw.randrange(70))))
    return texts


@pytest.fixture(scope="module")
def real_texts(spark):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_pieces_equal_the_library(real_texts):
    model = pieces.PieceModel(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts() + real_texts
    for text, raw in zip(texts, model.encode_batch(texts)):
        ids = np.frombuffer(raw, "<i4")
        assert ids.tolist() == library.encode(text)
        assert model.decode(ids) == library.decode(ids.tolist())


def test_overtaking_pairs_in_long_runs():
    model = pieces.PieceModel(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for n in (1, 15, 16, 17, 63, 64, 65, 66, 200, 4001):
        for text in (" " * n, "x" + " " * n + "y", "-" * n, "=" * n + " " * n, "ab" * n):
            assert model.encode(text).tolist() == library.encode(text)


def test_pieces_forget_and_still_agree(real_texts, monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_CHUNKS", 50)
    model = pieces.PieceModel(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in real_texts[:40]:
        assert model.encode(text).tolist() == library.encode(text)


def test_pieces_in_spark(spark):
    rows = [(1, "Hello  world"), (None, None), (3, ""), (3, ""), (4, "é" * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "decoded": F.lit(1)})
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    apart = pieces.decode(pieces.encode(df, PIECES), PIECES)
    at_once = pieces.encode(df, PIECES, decoded="decoded").select(*apart.columns)
    assert sorted(map(repr, apart.collect())) == sorted(map(repr, at_once.collect()))
    for r in pieces.digests(at_once).collect():
        assert r["ids"] == library.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"])
    assert pieces.encode(df.limit(0), PIECES).count() == 0


def test_words_equal_the_library(real_texts):
    own, library = dac.ChunkTokenizer(WORDS), Tokenizer.from_file(WORDS)
    texts = odd_texts(2) + real_texts
    for text, raw in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_codes_give_random_access():
    draw = np.random.default_rng(4)
    for ids in (
        np.zeros(0, np.uint32),
        np.zeros(3, np.uint32),
        draw.integers(0, 300, 5000).astype(np.uint32),
        (2.0 ** draw.uniform(0, 32, 4000)).astype(np.uint32),
        np.full(1025, 2**32 - 1, np.uint32),
    ):
        codes = dac.Codes(memoryview(dac.pack(ids)))
        assert len(codes) == len(ids)
        assert (codes.read(0, len(ids)) == ids).all()
        for _ in range(300 if len(ids) else 0):
            a = int(draw.integers(len(ids)))
            b = int(draw.integers(a, len(ids) + 1))
            assert (codes.read(a, b) == ids[a:b]).all() and codes[a] == ids[a]


def test_a_cut_shard_is_refused():
    shard = dac.pack_shard([1], [2], np.array([1, 2], np.uint32))
    dac.open_shard(shard + b"\n")
    with pytest.raises(PrepareError):
        dac.open_shard(shard[:-1])


def test_files_give_back_every_document(spark):
    draw = random.Random(8)
    texts = odd_texts(3, 300)
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)] + [(None, "no id"), (5, None), (5, None), (-3, "x")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(6)
    path = scratch(spark, "test-tokens")
    dac.write_tokens(df, path, WORDS, end_id=1, shard_tokens=2_000)
    found = dac.read_documents(spark, path).collect()
    library = Tokenizer.from_file(WORDS)
    wanted, before = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        wanted.append((key, before, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        before += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found), key=lambda r: r[1])
    assert got == wanted
    whole = [*library.encode(texts[40], add_special_tokens=False).ids, 1]
    assert dac.read_range(spark, path, 40 * 7 % 1009, 1, 4) == [whole[1:4]]


def test_files_of_an_empty_table(spark):
    path = scratch(spark, "test-no-tokens")
    dac.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, WORDS, end_id=1)
    assert dac.read_documents(spark, path).count() == 0


def test_a_finished_task_leaves_no_chunks_in_its_worker(spark):
    """Spark keeps idle workers: what a task cached must not stay in them."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.range(2_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("text")).coalesce(1)
    assert pieces.encode(df, path).filter("size(ids) = 0").count() == 0

    def held(batches):
        for batch in batches:
            sizes = [len(pieces._model(path).cache)] * batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n"])

    assert spark.range(1).coalesce(1).mapInArrow(held, "n long").first()["n"] < 100


def test_documents_are_read_by_stretches(spark, monkeypatch):
    """Not a document at a time: decoding costs by the call."""
    ends = np.cumsum([0, 3, 0, 4, 90, 0, 2, 1])
    assert dac._stretches(ends, 10) == [(0, 4), (4, 7), (7, 8)]
    assert dac._stretches(np.zeros(5, np.int64), 10) == [(0, 5)]
    assert len(dac._stretches(np.arange(1, 100_001) * 40, 500_000)) == 9
    texts = ["", "one two", None, "", "a" * 300, "  ", "three words, here", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(dac, "READ_TOKENS", 3)
    path = scratch(spark, "stretches")
    dac.write_tokens(docs, path, WORDS)
    found = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in dac.read_documents(spark, path).collect()}
    library = Tokenizer.from_file(WORDS)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert found == {i: (len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in enumerate(ids)}
