"""The pipeline: each stage on its own input, and the whole on a small table."""

import math
import re

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(
        {"score": F.lit("own"), "digest": F.lit(1), "size": F.lit(2), "copies": F.lit(3), "id": F.lit(4)}
    )
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert docs.filter("score <> 'own'").isEmpty()
    assert all(later <= earlier for earlier, later in zip(seen, seen[1:]))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == library.encode(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"])


def test_clean_documents_stay(spark):
    """Stages take out what cannot be told a language, and copies; nothing else."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.languages(spark, docs, SF)
    with_letters = docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    assert kept.count() == with_letters.count()
    unique = corpus_pipeline.exact_copies(spark, docs, SF)
    assert unique.count() == docs.select("text").distinct().count()
    assert unique.join(docs.groupBy("text").agg(F.max("doc_id").alias("doc_id")), ["doc_id", "text"]).count() == unique.count()


def test_odd_documents_through_all_stages(spark):
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (None, "the words of a text without id", "en", None, 5),
        (4, "the same words again and again in here", "en", "a", 1),
        (4, "the same words again and again in here", "en", "a", 1),
        (5, "the same words again and again in here", "en", "b", 1),
        (7, "Und das ist " + "sehr lang und " * 20_000, "de", "b", None),
        (8, "12345 !!", "de", "b", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-odd-{name}")
    assert {r["doc_id"] for r in docs.collect()} <= {None, 5, 7}


def test_empty_documents_through_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-none-{name}")
    assert docs.count() == 0


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) > 100
    assert all(re.fullmatch("[0-9a-f]{64}", r["ids_sha256"]) for r in out)


def test_without_languages_to_learn_all_rows_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.languages(spark, docs, SF).count() == docs.count()


def test_whole_run_against_plain_python(spark):
    """Every stage on what plain Python kept before it: letters, equal texts, all pairs of shingles, shares, ids."""
    import hashlib
    from collections import Counter

    from test_mixing import size_of, water
    from test_near_copies import brute

    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    kept = {}
    for r in given:
        if any(c.isalpha() for c in r["text"] or ""):
            kept[r["text"]] = max(kept.get(r["text"], r["doc_id"]), r["doc_id"])
    rows = [(key, text) for text, key in kept.items()]
    single = {key for key, *_, stays in brute(rows, 5, 80) if stays}
    texts = {key: text for key, text in rows if key in single}
    source = {r["doc_id"]: r["source"] for r in given}
    sizes, largest = Counter(), Counter()
    for key, text in texts.items():
        sizes[source[key]] += size_of(text)
        largest[source[key]] = max(largest[source[key]], size_of(text))
    target, _ = water(dict(sizes), sum(sizes.values()))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    taken, times = Counter(), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]])  # a document plain Python dropped has no text here
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["n_tokens"] == len(ids) and r["source"] == source[r["doc_id"]]
        times[r["doc_id"]] += 1
        taken[r["source"]] += size_of(texts[r["doc_id"]])
    assert max(times.values()) <= 3
    # the mix ends at the last document that fits
    budget = sum(sizes.values())
    assert math.isclose(sum(target.values()), budget) and budget - max(largest.values()) <= sum(taken.values()) <= budget
