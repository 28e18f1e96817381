"""From raw documents to token ids, in stages that each read the one before.

A stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of
``documents``. Nulls, empty texts, repeated rows, empty tables and extra columns are
treated as the operators' docstrings say; a repeated row is one document from the exact
stage on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.kinds import ref
from tablewright.llm import cuckoo, langid, mixing, nearcopies, pieces
from tablewright.llm.common import held_out, written

# A guess below this score is no better than none: every language's regression says no.
LEAST_SCORE = 0.3

# Language models, a tokenizer and the copies of texts are none of SQL's.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents no learned language can be told of; all stay if there is none to learn."""
    model = langid.fit(docs, ~held_out())
    if not model.languages:
        return docs
    found = langid.identify(docs, model, into=("_language", "_language_score"))
    known = (F.col("_language") != langid.UNKNOWN) & (F.col("_language_score") >= LEAST_SCORE)
    return found.filter(known).select(*[ref(c) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return cuckoo.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the row with the smallest id."""
    return nearcopies.drop_near_copies(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.take(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, ids_sha256, decoded_sha256)."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    chosen = docs.select("doc_id", "lang", "source", "text")
    encoded = pieces.encode(chosen, model, decoded="decoded")
    return pieces.digests(encoded).drop("text", "decoded")


STAGES = [
    ("language", languages),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix", mixed),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
