"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that depends on their
ids only, repeated up to ``max_repeats`` times. A document's virtual finish time is
the words of its source up to and including it, divided by the source's weight. All
queues are merged by finish time and the merged order is cut where the words reach
the budget, so at any point each source has been served in proportion to its weight,
and one that is used up leaves its share to the others.

Running sums never put a source into one task: the shuffled order is cut into slices
of the hash range, a slice is a task's work, and only slice sums are added up along a
source. The cut is found from a global range sort, partition sums and one running sum
inside the single partition that holds it; then each document's copies are counted
against that cut without a shuffle.

Inputs: a null text has size 0; a null source is a source of its own, after all
others; a null id is shuffled like id 0 with ties settled by the text's hash. Documents
without words are taken 0 times. Repeated rows count as separate documents. Where all
sizes are 0, targets and taken are 0. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.errors import PrepareError
from tablewright.functions.kinds import ref
from tablewright.llm.common import running_total, word_count, written


def _queue(source: Column) -> Column:
    """A name that is never null and sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def ranked_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources by code point, null last, with ``weights`` in turn: (queue, size, weight)."""
    ranked = running_total(sizes.withColumn("_one", F.lit(1)), [F.col("queue")], "_one", "_rank", "mix-ranks")
    turns = F.array(*[F.lit(float(w)) for w in weights])
    turn = F.element_at(turns, (F.col("_rank") % len(weights) + 1).cast("int"))
    return ranked.select("queue", "size", turn.alias("weight"))


def fair_targets(sizes: DataFrame, budget: int, max_repeats: int) -> DataFrame:
    """``sizes`` (queue, size, weight) with ``target``: the budget shared by weight.

    A source gets ``max_repeats`` times its size at most; the excess is shared again
    until no target is above. That is one water level, raised by Newton steps of one
    aggregate each: two numbers come back, whatever the number of sources.
    """
    limit = F.col("size") * max_repeats
    level = 0.0
    while True:
        full = F.col("weight") * level >= limit
        row = sizes.agg(
            F.sum(F.when(full, limit)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        raised = (budget - (row["full"] or 0)) / row["open"] if row["open"] else level
        if raised <= level:
            break
        level = raised
    return sizes.withColumn("target", F.least(limit.cast("double"), F.col("weight") * level))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_repeats: int = 3,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies, taken), a row per document.

    ``weights`` go to the sources in turn, by code point; the budget is the sum of all sizes.
    """
    if not weights or min(weights) <= 0:
        raise PrepareError("weights must be positive", {"weights": weights})
    sized = docs.select(
        ref(doc_id).cast("long").alias("doc_id"),
        ref(source).cast("string").alias("source"),
        F.xxhash64(ref(text)).alias("text_hash"),
        word_count(ref(text)).alias("size"),
    )
    shuffle = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(0)), F.col("text_hash"))
    sized = sized.withColumns(
        {"queue": _queue(F.col("source")), "place": shuffle.bitwiseAND(F.lit(2**63 - 1))}
    )
    sized = written(sized, "mix-sizes")
    facts = sized.agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest")
    ).first()
    budget = int(facts["words"] or 0)

    per_queue = sized.groupBy("queue").agg(F.sum("size").alias("size"))
    targets = written(fair_targets(ranked_weights(per_queue, weights), budget, max_repeats), "mix-targets")
    queued = written(_queued(sized, targets, facts["rows"]), "mix-queues")

    # A round that starts this far beyond a target ends beyond the cut, and is not sorted.
    spare = targets.count() * int(facts["largest"] or 0)
    rounds = F.explode(F.array(*[F.lit(k) for k in range(max_repeats)])).alias("round")
    entries = (
        queued.filter("size > 0")
        .select("*", rounds)
        .filter(F.col("round") * F.col("source_size") <= F.col("target") + spare)
        .select(_finish(F.col("round")).alias("finish"), "queue", "doc_id", "text_hash", "round", "size")
    )
    last = _last_within(entries, ["finish", "queue", "doc_id", "text_hash", "round"], budget)
    copies = F.lit(0)
    if last is not None:
        for k in range(max_repeats):
            copies = copies + F.when(_stands_by(last, k), 1).otherwise(0)
    return queued.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long")).select(
        "doc_id",
        "source",
        "text_hash",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def take(
    docs: DataFrame,
    mixed: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` as often as ``mixed``, made from it, says.

    Rows that repeat an id, source and text are one row here, taken as often as all of them.
    """
    key = ["_mix_id", "_mix_source", "_mix_hash"]
    named = [
        F.coalesce(ref(doc_id).cast("string"), F.lit("")).alias(key[0]),
        _queue(ref(source).cast("string")).alias(key[1]),
        F.xxhash64(ref(text)).alias(key[2]),
    ]
    counts = mixed.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key[0]),
        _queue(F.col("source")).alias(key[1]),
        F.col("text_hash").alias(key[2]),
        "copies",
    )
    counts = counts.groupBy(*key).agg(F.sum("copies").alias("_mix_copies")).filter("_mix_copies > 0")
    columns = [ref(c) for c in docs.columns]
    rows = docs.select("*", *named).join(counts, key).dropDuplicates(key)
    times = F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))
    return rows.select(*columns, times.alias("_mix_turn")).drop("_mix_turn")


def _queued(sized: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """Documents with ``upto``, the words of their queue up to and including them."""
    # As many slices as a slice has rows, so neither side of the sum outgrows a task.
    bits = math.isqrt(rows).bit_length()
    cut = sized.withColumn("slice", F.shiftright("place", 63 - bits))
    sums = cut.groupBy("queue", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("queue", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = (
        Window.partitionBy("queue", "slice")
        .orderBy("place", "doc_id", "text_hash")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    facts = targets.select("queue", F.col("size").alias("source_size"), "weight", "target")
    return (
        cut.withColumn("inside", F.sum("size").over(inside))
        .join(offsets, ["queue", "slice"])
        .withColumn("upto", F.col("offset") + F.col("inside"))
        .join(facts, "queue")
        .select("doc_id", "source", "queue", "text_hash", "size", "upto", "source_size", "weight", "target")
    )


def _finish(k: Column) -> Column:
    """The virtual finish time of a document's copy in round ``k``."""
    return (k * F.col("source_size") + F.col("upto")) / F.col("weight")


def _stands_by(last, k: int) -> Column:
    """Whether a document's copy in round ``k`` stands at or before ``last`` in the merged order."""
    no_id = -(2**63)  # nulls sort first
    here = F.struct(
        _finish(F.lit(k)).alias("finish"),
        "queue",
        F.coalesce("doc_id", F.lit(no_id)).alias("doc_id"),
        "text_hash",
        F.lit(k).alias("round"),
    )
    there = F.struct(
        F.lit(last["finish"]).alias("finish"),
        F.lit(last["queue"]).alias("queue"),
        F.lit(no_id if last["doc_id"] is None else last["doc_id"]).cast("long").alias("doc_id"),
        F.lit(last["text_hash"]).cast("long").alias("text_hash"),
        F.lit(last["round"]).alias("round"),
    )
    return here <= there


def _last_within(entries: DataFrame, order: list[str], budget: int):
    """The last entry, in global order, up to which the sizes stay within ``budget``."""
    ranged = entries.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "mix-order")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort, whatever the data.
    parts = ranged.groupBy("part").agg(F.sum("size").alias("words"))
    parts = parts.select("part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # The cut lies in the last partition that starts within the budget, or ends the one before.
    for part in parts.filter(F.col("offset") <= budget).orderBy(F.desc("part")).limit(2).collect():
        here = ranged.filter(F.col("part") == part["part"]).withColumn("sum", F.sum("size").over(upto))
        here = here.filter(F.col("sum") + part["offset"] <= budget)
        found = here.orderBy(*[F.desc(c) for c in order]).first()
        if found is not None:
            return found
    return None
