"""Mixing sources to target weights.

Each source's tokens, in a fixed order of its documents, are packed into blocks of BLOCK tokens.
Every source gets a number of slots (its target divided by BLOCK). Each slot draws its output shard by
a keyed hash, so a source's counts per shard are multinomial, conditional on the source's slots: the
mix meets its targets and not only in the mean, and no table of sources by shards is ever made. The
j-th slot of a source takes block perm(j mod n) of its n blocks, where perm is a pseudorandom
permutation per source and round (swap-or-not, Hoang, Morris and Rogaway 2012); slots and blocks are
joined by index. Slots are dealt in runs over tasks, SLOTS_PER_TASK each.

Sources are ordered by code point, null last, with weights 5, 2, 1 repeating. A target stops at
CAP times its source's size; the excess is shared again by weight until none is above. A null text
has size 0. Rows with a null or repeated doc_id each count, in order of id, size and hash of the text;
rows that are equal in all three are told apart by their place in it alone. A text of any length is
packed whole, as a range of blocks. Reruns agree, whatever the partitioning. An empty table gives an
empty result. ``taken`` carries the other columns, but for those named size, source_size, target and
taken, which its own replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Scratch, mix

WEIGHTS, CAP, BLOCK, SHARD_SLOTS, BUCKET_ROWS, SEED, ROUNDS = (5, 2, 1), 3, 64, 1 << 16, 4096, 17, 12
#: Slots of a run, the unit that is dealt to tasks, and of a task.
RUN, SLOTS_PER_TASK = 1 << 13, 1 << 16
SLOT = "no int, shard long, slot long, round long, block long"
TOKEN = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TOKEN)).cast("long"))


def targets(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` (source, source_size) with no, weight and target. A row per source, so the order is that of a small table."""
    ranked = sources.withColumn("no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("no") % len(WEIGHTS) + 1).cast("int"))
    ranked = scratch.save(ranked.withColumn("weight", cases), "sources")
    total, weights, capped = ranked.agg(F.sum("source_size"), F.sum("weight"), F.lit(0)).first()
    total, share, n_capped = total or 0, (total or 0) / (weights or 1), -1
    limit = F.col("source_size") * float(CAP)
    while True:  # each round is one small aggregate; the capped set only grows
        over = F.col("weight") * F.lit(share) > limit
        n, held, rest = ranked.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == n_capped or not rest:
            break
        share, n_capped = (total - (held or 0.0)) / rest, n
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), limit))


def _keyed(*parts: np.ndarray | int) -> np.ndarray:
    """A hash of numbers, by place."""
    h = np.full(1, U64(SEED))
    for k, x in enumerate(parts):
        h = mix(h * U64(0x9E3779B97F4A7C15) + np.asarray(x).astype(np.int64).view(U64) + U64(k))
    return h


def permuted(j: np.ndarray, n: int, no: int, epoch: np.ndarray | int) -> np.ndarray:
    """perm(j) in [0, n) for a source and round. Every step swaps x and key - x, or not, for both alike: a bijection, in 64 bits."""
    x = np.asarray(j, np.int64)
    for k in range(ROUNDS):
        key = (_keyed(no, epoch, k) % U64(n)).astype(np.int64)
        other = (key - x) % n
        swap = _keyed(no, epoch, k, np.maximum(x, other)) & U64(1) == 1
        x = np.where(swap, other, x)
    return x


def plan(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with source number and first token, sources with target and slots, slots with shard, block and round)."""
    rows = scratch.save(
        sized(docs).select("doc_id", F.col("source"), "size", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")), "sizes"
    )
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = targets(stats, scratch).withColumns({
        "blocks": F.expr(f"CAST(ceil(source_size / {BLOCK}) AS BIGINT)"),
        "buckets": F.expr(f"CAST(ceil(rows / {BUCKET_ROWS}) AS BIGINT)"),
    })
    # Slots of average length: the last block of a source may be short.
    mean = F.col("source_size") / F.nullif(F.col("blocks"), F.lit(0))
    slots = F.coalesce(F.least(F.round(F.col("target") / mean), CAP * F.col("blocks")), F.lit(0)).cast("long")
    sources = scratch.save(sources.withColumn("slots", slots), "targets")
    # First token of each document in its source, in two levels, so that a hot source is dealt over its buckets.
    keyed = rows.join(sources.select(F.col("source").alias("s"), "no", "buckets", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "h"), F.col("buckets")))
    order = [F.col("doc_id").asc_nulls_first(), "size", "h"]
    of_bucket = keyed.groupBy("no", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = of_bucket.select("no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("no", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["no", "bucket"])
    placed = scratch.save(placed.select("doc_id", "source", "no", "size", "h", "source_size", "target", (F.col("base") + F.col("within")).alias("start")), "placed")
    return placed, sources, dealt(sources)


def _dealer(shards: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():  # a run each
                slot = np.arange(r["lo"], r["hi"], dtype=np.int64)
                epoch = slot // r["blocks"]
                block = permuted(slot % r["blocks"], r["blocks"], r["no"], epoch)
                shard = (_keyed(r["no"], slot) % U64(shards)).astype(np.int64)
                columns = [np.full(len(slot), r["no"], np.int32), shard, slot, epoch, block]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["no", "shard", "slot", "round", "block"])

    return deal


def dealt(sources: DataFrame) -> DataFrame:
    """Slots: no, shard, slot (within its source), round, block. Only their number comes to the driver."""
    some = sources.where("slots > 0")
    total = some.agg(F.sum("slots")).first()[0] or 0
    shards, tasks = max(1, -(-total // SHARD_SLOTS)), max(1, -(-total // SLOTS_PER_TASK))
    runs = some.select("no", "blocks", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {RUN})")).alias("run"))
    runs = runs.select("no", "blocks", (F.col("run") * RUN).alias("lo"), F.least((F.col("run") + 1) * RUN, "slots").alias("hi"))
    return runs.repartition(tasks, "no", "lo").mapInArrow(_dealer(shards), SLOT)


def shard_counts(slots: DataFrame) -> DataFrame:
    """(no, shard, n): how many slots each shard has of each source."""
    return slots.groupBy("no", "shard").agg(F.count("*").alias("n"))


def segments(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix: for each slot the pieces of documents in its block, with their first word and number of words."""
    some = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")))
    piece = some.select(
        "no", "block", "doc_id", "start", F.greatest(F.col("start"), F.col("block") * BLOCK).alias("lo"),
        F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK).alias("hi"),
    )
    # Slots come out of a function, so Spark takes them for as few as the sources that they are made of, and would broadcast them.
    return slots.hint("merge").join(piece, ["no", "block"]).select("shard", "slot", "round", "no", "block", "doc_id", "start", (F.col("lo") - F.col("start")).alias("first_word"), (F.col("hi") - F.col("lo")).alias("words"))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: size, source_size, target (of its source), taken (words that the mix has of it)."""
    scratch = Scratch(spark, "mixing")
    placed, _, slots = plan(spark, docs, scratch)
    taken = segments(placed, slots).groupBy("no", "start").agg(F.sum("words").alias("taken"))
    out = placed.join(taken.withColumn("some", F.lit(True)), ["no", "start"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), "h")


def taken(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with size, source_size, target and taken; rows of equal id, size and text share theirs in turn."""
    own = digest(spark, docs)
    order = W.partitionBy("doc_id", "h").orderBy("source", "taken")
    numbered = own.withColumn("__k", F.row_number().over(order)).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), "__k", "size", "source_size", "target", "taken")
    left = docs.drop("size", "source_size", "target", "taken").withColumn("__h2", F.xxhash64(F.coalesce("text", F.lit(""))))
    left = left.withColumn("__k2", F.row_number().over(W.partitionBy("doc_id", "__h2").orderBy("source")))
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h2") == F.col("__h")) & (F.col("__k2") == F.col("__k"))
    return left.join(numbered, on).drop("__d", "__h", "__k", "__h2", "__k2")
