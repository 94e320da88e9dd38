"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbouring words, and pairs with one word
between, each hashed to 2**BITS places. Training is one pass after another over a bounded sample of
labelled rows (TRAIN_ROWS, those with the smallest hashes of doc_id); per-coordinate rates and L1
leave few weights, at most 2**BITS, so their broadcast has a known bound.

Labels come only from rows outside the held-out fifth (crc32 of doc_id as text, modulo 5, is not 0).
Text alone is scored. Null and empty texts have no features and get the score of the bias. Null
doc_ids count as held out. Null labels are left out; of several labels of a document the largest
counts. Of several texts of a labelled doc_id the one with the least hash trains (of equal hashes the least text), so
reruns give the same model. Texts of any length are read whole: their features are hashed in parallel, and the
task that trains holds no more than 2**BITS places of each row. Repeated rows get equal scores, other columns are carried
by ``scored``, whose column replaces one of that name, and without any labelled row every score is 0; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, U64, Scratch, chunks, mix, small_batches, words

BITS = 20
TRAIN_ROWS = 12_000
PASSES, ALPHA, BETA, L1, L2, POSITIVE = 8, 1.0, 1.0, 12.0, 1.0, 3.0
_MASK = U64((1 << BITS) - 1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every feature of all texts, repeats included."""
    hashes, first = words(data, offsets, ALNUM)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = [(text, mix(hashes + U64(1)) & _MASK)]
    for gap, salt in ((1, 2), (2, 3)):
        a, b = hashes[:-gap], hashes[gap:]
        same = text[:-gap] == text[gap:]
        out.append((text[:-gap][same], mix(a * U64(0x9E3779B97F4A7C15) + b + U64(salt))[same] & _MASK))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]).astype(np.int64)


def places(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct places of every text, in order."""
    for _, _, data, offsets in chunks(texts):
        text, place = features(data, offsets)
        found = np.unique(text * (1 << BITS) + place)
        bounds = np.searchsorted(found, np.arange(len(offsets)) << BITS)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield (found[a:b] & ((1 << BITS) - 1)).astype(np.int32)


def train(docs: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) of rows that come as their places; sequential, so rows must come in a fixed order."""
    bias = 1 << BITS
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    for _ in range(PASSES if docs else 0):
        for own, y in zip(docs, labels, strict=True):
            i = np.append(own, bias)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * (POSITIVE if y else 1.0)
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[i] = more
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    at = np.flatnonzero(w[:bias])
    return at, w[at], float(w[bias])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x.tobytes() for x in places(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["h"], batch["doc_id"], batch["toxic"], pa.array(rows, pa.binary())], ["h", "doc_id", "toxic", "places"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, labels = [], []
    for batch in batches:
        docs += [np.frombuffer(x, np.int32) for x in batch["places"].to_pylist()]
        labels += batch["toxic"].to_pylist()
    if docs:
        at, w, bias = train(docs, labels)
        columns = [pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["places", "weights", "bias"])


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float | None]:
    """(places, weights, bias); no bias where no row is labelled. One task trains on at most ``rows`` texts."""
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Only labels whose text is there count, so a fixed number of them is enough.
    there = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = there.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = own.join(F.broadcast(scratch.save(chosen, "chosen")), "doc_id")  # at most ``rows`` rows
    one = texts.groupBy("h", "doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min(F.struct(F.xxhash64("text").alias("k"), "text"))["text"].alias("text"))
    hashed = one.mapInArrow(_placed, "h long, doc_id long, toxic int, places binary")
    ordered = hashed.repartition(1).sortWithinPartitions("h", "doc_id").select("places", "toxic")
    model = scratch.save(ordered.mapInArrow(_train, "places binary, weights binary, bias double"), "weights").first()  # at most 12 * 2**BITS bytes
    if model is None:
        return np.zeros(0, np.int32), np.zeros(0), None
    return np.frombuffer(model["places"], np.int32), np.frombuffer(model["weights"], np.float64), model["bias"]


def _scorer(weights, column: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = weights.value
        dense = np.zeros(1 << BITS, np.float64)
        dense[at] = w
        for batch in batches:
            sums = np.full(batch.num_rows, bias if bias is not None else -np.inf)
            for i, j, data, offsets in chunks(batch["text"]):
                text, place = features(data, offsets)
                hit = dense[place] != 0
                found = np.unique(text[hit] * (1 << BITS) + place[hit])  # each feature of a text counts once
                sums[i:j] += np.bincount(found >> BITS, dense[found & ((1 << BITS) - 1)], minlength=j - i)
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-np.clip(sums, -700, 700)))
            p[np.isneginf(sums)] = 0.0
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in batch.schema.names), pa.array(p)], [*batch.schema.names, column])

    return score


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """``docs`` with the score as ``column``, which replaces one of that name."""
    scratch = Scratch(spark, "toxicity")
    docs = docs.drop(column)
    weights = spark.sparkContext.broadcast(fit(spark, docs, labels, scratch))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(_scorer(weights, column), f"{schema}, `{column}` double")


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(spark, docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
