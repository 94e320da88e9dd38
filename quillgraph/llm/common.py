"""What the training-data operators share: tables, scratch space, byte-level words and their hashes.

The byte functions work on the UTF-8 buffers of Arrow arrays, so no Python object is made per word.
Texts are handled in chunks of about ``CHUNK`` bytes (a longer text is a chunk of its own), which
bounds the memory of a Python worker whatever the Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch  # noqa: F401

CHUNK = 1 << 20
#: Rows of an Arrow batch; with long texts the default of 10,000 would need gigabytes.
BATCH_ROWS = 500
U64 = np.uint64
_B = U64(0x9E3779B97F4A7C15)
_INV_B = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the texts handed to a Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _mapping(word: str) -> np.ndarray:
    """Byte to byte, A-Z lower-cased, 0 for bytes outside words."""
    out = np.arange(256, dtype=np.uint8)
    if word == "spaced":  # whatever stands between white space
        out[[0x20, *range(0x09, 0x0E)]] = 0
    else:  # ASCII letters and digits, and all beyond ASCII
        out[:0x30] = out[0x3A:0x41] = out[0x5B:0x61] = out[0x7B:0x80] = 0
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


SPACED, ALNUM = _mapping("spaced"), _mapping("alnum")


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts that hold about ``most`` bytes."""
    data, offsets = utf8(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        for k, base in enumerate((_B, _INV_B)):
            all_of = np.full(size, base, U64)
            all_of[0] = 1
            _powers[k] = np.cumprod(all_of, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(data: np.ndarray, offsets: np.ndarray, mapping: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in order, first word of each text (one more than texts))."""
    c = mapping[data]
    inside = c != 0
    before = np.zeros(len(c), bool)
    before[1:] = inside[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(c)]
    before[edge] = False
    after = np.zeros(len(c), bool)
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = _power(len(c) + 1)
    sums = np.zeros(len(c) + 1, U64)
    np.cumsum(c.astype(U64) * power[: len(c)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each run of k words within a text, its first word, text of it)."""
    n = len(hashes) - k + 1
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xC2B2AE3D27D4EB4F) + hashes[j : n + j]
    return mix(out[at] + U64(k)), at, text[at]
