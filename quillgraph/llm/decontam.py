"""Benchmark decontamination by SimHash over item-sized windows.

Texts are lower-cased and cut into words (ASCII letters and digits and all beyond ASCII). Every
window of a document that is as long as a benchmark item gets the BITS-bit SimHash of its WORDS-word
shingles; a multi-index over SECTIONS sections of 16 bits, probed with all keys up to FLIPS bits away,
yields every item of that length within SURE bits for certain (of two fingerprints so near, one section
differs in FLIPS bits at most) and those up to RADIUS bits with a probability that the tests measure.
Each candidate within RADIUS is then judged by the exact weighted Jaccard similarity of the shingle
multisets, which must be PERCENT or more. Items of fewer words are one shingle.

Fingerprints of similar windows may lie further apart, most of all where few shingles make up a text, so the
rest is found exactly (``Index.rest``): so much must be shared that a window holds one of an item's rarest
shingles; texts that have one, and enough of the item's others, get the similarity of all their windows by
the spans of window starts in which each shingle counts. Only what is equal is settled before: its
fingerprints are equal, so the multi-index cannot miss it. No pair of the definition is left out, but for
collisions of 64-bit hashes.

RADIUS follows from PERCENT: equally many shingles at that similarity share 2 PERCENT / (100 + PERCENT) of
them, which is the cosine of their angle; fingerprint bits differ with that angle over pi, and RADIUS lies
SIGMAS deviations above that mean. Of random windows 3 % are candidates of an item before that test.

A text with fewer shingles than an item has no such window. Where the caller asks for it (``whole``; the
query and the pipeline do), all of its shingles are compared with the items of up to 100 / PERCENT times as
many, by the same similarity, exactly.

An exact bound keeps windows from being fingerprinted in vain: so much of the shingles must be shared,
so a window with fewer shingles that occur anywhere in the benchmark cannot match.

Items of equal words count as one, with the smallest item_id that they have (null where they have none) and
how many they are; they are brought together before anything else. Then they are dealt over blocks of about
BLOCK_BYTES, which lie in the shared folder. Documents are read once: a task takes about GATHER bytes of
them and holds one block after the other against those, so neither the driver nor a task ever has the whole
benchmark, and rows do not depend on the blocks.

Null texts count as empty, texts of any length are searched whole (in memory that grows with the longest
one), items without words match nothing, repeated rows each match; of equally similar windows the first
counts. Other columns are carried by ``marked`` and ignored by ``matches``; an empty table on either side
gives no match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, U64, Scratch, chunks, grams, mix, small_batches, words

WORDS, PERCENT, BLOCK_BYTES, GATHER, WINDOWS = 5, 80, 16 << 20, 32 << 20, 2048
#: Postings, or shingles that texts and items share, that ``rest`` holds at once; what one shingle or pair has is not split.
SLICE = 1 << 20
BITS, FLIPS, SIGMAS = 256, 2, 4.5
SECTIONS = BITS // 16
SURE = SECTIONS * (FLIPS + 1) - 1
_APART = math.acos(2 * PERCENT / (100 + PERCENT)) / math.pi
RADIUS = math.ceil(BITS * _APART + SIGMAS * math.sqrt(BITS * _APART * (1 - _APART)))
MATCH = "doc_id long, item_id long, n_items long, similarity double, first_word long, n_words long"
#: What to flip in a section's key to reach all keys at most FLIPS bits away.
_FLIPPED = np.array([sum(1 << b for b in some) for k in range(FLIPS + 1) for some in combinations(range(16), k)], np.uint16)


def _least(n: int) -> int:
    """How many of n shingles a window must share with an item of as many."""
    return -(-2 * n * PERCENT // (100 + PERCENT))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) of all members of the ranges."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of about SLICE in sum."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        yield a, b
        a = b


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes, BITS / 64 numbers each; repeats weigh as often as they occur."""
    salted = np.stack([mix(shingles + U64(k << 56)) for k in range(1, BITS // 64 + 1)], axis=2)
    bits = np.unpackbits(salted.view(np.uint8), axis=2)
    return np.packbits(bits.sum(1, dtype=np.int32) * 2 > shingles.shape[1], axis=1).view(U64)


class Index:
    """Items of one number of shingles."""

    def __init__(self, shingles: np.ndarray, names: np.ndarray):
        self.names, self.shingles = names, shingles  # names: the items' numbers
        self.prints = fingerprints(shingles)
        self.sections = []
        for own in self.prints.view(np.uint16).T:
            order = np.argsort(own, kind="stable")
            keys, first = np.unique(own[order], return_index=True)
            self.sections.append((keys, np.append(first, len(own)), order))
        self.counts = [np.unique(s, return_counts=True) for s in shingles]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``prints``, item) of all pairs of which a section differs in FLIPS bits at most."""
        found = []
        for own, (keys, first, order) in zip(prints.view(np.uint16).T, self.sections, strict=True):
            if len(keys) <= len(_FLIPPED):  # fewer keys than probes
                rows, at = np.nonzero(np.bitwise_count(own[:, None] ^ keys) <= FLIPS)
            else:
                asked = (own[:, None] ^ _FLIPPED).ravel()
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == asked)
                rows, at = hit // len(_FLIPPED), place[hit]
            n = first[at + 1] - first[at]
            of = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
            found.append(np.repeat(rows, n) * len(self.names) + order[of])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.names), pairs % len(self.names)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``prints``, item) of the candidates at most RADIUS apart."""
        rows, items = self.candidates(prints)
        near = np.bitwise_count(prints[rows] ^ self.prints[items]).sum(1, dtype=np.int64) <= RADIUS
        return rows[near], items[near]

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, item, how often it has it), by shingle."""
        keys = np.concatenate([k for k, _ in self.counts])
        item = np.repeat(np.arange(len(self.counts), dtype=np.int32), [len(k) for k, _ in self.counts])
        order = np.argsort(keys, kind="stable")
        return keys[order], item[order], np.concatenate([c for _, c in self.counts])[order]

    def overlaps(self, text: np.ndarray) -> np.ndarray:
        """Size of the multiset intersection of all shingles of a text and each item."""
        keys, item, count = self.postings
        own, n = np.unique(text, return_counts=True)
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        at = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        return np.bincount(item[at], np.minimum(count[at], np.repeat(n, hi - lo)), len(self.names)).astype(np.int64)

    @cached_property
    def rare(self) -> tuple[np.ndarray, np.ndarray]:
        """(shingle, item), by shingle, of as many of an item's shingles, rarest first, that no window can do without all of them."""
        keys, item, count = self.postings
        _, of, often = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.lexsort((keys, often[of], item))
        n = self.shingles.shape[1]
        before = np.cumsum(count[order]) - count[order] - item[order] * n  # every item has n
        order = np.sort(order[before <= n - _least(n)])
        return keys[order], item[order]

    @cached_property
    def bags(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, how often the item has it) by item, and where each item begins (one more than items)."""
        first = np.cumsum([0, *(len(k) for k, _ in self.counts)])
        return *(np.concatenate(x) for x in zip(*self.counts, strict=True)), first

    def rest(self, own: np.ndarray, text: np.ndarray, starts: np.ndarray, settled: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, size of the multiset intersection, start) of the best window of each pair that matches; ties to the first.

        ``own`` are the shingles of texts and ``text`` whose they are, in order; ``starts`` are those of all windows that can
        match. Pairs whose text * number of items + item is in ``settled`` are left out.
        """
        n, items = self.shingles.shape[1], len(self.names)
        covered = np.zeros(len(own) + 1, np.int32)
        covered[starts] += 1
        covered[starts + n] -= 1
        places = np.flatnonzero(np.cumsum(covered[:-1]))
        known = self.postings[0]
        at = np.minimum(np.searchsorted(known, own[places]), len(known) - 1)  # the first of its postings names a shingle
        hit = known[at] == own[places]
        places, at = places[hit], at[hit]
        keys, by = self.rare
        lo, hi = np.searchsorted(keys, own[places], "left"), np.searchsorted(keys, own[places], "right")
        pairs = np.zeros(0, np.int64)
        for a, b in _slices(hi - lo):
            of, member = _ranges(lo[a:b], hi[a:b])
            pairs = np.union1d(pairs, text[places[a:b]][of] * items + by[member])
        pairs = np.setdiff1d(pairs, settled, assume_unique=True)
        # Where a text has a shingle: a run of ``places``, by text and shingle.
        order = np.lexsort((places, at, text[places]))
        places, codes = places[order], (text[places] * len(known) + at)[order]
        bag, often, first = self.bags
        name = np.searchsorted(known, bag)
        for a, b in _slices(np.diff(first)[pairs % items]):
            some = pairs[a:b]
            pair, member = _ranges(first[some % items], first[some % items + 1])
            asked, c = (some // items)[pair] * len(known) + name[member], often[member]
            lo, hi = np.searchsorted(codes, asked, "left"), np.searchsorted(codes, asked, "right")
            enough = np.bincount(pair, np.minimum(hi - lo, c), len(some)) >= _least(n)
            kept = enough[pair] & (hi > lo)
            pair, c, lo, hi = pair[kept], c[kept], lo[kept], hi[kept]
            sizes = np.bincount(pair, hi - lo, len(some)).astype(np.int64)
            for i, j in _slices(sizes):
                u, v = np.searchsorted(pair, [i, j])
                if u < v:
                    yield self._best(places, text, some, pair[u:v], c[u:v], lo[u:v], hi[u:v])

    def _best(self, places, text, pairs, pair, count, lo, hi) -> tuple[np.ndarray, ...]:
        """What ``rest`` gives for pairs with runs lo to hi of ``places``, a run per shingle, which counts ``count`` times at most."""
        n, items = self.shingles.shape[1], len(self.names)
        run, member = _ranges(lo, hi)
        place, whose, most = places[member], pair[run], count[run]
        # A shingle counts in windows that begin after the count-th before it, and hold it.
        full = member - lo[run] >= most
        after = np.where(full, places[np.where(full, member - most, 0)] + 1, 0)
        mine = (pairs // items)[whose]
        begin = np.maximum(np.maximum(after, place - n + 1), np.searchsorted(text, mine, "left"))
        end = np.minimum(place, np.searchsorted(text, mine, "right") - n) + 1
        some = begin < end
        where = np.concatenate([begin[some], end[some]])
        whose = np.concatenate([whose[some], whose[some]])
        step = np.repeat([1, -1], int(some.sum()))
        order = np.lexsort((where, whose))
        where, whose, shared = where[order], whose[order], np.cumsum(step[order])
        last = np.append((where[1:] != where[:-1]) | (whose[1:] != whose[:-1]), True)[: len(where)]
        good = np.flatnonzero(last & (shared >= _least(n)))
        good = good[np.lexsort((where[good], -shared[good], whose[good]))]
        good = good[np.unique(whose[good], return_index=True)[1]]
        of = pairs[whose[good]]
        return of // items, of % items, shared[good], where[good]

    def shared(self, windows: np.ndarray, item: int) -> np.ndarray:
        """Size of the multiset intersection of each window and an item."""
        keys, counts = self.counts[item]
        at = np.minimum(np.searchsorted(keys, windows), len(keys) - 1)
        hit = keys[at] == windows
        flat = np.repeat(np.arange(len(windows)), windows.shape[1]) * len(keys) + at.ravel()
        have = np.bincount(flat[hit.ravel()], minlength=len(windows) * len(keys)).reshape(len(windows), -1)
        return np.minimum(have, counts).sum(1)


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def index(items: list[tuple[int | None, int, str]]) -> dict[int, tuple[np.ndarray, dict[int, Index], dict[int, tuple]]]:
    """By words per shingle: all shingles of the items, indexes by number of shingles, and id and copies by an item's number.

    ``items`` are (id, copies, text), no two of equal words.
    """
    by: dict[int, dict[int, list]] = {}
    if items:
        for i, j, data, offsets in chunks(_lower(pa.array([x[2] for x in items], pa.string()))):
            hashes, first = words(data, offsets, ALNUM)
            for r in range(j - i):
                own = hashes[first[r] : first[r + 1]]
                if len(own):
                    k = min(WORDS, len(own))
                    shingles = grams(own, np.array([0, len(own)]), k)[0]
                    by.setdefault(k, {}).setdefault(len(shingles), []).append((shingles, i + r))
    out = {}
    for k, sizes in by.items():
        indexes = {n: Index(np.array([s for s, _ in es]), np.array([r for _, r in es])) for n, es in sizes.items()}
        known = np.unique(np.concatenate([x.shingles.ravel() for x in indexes.values()]))
        out[k] = known, indexes, {r: items[r][:2] for es in sizes.values() for _, r in es}
    return out


Worded = list[tuple[int, np.ndarray, np.ndarray]]


def worded(texts: pa.Array) -> Worded:
    """(first row, hashes of its words, first word of each text) of every chunk of ``texts``."""
    return [(i, *words(data, offsets, ALNUM)) for i, _, data, offsets in chunks(_lower(texts))]


def search(texts: pa.Array | Worded, built: dict, whole: bool = False) -> list[tuple[int, int | None, int, float, int, int]]:
    """(row, item, copies of the item, similarity, first word, words) of the best window of each pair.

    With ``whole`` a text of fewer shingles than an item is a window of its own.
    """
    best: dict[tuple[int, int], tuple] = {}  # by row and number of the item
    for i, hashes, first in texts if isinstance(texts, list) else worded(texts):
        for k, (all_of, indexes, copies) in built.items():
            own, at, text = grams(hashes, first, k)
            if not len(own):
                continue
            place = np.minimum(np.searchsorted(all_of, own), len(all_of) - 1)
            known = all_of[place] == own
            if whole:
                size, met = (np.bincount(x, minlength=len(first) - 1) for x in (text, text[known]))
                ends = np.cumsum(size)
                for n, items in indexes.items():
                    # What is shared is among the known shingles, and must be so much of both.
                    short = (size < n) & ((100 + PERCENT) * met >= PERCENT * (n + size))
                    for t in np.flatnonzero(short):
                        d = int(size[t])
                        shared = items.overlaps(own[ends[t] - d : ends[t]])
                        for item in np.flatnonzero(100 * shared >= PERCENT * (n + d - shared)):
                            row, name, m = i + int(t), int(items.names[item]), int(shared[item])
                            x = (float(m / (n + d - m)), 0, d + k - 1, copies[name])
                            best[row, name] = max(best.get((row, name), x), x, key=lambda y: y[:3])
            fewest = min(map(_least, indexes))
            some = np.bincount(text[known], minlength=len(first) - 1) >= fewest
            mine = some[text]
            own, at, text, known = own[mine], at[mine], text[mine], known[mine]
            sums = np.concatenate([[0], np.cumsum(known)])
            for n, items in indexes.items():
                if len(own) < n:
                    continue
                starts = np.flatnonzero((sums[n:] - sums[:-n] >= _least(n)) & (text[n - 1 :] == text[: len(text) - n + 1]))
                if not len(starts):
                    continue
                settled = []  # equal, so with a fingerprint that cannot be missed
                for a in range(0, len(starts), WINDOWS):
                    s = starts[a : a + WINDOWS]
                    windows = own[s[:, None] + np.arange(n)]
                    rows, found = items.within(fingerprints(windows))
                    for item in np.unique(found):
                        r = rows[found == item]
                        shared = items.shared(windows[r], item)
                        for w, m in zip(s[r], shared, strict=True):
                            if 100 * m >= PERCENT * (2 * n - m):
                                row, name, start = i + int(text[w]), int(items.names[item]), int(at[w] - first[text[w]])
                                x = (float(m / (2 * n - m)), -start, n + k - 1, copies[name])
                                best[row, name] = max(best.get((row, name), x), x, key=lambda y: y[:3])
                                if m == n:
                                    settled.append(int(text[w]) * len(items.names) + int(item))
                for found in items.rest(own, text, starts, np.unique(np.array(settled, np.int64))):
                    for t, item, m, w in zip(*(x.tolist() for x in found), strict=True):
                        row, name, start = i + t, int(items.names[item]), int(at[w] - first[t])
                        x = (float(m / (2 * n - m)), -start, n + k - 1, copies[name])
                        best[row, name] = max(best.get((row, name), x), x, key=lambda y: y[:3])
    return [(row, *x[3], x[0], -x[1], x[2]) for (row, _), x in sorted(best.items())]


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their words in lower case, a space between them."""
    for batch in batches:
        bare = pc.replace_substring_regex(_lower(batch["text"]), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
        yield pa.RecordBatch.from_arrays([batch["item_id"], pc.utf8_trim(bare, " ").cast(pa.string())], ["item_id", "words"])


def blocks(benchmark: DataFrame, scratch: Scratch) -> list[str]:
    """Folders of distinct items (item_id, copies, words), each of about BLOCK_BYTES, by the hash of their words."""
    texts = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = texts.mapInArrow(_normal, "item_id long, words string").where("words != ''")
    items = scratch.save(items.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies")), "items")
    n = -(-(items.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // BLOCK_BYTES)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(max(1, n))))
    dealt.repartition(max(1, n), "block").write.partitionBy("block").parquet(root := scratch.path("blocks"))
    return [f"{root}/block={r['block']}" for r in dealt.select("block").distinct().orderBy("block").collect()]


_held: dict[str, dict] = {}


def held(folder: str) -> dict:
    """The index of a block; a worker keeps that of the last one."""
    if folder not in _held:
        _held.clear()
        system, path = fs.FileSystem.from_uri(folder)
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
        t = ds.dataset(files, filesystem=system, format="parquet").to_table(columns=["item_id", "copies", "words"]).sort_by("words")
        _held[folder] = index(list(zip(*(t[c].to_pylist() for c in t.column_names), strict=True)))
    return _held[folder]


def _searched(batches: Iterator[pa.RecordBatch], folders: list[str], whole: bool) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with what all blocks have of it. Batches are gathered, so that a block is not loaded for a few rows."""

    def found(some: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        texts, out = [worded(b["text"]) for b in some], [[] for _ in some]
        for folder in folders:
            built = held(folder)
            for t, o in zip(texts, out, strict=True):
                o += search(t, built, whole)
        yield from zip(some, out, strict=True)

    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch["text"].nbytes
        if size >= GATHER or len(folders) == 1:
            yield from found(some)
            some, size = [], 0
    if some:
        yield from found(some)


def _matcher(folders: list[str], whole: bool):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _searched(batches, folders, whole):
            ids = batch["doc_id"].take(pa.array([x[0] for x in found], pa.int64()))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k + 1] for x in found], t) for k, t in enumerate(types))], ["doc_id", "item_id", "n_items", "similarity", "first_word", "n_words"])

    return match


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """A row per document row and benchmark text that it holds: the best window, ties to the first.

    With ``whole`` also the texts that are most of a longer item.
    """
    small_batches(spark)
    folders = blocks(benchmark, Scratch(spark, "decontam"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_matcher(folders, whole), MATCH) if folders else spark.createDataFrame([], MATCH)


def _marker(folders: list[str], column: str, whole: bool):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _searched(batches, folders, whole):
            flags = np.zeros(batch.num_rows, bool)
            flags[[x[0] for x in found]] = True
            yield pa.RecordBatch.from_arrays([pa.array(flags) if n == column else batch[n] for n in batch.schema.names], batch.schema.names)

    return mark


def marked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, column: str = "contaminated", whole: bool = False) -> DataFrame:
    """``docs`` with a flag as ``column``, which replaces one of that name. No shuffle."""
    small_batches(spark)
    folders = blocks(benchmark, Scratch(spark, "decontam"))
    out = docs.withColumn(column, F.lit(False))
    schema = ", ".join(f"`{n}` {t}" for n, t in out.dtypes)
    return out.mapInArrow(_marker(folders, column, whole), schema) if folders else out
