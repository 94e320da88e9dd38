"""MinHash near-dedup over SetSketch registers.

A document's set holds its distinct WORDS-word shingles as 64-bit hashes (words: runs of what is not
ASCII white space, A-Z lower-cased; fewer words make one shingle; no word, no set). Steps:

1. One pass makes each set's size, its 64-bit sum, M SetSketch registers (truncated logarithms, to
   base RADIX, of exponential minima; the registers of a union are the maxima) and M / ROWS band keys.
2. Documents with equal sets form a class; only classes go on, so copies are never expanded. The sets of
   classes that share a bucket with another one are made once, from the texts of their representatives.
3. PIVOTS times, every class is compared with one member of each of its buckets (linear in the bucket), each
   time one that is not yet joined to those before it. What passes the likelihood test is verified on whole
   sets, with a set of many partners dealt over copies; links join classes to components.
4. Buckets that still hold several components are parted by size, without loss: members whose sizes differ too
   much for the least similarity never meet. The parts go in blocks of BLOCK members (or BLOCK_SETS shingles), by pairs of
   blocks; a task compares registers, then whole sets of what passes, and only links that join two components leave it.

The test maximises the joint likelihood of the registers' comparisons (greater, less, equal) given
both set sizes and drops a pair only if the least similarity is exp(SURE) times less likely than the best J.
That similarity is PERCENT unless the caller gives another one. At J = 0.85 a pair shares no band
with a probability of 1e-5, at 0.8 of 7e-4 (at 0.5 it shares one with 0.31); links within a component that are
skipped cannot change the result, which is exact but for that and for collisions of 64-bit hashes.

Sets are shuffled once for each bucket that is still open after step 3, and for each block of it that they meet: what
is quadratic in a bucket of very many pages that resemble each other and are no copies is the number of blocks squared.

A null doc_id is never the least id unless its component has no other, then component_id is null and kept
is true. Rows that repeat a doc_id are rows of their own. Texts of any length are taken whole; a null text is an empty one.
Other columns are ignored by ``digest`` and carried by ``deduplicated``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_numbers
from .common import SPACED, U64, Scratch, chunks, grams, mix, small_batches, words

WORDS, PERCENT = 5, 85
M, ROWS, RADIX, RATE = 144, 6, 1.001, 100.0
BANDS = M // ROWS
PIVOTS, BLOCK, BLOCK_SETS, STEP, SURE, SALT = 3, 2048, 1 << 20, 256, 18.0, 256
_rng = np.random.Generator(np.random.PCG64(20240))
_MUL = _rng.integers(1, 1 << 63, M, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _rng.integers(0, 1 << 63, M, dtype=np.uint64)
SKETCH = "doc_id long, h long, n long, node long, bands array<long>, registers binary"


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted within each; where each text's begin)."""
    hashes, first = words(data, offsets, SPACED)
    n = np.diff(first)
    own, at, text = grams(hashes, first, WORDS)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        single = np.empty(len(short), U64)
        with np.errstate(over="ignore"):
            for k, i in enumerate(short):
                h = U64(n[i])
                for w in hashes[first[i] : first[i + 1]]:
                    h = h * U64(0xC2B2AE3D27D4EB4F) + w
                single[k] = h
        own, text = np.concatenate([own, mix(single)]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        own, text = own[order], text[order]
    bounds = np.searchsorted(text, np.arange(len(n) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own[a:b].sort()
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    return own[fresh], np.searchsorted(text[fresh], np.arange(len(n) + 1))


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers of every set that is not empty, uint16."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    least = np.full((len(starts), M), ~U64(0))
    step = 1 << 15  # keeps the products in the processor's cache
    for a in range(0, len(sets), step):
        part = sets[a : a + step]
        i = max(0, int(np.searchsorted(starts, a, "right")) - 1)
        j = int(np.searchsorted(starts, a + len(part), "left"))
        cut = np.maximum(starts[i:j] - a, 0)
        for k in range(M):
            low = np.minimum.reduceat(part * _MUL[k] + _ADD[k], cut)
            np.minimum(least[i:j, k], low, out=least[i:j, k])
    u = ((least >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
    e = -np.log1p(-u) / RATE
    return np.clip(np.floor(1.0 - np.log(e) / np.log(RADIX)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    out = np.empty((len(regs), BANDS), U64)
    for b in range(BANDS):
        h = np.full(len(regs), U64(b + 1))
        for r in range(ROWS):
            h = h * U64(0xC2B2AE3D27D4EB4F) + regs[:, b * ROWS + r].astype(U64)
        out[:, b] = mix(h)
    return out


def nodes(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A number for each set, whatever the order of its members; 0 for the empty set."""
    n = np.diff(bounds)
    full, out = np.flatnonzero(n), np.zeros(len(n), U64)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(sets ^ U64(0xA0761D6478BD642F)), bounds[:-1][full]) + n[full].astype(U64))
    return out.view(np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch["text"]):
            sets, bounds = shingles(data, offsets)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            bands, kept = np.zeros((0, BANDS), U64), [None] * (j - i)
            if len(full):
                regs = registers(sets, bounds)
                bands = band_keys(regs)
                for k, r in zip(full.tolist(), regs, strict=True):
                    kept[k] = r.tobytes()
            ends = np.zeros(j - i + 1, np.int64)
            ends[1:] = np.cumsum((n > 0) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(i, j - i), batch["h"].slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(nodes(sets, bounds)), _lists(bands.ravel(), ends), pa.array(kept, pa.binary())],
                ["doc_id", "h", "n", "node", "bands", "registers"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch["text"]):
            sets, bounds = shingles(data, offsets)
            yield pa.RecordBatch.from_arrays([batch["node"].slice(i, j - i), _lists(sets, bounds)], ["node", "set"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as bytes."""
    for batch in batches:
        sets = [x.values.to_numpy().tobytes() for x in batch["set"]]
        yield pa.RecordBatch.from_arrays([batch["node"], batch["registers"], pa.array(sets, pa.binary())], ["node", "registers", "set"])


_GRID = np.linspace(0.0, 0.98, 50)


def possible(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether J >= percent / 100 cannot be ruled out, from how many registers of a exceed those of b, and are less."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(n_a / n_b, n_b / n_a)  # no J is greater
    j = np.minimum(np.append(_GRID, percent / 100)[None, :], top[:, None])
    c = (RADIX - 1) / RADIX
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * c) / np.log(RADIX)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    same = M - more - less
    like = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    best, here = like.max(1), like[:, -1]
    above = like[:, :-1].argmax(1)
    return (top * 100 >= percent - 1e-9) & ((here >= best - SURE) | (j[np.arange(len(j)), above] >= percent / 100))


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with both registers, to those that pass the test."""
    regs = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, M)
    for batch in batches:
        if batch.num_rows:
            a, b = regs(batch["ra"]), regs(batch["rb"])
            ok = possible((a > b).sum(1), (a < b).sum(1), batch["na"].to_numpy().astype(float), batch["nb"].to_numpy().astype(float), percent)
            yield pa.RecordBatch.from_arrays([batch[n].filter(pa.array(ok)) for n in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"])


def _linked(t: pa.Table, own: bool, percent: int) -> pa.RecordBatch:
    """Links between different components among the members of two blocks (``own``: of one), checked on whole sets.

    A pair is looked at in the first band that it shares only. What a link joins counts as one component from then on,
    so there are fewer links than members.
    """
    node, label, n, side, low = (t[c].to_numpy() for c in ("node", "component", "n", "side", "low"))
    label = label.copy()
    flat = lambda c, kind: np.frombuffer(pa.concat_arrays(t[c].chunks).cast(pa.large_binary()).buffers()[2], kind)
    regs, every, band = flat("registers", np.uint16).reshape(-1, M), flat("set", U64), t["band"][0].as_py()
    ends = np.cumsum(n)
    bands = regs.reshape(len(n), BANDS, ROWS)
    left, right = (np.flatnonzero(side == x) for x in ((0, 0) if own else (0, 1)))
    out = []
    for k, a in enumerate(left):
        others = right[k + 1 :] if own else right
        fit = (label[others] != label[a]) & (100 * np.minimum(n[others], n[a]) >= percent * np.maximum(n[others], n[a])) & ~(low[a] & low[others])
        others = others[fit]
        if len(others):
            others = others[possible((regs[a] > regs[others]).sum(1), (regs[a] < regs[others]).sum(1), np.full(len(others), float(n[a])), n[others].astype(float), percent)]
            others = others[~(bands[a, :band] == bands[others, :band]).all(2).any(1)]
        own_set = every[ends[a] - n[a] : ends[a]]
        for i in range(0, len(others), STEP):
            some = others[i : i + STEP]
            some = some[label[some] != label[a]]
            if not len(some):
                continue
            theirs = np.concatenate([every[ends[b] - n[b] : ends[b]] for b in some])
            hit = own_set[np.minimum(np.searchsorted(own_set, theirs), n[a] - 1)] == theirs
            shared = np.add.reduceat(hit, np.cumsum(n[some]) - n[some], dtype=np.int64)
            for b in some[100 * shared >= percent * (n[a] + n[some] - shared)]:
                if label[b] != label[a]:
                    out.append((node[a], node[b]))
                    label[label == label[b]] = label[a]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], ["u", "v"])


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of every pair of blocks; rows come sorted by key, s, i, j."""
    place, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        where = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("key", "s", "i", "j")])
        cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if (now := tuple(where[:, a].tolist())) != place:
                if sum(x.num_rows for x in kept) > 1:
                    yield _linked(pa.Table.from_batches(kept), place[2] == place[3], percent)
                place, kept = now, []
            kept.append(batch.slice(a, b - a))
    if sum(x.num_rows for x in kept) > 1:
        yield _linked(pa.Table.from_batches(kept), place[2] == place[3], percent)


PAIR = "a long, b long, na long, nb long"


def whole_sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, set) of the classes ``nodes``, from the texts of their representatives."""
    wanted = reps.join(nodes, "node", "left_semi").select("node", "doc_id", "h")
    known = docs.join(wanted, ["doc_id", "h"]).select("node", "text")
    # Rows without an id meet by text, one of each, so that many copies do not meet in one task.
    unknown = docs.where("doc_id IS NULL").select("h", "text").dropDuplicates(["h"])
    texts = known.unionByName(unknown.join(wanted.where("doc_id IS NULL"), "h").select("node", "text"))
    return scratch.save(texts.mapInArrow(_sets, "node long, set array<long>").dropDuplicates(["node"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """Pairs of classes whose whole ``sets`` meet ``percent``. A class with many partners is dealt over copies of its set."""
    degree = pairs.groupBy("b").agg(F.count("*").alias("d"))
    salted = pairs.join(degree, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.expr(f"ceil(d / {SALT})")).cast("int"))
    copies = sets.join(degree.select(F.col("b").alias("node"), "d"), "node").select(F.col("node").alias("b"), F.col("set").alias("sb"), F.explode(F.expr(f"sequence(0, cast(ceil(d / {SALT}) AS int) - 1)")).alias("salt"))
    both = salted.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(copies, ["b", "salt"])
    shared = both.select("a", "b", (F.col("na") + F.col("nb")).alias("total"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"))
    links = shared.where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent)
    return scratch.save(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "verified")


def classes(sketch: DataFrame, scratch: Scratch) -> DataFrame:
    """Sketches of one row of each class: of its least id, any where no id is known. Payloads are fetched by id and text, which are spread evenly."""
    least = sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    unknown = sketch.where("n > 0 AND doc_id IS NULL").dropDuplicates(["node"]).join(least, "node", "left_anti")
    return scratch.save(sketch.join(least, ["node", "doc_id"]).dropDuplicates(["node"]).unionByName(unknown), "classes")


def bucketed(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, band, node) of the classes that share a band's key with another one."""
    members = scratch.save(reps.select("node", F.posexplode("bands").alias("band", "key")), "bands")
    shared = members.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    out = scratch.save(members.join(shared, "key"), "members")
    scratch.drop(members)
    return out


def with_component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their node; a node without a link is one of its own."""
    if found is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def pivot_links(reps: DataFrame, members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """Links of classes with a pivot of each of their buckets, PIVOTS times, as components."""
    side = lambda k: reps.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("registers").alias(f"r{k}"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    active, found = with_component(members.select("key", "node"), None), None
    for _ in range(PIVOTS):
        pivot = active.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("rows")).where("rows > 1").select("key", "pivot")
        placed = scratch.save(active.select("key", "node").join(pivot, "key"), "pivots")
        star = placed.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).repartition("a").distinct()  # dealt as the join needs it
        sized = star.join(side("a"), "a").join(side("b"), "b").where(near)
        passed = scratch.save(sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(lambda x: _likely(x, percent), PAIR), "star")
        new = verified(passed, sets, scratch, percent)
        if not new.isEmpty():
            found = connected_numbers(new if found is None else new.union(found.select("node", "component")), scratch)
        # On with those that are not joined to the pivot, where there are two or more components of them.
        of_pivot = with_component(placed.select("key", F.col("pivot").alias("node")).distinct(), found).select("key", F.col("component").alias("done"))
        rest = with_component(placed.select("key", "node"), found).join(of_pivot, "key").where("component != done").drop("done")
        several = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
        active = scratch.save(rest.join(several, "key"), "rest")
        if active.isEmpty():
            break
    return found


def block_links(reps: DataFrame, members: DataFrame, sets: DataFrame, found: DataFrame | None, scratch: Scratch, percent: int) -> DataFrame:
    """(u, v): links between components among the members of buckets that still hold several."""
    own = scratch.save(with_component(members, found).join(reps.select("node", "n"), "node"), "placed")
    left = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo != hi AND size > 2")
    # Sizes of similar sets lie in the same step of a geometric scale or in neighbouring ones. Part s holds those of step s
    # and, marked low, those of the step before; two low ones meet in their own part.
    step = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / percent)) * (1 + 1e-9))).cast("int")
    open_ = own.join(left.select("key"), "key").withColumn("step", step).withColumn("s", F.explode(F.array("step", F.col("step") + 1))).withColumn("low", F.col("s") != F.col("step"))
    parts = F.expr(f"CAST(greatest(ceil(size / {BLOCK}), ceil(total / {BLOCK_SETS})) AS int)").alias("parts")
    sizes = open_.groupBy("key", "s").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("low").alias("all_low"))
    dealt = open_.join(sizes.where("lo != hi AND NOT all_low").select("key", "s", parts), ["key", "s"])
    dealt = scratch.save(dealt.withColumn("p", F.pmod(F.xxhash64("node"), "parts").cast("int")), "open")
    # Block p meets all blocks: as the left side those from p on, as the right side those before it.
    spread = dealt.withColumn("q", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "key", "s", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), (F.col("p") > F.col("q")).cast("int").alias("side"), "low", "node", "component", "band", "n"
    )
    full = reps.select("node", "registers").join(sets.join(dealt.select("node").distinct(), "node", "left_semi"), "node")
    packed = full.mapInArrow(_packed, "node long, registers binary, set binary")
    order = ["key", "s", "i", "j"]
    sent = spread.join(packed, "node").repartition(*order).sortWithinPartitions(*order)
    columns = [*order, "side", "low", "node", "component", "n", "registers", "band", "set"]
    return scratch.save(sent.select(columns).mapInArrow(lambda x: _blocks(x, percent), "u long, v long"), "blocks")


def clusters(spark: SparkSession, docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, (node, component) of the classes that have a link)."""
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    sketch = scratch.save(docs.select("doc_id", "h", "text").mapInArrow(_sketch, SKETCH), "sketches")
    reps = classes(sketch, scratch)
    members = bucketed(reps, scratch)
    sets = whole_sets(docs, reps, members.select("node").distinct(), scratch)
    found = pivot_links(reps, members, sets, scratch, percent)
    links = block_links(reps, members, sets, found, scratch, percent)
    if found is not None:
        links = links.union(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
    return sketch, connected_numbers(links, scratch)


def digest(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept."""
    return _digest(spark, docs, percent).drop("h", "component")


def deduplicated(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of ``docs``: of those with its least id, the text with the least hash. Rows without a word stay."""
    kept = _digest(spark, docs, percent).where("kept").select(F.col("doc_id").alias("__d"), F.col("h").alias("__own"), F.col("n_shingles").alias("__n"), "component")
    # All kept rows of a component have one id, or none has any.
    one = kept.where("__n > 0").groupBy("component").agg(F.min("__d").alias("__d"), F.min("__own").alias("__own"), F.max("__n").alias("__n")).drop("component")
    own = one.unionByName(kept.where("__n = 0").drop("component").distinct())
    keyed = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    on = keyed["doc_id"].eqNullSafe(own["__d"]) & (keyed["__h"] == own["__own"])
    joined = keyed.join(own, on)
    single = joined.where("__n > 0").dropDuplicates(["doc_id", "__h"])
    return single.select(docs.columns).unionByName(joined.where("__n = 0").select(docs.columns))


def _digest(spark: SparkSession, docs: DataFrame, percent: int) -> DataFrame:
    scratch = Scratch(spark, "neardup")
    sketch, found = clusters(spark, docs, scratch, percent)
    least = sketch.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    of_class = least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_class = scratch.save(of_class, "least")
    joined = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = of_class.join(joined, "component").select("node", "component_id", "component")
    rows = sketch.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    some = rows.where("node IS NOT NULL").join(by_class, "node").drop("node")
    none = rows.where("node IS NULL").drop("node").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
