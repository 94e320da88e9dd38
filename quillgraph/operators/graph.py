"""The graph of notes: adjacency, walks, components, cycles.

Edges are tables (a, b, kind, weight). A walk deals the pairs of notes over tasks by name, EDGES_PER_TASK
each, so that notes of a folder mostly lie together. A task walks its own edges to the end, however long
the way; what it finds out about notes that other tasks hold too goes to those, until nothing gets nearer.
So a walk takes as many rounds as a shortest path leaves and enters parts, not one for each of its notes.
Predecessors follow from the depths by a join. What depends on ancestors (paths, what lies below a note)
is made by doubling the way up, in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, grown
from .components import connected
from .cooccurrence import first_partners

#: Pairs of notes that one task holds: about 100 bytes each for short names.
EDGES_PER_TASK = 1 << 20


def adjacency(edges: DataFrame) -> DataFrame:
    """(note, other) both ways, each pair once, without edges to oneself."""
    pairs = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = F.explode(F.array(F.struct(F.col("a").alias("note"), F.col("b").alias("other")), F.struct(F.col("b").alias("note"), F.col("a").alias("other"))))
    return pairs.select(ends.alias("e")).select("e.note", "e.other")


def of_kind(edges: DataFrame, kind: str) -> DataFrame:
    """One stage of the graph; a kind that no stage makes gives no edges."""
    return edges.where(F.col("kind") == kind)


def note_set(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(note): given notes and the ends of edges."""
    return notes.select(F.col("note_id").alias("note")).union(edges.select("a")).union(edges.select("b")).distinct()


def unconnected(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(note_id) of notes with no edge but to themselves."""
    ends = edges.where("a != b").select(F.explode(F.array("a", "b")).alias("note_id")).distinct()  # before the join, so that few rows are shuffled
    return notes.select("note_id").join(grown(ends), "note_id", "left_anti")


def degrees(adjacent: DataFrame) -> DataFrame:
    return adjacent.groupBy("note").agg(F.count("*").alias("degree"))


class _Codes:
    """Names as numbers, and the neighbours of each, both ways."""

    def __init__(self, note: pa.ChunkedArray, other: pa.ChunkedArray, more: pa.ChunkedArray):
        self.names = pc.unique(pa.chunked_array([*note.chunks, *other.chunks, *more.chunks], pa.string()))
        number = lambda x: pc.index_in(x, self.names).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) if len(x) else np.zeros(0, np.int64)
        x, y = number(note), number(other)
        self.a, self.b = np.concatenate([x, y]), np.concatenate([y, x])
        order = np.argsort(self.a, kind="stable")
        self.a, self.b, self.more = self.a[order], self.b[order], number(more)
        self.first = np.searchsorted(self.a, np.arange(len(self.names) + 1))

    def around(self, notes: np.ndarray) -> np.ndarray:
        """Neighbours of ``notes``."""
        n = self.first[notes + 1] - self.first[notes]
        return self.b[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[notes], n)]

    def walk(self, given: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(notes that are reached, their depths), from the notes ``more`` at depths ``given``."""
        far = np.iinfo(np.int64).max
        depth = np.full(len(self.names), far)
        np.minimum.at(depth, self.more, given)
        order = np.argsort(given, kind="stable")
        seeds, levels, at = self.more[order], given[order], 0
        frontier, d = seeds[:0], 0
        while True:
            if not len(frontier):
                if at == len(seeds):
                    break
                d = int(levels[at])
            till = int(np.searchsorted(levels, d, "right"))
            frontier = np.unique(np.concatenate([frontier, seeds[at:till][depth[seeds[at:till]] == d]]))
            at = max(at, till)
            if most is not None and d >= most:
                break
            to = self.around(frontier)
            frontier = np.unique(to[depth[to] > d + 1])
            d += 1
            depth[frontier] = d
        reached = np.flatnonzero(depth < far)
        return reached, depth[reached]

    def components(self) -> np.ndarray:
        label = np.arange(len(self.names))
        while True:
            low = label.copy()
            np.minimum.at(low, self.a, label[self.b])
            np.minimum.at(low, label[self.a], label[self.b])
            low = low[low]
            if (low == label).all():
                return label
            label = low


def _walker(most: int | None):
    def run(t: pa.Table) -> pa.Table:
        edges, seeds = t.filter(pc.is_null(t["depth"])), t.filter(pc.is_valid(t["depth"]))
        codes = _Codes(edges["note"], edges["other"], seeds["note"])
        at, depth = codes.walk(seeds["depth"].to_numpy().astype(np.int64), most)
        return pa.table({"note": codes.names.take(pa.array(at)), "depth": pa.array(depth, pa.int32())})

    return run


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task as stars around the least note of what they join; as few as there are notes."""

    def stars(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(some)
        codes = _Codes(t["u"], t["v"], t["u"].slice(0, 0))
        label, rank = codes.components(), np.empty(len(codes.names), np.int64)
        rank[pc.sort_indices(codes.names).to_numpy()] = np.arange(len(rank))
        least = np.full(len(rank), len(rank))
        np.minimum.at(least, label, rank)
        root = np.argsort(rank)[least[label]]
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([codes.names.take(pa.array(at)), codes.names.take(pa.array(root[at]))], ["u", "v"])

    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= EDGES_PER_TASK:
            yield stars(some)
            some, n = [], 0
    if n:
        yield stars(some)


@dataclass
class Reach:
    """What a walk found: ``reached`` (note, depth, via) and the tables it walked."""

    reached: DataFrame
    adjacent: DataFrame
    seeds: DataFrame
    bound: int | None

    def left_out(self, notes: DataFrame) -> DataFrame:
        """(note) of the given notes that were not reached."""
        return notes.select("note").join(grown(self.reached), "note", "left_anti")

    def truncated(self) -> DataFrame:
        """(truncated): whether a note at the bound has a neighbour that was not reached."""
        if self.bound is None:
            return self.reached.limit(0).agg(F.lit(False).alias("truncated"))
        edge = self.reached.where(F.col("depth") == self.bound).select("note")
        beyond = edge.join(grown(self.adjacent), "note").select(F.col("other").alias("note")).join(grown(self.reached), "note", "left_anti")
        return beyond.agg((F.count("*") > 0).alias("truncated"))


def reach(adjacent: DataFrame, seeds: DataFrame, bound: int | None = None, scratch: Scratch | None = None) -> Reach:
    """Multi-source breadth-first walk from ``seeds`` (note) over (note, other), both ways; no seeds reach nothing.

    Of the notes a step nearer to a seed, the least is the one a note was reached by.
    """
    scratch = scratch or Scratch(adjacent.sparkSession, "walk")
    adjacent, seeds = scratch.save(adjacent, "adjacency"), seeds.select("note").distinct()
    parts = max(1, -(-adjacent.count() // (2 * EDGES_PER_TASK)))
    pairs, start = adjacent.where("note < other"), seeds.select("note", F.lit(0).alias("depth"))
    if parts == 1:  # no note lies in another part
        known = _walked(pairs.withColumn("part", F.lit(0)), start.withColumn("part", F.lit(0)), bound, scratch)
    else:
        dealt = pairs.repartitionByRange(parts, "note", "other").select(F.spark_partition_id().alias("part"), "note", "other")
        known = _exchanged(scratch.save(dealt, "parts"), scratch.save(start, "seeds"), bound, scratch)
    # The nearest of a note's neighbours is a step nearer than the note; seeds have none.
    at = lambda depth, via: F.struct(depth.alias("depth"), via.alias("via")).alias("x")
    led = known.join(grown(adjacent), "note").select(F.col("other").alias("note"), at(F.col("depth"), F.col("note")))
    own = known.where("depth = 0").select("note", at(F.lit(-1), F.lit(None).cast("string")))
    found = led.unionByName(own).groupBy("note").agg(F.min("x").alias("x")).select("note", (F.col("x.depth") + 1).alias("depth"), "x.via")
    return Reach(scratch.save(found if bound is None else found.where(F.col("depth") <= bound), "reached"), adjacent, seeds, bound)


def _walked(edges: DataFrame, start: DataFrame, bound: int | None, scratch: Scratch) -> DataFrame:
    """(note, depth) of what each part reaches from ``start`` (part, note, depth), that included."""
    rows = edges.select("part", "note", "other", F.lit(None).cast("int").alias("depth")).unionByName(start.select("part", "note", F.lit(None).cast("string").alias("other"), "depth"))
    return scratch.save(rows.groupBy("part").applyInArrow(_walker(bound), "note string, depth int"), "walked")


def _exchanged(edges: DataFrame, known: DataFrame, bound: int | None, scratch: Scratch) -> DataFrame:
    """Depths of all notes that are reached, by walks within parts and exchanges between them."""
    ends = edges.select("part", F.explode(F.array("note", "other")).alias("note")).distinct()
    ends = scratch.save(ends, "ends")
    several = ends.groupBy("note").agg(F.count("*").alias("n")).where("n > 1").select("note")
    border = scratch.save(ends.join(grown(several), "note"), "border")
    start = scratch.save(ends.join(grown(known), "note"), "start")  # seeds without an edge are known, and lead nowhere
    while not start.isEmpty():
        active = edges.join(start.select("part").distinct(), "part", "left_semi")
        met = _walked(active, start, bound, scratch).groupBy("note").agg(F.min("depth").alias("depth"))
        was = known.select("note", F.col("depth").alias("was"))
        fresh = scratch.save(met.join(grown(was), "note", "left").where("was IS NULL OR depth < was").select("note", "depth"), "fresh")
        known = scratch.save(known.unionByName(fresh).groupBy("note").agg(F.min("depth").alias("depth")), "known")
        start = scratch.save(border.join(grown(fresh), "note"), "start")
    return known


def reach_shared(adjacent: DataFrame, rows: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(note, depth, via) of a walk over (note, other) and over the notes of ``rows`` (see ``cooccurrence.coded``) that share terms.

    Pairs that share terms are not made: a level looks for the first note of the level before that each note left shares terms with.
    """
    adjacent = scratch.save(adjacent, "adjacency")
    level = scratch.save(seeds.select("note", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).distinct(), "level")
    reached, left, depth = level, rows, 0
    while not level.isEmpty():
        depth += 1
        at = level.select("note")
        left = scratch.save(left.join(grown(at.withColumnRenamed("note", "note_id")), "note_id", "left_anti"), "left")
        among = scratch.save(rows.join(grown(at.withColumnRenamed("note", "note_id")), "note_id").withColumn("place", F.col("note_id")), "among")
        by_terms = first_partners(left, among, scratch).select(F.col("note_id").alias("note"), F.col("partner").alias("via"))
        by_links = adjacent.join(grown(at), "note").select(F.col("other").alias("note"), F.col("note").alias("via"))
        met = by_terms.unionByName(by_links.join(grown(reached.select("note")), "note", "left_anti"))
        level = scratch.save(met.groupBy("note").agg(F.min("via").alias("via")).select("note", F.lit(depth).alias("depth"), "via"), "level")
        reached = reached.unionByName(level)
    return reached


def _rounds(reached: DataFrame) -> int:
    return int(reached.agg(F.max("depth")).first()[0] or 0).bit_length()


def paths(found: Reach, scratch: Scratch) -> DataFrame:
    """(note, depth, path): a shortest path to each reached note, by predecessors.

    Each round prepends the path of the note that a path begins below, so its length doubles.
    """
    now = found.reached.select("note", "depth", F.col("via").alias("up"), F.array("note").alias("path"))
    for _ in range(_rounds(found.reached)):
        above = now.select(F.col("note").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        longer = now.where("up IS NOT NULL").join(grown(above), "up").select("note", "depth", F.col("next").alias("up"), F.concat("head", "path").alias("path"))
        now = scratch.save(now.where("up IS NULL").unionByName(longer), "paths")
    return now.select("note", "depth", "path")


def components(adjacent: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(note, component) of all notes with an edge; a component is named by its least note.

    Tasks first contract what they hold, so that fewer links go on to the steps over the whole table.
    """
    scratch = scratch or Scratch(adjacent.sparkSession, "components")
    links = adjacent.where("note > other").select(F.col("note").alias("u"), F.col("other").alias("v"))
    return connected(links.mapInArrow(_contract, "u string, v string"), scratch).select(F.col("node").alias("note"), "component")


def forest(adjacent: DataFrame, scratch: Scratch) -> Reach:
    """A breadth-first walk from the least note of every component."""
    roots = components(adjacent, scratch).select(F.col("component").alias("note")).distinct()
    return reach(adjacent, roots, None, scratch)


def _labels(pairs: DataFrame) -> DataFrame:
    """Edges that the forest leaves out, with a label; a pair's ends each take it."""
    label = F.xxhash64("note", "other")
    return pairs.select(F.explode(F.array(F.struct(F.col("note"), label.alias("x")), F.struct(F.col("other").alias("note"), label.alias("x")))).alias("e")).select("e.*")


def cycle_notes(adjacent: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(note) of every note that lies on a cycle, that is, with an edge that is no bridge.

    Each edge outside a spanning forest gets a 64-bit label. The XOR of the labels at the notes below
    a tree edge is that of the edges that leave it, so it is 0 for a bridge (and for others with a
    probability of 2**-64).
    """
    scratch = scratch or Scratch(adjacent.sparkSession, "cycles")
    tree = forest(adjacent, scratch)
    adjacent, reached = tree.adjacent, tree.reached
    pairs = adjacent.where("note < other")
    of_tree = reached.where("via IS NOT NULL").select(F.least("note", "via").alias("note"), F.greatest("note", "via").alias("other"))
    extra = scratch.save(pairs.join(grown(of_tree), ["note", "other"], "left_anti"), "extra")
    own = _labels(extra).groupBy("note").agg(F.bit_xor("x").alias("x"))
    placed = reached.join(grown(own), "note", "left").select("note", "depth", "via", F.coalesce("x", F.lit(0).cast("long")).alias("x"))
    covered = _below(scratch.save(placed, "placed"), scratch).where("x != 0 AND via IS NOT NULL")
    ends = covered.select(F.explode(F.array("note", "via")).alias("note")).union(extra.select(F.explode(F.array("note", "other"))))
    return ends.distinct()


def _below(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """``placed`` (note, depth, via, x) with the XOR of x over each note and all below it.

    After k rounds a note has what is less than 2**k levels below; those just so many levels below add theirs.
    """
    now = placed.withColumn("up", F.col("via"))
    for _ in range(_rounds(placed)):
        more = now.where("up IS NOT NULL").groupBy(F.col("up").alias("note")).agg(F.bit_xor("x").alias("more"))
        above = now.select(F.col("note").alias("up"), F.col("up").alias("next"))
        step = now.join(grown(above), "up", "left").join(grown(more), "note", "left")
        now = scratch.save(step.select("note", "depth", "via", F.col("x").bitwiseXOR(F.coalesce("more", F.lit(0).cast("long"))).alias("x"), F.col("next").alias("up")), "below")
    return now.drop("up")


def has_cycle(adjacent: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(n_notes, n_pairs, n_components, has_cycle) of the notes that have an edge: pairs - notes + components > 0."""
    scratch = scratch or Scratch(adjacent.sparkSession, "cycles")
    found = components(adjacent, scratch)
    pairs = adjacent.agg((F.count("*") / 2).cast("long").alias("n_pairs"))
    out = found.agg(F.count("*").alias("n_notes"), F.countDistinct("component").alias("n_components")).crossJoin(pairs)
    return out.select("n_notes", "n_pairs", "n_components", (F.col("n_pairs") - F.col("n_notes") + F.col("n_components") > 0).alias("has_cycle"))


def cycles(adjacent: DataFrame, max_length: int = 4) -> DataFrame:
    """(length, cycle): all simple cycles of 3 to ``max_length`` notes, least note first, then the smaller neighbour.

    Trails grow from their least note by joins; their number grows fast with the length in dense graphs.
    """
    step = adjacent.select(F.col("note").alias("last"), F.col("other").alias("next"))
    trails = adjacent.where("note < other").select(F.array("note", "other").alias("trail"), F.col("other").alias("last"))
    closing = adjacent.select(F.col("note").alias("last"), F.col("other").alias("first"))
    out = None
    for n in range(3, max_length + 1):
        trails = trails.join(step, "last").where((F.col("next") > F.col("trail")[0]) & ~F.array_contains("trail", F.col("next")))
        trails = trails.select(F.concat("trail", F.array("next")).alias("trail"), F.col("next").alias("last"))
        ended = trails.where(F.col("trail")[1] < F.col("last")).withColumn("first", F.col("trail")[0]).join(closing, ["last", "first"], "left_semi")
        found = ended.select(F.lit(n).alias("length"), F.col("trail").alias("cycle"))
        out = found if out is None else out.unionByName(found)
    return out


def triangles(adjacent: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, all adjacent. Pairs are directed from the note of smaller degree, so hubs fan out little."""
    degree = degrees(adjacent)
    rank = lambda c: F.struct(F.col(f"d_{c}"), F.col(c))
    sized = adjacent.join(degree.select("note", F.col("degree").alias("d_note")), "note").join(degree.select(F.col("note").alias("other"), F.col("degree").alias("d_other")), "other")
    out = sized.where(rank("note") < rank("other")).select("note", "other", "d_other")
    x = out.select(F.col("note"), F.col("other").alias("x"), F.col("d_other").alias("dx"))
    y = out.select(F.col("note"), F.col("other").alias("y"), F.col("d_other").alias("dy"))
    wedges = x.join(y, "note").where(F.struct("dx", "x") < F.struct("dy", "y"))
    closed = wedges.join(adjacent.select(F.col("note").alias("x"), F.col("other").alias("y")), ["x", "y"], "left_semi")
    s = F.array_sort(F.array("note", "x", "y"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))
