"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is an aggregate and a join on a node, written to the shared folder; neither links nor
components reach the driver. Known to converge in O(log n) rounds (Kiveris et al., 2014).
Links between numbers are contracted first by the tasks that read them; where LINKS_PER_TASK or fewer are left, one task
settles those, else the steps go on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, grown

#: Links between numbers that one task holds, 16 bytes each.
LINKS_PER_TASK = 1 << 20


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v. Each node's neighbours (larger ones, or smaller ones and itself) move to its least one."""
    both = links if not large else links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(grown(least), "u")
    moved = joined.where(F.col("v") > F.col("u")) if large else joined
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
    return (out if large else out.unionAll(least.select("u", F.col("m").alias("v")).where(F.col("u") != F.col("m")))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has at most one link upwards, to a node that has none: then all components are stars."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    of_node = ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
    return of_node.where("ups > 1 OR (ups = 1 AND low = 0)").isEmpty()


def connected(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link; a component is named by its least node. Self-links are ignored."""
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct()
    now = scratch.save(pairs, "links")
    for _ in range(rounds):
        if _settled(now):
            break
        step = scratch.save(_star(_star(now, True), False), "star")
        scratch.drop(now)
        now = step
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the links, the least node of the component of each)."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        low, least = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(low, label[a], least)
        np.minimum.at(low, label[b], least)
        low = low[low]
        if (low == label).all():
            return names, names[label]
        label = low


def _contract(batches: Iterator[pa.RecordBatch], roots: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Links of a task as (node, least node of what they join), by ``most`` links; with ``roots``, least nodes have a row too."""

    def stars(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, least = _roots(*(np.concatenate([x[c].to_numpy() for x in some]) for c in ("u", "v")))
        here = slice(None) if roots else node != least
        return pa.RecordBatch.from_arrays([pa.array(node[here]), pa.array(least[here])], ["u", "v"])

    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= most:
            yield stars(some)
            some, n = [], 0
    if n:
        yield stars(some)


def connected_numbers(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``connected`` for links between numbers, as a saved table."""
    most = LINKS_PER_TASK
    kind = "u long, v long"
    now = scratch.save(links.select("u", "v").where("u != v").mapInArrow(lambda x: _contract(x, False, most), kind), "links")
    if now.count() > most:
        out = connected(now, scratch)
    else:
        out = now.coalesce(1).mapInArrow(lambda x: _contract(x, True, most + 1), kind).select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = scratch.save(out, "components")
    scratch.drop(now)
    return out
