"""Relations that notes state: links, resolved by a cascade of lookups that is one equi-join.

A target names, in this order: a note's id; an id in the folder of the linking note; an id without
its extension, in that folder or as written; a note's bare name without extension. Within a step the
least id wins. Titles and fragments inside the brackets belong to the target, as the pattern reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import grown

LINK, COOCCURRENCE, SIMILARITY = "link", "cooccurrence", "similarity"


def targets(notes: DataFrame) -> DataFrame:
    """(source, target): the distinct targets of each note."""
    return notes.select(F.col("note_id").alias("source"), F.explode(X.link_targets(F.coalesce("text", F.lit("")))).alias("target"))


def keys(ids: DataFrame) -> DataFrame:
    """(way, key, note): what a note can be called, ways 1 to 3; the least note of each."""
    one = ids.select(F.col("note_id").alias("note"), F.explode(F.array(
        F.struct(F.lit(1).alias("way"), F.col("note_id").alias("key")),
        F.struct(F.lit(2).alias("way"), X.without_extension(F.col("note_id")).alias("key")),
        F.struct(F.lit(3).alias("way"), X.without_extension(X.basename(F.col("note_id"))).alias("key")),
    )).alias("k"))
    return one.groupBy("k.way", "k.key").agg(F.min("note").alias("note"))


def resolved(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(source, target, note): ``links`` with the note that each target names, or null."""
    where = X.folder(F.col("source"))
    sibling = F.when(where.isNotNull(), F.concat(where, F.lit("/"), "target")).otherwise(F.col("target"))
    ask = lambda rank, way, key: F.struct(F.lit(rank).alias("rank"), F.lit(way).alias("way"), key.alias("key"))
    target = F.col("target")
    asked = links.withColumn("q", F.explode(F.array(ask(1, 1, target), ask(2, 1, sibling), ask(3, 2, sibling), ask(4, 2, target), ask(5, 3, target))))
    asked = asked.select("source", "target", "q.rank", "q.way", "q.key")
    hits = asked.join(grown(keys(ids)), ["way", "key"], "left")
    best = F.min(F.when(F.col("note").isNotNull(), F.struct("rank", "note")))
    return hits.groupBy("source", "target").agg(best.alias("best")).select("source", "target", F.col("best.note").alias("note"))


def edges(found: DataFrame) -> DataFrame:
    """(a, b, kind, weight) of resolved links; links to oneself are none, a pair counts once."""
    pairs = found.where("note IS NOT NULL AND note != source").select(F.least("source", "note").alias("a"), F.greatest("source", "note").alias("b"))
    return pairs.distinct().select("a", "b", F.lit(LINK).alias("kind"), F.lit(1.0).alias("weight"))


def dangling(found: DataFrame) -> DataFrame:
    """(source, target) of links that name no note."""
    return found.where("note IS NULL").select("source", "target")
