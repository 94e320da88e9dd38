"""Full-text search over note bodies, ranked by BM25, independent of the graph.

Every token of a body counts, short ones and stop words too. Plain search matches words as they
are; with ``normalise`` words are folded and stemmed, by a function that runs over the distinct words
of the corpus only. Any term of a query is enough. Scores are negative, the best first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as X
from ..scratch import Scratch, grown

#: Fixed values of the ranking function.
K1, B, FLOOR = 1.2, 0.75, 1e-6


def query_terms(queries: DataFrame, stop: DataFrame) -> DataFrame:
    """(qid, pos, term): words of three characters or more that are no stop words, by first place, unrepeated."""
    kept = queries.select("qid", F.posexplode(F.array_distinct(F.filter(X.tokens(F.coalesce("text", F.lit(""))), lambda w: F.length(w) >= X.MIN_TERM))).alias("pos", "term"))
    return kept.join(F.broadcast(stop), "term", "left_anti").select("qid", "pos", "term")


def bodies(notes: DataFrame) -> DataFrame:
    """(note_id, tokens)."""
    return notes.select("note_id", X.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def lengths(body: DataFrame) -> DataFrame:
    """(note_id, n_tokens)."""
    return body.select("note_id", F.size("tokens").cast("long").alias("n_tokens"))


def _mapped(words: DataFrame, normalise: bool) -> DataFrame:
    """(term, key): how each distinct word is matched."""
    key: Column = stem.normalised(F.col("term")) if normalise else F.col("term")
    return words.select("term").distinct().select("term", key.alias("key"))


def matches(body: DataFrame, asked: DataFrame, normalise: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(note_id, key, freq): how often a note holds each key that is asked for. With ``scratch`` the words of these keys are saved."""
    every = body.select("note_id", F.explode("tokens").alias("term"))
    if not normalise:
        wanted = asked.select("term").distinct()
        return every.join(wanted, "term", "left_semi").groupBy("note_id", F.col("term").alias("key")).agg(F.count("*").alias("freq"))
    wanted = _mapped(asked, True).select("key").distinct()
    known = _mapped(every, True).join(wanted, "key")  # no semi-join: that is pushed below the distinct words, and each token is stemmed
    known = known if scratch is None else scratch.save(known, "known")
    return every.join(known, "term").groupBy("note_id", "key").agg(F.count("*").alias("freq"))


def scored(body: DataFrame, asked: DataFrame, normalise: bool = False) -> DataFrame:
    """(qid, note_id, score) of every note that holds a term of a query, score rounded to nine places.

    Lengths and matches are saved, so that bodies are read once for each.
    """
    scratch = Scratch(body.sparkSession, "search")
    size = scratch.save(lengths(body), "lengths")
    stats = size.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean"))
    hits = scratch.save(matches(body, asked, normalise, scratch), "matches")
    held = hits.groupBy("key").agg(F.count("*").alias("held")).crossJoin(F.broadcast(stats.select("n")))
    idf = F.log((F.col("n") - F.col("held") + 0.5) / (F.col("held") + 0.5))
    weights = held.select("key", F.when(idf <= 0, FLOOR).otherwise(idf).alias("idf"))
    wanted = asked.join(_mapped(asked, normalise), "term").select("qid", "key")  # two terms of one key count twice
    rows = hits.join(weights, "key").join(wanted, "key").join(size, "note_id").crossJoin(F.broadcast(stats.select("mean")))
    part = F.col("idf") * F.col("freq") * (K1 + 1) / (F.col("freq") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    return rows.groupBy("qid", "note_id").agg(F.round(-F.sum(part), 9).alias("score"))


def search(notes: DataFrame, queries: DataFrame, stop: DataFrame, normalise: bool = False, limit: int | None = None) -> DataFrame:
    """(qid, note_id, score, rank), the first ``limit`` of each query; ties go to the least note."""
    from pyspark.sql import Window as W

    out = scored(bodies(notes), query_terms(queries, stop), normalise)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("score", "note_id")))
    return out if limit is None else out.where(F.col("rank") <= limit)


def match_set(body: DataFrame, asked: DataFrame, normalise: bool = False) -> DataFrame:
    """(qid, note_id): notes that a search of the query would list, without ranking them."""
    wanted = asked.join(_mapped(asked, normalise), "term").select("qid", "key")
    return matches(body, asked, normalise).join(wanted, "key").select("qid", "note_id").distinct()


def holding(body: DataFrame, candidates: DataFrame, asked: DataFrame, normalise: bool = False) -> DataFrame:
    """(qid, note_id): those of the ``candidates`` (qid, note_id) that a search of the query would list.

    Only candidates meet the terms of their query, so a word that many queries and notes share costs no more than they do.
    """
    asked = Scratch(body.sparkSession, "holding").save(asked.join(_mapped(asked, normalise), "term").select("qid", "key"), "asked")  # of known size, so that few words need not be met by a shuffle of all
    wanted = candidates.join(grown(asked), "qid")
    every = body.select("note_id", F.explode(F.array_distinct("tokens")).alias("term"))
    keys = asked.select("key").distinct()
    if normalise:
        held = every.join(_mapped(every, True).join(keys, "key"), "term").select("note_id", "key")
    else:
        held = every.withColumnRenamed("term", "key").join(keys, "key", "left_semi")
    return wanted.join(grown(held), ["note_id", "key"], "left_semi").select("qid", "note_id").distinct()
