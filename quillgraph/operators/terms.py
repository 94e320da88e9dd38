"""Terms of notes, the languages they are written in, and how much a term tells notes apart.

Notes are tables (note_id, text). No operator here shuffles texts: words are made in the projection
of the scan, and only words or counts go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stopwords as lists_of
from ..functions import text as X

#: A language counts where its list covers at least best / RATIO of the vocabulary.
RATIO = 2


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


def note_terms(notes: DataFrame) -> DataFrame:
    """(note_id, term): the distinct words of three characters or more of each note."""
    return notes.select("note_id", F.explode(X.terms(_text())).alias("term"))


def vocabulary(notes: DataFrame) -> DataFrame:
    """(term): every such word of the corpus once."""
    return note_terms(notes).select("term").distinct()


def _covered(words: DataFrame, lists: lists_of.Lists | None) -> DataFrame:
    """(lang, n): words of the vocabulary in each list, and under no language all of them. The vocabulary is read once.

    The lists are a constant of known size, so they are broadcast, a row per word.
    """
    known = lists_of.table(words.sparkSession, lists).groupBy("term").agg(F.collect_list("lang").alias("langs"))
    marked = words.join(F.broadcast(known), "term", "left")
    every = F.concat(F.coalesce("langs", F.array().cast("array<string>")), F.array(F.lit("")))
    return marked.select(F.explode(every).alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


def _all():
    """A table of a row per language, seen as one group."""
    return W.partitionBy(F.lit(1))


def language_scores(words: DataFrame, lists: lists_of.Lists | None = None) -> DataFrame:
    """(lang, n_found, n_words, score) of languages of which a word occurs; ``words`` is a vocabulary."""
    found = _covered(words, lists).withColumn("n_words", F.max(F.when(F.col("lang") == "", F.col("n"))).over(_all())).where("lang != ''")
    return found.select("lang", F.col("n").alias("n_found"), "n_words", (F.col("n") / F.col("n_words")).alias("score"))


def detected(words: DataFrame, lists: lists_of.Lists | None = None, ratio: int = RATIO) -> DataFrame:
    """(lang): languages that score at least 1 / ratio of the best. A row per language at most."""
    found = _covered(words, lists).where("lang != ''").withColumn("best", F.max("n").over(_all()))
    return found.where(F.col("n") * ratio >= F.col("best")).select("lang")


def stop_terms(words: DataFrame, lists: lists_of.Lists | None = None, ratio: int = RATIO) -> DataFrame:
    """(term): words of the detected languages' lists, three characters or more. No larger than the lists."""
    known = lists_of.table(words.sparkSession, lists)
    return known.join(F.broadcast(detected(words, lists, ratio)), "lang").where(F.length("term") >= X.MIN_TERM).select("term").distinct()


def listed(notes: DataFrame, lists: lists_of.Lists | None = None) -> DataFrame:
    """(term): the part of the vocabulary that stands in a list, which is all that stop words depend on; no other word is shuffled."""
    known = lists_of.table(notes.sparkSession, lists).where(F.length("term") >= X.MIN_TERM).select("term").distinct()
    words = notes.select(F.explode(X.tokens(_text())).alias("term"))
    return words.join(F.broadcast(known), "term", "left_semi").distinct()


def fingerprint(stop: DataFrame) -> DataFrame:
    """(fingerprint): SHA-256 of the sorted stop words, joined by line ends."""
    joined = F.array_join(F.sort_array(F.collect_set("term")), "\n")  # no larger than the lists
    return stop.agg(F.sha2(joined, 256).alias("fingerprint"))


def content_terms(notes: DataFrame, stop: DataFrame) -> DataFrame:
    """(note_id, term) without stop words."""
    return note_terms(notes).join(F.broadcast(stop), "term", "left_anti").select("note_id", "term")


def postings(notes: DataFrame, stop: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(note_id, term): a note's terms and its own name, which counts even if short or a stop word; of the terms ``only`` where given."""
    return postings_of(notes.select("note_id", X.terms(_text()).alias("terms")), stop, only)


def postings_of(held: DataFrame, stop: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The same of notes whose terms are stored (note_id, terms); reads no text."""
    name = X.note_name(F.col("note_id"))
    rows = held.select("note_id", name.alias("name"), F.explode(F.array_union("terms", F.array(name))).alias("term"))
    rows = rows if only is None else rows.join(only.select("term").distinct(), "term", "left_semi")
    words = stop.select(F.col("term").alias("__stop"))
    return rows.join(F.broadcast(words), (F.col("term") == F.col("__stop")) & (F.col("term") != F.col("name")), "left_anti").select("note_id", "term")


def term_weights(posted: DataFrame, notes: DataFrame) -> DataFrame:
    """(term, df, idf): idf is ln(notes / notes that hold the term), 0 for a term in every note."""
    n = notes.agg(F.count("*").alias("n_notes"))
    counts = posted.groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(n)).select("term", "df", F.log(F.col("n_notes") / F.col("df")).alias("idf"))
