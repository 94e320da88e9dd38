"""Ranked retrieval: notes that share words with questions, by the weight of what they share.

Questions are tables (qid, text), one row or many; all operators are set-at-a-time. Worths are
rounded to nine places before they rank, so that the order of a sum does not matter; ties go to the
least note. Terms of a question have three characters or more, so a shorter or longer-than-a-word
name is never matched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import Scratch, grown

PLACES, EVIDENCE, MIN_BEYOND = 9, 5, 2


def question_terms(questions: DataFrame, stop: DataFrame) -> DataFrame:
    """(qid, term) without stop words."""
    asked = questions.select("qid", F.explode(X.terms(F.coalesce("text", F.lit("")))).alias("term"))
    return asked.join(F.broadcast(stop), "term", "left_anti").select("qid", "term")


def shared(posted: DataFrame, asked: DataFrame, n_notes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(qid, note_id, term, idf): terms that a note shares with a question. Only the questions' terms are counted.

    With ``scratch`` the postings of these terms are saved, and ``posted`` is read once.
    """
    wanted = asked.select("term").distinct()
    hits = posted.join(wanted, "term", "left_semi")
    hits = hits if scratch is None else scratch.save(hits, "hits")
    weights = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_notes))
    weighted = weights.select("term", F.log(F.col("n_notes") / F.col("df")).alias("idf"))
    return hits.join(weighted, "term").join(asked, "term").select("qid", "note_id", "term", "idf")


def seeds(hits: DataFrame) -> DataFrame:
    """(qid, note_id, n_shared, worth, strongest) of every note that shares a term, worth 0 included."""
    return hits.groupBy("qid", "note_id").agg(
        F.count("*").alias("n_shared"), F.round(F.sum("idf"), PLACES).alias("worth"), F.round(F.max("idf"), PLACES).alias("strongest")
    )


def ranked(found: DataFrame, by: str = "worth") -> DataFrame:
    """``found`` with the rank of each seed of a question."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(by), "note_id")))


def leaders(found: DataFrame) -> DataFrame:
    """(qid, n_seeds, by_worth, by_strongest, agree): the first seed by either ranking, by aggregates without a sort."""
    least = lambda by: F.min(F.struct((-F.col(by)).alias("w"), "note_id"))["note_id"]
    out = found.groupBy("qid").agg(F.count("*").alias("n_seeds"), least("worth").alias("by_worth"), least("strongest").alias("by_strongest"))
    return out.withColumn("agree", F.col("by_worth") == F.col("by_strongest"))


def ordered(reached: DataFrame, found: DataFrame) -> DataFrame:
    """(note, depth, worth, is_seed) of one question's walk; what shares nothing is worth 0."""
    of = found.select(F.col("note_id").alias("note"), "worth", F.lit(True).alias("is_seed"))
    out = reached.select("note", "depth").join(grown(of), "note", "left")
    return out.select("note", "depth", F.coalesce("worth", F.lit(0.0)).alias("worth"), F.coalesce("is_seed", F.lit(False)).alias("is_seed"))


def _order():
    return [F.desc("worth"), F.asc("depth"), F.asc("note")]


def evidence(walk: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """The first ``most`` notes by worth, depth and name, with their rank. A top-k, so no full sort."""
    top = walk.orderBy(*_order()).limit(most)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*_order())))


def withheld(walk: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """(note, depth, worth, is_seed) beyond the evidence."""
    return walk.join(F.broadcast(evidence(walk, most).select("note")), "note", "left_anti")


def grounding(top: DataFrame, led: DataFrame) -> DataFrame:
    """(seeds, through_edges, seeds_agree) of the evidence; no row where there is none."""
    counts = top.agg(F.count_if("is_seed").alias("seeds"), F.count_if(~F.col("is_seed")).alias("through_edges"), F.count("*").alias("n")).where("n > 0")
    return counts.crossJoin(led.select(F.col("agree").alias("seeds_agree"))).select("seeds", "through_edges", "seeds_agree")


def fork(questions: DataFrame, found: DataFrame, parts: DataFrame, min_beyond: int = MIN_BEYOND) -> DataFrame:
    """(qid, n_seeds, n_reached, n_beyond, outcome) of unbounded walks, for all questions at once.

    A walk reaches the components of its seeds, so their sizes tell how much; no question is walked by
    itself. ``parts`` is (note, component); a note without an edge is a component of its own.
    """
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    of_seed = found.select("qid", F.col("note_id").alias("note")).join(grown(parts), "note", "left")
    touched = of_seed.groupBy("qid", F.coalesce("component", "note").alias("component")).agg(F.count("*").alias("here"))
    reached = touched.join(grown(sizes), "component", "left").groupBy("qid").agg(F.sum("here").alias("n_seeds"), F.sum(F.coalesce("size", F.lit(1))).alias("n_reached"))
    out = questions.select("qid").join(reached, "qid", "left").select("qid", F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"), F.coalesce("n_reached", F.lit(0)).alias("n_reached"))
    beyond = F.col("n_reached") - F.col("n_seeds")
    outcome = F.when(F.col("n_seeds") == 0, "absent").when(beyond == 0, "unconnected").when(beyond < min_beyond, "thin").otherwise("answerable")
    return out.withColumn("n_beyond", beyond).withColumn("outcome", outcome)
