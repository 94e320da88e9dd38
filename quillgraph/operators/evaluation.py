"""Measurements of a graph, a corpus and an evaluation run: ordinary aggregates, one row or few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graph

COMPARISON = 10


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def by_kind(edges: DataFrame) -> DataFrame:
    """(kind, n_edges)."""
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges"))


def metrics(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(notes, edges, pairs, density, connected, unconnected): density is 2 pairs / notes, 0 without notes."""
    counts = edges.agg(F.count("*").alias("edges"))
    pairs = _pairs(edges).agg(F.count("*").alias("pairs"))
    return measured(notes, counts, pairs, graph.unconnected(notes, edges))


def measured(notes: DataFrame, counts: DataFrame, pairs: DataFrame, lone: DataFrame) -> DataFrame:
    """``metrics`` from one row each with (edges) and (pairs), and the notes (note_id) without an edge."""
    n = notes.agg(F.count("*").alias("notes"))
    alone = lone.agg(F.count("*").alias("unconnected"))
    out = n.crossJoin(counts).crossJoin(pairs).crossJoin(alone)  # one row each
    density = F.coalesce(F.try_divide(F.col("pairs") * 2, F.col("notes")), F.lit(0.0))
    return out.select("notes", "edges", "pairs", F.round(density, 9).alias("density"), (F.col("notes") - F.col("unconnected")).alias("connected"), "unconnected")


def subjects(notes: DataFrame, branch: str) -> DataFrame:
    """(note_id, subject): first folder, or the name of a note at the top; the branch where no note is in a folder."""
    any_filed = notes.agg(F.coalesce(F.max(F.contains("note_id", F.lit("/"))), F.lit(False)).alias("filed"))
    own = F.when(F.contains("note_id", F.lit("/")), F.substring_index("note_id", "/", 1)).otherwise(F.regexp_replace("note_id", r"\.[^.]*\z", ""))
    return notes.select("note_id").crossJoin(F.broadcast(any_filed)).select("note_id", F.when(F.col("filed"), own).otherwise(branch).alias("subject"))


def between(home: DataFrame, edges: DataFrame) -> DataFrame:
    """(sa, sb, n): pairs by the subjects of their ends."""
    of = lambda c: home.select(F.col("note_id").alias(c), F.col("subject").alias(f"s{c}"))
    return _pairs(edges).join(of("a"), "a").join(of("b"), "b").groupBy("sa", "sb").agg(F.count("*").alias("n"))


def subject_counts(home: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, notes, inside): notes of each subject and pairs within it."""
    return counts_of(home, between(home, edges))


def counts_of(home: DataFrame, found: DataFrame) -> DataFrame:
    """``subject_counts`` from (sa, sb, n)."""
    inside = found.where("sa = sb").groupBy(F.col("sa").alias("subject")).agg(F.sum("n").alias("inside"))
    counts = home.groupBy("subject").agg(F.count("*").alias("notes"))
    return counts.join(inside, "subject", "left").select("subject", "notes", F.coalesce("inside", F.lit(0)).alias("inside"))


def subject_touches(home: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, other, pairs) between two subjects, both ways. Pairs are summed by subjects before they are turned."""
    return touches_of(between(home, edges))


def touches_of(found: DataFrame) -> DataFrame:
    """``subject_touches`` from (sa, sb, n)."""
    across = found.where("sa != sb")
    both = F.explode(F.array(F.struct(F.col("sa").alias("subject"), F.col("sb").alias("other")), F.struct(F.col("sb").alias("subject"), F.col("sa").alias("other"))))
    return across.select(both.alias("e"), "n").groupBy("e.subject", "e.other").agg(F.sum("n").alias("pairs"))


def related(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(note_id, degree) of notes with a pair, to be ordered by degree and then name."""
    return related_by(notes, degrees_of(edges))


def degrees_of(edges: DataFrame) -> DataFrame:
    """(note_id, n): the pairs of each note."""
    return _pairs(edges).select(F.explode(F.array("a", "b")).alias("note_id")).groupBy("note_id").agg(F.count("*").alias("n"))


def related_by(notes: DataFrame, degrees: DataFrame) -> DataFrame:
    """``related`` from (note_id, n), of a note one row or more."""
    ends = degrees.groupBy("note_id").agg(F.sum("n").alias("degree"))
    return ends.join(notes.select("note_id"), "note_id", "left_semi")


def profile(notes: DataFrame, edges: DataFrame, branch: str) -> DataFrame:
    """(subject, notes, inside, touches): touches is a map of other subject to pairs."""
    home = subjects(notes, branch)
    touches = subject_touches(home, edges).groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("other", "pairs")))).alias("touches"))
    out = subject_counts(home, edges).join(touches, "subject", "left")
    return out.withColumn("touches", F.coalesce("touches", F.create_map().cast("map<string,bigint>")))


def listing(touches: DataFrame, most: int = 4) -> DataFrame:
    """(subject, listed, more): the ``most`` subjects that each touches most, and how many are left out."""
    order = W.partitionBy("subject").orderBy(F.desc("pairs"), "other")
    placed = touches.withColumn("k", F.row_number().over(order))
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "other")))), lambda x: x["other"])
    return placed.groupBy("subject").agg(F.array_join(shown, ", ").alias("listed"), F.count_if(F.col("k") > most).alias("more"))


def report(attempts: DataFrame) -> DataFrame:
    """One row of counts over attempts (question, verdict, outcome, total, correct, fabricated, seeds, through_edges, agree).

    Nulls mean: not asked (outcome), no citation check (total), nothing read (seeds). A dropped question with an outcome is an error.
    """
    bad = (F.col("verdict") == "dropped") & F.col("outcome").isNotNull()
    sound = attempts.withColumn("verdict", F.when(bad, F.raise_error(F.lit("a dropped question has an outcome"))).otherwise(F.col("verdict")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return sound.agg(
        F.count("*").alias("proposed"), F.count_if(F.col("verdict") == "kept").alias("kept"), F.count_if(F.col("verdict") == "dropped").alias("dropped"),
        F.count_if(F.col("outcome") == "answer").alias("answers"), F.count_if(F.col("outcome") == "parts").alias("parts"),
        F.count_if(F.col("outcome").isin("absent", "unconnected", "thin")).alias("refusals"),
        total("total").alias("citations"), total("correct").alias("correct"), F.count_if(F.col("total") == 0).alias("uncorroborated"), total("fabricated").alias("fabricated"),
        total("seeds").alias("read_from_questions"), total("through_edges").alias("read_through_edges"),
        F.count("seeds").alias("grounded"), F.count_if("agree").alias("breadth_agreed"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """What follows from the counts; every ratio is 0 over nothing."""
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)
    out = counts.withColumn("measured", F.col("answers") + F.col("parts") + F.col("refusals"))
    return out.select(
        "measured", (F.col("kept") - F.col("measured")).alias("unasked"), ratio(F.col("answers"), F.col("measured")).alias("answer_rate"),
        ratio(F.col("correct"), F.col("citations")).alias("citation_rate"),
        ratio(F.col("read_through_edges"), F.col("read_from_questions") + F.col("read_through_edges")).alias("edge_share"),
        (F.col("kept") >= COMPARISON).alias("is_a_comparison"),
    )


def percent(share: Column) -> Column:
    """Whole percents, halves to even."""
    return F.bround(share * 100, 0).cast("long")
