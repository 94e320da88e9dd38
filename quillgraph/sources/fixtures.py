"""Adapters that read the test tables as notes, snapshots, citations and attempts.

Every rule has the same form in ``plans/oracle.py``; doc_id is spelled with six digits or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = [
    (1, "Where is the heoron, and what does atonou mean?"), (2, "the and of?"), (3, "xyzzy plugh?"),
    (4, "000007 inantion"), (5, "thanbletion thattionwh andreineaou ungöst"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores is dealt out evenly; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _name(c):
    return F.format_string("%06d", c)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, doc_id, text): the source is the folder."""
    rows = spread(table(spark, sf_dir, "documents"))
    note_id = F.concat(F.coalesce("source", F.lit("unfiled")), F.lit("/"), _name(F.col("doc_id")), F.lit(".md"))
    return rows.select(note_id.alias("note_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def linked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with two links and a dangling one each; every fifth asks a question."""
    rows = notes(spark, sf_dir)
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    link = lambda c: F.concat(F.lit(" [["), c, F.lit("]]"))
    asked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\nWhy is there nothing in "), _name(F.col("doc_id")), F.lit("?"))).otherwise("")
    text = F.concat("text", link(_name(F.expr("doc_id div 2"))), link(_name(F.expr("doc_id * 7 % n"))), link(F.concat(F.lit("missing-"), (F.col("doc_id") % 10).cast("string"))), asked)
    return rows.crossJoin(n).select("note_id", "doc_id", text.alias("text"))


def styled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_id, text): links as titles, parts, paths with and without extension, siblings, beside addresses and places; a third has none that holds."""
    rows = notes(spark, sf_dir).select("note_id", "doc_id")
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    led = rows.crossJoin(n).select("note_id", "doc_id", F.expr("doc_id * 3 % n").alias("to"))
    there = rows.select(F.col("doc_id").alias("to"), F.col("note_id").alias("path"))
    name, path = _name(F.col("to")), F.coalesce("path", F.lit("gone.md"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = {
        0: say("[[", name, "|shown as]]"), 1: say("[[ ", name, "#part|shown]]"), 2: say("[shown](", path, ")"), 3: say("[shown](", F.regexp_replace(path, r"\.md$", ""), ")"),
        4: say("[shown](", name, ".md)"), 5: say("[[", name, "]] [a](https://e.org/", name, ") [b](#here) [c](mailto:a@b)"), 8: say("[[gone-", name, "]]"),
    }
    link = F.coalesce(*[F.when(F.col("doc_id") % 9 == k, x) for k, x in forms.items()], F.lit("no link"))
    return led.join(there, "to", "left").select("note_id", say("About ", _name(F.col("doc_id")), ": ", link, ".").alias("text"))


def questions(spark: SparkSession, only: int | None = None) -> DataFrame:
    rows = [q for q in QUESTIONS if only is None or q[0] == only]
    table = F.array(*[F.struct(F.lit(qid).alias("qid"), F.lit(text).alias("text")) for qid, text in rows])
    return spark.range(1).coalesce(1).select(F.inline(table))  # of a size that Spark knows, so that what is asked goes to the notes and not the other way round


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) stat tables (note_id, mtime, size)."""
    rows = notes(spark, sf_dir).select("note_id", "doc_id", F.lit(1.0).alias("mtime"), F.length("text").cast("long").alias("size"))
    old = rows.where("doc_id % 10 != 3").drop("doc_id")
    grown = F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size")
    return old, rows.where("doc_id % 10 != 7").select("note_id", "mtime", grown)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, path, quote): true, altered, misplaced, without a note, and with other white space, in turn."""
    rows = notes(spark, sf_dir)
    k = F.col("doc_id") % 5
    cut = F.substring("text", 11, 40)
    path = F.when(k == 3, F.concat(F.lit("gone/"), _name(F.col("doc_id")))).otherwise(F.col("note_id"))
    quote = F.when(k == 1, F.concat(F.lit("zzz "), cut)).when(k == 2, F.concat(_name(F.col("doc_id")), F.lit(" "), cut)).when(k == 4, F.replace(cut, F.lit(" "), F.lit(" \t\n "))).otherwise(cut)
    return rows.select(F.expr("doc_id div 2").alias("answer_id"), path.alias("path"), quote.alias("quote"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kept = d % 4 != 0
    outcome = F.when(kept, F.element_at(F.array(F.lit(None).cast("string"), *[F.lit(x) for x in ("answer", "parts", "absent", "thin", "unconnected", "answer")]), (d % 7 + 1).cast("int")))
    checked, read = outcome.isin("answer", "parts"), outcome.isin("answer", "parts", "thin")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("question "), d.cast("string")).alias("question"), F.when(kept, "kept").otherwise("dropped").alias("verdict"), outcome.alias("outcome"),
        F.when(checked, d % 3).alias("total"), F.when(checked, F.greatest(d % 3 - d % 2, F.lit(0))).alias("correct"), F.when(checked, F.least(d % 3, d % 2)).alias("fabricated"),
        F.when(read, d % 5).alias("seeds"), F.when(read, 5 - d % 5).alias("through_edges"), F.when(read, d % 11 != 0).alias("agree"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, reply, paths): whole, declining, out of range, of the wrong type, blank and broken ones."""
    d = F.col("doc_id")
    s = d.cast("string")
    answer = F.when(d % 7 == 1, F.lit(" Not in note. ")).otherwise(F.concat(F.lit("Answer "), s))
    note1 = F.when(d % 5 == 1, F.lit('"one"')).when(d % 5 == 2, F.lit("true")).otherwise((d % 4).cast("string"))
    quote2 = F.when(d % 6 == 0, F.lit('"  "')).when(d % 6 == 1, F.lit("7")).otherwise(F.concat(F.lit('"quote b '), s, F.lit('"')))
    whole = F.concat(F.lit('{"answer":"'), answer, F.lit('","note1":'), note1, F.lit(',"quote1":"quote a '), s, F.lit('","note2":'), (d % 3).cast("string"), F.lit(',"quote2":'), quote2, F.lit("}"))
    reply = F.when(d % 11 == 0, F.lit('{"answer": "cut')).when(d % 13 == 0, F.lit("[1, 2]")).otherwise(whole)
    return table(spark, sf_dir, "documents").select(d.alias("answer_id"), reply.alias("reply"), F.array(F.lit("a.md"), F.lit("b.md")).alias("paths"))


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, href) of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1)))).alias("href"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, answer, texts): copied with other white space and full stops, altered, and empty, in turn."""
    k = F.col("doc_id") % 4
    cut = F.substring("text", 21, 30)
    answer = F.when(k == 1, F.concat(F.replace(cut, F.lit(" "), F.lit("  \n")), F.lit(".."))).when(k == 2, F.concat(cut, F.lit(" zzz"))).when(k == 3, F.lit(" . ")).otherwise(cut)
    return notes(spark, sf_dir).select(F.col("doc_id").alias("answer_id"), answer.alias("answer"), F.array(F.lit("another text"), F.col("text")).alias("texts"))
