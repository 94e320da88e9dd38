"""Replies of a model as columns: reading them, checking their citations, and what to show.

Replies are JSON texts {answer, note1, quote1, ...}. Evidence of an answer is an array of
(path, text). A citation holds if its flattened quote stands in the flattened note it names; an
empty quote stands in every note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SLOTS = 2
#: Fixed value: the words by which a model declines.
DECLINED = "not in note"
OBJECT = r"^\s*\{"


def _field(reply: Column, name: str) -> Column:
    return F.get_json_object(reply, f"$.{name}")


def parsed(replies: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``replies`` (.., reply, paths) with answer and citations (array of path, quote).

    What is no JSON object is an empty answer without citations, and so is one that declines, but for
    its words. A note number from 1 to the number of paths becomes the path; anything else stays as its text.
    """
    valid = F.try_parse_json("reply").isNotNull() & F.col("reply").rlike(OBJECT)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(F.try_parse_json("reply"), f"$.{name}", "variant"))
    answer = F.when(valid, F.coalesce(_field(F.col("reply"), "answer"), F.lit(""))).otherwise("")
    declined = F.regexp_replace(F.lower(X.stripped(answer)), r"[.!]+\z", "") == DECLINED
    cited = []
    for n in range(1, slots + 1):
        number, quote = _field(F.col("reply"), f"note{n}"), _field(F.col("reply"), f"quote{n}")
        at = F.try_to_number(number, F.lit("999999999")).cast("int")
        named = (kind(f"note{n}") == "BIGINT") & at.between(1, F.size("paths"))
        path = F.when(named, F.get("paths", at - 1)).otherwise(F.coalesce(number, F.lit("None")))
        spoken = (kind(f"quote{n}") == "STRING") & (X.stripped(quote) != "")
        cited.append(F.when(F.coalesce(spoken, F.lit(False)), F.struct(path.alias("path"), quote.alias("quote"))))
    none = F.array().cast("array<struct<path:string,quote:string>>")
    return replies.withColumn("answer", answer).withColumn("citations", F.when(valid & ~declined, F.array_compact(F.array(*cited))).otherwise(none))


def copied(answer: Column, texts: Column) -> Column:
    """Whether the flattened answer, without full stops at its end, is not empty and stands in one of the texts."""
    said = F.regexp_replace(X.flattened(answer), r"\.+\z", "")
    return (said != "") & F.exists(texts, lambda t: F.contains(X.flattened(t), said))


def checked(citations: DataFrame, notes: DataFrame) -> DataFrame:
    """``citations`` (.., path, quote) with finding: null where it holds, else what is wrong.

    Only cited notes are joined; quotes are flattened once per citation and texts once per cited note and citation.
    """
    cited = citations.select("path").distinct()
    texts = notes.join(cited, notes["note_id"] == cited["path"], "left_semi").select(F.col("note_id").alias("__id"), X.flattened(F.coalesce("text", F.lit(""))).alias("__text"))
    joined = citations.join(texts, F.col("path") == F.col("__id"), "left")
    finding = F.when(F.col("__id").isNull(), "no such note").when(~F.contains("__text", X.flattened(F.col("quote"))), "not in the note")
    return joined.withColumn("finding", finding).drop("__id", "__text")


def summary(found: DataFrame) -> DataFrame:
    """(answer_id, total, correct, fabricated, allowed): an answer may be shown if it cites and nothing is made up."""
    out = found.groupBy("answer_id").agg(F.count("*").alias("total"), F.count_if(F.col("finding").isNull()).alias("correct"), F.count_if(F.col("finding").isNotNull()).alias("fabricated"))
    return out.withColumn("allowed", (F.col("total") > 0) & (F.col("fabricated") == 0))


def guarded(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(answer_id, outcome) of ``answers`` (answer_id): answer, parts (some citations hold) or thin (none does)."""
    out = answers.select("answer_id").join(summary(found), "answer_id", "left")
    outcome = F.when(F.coalesce("allowed", F.lit(False)), "answer").when(F.coalesce("correct", F.lit(0)) > 0, "parts").otherwise("thin")
    return out.select("answer_id", outcome.alias("outcome"))


def kept_parts(found: DataFrame) -> DataFrame:
    """Citations of answers that are not shown whole, without those whose (path, quote) is made up."""
    bad = found.where("finding IS NOT NULL").select("answer_id", "path", "quote").distinct()
    broken = bad.select("answer_id").distinct()
    return found.drop("finding").join(broken, "answer_id", "left_semi").join(bad, ["answer_id", "path", "quote"], "left_anti")
