"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs of what is not ASCII white space. A null or empty text has no words and fails. Every
row is judged by itself, so repeated rows, ties and further columns do not matter, and an empty
table gives an empty result. Texts are read whole: windows are found twice by sorting their hashes
within the row, which costs n log n, not by comparing every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "with", "der", "die", "das", "und", "den", "von", "mit", "ist", "nicht", "ein", "eine", "le", "la", "les", "de", "des", "et", "que", "un", "une", "du", "en", "el", "los", "las", "por", "con", "para", "y", "a")
#: (name, measure, operator, threshold): a document that meets one fails. ``base`` rules decide base_failed.
RULES = [
    ("too_short", "n_words", "<", 50, True),
    ("repeated_windows", "100 * n_repeat_words - 50 * n_words", ">", 0, True),
    ("too_long", "n_words", ">", 1_000_000, False),
    ("short_words", "word_chars / n_words", "<", 2.0, False),
    ("long_words", "word_chars / n_words", ">", 15.0, False),
    ("symbols", "n_symbols / n_words", ">", 0.3, False),
    ("repeated_lines", "n_dup_lines / n_lines", ">", 0.5, False),
    ("few_stop_words", "n_stop_words", "<", 2, False),
]


def _verdict(base: bool) -> Column:
    sql = " OR ".join(f"({m.replace('/ n_words', '/ nullif(n_words, 0)').replace('/ n_lines', '/ nullif(n_lines, 0)')} {op} {x})" for _, m, op, x, b in RULES if b is base)
    return F.coalesce(F.expr(sql), F.lit(False))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of RULES beside its columns (which win on no clash: measures replace them)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    split = F.filter(F.split(whole, SPACE), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Hash and place of each window, sorted: equal windows stand side by side. Words that they cover are then counted
    # in order of place, each window adding what its predecessor did not cover. Arrays that an inner function reads are
    # bound by transform(array(x), ...): where a filter is pushed below this projection, Spark repeats expressions, and
    # an array written out within an inner function would be made again for each of its elements.
    covered = F.expr(
        "transform(array(__w), w -> transform(array(CASE WHEN size(w) < 4 THEN array() ELSE array_sort(transform("
        "slice(w, 1, size(w) - 2), (x, i) -> struct(xxhash64(x, get(w, i + 1), get(w, i + 2)) AS h, i AS i))) END), "
        "s -> aggregate(array_sort(transform(filter(s, (x, j) -> x.h = get(s, j - 1).h OR x.h = get(s, j + 1).h), x -> x.i)), "
        "struct(0L AS n, -3 AS last), (t, i) -> struct(t.n + least(3, i - t.last) AS n, i AS last), t -> t.n))[0])[0]"
    )
    return (
        docs.withColumn("__w", split).withColumn("__l", lines)
        .withColumns({
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, "[#*$%&|<>]", ""))).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_stop_words": F.size(F.filter("__w", lambda w: w.isin(*STOP_WORDS))).cast("long"),
        })
        .drop("__w", "__l")
    )


def judged(docs: DataFrame) -> DataFrame:
    """``measured`` with base_failed, failed (names of all rules that are met) and kept."""
    out = measured(docs).withColumn("base_failed", _verdict(True))
    return out.withColumn("kept", ~F.col("base_failed") & ~_verdict(False))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its counts, whether the base rules fail it, and the verdict of all."""
    return judged(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
