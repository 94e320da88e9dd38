"""Text functions on columns; every pattern is written so that Java and RE2 read it alike.

No Python runs per row. Null texts give null or empty results as the built-in functions do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. A word is a run of letters and digits of any script; a term has three or more of them.
WORD = r"[\p{L}\p{N}]+"
MIN_TERM = 3
#: Unicode white space, and the ends of lines.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Fixed values: [[target]], [[target|alias]], [[target#heading]] and [label](target).
WIKI_LINK = r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]"
INLINE_LINK = r"\[[^\]]*\]\(([^)]+)\)"
#: Marks of headings and lists before a line's words, up to the last white space among them or the line's end. Linear in its length.
FRAMING = r"^[-*+#](?:[-*+# \t]*\z|[-*+# \t]*[ \t])"
EXTENSION = r"\.[^./]*\z"


def stripped(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, rf"^{SPACE}", ""), rf"{SPACE}\z", "")


def flattened(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def tokens(c: Column) -> Column:
    """All words in order, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def terms(c: Column) -> Column:
    """Distinct words of MIN_TERM characters or more."""
    return F.array_distinct(F.filter(tokens(c), lambda w: F.length(w) >= MIN_TERM))


def note_name(note_id: Column) -> Column:
    """Last segment of the path, without its last extension, lower-cased."""
    return F.lower(F.regexp_replace(F.substring_index(note_id, "/", -1), EXTENSION, ""))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, EXTENSION, "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """What stands before the last slash; null for a note at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", ""))


def link_targets(c: Column) -> Column:
    """Distinct names that a text links to; addresses elsewhere and places in the same note are none."""
    wiki = F.regexp_extract_all(c, F.lit(WIKI_LINK), F.lit(1))
    inline = F.filter(
        F.regexp_extract_all(c, F.lit(INLINE_LINK), F.lit(1)),
        lambda t: ~(F.contains(t, F.lit("://")) | F.startswith(t, F.lit("#")) | F.startswith(t, F.lit("mailto:"))),
    )
    return F.array_distinct(F.filter(F.transform(F.concat(wiki, inline), stripped), lambda t: t != ""))


def _unframed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, FRAMING, ""))


def questions(c: Column) -> Column:
    """Spans that end in a question mark and hold a word, in order: lines cut after ., ! and ?, without framing.

    Lines and spans without a question mark leave before they are cut or stripped.
    """
    asks = lambda s: F.contains(s, F.lit("?"))
    spans = F.flatten(F.transform(F.filter(F.split(c, LINE_END), asks), lambda line: F.split(_unframed(line), rf"(?<=[.!?]){SPACE}")))
    return F.filter(F.transform(F.filter(spans, asks), _unframed), lambda s: F.endswith(s, F.lit("?")) & s.rlike(r"[\p{L}\p{N}_]"))
