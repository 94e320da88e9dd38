"""Text functions against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import stem, stopwords
from quillgraph.functions import text as X
from quillgraph.operators import proposals, terms

NOTES = "note_id string, text string"
TEXTS = [
    "", "a bc def", "città CITTA Ünder_score x9z 12345", "ein Wort und　noch\x1ceins ", "# Is it so?", "- Is it? No. - Was it?  Yes!", "-- -5 degrees?", "-5 degrees?", "??",
    "* * see [[queue]] and the printer. Does it jam?\n\nEnd", "---\n----------------------------------------x?", "a? b?\rc? d?", "#\t#", "#x?", "+ *", "İ ſ ßtraße", None,
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame([(f"n{i:02d}.md", t) for i, t in enumerate(TEXTS)], NOTES)


def test_terms_and_flattening(notes):
    rows = notes.select("text", X.terms(F.col("text")).alias("t"), X.flattened(F.col("text")).alias("f")).collect()
    for r in rows:
        if r["text"] is None:
            assert r["t"] is None and r["f"] is None
        else:
            assert set(r["t"]) == {w for w in re.findall(r"[^\W_]+", r["text"].lower()) if len(w) >= 3}
            assert r["f"] == " ".join(r["text"].split())


def test_lifted_questions(notes):
    def bare(s):
        """Without marks of headings and lists: up to the last blank among them, or all of a line that has nothing else."""
        marks = 0
        while marks < len(s) and s[marks] in "-*+# \t":
            marks += 1
        if marks < len(s):
            while marks and s[marks - 1] not in " \t":
                marks -= 1
        return (s[marks:] if s[:1] in tuple("-*+#") else s).strip()

    want = []
    for i, t in enumerate(TEXTS):
        k = 0
        for line in (t or "").splitlines():
            for span in re.split(r"(?<=[.!?])\s+", bare(line)):
                span = bare(span)
                if span.endswith("?") and re.search(r"\w", span):
                    k += 1
                    want.append((f"n{i:02d}.md", k, span))
    got = [tuple(r) for r in proposals.lifted(notes).orderBy("note_id", "pos").collect()]
    assert got == want
    first = [tuple(r) for r in proposals.lifted(notes, 1).orderBy("note_id").collect()]
    assert first == [x for x in want if x[1] == 1]
    assert sorted(map(tuple, proposals.first_by_note(proposals.lifted(notes), 1).collect())) == first


@pytest.mark.parametrize(("path", "name", "bare", "folder"), [
    ("a/b/Note.One.md", "note.one", "a/b/Note.One", "a/b"), ("plain", "plain", "plain", None), ("x.y/z", "z", "x.y/z", "x.y"), ("Top.md", "top", "Top", None),
])
def test_names(spark, path, name, bare, folder):
    p = F.lit(path)
    assert tuple(spark.range(1).select(X.note_name(p), X.without_extension(p), X.folder(p)).first()) == (name, bare, folder)


def test_link_targets(spark):
    text = "[[one]] [[two|alias]] [[three#head]] [x](four.md) ![i](img.png) [u](http://a/b) [h](#here) [m](mailto:a@b) [[ ]] [[one]] [t](five.md \"title\")"
    got = spark.range(1).select(X.link_targets(F.lit(text))).first()[0]
    assert sorted(got) == ["five.md \"title\"", "four.md", "img.png", "one", "three", "two"]


@pytest.mark.parametrize(("word", "want"), [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
    ("conflated", "conflat"), ("troubling", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("electrical", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("città", "città"),
])
def test_stem(word, want):
    assert stem.stem(word) == want


def test_fold():
    assert stem.fold("Città ÜBER") == "citta uber"


def test_default_lists():
    lists = stopwords.default_lists()
    assert {"english", "german", "french", "spanish", "italian"} <= set(lists) and "the" in lists["english"]


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), NOTES)


LISTS = {"english": ("the", "and", "with", "was", "a"), "italian": ("della", "che", "non", "la"), "german": ("die", "der", "und")}


@pytest.mark.parametrize(("texts", "langs"), [
    ({"a": "the cat and the dog with the kettle was", "b": "the press"}, {"english"}),
    ({"a": "the cat and the dog", "b": "la casa della nonna che non"}, {"english", "italian"}),
    ({"a": "kettle copper spout"}, set()), ({"a": ""}, set()), ({}, set()),
])
def test_languages(spark, texts, langs):
    words = terms.vocabulary(corpus(spark, texts))
    assert {r[0] for r in terms.detected(words, LISTS).collect()} == langs
    stop = {r[0] for r in terms.stop_terms(words, LISTS).collect()}
    assert stop == {w for lang in langs for w in LISTS[lang] if len(w) >= 3}


def test_weights_count_the_name(spark):
    notes = corpus(spark, {"x/the.md": "kettle the copper", "y/cat.md": "copper dog"})
    stop = spark.createDataFrame([("the",)], "term string")
    got = {r["term"]: (r["df"], round(r["idf"], 9)) for r in terms.term_weights(terms.postings(notes, stop), notes).collect()}
    one = (1, round(math.log(2), 9))
    assert got == {"kettle": one, "copper": (2, 0.0), "the": one, "dog": one, "cat": one}


def test_fingerprint_moves_with_the_words(spark):
    a, b = (spark.createDataFrame([(w,) for w in words], "term string") for words in (["one", "two"], ["two", "one", "six"]))
    assert terms.fingerprint(a).first() != terms.fingerprint(b).first()
    assert terms.fingerprint(a).first() == terms.fingerprint(a.orderBy("term")).first()
