"""Ranking, forks, full-text search, replies and citations."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import stem
from quillgraph.operators import answers, graph, keyword, proposals, retrieval, terms
from quillgraph.plans import model

NOTES = "note_id string, text string"
EDGE = "a string, b string, kind string, weight double"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "term string")


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), NOTES)


def seeds(spark, notes, none, *asked):
    questions = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    found = retrieval.shared(terms.postings(notes, none), retrieval.question_terms(questions, none), notes.agg(F.count("*").alias("n_notes")))
    return questions, retrieval.seeds(found)


def test_rare_beats_common(spark, none):
    texts = {"rare.md": "obsidian"} | {f"c{i}.md": "press jam border" for i in range(6)} | {f"q{i}.md": "quiet" for i in range(5)}
    _, found = seeds(spark, corpus(spark, texts), none, "obsidian press")
    rows = retrieval.ranked(found).orderBy("rank").collect()
    assert [r["note_id"] for r in rows] == ["rare.md", *(f"c{i}.md" for i in range(6))]
    assert rows[0]["worth"] == round(math.log(12), 9)


def test_breadth_against_the_best_word(spark, none):
    texts = {"broad.md": "alpha beta gamma", "b2.md": "alpha", "b3.md": "beta", "b4.md": "gamma", "sharp.md": "unique"} | {f"q{i}.md": "quiet" for i in range(5)}
    _, found = seeds(spark, corpus(spark, texts), none, "alpha beta gamma unique", "unique")
    got = {r["qid"]: (r["by_worth"], r["by_strongest"], r["agree"]) for r in retrieval.leaders(found).collect()}
    assert got == {0: ("broad.md", "sharp.md", False), 1: ("sharp.md", "sharp.md", True)}


def test_a_word_of_every_note_still_seeds(spark, none):
    _, found = seeds(spark, corpus(spark, {"a.md": "common", "b.md": "common"}), none, "common")
    assert {(r["note_id"], r["worth"]) for r in found.collect()} == {("a.md", 0.0), ("b.md", 0.0)}


def test_fork(spark, none):
    texts = {"s.md": "obsidian", "x.md": "one", "y.md": "two", "t.md": "thin", "u.md": "next", "lone.md": "alone", "p.md": "pair", "q.md": "pair"}
    edges = spark.createDataFrame([("s.md", "x.md", "link", 1.0), ("x.md", "y.md", "link", 1.0), ("t.md", "u.md", "link", 1.0), ("p.md", "q.md", "link", 1.0)], EDGE)
    questions, found = seeds(spark, corpus(spark, texts), none, "obsidian", "thin", "alone", "nothing here", "pair", "")
    rows = retrieval.fork(questions, found, graph.components(graph.adjacency(edges))).orderBy("qid").collect()
    assert [(r["outcome"], r["n_seeds"], r["n_beyond"]) for r in rows] == [("answerable", 1, 2), ("thin", 1, 1), ("unconnected", 1, 0), ("absent", 0, 0), ("unconnected", 2, 0), ("absent", 0, 0)]


def test_evidence_and_grounding(spark, none):
    texts = {f"n{i}.md": "word" if i < 2 else "other" for i in range(8)}
    notes = corpus(spark, texts)
    edges = spark.createDataFrame([(f"n{i}.md", f"n{i + 1}.md", "link", 1.0) for i in range(7)], EDGE)
    _, found = seeds(spark, notes, none, "word")
    walk = graph.reach(graph.adjacency(edges), found.select(F.col("note_id").alias("note")))
    placed = retrieval.ordered(walk.reached, found)
    top = retrieval.evidence(placed)
    assert [r["note"] for r in top.orderBy("rank").collect()] == [f"n{i}.md" for i in range(5)]
    assert {r["note"] for r in retrieval.withheld(placed).collect()} == {"n5.md", "n6.md", "n7.md"}
    assert tuple(retrieval.grounding(top, retrieval.leaders(found)).first()) == (2, 3, True)
    assert retrieval.grounding(top.limit(0), retrieval.leaders(found)).isEmpty()


SEARCHED = {
    "a.md": "The presses were jamming at the border, and the printer press jams again.", "b.md": "Città di notte; a citta walks.", "c.md": "Running runners ran to the running press",
    "d.md": "the the the", "e.md": "Quiet notes about kettles, relational kettles and conditional formalities", "f.md": "press " * 30, "g.md": "", "h.md": "Über naïve relations jam",
}


@pytest.mark.parametrize("query", ["Why did the press jam?", "citta", "running kettle relation", "naive uber", "press presses pressing", "nothing-such \"quoted\" (odd)"])
def test_search_equals_sqlite(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, body, tokenize = 'porter unicode61')")
    con.executemany("INSERT INTO t VALUES (?, ?)", SEARCHED.items())
    stop = spark.createDataFrame([("the",), ("did",), ("why",)], "term string")
    queries = spark.createDataFrame([(1, query)], "qid int, text string")
    asked = [r["term"] for r in keyword.query_terms(queries, stop).orderBy("pos").collect()]
    match = " OR ".join(f'"{t}"' for t in asked)
    want = {p: round(s, 6) for p, s in con.execute("SELECT path, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    got = keyword.search(corpus(spark, SEARCHED), queries, stop, normalise=True)
    assert {r["note_id"]: round(r["score"], 6) for r in got.collect()} == want
    found = keyword.match_set(keyword.bodies(corpus(spark, SEARCHED)), keyword.query_terms(queries, stop), True)
    assert {r["note_id"] for r in found.collect()} == set(want)
    first = keyword.search(corpus(spark, SEARCHED), queries, stop, normalise=True, limit=2).collect()
    assert len(first) == min(2, len(want))


def test_a_query_of_stop_words_finds_nothing(spark):
    stop = spark.createDataFrame([("the",)], "term string")
    assert keyword.search(corpus(spark, SEARCHED), spark.createDataFrame([(1, "the of")], "qid int, text string"), stop).isEmpty()


def test_proposals_and_verdicts(spark, none):
    notes = corpus(spark, {"q.md": "# Why did it jam?\nAnd? so what? One more? Four?", "near.md": "jam here", "far.md": "copper", "lone.md": "Anyone?"})
    edges = spark.createDataFrame([("q.md", "near.md", "link", 1.0), ("near.md", "far.md", "link", 1.0)], EDGE)
    found = proposals.proposals(notes, graph.adjacency(edges))
    rows = found.orderBy("pos").collect()
    assert [(r["note_id"], r["question"], r["answers"]) for r in rows] == [("q.md", q, ["far.md", "near.md"]) for q in ("Why did it jam?", "And?", "so what?")]
    assert proposals.proposals(notes, graph.adjacency(edges), limit=1).count() == 1
    extra = spark.createDataFrame([("x", 1, "copper jam?", ["far.md", "near.md"]), ("x", 2, "copper?", []), ("x", 3, "copper?", ["gone.md"]), ("x", 4, "copper?", ["far.md", "near.md"])], "note_id string, pos int, question string, answers array<string>")
    got = {r["pos"]: (r["verdict"], r["reason"]) for r in proposals.verdicts(extra, notes, none).collect()}
    assert got == {1: ("dropped", "search finds it"), 2: ("dropped", "no support"), 3: ("dropped", "support missing"), 4: ("kept", "search falls short")}


REPLIES = [
    '{"answer": "A b.", "note1": 1, "quote1": "A b.", "note2": 2, "quote2": "C"}', '{"answer": "NOT in note!", "note1": 1, "quote1": "A"}', '{"answer": "x", "note1": 3, "quote1": "A", "note2": "two", "quote2": "B"}',
    '{"answer": "x", "note1": true, "quote1": "A", "note2": 1.5, "quote2": "  "}', '{"answer": "x", "note1": 0, "quote1": 7, "quote2": "B"}', '{"answer": "cut', "[1]", "null", "", '{"note1": 1, "quote1": "q"}', None,
]


SAID = [
    ("A b.", [("a.md", "A b."), ("b.md", "C")]), ("NOT in note!", []), ("x", [("3", "A"), ("two", "B")]), ("x", [("true", "A")]), ("x", [("none", "B")]),
    ("", []), ("", []), ("", []), ("", []), ("", [("a.md", "q")]), ("", []),
]


def test_replies_in_bulk_and_one_by_one(spark):
    evidence = [("a.md", "A b. C"), ("b.md", "")]
    df = spark.createDataFrame([(i, r, ["a.md", "b.md"]) for i, r in enumerate(REPLIES)], "answer_id int, reply string, paths array<string>")
    for r in answers.parsed(df).collect():
        got = [(c["path"].lower(), c["quote"]) for c in r["citations"]]
        assert (r["answer"], got) == SAID[r["answer_id"]], REPLIES[r["answer_id"]]
    for k in (0, 3, 5):
        one = model.understood(REPLIES[k], evidence)
        assert (one.text, [(c.path.lower(), c.quote) for c in one.citations], one.whole) == (*SAID[k], k == 0)


def test_citations(spark):
    notes = corpus(spark, {"a.md": "One  two\nthree.", "b.md": None})
    cited = spark.createDataFrame([(1, "a.md", "two three."), (2, "a.md", "two four"), (2, "a.md", "One two"), (3, "z.md", "One"), (4, "a.md", ""), (5, "b.md", "x"), (5, "b.md", "x")], "answer_id int, path string, quote string")
    found = answers.checked(cited, notes)
    assert sorted((r["answer_id"], r["finding"] or "") for r in found.collect()) == [(1, ""), (2, ""), (2, "not in the note"), (3, "no such note"), (4, ""), (5, "not in the note"), (5, "not in the note")]
    ids = spark.createDataFrame([(i,) for i in range(1, 7)], "answer_id int")
    assert {r[0]: r[1] for r in answers.guarded(ids, found).collect()} == {1: "answer", 2: "parts", 3: "thin", 4: "answer", 5: "thin", 6: "thin"}
    assert [tuple(r) for r in answers.kept_parts(found).select("answer_id", "quote").collect()] == [(2, "One two")]


@pytest.mark.parametrize(("said", "want"), [("Two three.", False), ("two three", True), ("two\n three..", True), ("", False), (".", False), ("four", False)])
def test_copied(spark, said, want):
    got = spark.range(1).select(answers.copied(F.lit(said), F.array(F.lit("One two  three. End")))).first()[0]
    assert got == want


def test_prompt_and_shape():
    text = model.prompt("Why?", [("a.md", "one"), ("b.md", "two")])
    assert text.index("Note 1 (a.md)") < text.index("Note 2 (b.md)") < text.index("Why?")
    assert set(model.shape(1)["required"]) == {"answer", "note1", "quote1"}


def test_extractive():
    reply = model.extractive("why does the press jam", [("a", "Quiet here. The press may jam."), ("b", "")])
    assert reply.text == "The press may jam." and reply.citations == [model.Citation("a", "The press may jam.")]
    assert stem.stem("jamming") == "jam"
