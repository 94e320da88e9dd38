"""Links, co-occurrence and refreshed edges against plain Python."""

import random
from itertools import combinations

import pytest

from quillgraph.operators import cooccurrence, evaluation, links, refresh
from quillgraph.scratch import Scratch

NOTES = "note_id string, text string"


def test_link_cascade(spark):
    notes = spark.createDataFrame([
        ("a/one.md", "[[two]] [x](three.md) [[b/four.md]] [[five]] [[gone]] [[a/one.md]] [y](../b/four.md) [[b/two]]"),
        ("a/three.md", ""), ("a/two.txt", "[[one]]"), ("b/four.md", None), ("b/two.md", "[[two]]"), ("c/five.md", ""), ("b/five.md", ""), ("top.md", "[[three.md]] [[three]] [[top]]"),
    ], NOTES)
    found = links.resolved(links.targets(notes), notes)
    got = {(r["source"], r["target"]): r["note"] for r in found.collect()}
    assert got == {
        ("a/one.md", "two"): "a/two.txt", ("a/one.md", "three.md"): "a/three.md", ("a/one.md", "b/four.md"): "b/four.md", ("a/one.md", "five"): "b/five.md", ("a/one.md", "gone"): None,
        ("a/one.md", "a/one.md"): "a/one.md", ("a/one.md", "../b/four.md"): None, ("a/one.md", "b/two"): "b/two.md",
        ("a/two.txt", "one"): "a/one.md", ("b/two.md", "two"): "b/two.md", ("top.md", "three.md"): None, ("top.md", "three"): "a/three.md", ("top.md", "top"): "top.md",
    }
    pairs = sorted((r["a"], r["b"]) for r in links.edges(found).collect())
    assert pairs == [("a/one.md", "a/three.md"), ("a/one.md", "a/two.txt"), ("a/one.md", "b/five.md"), ("a/one.md", "b/four.md"), ("a/one.md", "b/two.md"), ("a/three.md", "top.md")]
    assert {tuple(r) for r in links.dangling(found).collect()} == {("a/one.md", "gone"), ("a/one.md", "../b/four.md"), ("top.md", "three.md")}


def rows(sets):
    return [(n, t) for n, ts in sets.items() for t in ts]


def pairs(sets, least=2):
    return {(a, b, len(sets[a] & sets[b])) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least}


def random_sets(seed, n=60):
    rng = random.Random(seed)
    return {f"n{i:03d}": {"everywhere", *(f"t{int(rng.expovariate(0.15))}" for _ in range(rng.randint(0, 12)))} for i in range(n)}


@pytest.mark.parametrize(("seed", "block", "spread"), [(1, 512, 16), (2, 7, 16), (3, 4, 2), (4, 1, 3)])
def test_shared_terms(spark, monkeypatch, seed, block, spread):
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    monkeypatch.setattr(cooccurrence, "SPREAD", spread)
    sets = random_sets(seed)
    df = spark.createDataFrame(rows(sets), "note_id string, term string")
    got = [tuple(r) for r in cooccurrence.shared_terms(df, Scratch(spark, "t")).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs(sets)
    dirty = {n for i, n in enumerate(sets) if i % 7 == 2}
    some = cooccurrence.shared_terms(df, Scratch(spark, "t"), dirty=spark.createDataFrame([(n,) for n in dirty], "note_id string"))
    got = [tuple(r) for r in some.collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in pairs(sets) if p[0] in dirty or p[1] in dirty}


def test_no_terms(spark):
    empty = spark.createDataFrame([], "note_id string, term string")
    assert cooccurrence.shared_terms(empty, Scratch(spark, "t")).isEmpty()


def test_diff_and_kept_edges(spark):
    stat = "note_id string, mtime double, size long"
    old = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1), ("c", 1.0, 1)], stat)
    new = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("d", 1.0, 1)], stat)
    moved = refresh.diff(old, new)
    assert {tuple(r) for r in moved.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert refresh.is_current(old, old) and not refresh.is_current(old, new)
    edges = spark.createDataFrame([("a", "b", "x", 1.0), ("a", "e", "x", 1.0), ("c", "d", "x", 1.0)], "a string, b string, kind string, weight double")
    assert [r["b"] for r in refresh.kept_edges(edges, moved).collect()] == ["e"]


EDGE = "a string, b string, kind string, weight double"


def test_metrics_and_profile(spark):
    notes = spark.createDataFrame([(n,) for n in ("x/1.md", "x/2.md", "y/3.md", "lone.md")], "note_id string")
    edges = spark.createDataFrame([("x/1.md", "x/2.md", "link", 1.0), ("x/1.md", "x/2.md", "cooccurrence", 3.0), ("x/2.md", "y/3.md", "link", 1.0)], EDGE)
    assert evaluation.metrics(notes, edges).first().asDict() == {"notes": 4, "edges": 3, "pairs": 2, "density": 1.0, "connected": 3, "unconnected": 1}
    assert evaluation.metrics(notes.limit(0), edges.limit(0)).first()["density"] == 0.0
    got = {r["subject"]: (r["notes"], r["inside"], r["touches"]) for r in evaluation.profile(notes, edges, "b").collect()}
    assert got == {"x": (2, 1, {"y": 1}), "y": (1, 0, {"x": 1}), "lone": (1, 0, {})}
    flat = spark.createDataFrame([("a.md",), ("b.md",)], "note_id string")
    assert {r["subject"] for r in evaluation.subjects(flat, "branch").collect()} == {"branch"}
    assert {tuple(r) for r in evaluation.related(notes, edges).collect()} == {("x/1.md", 1), ("x/2.md", 2), ("y/3.md", 1)}


def test_report_needs_sound_attempts(spark):
    schema = "question string, verdict string, outcome string, total long, correct long, fabricated long, seeds long, through_edges long, agree boolean"
    empty = evaluation.report(spark.createDataFrame([], schema))
    assert set(empty.first()) == {0} and evaluation.rates(empty).first()["answer_rate"] == 0.0
    bad = spark.createDataFrame([("q", "dropped", "answer", 1, 1, 0, 1, 1, True)], schema)
    with pytest.raises(Exception, match="dropped question"):
        evaluation.report(bad).collect()
