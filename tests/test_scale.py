"""What must not grow with pairs of notes, or go through the driver; and the tiles of co-occurrence against plain Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import stem
from quillgraph.operators import cooccurrence, keyword
from quillgraph.plans import catalogue
from quillgraph.scratch import Scratch

from .test_relations import pairs, random_sets, rows

SF = "/root/testdata/sf0.001"
PAIRWISE = "cooccurrence_edges edges_by_kind graph_metrics kind_shares reach_all refreshed_edges stage_filter_link related_notes subject_counts_all subject_listing_all subject_touches_all unconnected_notes_all".split()


@pytest.fixture
def saved(monkeypatch):
    """(name, columns, rows, plan) of what is saved."""
    out, save = [], Scratch.save

    def noted(self, df, name):
        plan = df._jdf.queryExecution().toString()
        got = save(self, df, name)
        out.append((name, df.columns, got.count(), plan))
        return got

    monkeypatch.setattr(Scratch, "save", noted)
    return out


@pytest.mark.parametrize("name", PAIRWISE)
def test_pairs_are_not_saved(spark, saved, name):
    catalogue.QUERIES[name](spark, SF)
    assert all(n <= 3 * 200 for _, columns, n, _ in saved if {"a", "b"} <= set(columns))  # links only


def test_pairs_are_not_shuffled(spark):
    plan = catalogue.QUERIES["cooccurrence_edges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def walked(name, spark, saved):
    catalogue.QUERIES[name](spark, SF)
    return [plan.split("== Physical Plan ==")[1] for _, _, _, plan in saved]


@pytest.mark.parametrize("name", ["reach_unbounded", "reach_paths", "cycle_notes"])
def test_walks_broadcast_no_notes(spark, saved, name):
    assert not [p for p in walked(name, spark, saved) if "BroadcastHashJoin" in p]


@pytest.mark.parametrize("name", ["question_seeds", "seeds_by_strongest", "seeds_agree", "refusal_fork", "evidence_topk", "withheld_notes", "grounding"])
def test_seeds_read_texts_once_for_hits(spark, saved, name):
    out = catalogue.QUERIES[name](spark, SF)
    assert "text:string" not in out._jdf.queryExecution().executedPlan().toString()
    words = [p for p in (plan.split("== Physical Plan ==")[1] for n, _, _, plan in saved if n in ("hits", "stop"))]
    assert len(words) == 2 and all("SortMergeJoin" not in p for p in words)  # no postings or words are shuffled to meet the few that are asked for


@pytest.mark.parametrize("name", ["question_proposals", "first_proposals", "question_verdicts"])
def test_questions_are_lifted_once(spark, saved, name):
    out = catalogue.QUERIES[name](spark, SF)
    assert [n for n, *_ in saved].count("lifted") == 1
    assert name == "question_verdicts" or "text:string" not in out._jdf.queryExecution().executedPlan().toString()


def test_distinct_words_are_stemmed(spark):
    every = spark.createDataFrame([("a", "presses"), ("b", "press")], "note_id string, term string")
    body = every.groupBy("note_id").agg(F.collect_list("term").alias("tokens"))
    asked = spark.createDataFrame([(1, 0, "pressing")], "qid int, pos int, term string")
    found = keyword.matches(body, asked, True)
    assert {tuple(r) for r in found.collect()} == {("a", "press", 1), ("b", "press", 1)}
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [(i, line.index("ArrowEvalPython")) for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert depth and all(any("Aggregate [term" in below for below in plan[i + 1 : i + 4]) for i, _ in depth)  # never below what makes words distinct
    assert stem.stem("pressing") == "press"


def side(sets, names, common):
    terms = sorted({t for s in sets.values() for t in s})
    bit = {t: k for k, t in enumerate(terms[:common])}
    bits = np.zeros((len(names), common), np.uint8)
    for k, n in enumerate(names):
        bits[k, [bit[t] for t in sets[n] if t in bit]] = 1
    rare = [[terms.index(t) for t in sorted(sets[n]) if t not in bit] for n in names]
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64).tolist()
    return cooccurrence._Side(pa.table({"note_id": pa.array(names, pa.string()), "common": pa.array(words, pa.list_(pa.int64())), "rare": pa.array(rare, pa.list_(pa.int32())), "group": pa.array(names, pa.string())}))


@pytest.mark.parametrize(("tile", "products"), [((256, 2048), 1 << 20), ((7, 5), 3), ((3, 64), 1), ((64, 2), 10)])
def test_tiles(monkeypatch, tile, products):
    monkeypatch.setattr(cooccurrence, "TILE", tile)
    monkeypatch.setattr(cooccurrence, "PRODUCTS", products)
    sets = random_sets(5)
    names = sorted(sets)
    all_of = side(sets, names, 64)
    got = [x for b in cooccurrence._pairs_of(all_of, all_of, 2) for x in zip(*b.to_pydict().values(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == pairs(sets)
    a, b = side(sets, names[:25], 64), side(sets, names[25:], 64)
    got = {x for b in cooccurrence._pairs_of(a, b, 2) for x in zip(*b.to_pydict().values(), strict=True)}
    assert got == {p for p in pairs(sets) if p[0] in names[:25] and p[1] in names[25:]}


@pytest.mark.parametrize(("block", "spread", "common", "first"), [(512, 10, 512, 1 << 28), (7, 3, 64, 60), (1, 4, 64, 1)])
def test_degrees_groups_and_partners(spark, monkeypatch, block, spread, common, first):
    for name, value in {"BLOCK": block, "SPREAD": spread, "COMMON": common, "PAIRS": first}.items():
        monkeypatch.setattr(cooccurrence, name, value)
    sets = random_sets(6)
    scratch = Scratch(spark, "t")
    found = cooccurrence.coded(spark.createDataFrame(rows(sets), "note_id string, term string"), scratch)
    want = pairs(sets)
    near = {n: sorted({x for p in want if n in p[:2] for x in p[:2] if x != n}) for n in sets}
    assert {tuple(r) for r in cooccurrence.degrees(found).collect()} == {(n, len(x)) for n, x in near.items() if x}
    groups = {n: f"g{int(n[1:]) % 4}" for n in sets}
    got = {}
    for r in cooccurrence.grouped(found.withColumn("subject", F.concat(F.lit("g"), F.expr("CAST(substring(note_id, 2) AS int) % 4"))), "subject").collect():
        key = tuple(sorted((r["g"], r["h"])))
        got[key] = got.get(key, 0) + r["n"]
    assert got == {k: n for k in {tuple(sorted((groups[a], groups[b]))) for a, b, _ in want} if (n := sum(tuple(sorted((groups[a], groups[b]))) == k for a, b, _ in want))}
    given = [(a, b) for a in sets for b in sets if a < b and (int(a[1:]) + int(b[1:])) % 7 == 0]
    asked = cooccurrence.alike(spark.createDataFrame(given, "a string, b string"), found)
    assert {tuple(r) for r in asked.collect()} == {p[:2] for p in want if p[:2] in set(given)}
    met = cooccurrence.first_partners(found, found.withColumn("place", F.col("note_id")), scratch)
    assert {tuple(r) for r in met.collect()} == {(n, x[0]) for n, x in near.items() if x}
