"""Walks, components and cycles against plain Python, in one part and in many."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import components, graph
from quillgraph.scratch import Scratch


def adjacency(spark, pairs):
    rows = [(a, b, "link", 1.0) for a, b in pairs]
    return graph.adjacency(spark.createDataFrame(rows, "a string, b string, kind string, weight double"))


def walk(pairs, seeds, bound=None):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out, frontier, d = {s: (0, None) for s in seeds}, set(seeds), 0
    while frontier and (bound is None or d < bound):
        d += 1
        new = {}
        for n in sorted(frontier, reverse=True):
            for m in near[n]:
                if m not in out:
                    new[m] = (d, n)
        out |= new
        frontier = set(new)
    return out


def random_pairs(seed, n=40, m=45):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]


@pytest.mark.parametrize("size", [1 << 20, 10, 1])
@pytest.mark.parametrize("bound", [None, 0, 2])
def test_reach(spark, monkeypatch, size, bound):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", size)
    pairs = random_pairs(5)
    adj = adjacency(spark, pairs)
    seeds = ["n03", "n11", "unknown"]
    found = graph.reach(adj, spark.createDataFrame([(s,) for s in seeds], "note string"), bound)
    got = {r["note"]: (r["depth"], r["via"]) for r in found.reached.collect()}
    assert got == walk(pairs, seeds, bound)
    notes = spark.createDataFrame([(f"n{i:02d}",) for i in range(40)], "note string")
    assert {r[0] for r in found.left_out(notes).collect()} == {f"n{i:02d}" for i in range(40)} - set(got)
    assert found.truncated().first()[0] == (len(walk(pairs, seeds)) > len(got))
    trails = {r["note"]: r["path"] for r in graph.paths(found, Scratch(spark, "t")).collect()}
    for n, (d, via) in got.items():
        assert trails[n] == ([*trails[via], n] if via else [n]) and len(trails[n]) == d + 1


def test_no_seeds(spark):
    none = graph.reach(adjacency(spark, [("a", "b")]), spark.createDataFrame([], "note string"))
    assert none.reached.isEmpty()


def test_bound_at_the_end_is_not_truncated(spark):
    found = graph.reach(adjacency(spark, [("a", "b"), ("b", "c")]), spark.createDataFrame([("a",)], "note string"), 2)
    assert not found.truncated().first()[0]


def test_a_long_chain_takes_seconds(spark):
    adj = adjacency(spark, [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(2000)])
    began = time.time()
    found = graph.reach(adj, spark.createDataFrame([("n00000",)], "note string"))
    assert found.reached.agg(F.max("depth")).first()[0] == 2000
    assert time.time() - began < 30


def roots(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {x: root(x) for x in up}


def test_a_chain_over_many_parts_among_other_edges(spark, monkeypatch):
    """A chain that crosses parts, between stars and short rings, in few rounds and without a job for each note."""
    monkeypatch.setattr(graph, "EDGES_PER_TASK", 8_000)
    n = 20_000
    name = lambda c, v: F.concat(F.lit(c), F.format_string("%07d", v))
    i = F.col("id")
    chain = spark.range(n).select(name("m", i).alias("a"), name("m", i + 1).alias("b"))
    rings = spark.range(60_000).select(name("c", i).alias("a"), name("c", F.expr("id - id % 6 + (id + 1) % 6")).alias("b"))
    star = spark.range(20_000).select(F.lit("hub").alias("a"), name("z", i).alias("b"))
    edges = chain.union(rings).union(star).union(spark.createDataFrame([("hub", f"m{n // 2:07d}")], "a string, b string"))
    adj = graph.adjacency(edges.withColumns({"kind": F.lit("link"), "weight": F.lit(1.0)}))
    rounds = []
    walked = graph._walked
    monkeypatch.setattr(graph, "_walked", lambda *args: rounds.append(1) or walked(*args))
    found = graph.reach(adj, spark.createDataFrame([("m0000000",)], "note string"))
    assert len(rounds) < 12
    got = found.reached.agg(F.count("*"), F.max("depth"), F.sum("depth")).first()
    assert tuple(got) == (n + 1 + 1 + 20_000, n, n * (n + 1) // 2 + (n // 2 + 1) + 20_000 * (n // 2 + 2))
    wrong = found.reached.where("note LIKE 'm%' AND depth > 0").where(F.col("via") != name("m", F.col("depth") - 1))
    assert wrong.isEmpty()


def test_components(spark):
    pairs = random_pairs(8, 60, 40)
    got = {r["note"]: r["component"] for r in graph.components(adjacency(spark, pairs)).collect()}
    assert got == roots(pairs)


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_components_of_numbers(spark, monkeypatch, most):
    rng = random.Random(9)
    pairs = {(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)} | {(1000 + i, 1001 + i) for i in range(300)} | {(7, 7), (9000, 9000)}
    monkeypatch.setattr(components, "LINKS_PER_TASK", most)
    links = spark.createDataFrame(sorted(pairs), "u long, v long").repartition(3)
    got = components.connected_numbers(links, Scratch(spark, "numbers")).collect()
    want = roots({p for p in pairs if p[0] != p[1]})
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert components.connected_numbers(links.where("u = v"), Scratch(spark, "numbers")).isEmpty()


def on_cycle(pairs):
    pairs = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    out = set()
    for p in pairs:
        parts = roots(pairs - {p})
        if p[0] in parts and p[1] in parts and parts[p[0]] == parts[p[1]]:
            out |= set(p)
    return out


@pytest.mark.parametrize(("size", "seed", "m"), [(1 << 20, 1, 30), (1 << 20, 2, 45), (4, 3, 26), (1 << 20, 4, 20)])
def test_cycle_notes(spark, monkeypatch, size, seed, m):
    monkeypatch.setattr(graph, "EDGES_PER_TASK", size)
    pairs = random_pairs(seed, 24, m)
    adj = adjacency(spark, pairs)
    want = on_cycle(pairs)
    assert {r[0] for r in graph.cycle_notes(adj).collect()} == want
    assert graph.has_cycle(adj).first()["has_cycle"] == bool(want)


def test_cycles_do_not_depend_on_order(spark):
    for pairs in ([("a", "b"), ("b", "c"), ("c", "a")], [("c", "b"), ("a", "c"), ("b", "a")]):
        assert [tuple(r["cycle"]) for r in graph.cycles(adjacency(spark, pairs), 3).collect()] == [("a", "b", "c")]
    square = adjacency(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("a", "c")])
    assert sorted((r["length"], "".join(r["cycle"])) for r in graph.cycles(square, 4).collect()) == [(3, "abc"), (3, "acd"), (4, "abcd")]
    assert {tuple(r) for r in graph.triangles(square).collect()} == {("a", "b", "c"), ("a", "c", "d")}
    assert graph.cycles(adjacency(spark, [("a", "b"), ("b", "c")]), 5).isEmpty()


def test_stages_and_orphans(spark):
    edges = spark.createDataFrame([("a", "b", "link", 1.0), ("c", "c", "link", 1.0), ("a", "d", "cooccurrence", 2.0)], "a string, b string, kind string, weight double")
    notes = spark.createDataFrame([(n,) for n in "abcde"], "note_id string")
    assert {r[0] for r in graph.unconnected(notes, edges).collect()} == {"c", "e"}
    assert graph.of_kind(edges, "link").count() == 2 and graph.of_kind(edges, "similarity").isEmpty()
    assert {r[0] for r in graph.note_set(notes.where("note_id < 'b'"), edges).collect()} == {"a", "b", "c", "d"}
