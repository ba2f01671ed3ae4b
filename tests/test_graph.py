"""Graph operators on the small known graphs, and against a plain message-passing model on random ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermesh.graph import core as G
from ledgermesh.graph.components import connected_components
from ledgermesh.graph.labels import propagate_labels
from ledgermesh.graph.pagerank import delta_pagerank, modified_pagerank, static_pagerank
from ledgermesh.graph.scc import strong_components
from ledgermesh.graph.search import ancestor_words, ancestors, k_hop, on_short_cycle, short_cycles
from ledgermesh.plans.flows import component_sizes

CYCLIC = [(0, 1), (0, 2), (1, 3), (2, 5), (3, 4), (4, 2), (5, 4), (5, 6), (6, 0), (6, 2)]
STAR = [(0, 6), (1, 6), (2, 6), (3, 6), (4, 6), (5, 6), (6, 7)]
NAMED = [(1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (5, 2), (5, 6), (3, 6), (7, 8)]


@pytest.fixture(scope="module")
def graphs(spark):
    make = lambda rows: spark.createDataFrame(rows, "src long, dst long").persist()
    weighted = spark.createDataFrame([(a, b, (i + 1) / 10) for i, (a, b) in enumerate(CYCLIC)], "src long, dst long, weight double").persist()
    return {"cyclic": make(CYCLIC), "star": make(STAR), "named": make(NAMED), "weighted": weighted}


def by_id(frame, column):
    return {r["id"]: r[column] for r in frame.collect()}


def near(got, wanted, tolerance=1e-7):
    assert got.keys() == wanted.keys()
    assert all(abs(got[k] - wanted[k]) < tolerance for k in got), got


def test_degrees_and_core(graphs):
    assert by_id(G.degrees(graphs["cyclic"]), "degree") == {0: 3, 1: 2, 2: 4, 3: 2, 4: 3, 5: 3, 6: 3}
    assert by_id(G.out_degrees(graphs["cyclic"]), "out_degree") == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2}
    vertices, edges = G.core(graphs["named"])
    assert by_id(vertices, "degree") == {1: 2, 2: 4, 3: 3, 4: 2, 5: 3, 6: 2}
    assert edges.count() == 8 and G.core(graphs["named"], literal=True)[1].count() == 8


def test_subgraph_and_parallel_edges(spark, graphs):
    vertices = G.vertices_of(graphs["named"])
    v, e = G.subgraph(vertices, graphs["named"], vertices["id"] < 5)
    assert v.count() == 4 and sorted(map(tuple, e.collect())) == [(1, 2), (2, 3), (2, 4), (3, 1)]
    twice = graphs["weighted"].union(graphs["weighted"])
    merged = {(r.src, r.dst): (r.n, round(r.w, 6)) for r in G.merge_parallel(twice, w="weight").collect()}
    assert merged[(0, 1)] == (2, 0.2) and len(merged) == 10
    assert G.counts(vertices, graphs["named"]) == (8, 9)


def test_components(graphs):
    named = graphs["named"]
    vertices = G.vertices_of(named)
    assert by_id(connected_components(vertices, named), "component") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7}
    assert set(by_id(connected_components(G.vertices_of(graphs["cyclic"]), graphs["cyclic"]), "component").values()) == {0}
    assert by_id(strong_components(named, 10), "component") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 8}
    assert set(by_id(strong_components(graphs["cyclic"], 10), "component").values()) == {0}
    assert by_id(component_sizes(vertices, named, strong=10), "size") == {1: 5, 2: 5, 3: 5, 4: 5, 5: 5, 6: 1, 7: 1, 8: 1}
    assert by_id(component_sizes(vertices, named), "size")[7] == 2


def test_search(graphs):
    assert by_id(k_hop(graphs["cyclic"], 2, 2), "left") == {2: 2, 0: 1, 4: 1, 5: 1, 6: 1, 1: 0, 3: 0}
    cycles = by_id(short_cycles(graphs["cyclic"], 3), "ancestors")
    assert cycles == {2: [0, 1, 2, 3, 4, 5, 6], 4: [0, 1, 2, 3, 4, 5, 6], 5: [0, 2, 3, 4, 5, 6], 6: [0, 2, 4, 5, 6]}


def test_cycles_against_brute_force(spark):
    rng = np.random.default_rng(4)
    ids = np.concatenate([[0, -1, 2**62, -(2**62)], rng.integers(-(2**62), 2**62, 146)]).tolist()
    edges = [(ids[int(a)], ids[int(b)]) for a, b in rng.integers(0, 150, (260, 2))]
    frame = spark.createDataFrame(edges + edges[:9] + [(None, 0), (0, None), (None, None)], "src long, dst long").repartition(7)
    for longest in (1, 3):
        pairs = walk = set(edges)
        for _ in range(longest - 1):
            walk = {(a, c) for a, b in walk for x, c in edges if x == b}
            pairs = pairs | walk
        assert {(r.ancestor, r.id) for r in ancestors(frame, longest).collect()} == pairs
        wanted = {v: sorted(a for a, b in pairs if b == v) for v in ids if (v, v) in pairs}
        assert by_id(short_cycles(frame, longest), "ancestors") == wanted
    named = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    assert by_id(short_cycles(named), "ancestors") == {"a": ["a", "b", "c"], "b": ["a", "b", "c"]}


@pytest.fixture()
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in were.items():
        spark.conf.set(k, v)


def test_cycle_members_and_words(spark):
    rng = random.Random(11)
    pairs = sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(260)} | {(400, 400), (500, 501)})
    edges = spark.createDataFrame([*pairs, (None, 1), (1, None)], "src long, dst long")
    for longest in (1, 2, 3):
        lists = by_id(short_cycles(edges, longest), "ancestors")
        assert sorted(r.id for r in on_short_cycle(edges, longest).collect()) == sorted(lists)
        rows = ancestor_words(edges, longest, cyclic=True).collect()
        assert all(0 < len(r.ancestors) <= 64 for r in rows)
        joined = {}
        for r in rows:
            joined.setdefault(r.id, []).extend(r.ancestors)
        assert {i: sorted(x) for i, x in joined.items()} == lists
    assert on_short_cycle(edges.limit(0)).count() == 0


def test_cycles_of_a_dense_graph_join_few_rows(spark, many_partitions):
    n, store, sc = 160, spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc()
    listed = lambda: [x.executionId() for x in (runs.apply(i) for runs in [store.executionsList()] for i in range(runs.size()))]
    before = max(listed(), default=-1)  # the store keeps the latest runs only, so ids tell them apart, not places
    edges = spark.range(n).select(F.col("id").alias("src")).crossJoin(spark.range(n).select(F.col("id").alias("dst")))
    assert by_id(short_cycles(edges), "ancestors") == {v: list(range(n)) for v in range(n)}
    sc.listenerBus().waitUntilEmpty()
    rows = []
    for run in (x for x in listed() if x > before):
        nodes, told = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in node.name() and "Cartesian" not in node.name():
                counts = (node.metrics().apply(j) for j in range(node.metrics().size()))
                rows += [int(told.apply(m.accumulatorId()).replace(",", "")) for m in counts if m.name() == "number of output rows" and told.contains(m.accumulatorId())]
    assert rows and max(rows) <= 8 * n * n  # walks of two edges are n times the edges


def test_ranks(graphs):
    star, cyclic, weighted = graphs["star"], graphs["cyclic"], graphs["weighted"]
    low = dict.fromkeys(range(6), 0.15)
    near(by_id(delta_pagerank(star, 0.001), "rank"), low | {6: 0.915, 7: 0.92775})
    near(by_id(modified_pagerank(star, 0.001), "rank"), dict.fromkeys(range(6), 0.16875) | {6: 0.879375, 7: 0.76621875})
    near(by_id(static_pagerank(cyclic, 5), "rank"), {0: 0.3363018, 1: 0.27878516, 2: 1.09397374, 3: 0.37282428, 4: 0.81058233, 5: 0.96673283, 6: 0.50075325})
    near(by_id(delta_pagerank(cyclic, 0.001), "rank"), {0: 0.516265, 1: 0.368295, 2: 1.799064, 3: 0.460344, 4: 1.254219, 5: 1.679204, 6: 0.863662}, 1e-6)
    near(by_id(modified_pagerank(cyclic, 0.001), "rank"), {0: 0.0824396, 1: 0.09428571, 2: 0.0824396, 3: 0.16714286, 4: 0.14355536, 5: 0.28735714, 6: 0.14355536})
    near(by_id(delta_pagerank(weighted, 0.001, weighted=True), "rank"), {0: 0.24611783, 1: 0.16041276, 2: 0.44002384, 3: 0.19049743, 4: 0.31932453, 5: 0.29946084, 6: 0.25128845})
    near(by_id(modified_pagerank(weighted, 0.001, weighted=True), "rank"), {0: 0.08686942, 1: 0.07, 2: 0.09414063, 3: 0.16714286, 4: 0.1448948, 5: 0.3112594, 6: 0.16253283})


def test_standard_rank_reaches_the_fixpoint(graphs):
    got = by_id(modified_pagerank(graphs["cyclic"], 0.001, 60, standard=True), "rank")
    near(got, {0: 0.07423408, 1: 0.05297805, 2: 0.25941186, 3: 0.06645992, 4: 0.18073918, 5: 0.24192866, 6: 0.12424825}, 2e-5)


def test_labels(graphs):
    cyclic, star = graphs["cyclic"], graphs["star"]
    assert by_id(propagate_labels(cyclic, 1), "label") == {0: 1, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 0}
    assert by_id(propagate_labels(cyclic, 2), "label") == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0}
    assert set(by_id(propagate_labels(cyclic, 3), "label").values()) == {0}
    assert by_id(propagate_labels(star, 3), "label") == dict.fromkeys([0, 1, 2, 3, 4, 5, 7], 6) | {6: 0}
    assert by_id(propagate_labels(star, 4), "label") == dict.fromkeys([0, 1, 2, 3, 4, 5, 7], 0) | {6: 6}


def plain_labels(edges, rounds, sends):
    """Message passing by dictionaries."""
    ids = sorted({x for e in edges for x in e})
    state = {v: (v, 0, 0) for v in ids}
    active = set(ids)
    for _ in range(rounds):
        votes = {}
        for a, b in edges:
            if a in active or b in active:
                for s, t in ((a, b), (b, a)):
                    label, last, last2 = state[s]
                    if sends == "always" or label != (last if sends == "changed" else last2):
                        votes.setdefault(t, {}).setdefault(label, 0)
                        votes[t][label] += 1
        if not votes:
            break
        for v, own in votes.items():
            best = min(own, key=lambda x: (-own[x], x))
            state[v] = (best, state[v][0], state[v][1])
        active = set(votes)
    return {v: s[0] for v, s in state.items()}


@pytest.mark.parametrize("sends", ["always", "changed", "changed_twice"])
def test_labels_equal_plain_model(spark, sends):
    rng = random.Random(5)
    edges = [(rng.randrange(1, 15), rng.randrange(1, 15)) for _ in range(25)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert by_id(propagate_labels(frame, 4, sends), "label") == plain_labels(edges, 4, sends)


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert connected_components(G.vertices_of(none), none).count() == 0
    assert strong_components(none, 3).count() == 0 and k_hop(none, 1).count() == 0 and short_cycles(none).count() == 0
    assert modified_pagerank(none, 0.1, 3).count() == 0 and propagate_labels(none, 2).count() == 0 and G.core(none)[0].count() == 0
