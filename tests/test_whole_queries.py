"""Queries over all transitions and all transfers, on small tables whose edges are rare, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgermesh.plans import queries as Q


@pytest.fixture(scope="module")
def rare(spark, tmp_path_factory):
    """A folder of tables with no transition more than a few times, and the transitions and transfers."""
    rng = random.Random(6)
    place = str(tmp_path_factory.mktemp("rare"))
    orders = [(o, o % 17, f"{1992 + o % 7}-0{1 + o % 9}-11", "F") for o in range(40)]
    items, edges = [], set()
    for o, *_ in orders:
        low = 10 * (o % 3)  # three groups of suppliers
        visits = [low + rng.randrange(9) for _ in range(rng.randint(1, 3))]
        items += [(o, n, n, s, f"1996-01-{1 + rng.randrange(28):02d}", float(n)) for n, s in enumerate(visits)]
        edges |= set(zip(visits, visits[1:], strict=False))
    day = lambda c: F.to_date(c)
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string").withColumn("o_orderdate", day("o_orderdate")).write.parquet(f"{place}/orders.parquet")
    frame = spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_extendedprice double")
    frame.withColumn("l_shipdate", day("l_shipdate")).write.parquet(f"{place}/lineitem.parquet")
    return place, edges, {(o % 17, Q.SUPPLIER + s) for o, _, _, s, *_ in items}


def run(spark, name, place):
    return Q.queries()[name](spark, place).collect()


def reach(edges):
    """All that each vertex reaches, itself too."""
    onward = defaultdict(set)
    for a, b in edges:
        onward[a].add(b)
    out = {}
    for v in {x for e in edges for x in e}:
        seen, left = {v}, [v]
        while left:
            for y in onward[left.pop()] - seen:
                seen.add(y)
                left.append(y)
        out[v] = seen
    return out


def test_transitions_are_all_there(spark, rare):
    place, edges, _ = rare
    degree = Counter(x for e in edges for x in e)
    assert {r.id: r.degree for r in run(spark, "degrees", place)} == degree
    assert {r.id: r.out_degree for r in run(spark, "out_degrees", place)} == Counter(a for a, _ in edges)
    pruned = Counter(x for a, b in edges if degree[a] + degree[b] > 2 for x in (a, b))
    assert {r.id: r.degree for r in run(spark, "core_prune", place)} == pruned
    to = reach(edges)
    assert {r.id: r.component for r in run(spark, "scc", place)} == {v: min(w for w in to[v] if v in to[w]) for v in to}


def test_transfers_are_all_there(spark, rare):
    place, _, transfers = rare
    to = reach(transfers | {(b, a) for a, b in transfers})
    wanted = {v: min(to[v]) for v in to}
    assert {r.id: r.component for r in run(spark, "connected_components", place)} == wanted
    sizes = Counter(wanted.values())
    assert {r.id: (r.component, r.size) for r in run(spark, "left_outer_sizes", place)} == {v: (c, sizes[c]) for v, c in wanted.items()}


@pytest.mark.parametrize("name, weighted", [("pagerank_delta_converged", False), ("pagerank_delta_weighted_converged", True)])
def test_delta_ranks_converge(spark, rare, name, weighted):
    place, _, _ = rare
    edges = [(r.src, r.dst, r.weight) for r in Q._weighted(spark, place).collect()]
    out = Counter(a for a, _, _ in edges)
    rank = {v: 0.15 for a, b, _ in edges for v in (a, b)}
    delta, active, rounds = dict(rank), set(rank), 0
    while active and rounds < 200:
        got = defaultdict(float)
        for a, b, w in edges:
            if a in active and delta[a] > 0.001:
                got[b] += delta[a] * (w if weighted else 1.0) / out[a]
        for v, m in got.items():
            delta[v] = 0.85 * m
            rank[v] += delta[v]
        active, rounds = set(got), rounds + 1
    assert rounds > 5
    assert {r.id: r["rank"] for r in run(spark, name, place)} == {v: pytest.approx(x, abs=2e-6) for v, x in rank.items()}
