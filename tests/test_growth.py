"""What a task holds, and how often the input is read, doesn't grow with the input."""

import random

import pytest
from pyspark.sql import functions as F

from ledgermesh import session
from ledgermesh.graph import blocks, labels, layout, scc, search
from ledgermesh.graph.search import on_short_cycle, short_cycle_texts, short_cycles
from ledgermesh.operators import relational as R
from ledgermesh.operators.ordered import quantiles
from ledgermesh.plans import flows
from ledgermesh.plans.scale_queries import forest_sample_invariants


def cyclic(edges, longest):
    walks, found = set(edges), {a for a, b in edges if a == b}
    for _ in range(longest - 1):
        walks = {(a, d) for a, b in walks for c, d in edges if c == b}
        found |= {a for a, b in walks if a == b}
    return found


def test_members_of_a_dense_graph_need_no_bits(spark, monkeypatch):
    monkeypatch.setattr(search, "_reaching", lambda *a: pytest.fail("bits for all walks"))
    both = spark.range(30).select(F.col("id").alias("src"), (F.col("id") * 7 % 30).alias("dst")).filter("src <> dst")
    assert on_short_cycle(both.union(both.select("dst", "src"))).count() == both.selectExpr("explode(array(src, dst)) id").distinct().count()
    rng = random.Random(2)  # a tournament has no edge both ways
    one = [(a, b) if rng.random() < 0.5 else (b, a) for a in range(25) for b in range(a)]
    got = {r.id for r in on_short_cycle(spark.createDataFrame(one, "src long, dst long")).collect()}
    assert got == cyclic(one, 3)


@pytest.mark.parametrize("most", [0, 10**9])
def test_members_by_walks_and_by_bits_are_the_same(spark, monkeypatch, most):
    closed = search._closed_wedges
    monkeypatch.setattr(search, "_closed_wedges", lambda edges, rest, _: closed(edges, rest, most))
    rng = random.Random(9)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(100)} | {(70 + i, 71 + i) for i in range(80)} | {(100, 98), (140, 137)})
    for longest in (3, 4):
        assert {r.id for r in on_short_cycle(spark.createDataFrame(edges, "src long, dst long"), longest).collect()} == cyclic(edges, longest)


def test_lists_of_ancestors_are_not_shuffled(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    frame = short_cycles(edges)
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    listed = next(i for i, x in enumerate(lines) if "BroadcastHashJoin" in x and "word" in x)
    assert not any("Exchange" in x for x in lines[:listed])
    assert {r.id: r.ancestors for r in frame.collect()} == {1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 3: [1, 2, 3, 4]}


def test_ancestors_of_a_dense_graph_leave_no_partial_sums(spark, monkeypatch):
    monkeypatch.setattr(search, "_laid_out", lambda *a: pytest.fail("each bucket sends sums for all targets"))
    for name, least in (("CHUNK", 2), ("EDGES", 60), ("TARGETS", 8), ("BITS", 64 * 150)):
        monkeypatch.setattr(blocks, name, least)
    rng = random.Random(5)
    edges = sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(700)} | {(a, b) for a in range(160, 166) for b in range(160, 166)})
    walks, reached = set(edges), set(edges)
    out = {a: {d for c, d in edges if c == a} for a, _ in edges}
    for _ in range(2):
        walks = {(a, d) for a, b in walks for d in out.get(b, ())}
        reached |= walks
    wanted = {v: ",".join(map(str, sorted(a for a, b in reached if b == v))) for v, b in reached if v == b}
    rows = short_cycle_texts(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()
    assert {r.id: r.ancestors for r in rows} == wanted and len(rows) == len(wanted)


def test_bits_between_rounds_are_bounded_by_the_edges(spark, monkeypatch):
    """Parts go through the rounds in batches, and neither bits nor edges are copied for each block and part."""
    n, sizes, write = 300, [], blocks.stored
    for name, value in (("CHUNK", 3), ("TARGETS", 64), ("SLICE", 6), ("LEAST", 1 << 11), ("HELD", 0)):
        monkeypatch.setattr(blocks, name, value)
    edges = [(i, (i + j) % n) for i in range(n) for j in (1, 2, 150)]
    monkeypatch.setattr(blocks, "stored", lambda df: sizes.append((df, write(df))) or sizes[-1][1])
    rows = short_cycle_texts(spark.createDataFrame(edges, "src long, dst long"))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df, _ in sizes[1:]]
    assert len(plans) > 3 and all("CartesianProduct" in p for p in plans)
    two = {0, 1, 2, 150}
    steps = {a + b + c for a in two for b in two for c in two if (a, b, c) != (0, 0, 0)}
    # the ring is closed by two halves, and back and forth
    wanted = {i: ",".join(map(str, sorted({(i - s) % n for s in steps}))) for i in range(n)}
    assert {r.id: r.ancestors for r in rows.collect()} == wanted


def test_texts_are_in_order_where_words_cross(spark):
    n = 200  # a ring in shuffled order: neighbours' ids lie anywhere, so words of one vertex cross
    ids = random.Random(6).sample(range(-1000, 1000), n)
    edges = [(ids[i], ids[(i + j) % n]) for i in range(n) for j in (1, 7, 50, 199)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    lists = {r.id: ",".join(map(str, r.ancestors)) for r in short_cycles(frame).collect()}
    assert {r.id: r.ancestors for r in short_cycle_texts(frame).collect()} == lists and len(lists) == n


def test_label_rounds_have_partitions_by_edges(spark, monkeypatch):
    seen, run, dealt, write = [], labels.pregel, session.dealt, layout.stored_buckets
    monkeypatch.setattr(layout, "stored_buckets", lambda df, buckets, *c: seen.append(buckets) or write(df, buckets, *c))
    monkeypatch.setattr(layout, "BUCKET", 10)
    monkeypatch.setattr(labels, "dealt", lambda s, rows: dealt(s, rows, 10))
    monkeypatch.setattr(labels, "pregel", lambda *a, **b: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or run(*a, **b))
    edges = spark.range(60).select("id", (F.col("id") * 7 % 60).alias("dst")).toDF("src", "dst")
    labels.propagate_labels(edges, 1)
    assert seen == [12, "12"] and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_cards_are_dealt_by_events(spark, monkeypatch):
    events = spark.range(300).select((F.col("id") % 40).alias("card"), (F.col("id") % 7).alias("mchnt"), "id")
    transitions = lambda: R.transitions_by_lag(events, "card", "mchnt", F.col("id"), ["id"])
    wanted = sorted(map(tuple, transitions().collect()))
    monkeypatch.setattr(R, "tasks_for", lambda s, rows: session.tasks_for(s, rows, 30))
    got = transitions()
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString() and got.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, got.collect())) == wanted


def counted(spark, frame):
    """The frame, and a counter of the rows that are made for it."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return frame.mapInPandas(run, frame.schema), made


def test_transfers_are_made_once_and_not_chased(spark, monkeypatch):
    monkeypatch.setattr(scc, "_chase", lambda *a: pytest.fail("chains of a graph from one side to another"))
    rows = spark.range(200).select(F.format_string("C%d", F.col("id") % 30).alias("srccard"), F.format_string("S%d", F.col("id") % 7).alias("dstcard"), F.lit(1.0).alias("money"))
    frame, made = counted(spark, rows)
    got = flows.transfer_strong_components(frame)
    assert got.filter("id <> component").isEmpty() and got.count() == 37 and made.value == 200


def test_edges_of_strong_components_are_made_once(spark):
    frame, made = counted(spark, spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 1), (7, 7)], "src long, dst long"))
    got = {r.id: r.component for r in scc.strong_components(frame, 3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7} and made.value == 7


def test_accounts_of_both_sides_are_made_once(spark):
    frame, made = counted(spark, spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "srccard string, dstcard string"))
    assert sorted(r.account for r in R.account_vertices(frame).collect()) == ["a", "b", "c"] and made.value == 3


def test_quantiles_equal_percentile(spark, monkeypatch):
    rng = random.Random(1)
    frame = spark.createDataFrame([(rng.randrange(50),) for _ in range(203)] + [(None,)], "x long").repartition(5)
    shares = [i / 10 for i in range(11)]
    wanted = frame.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]
    assert quantiles(frame, "x", shares) == pytest.approx(wanted) and quantiles(frame.limit(0), "x", shares) == []
    monkeypatch.setattr(F, "percentile", lambda *a: pytest.fail("all distinct values in one task"))
    assert forest_sample_invariants(spark, "/root/testdata/sf0.001").first().order_is_nothing
