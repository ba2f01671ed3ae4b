"""What holds at any size: fair samples, edges that stay where they are, hubs, long chains, hot cards, one scan, folders that aren't opened."""

import hmac
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermesh.functions import scalars as S
from ledgermesh.graph.components import connected_components
from ledgermesh.graph.core import vertices_of
from ledgermesh.graph.labels import propagate_labels
from ledgermesh.graph.layout import lay_out
from ledgermesh.graph.pagerank import static_pagerank
from ledgermesh.graph.scc import strong_components
from ledgermesh.ml import evidence as E
from ledgermesh.ml.isolation_forest import bounded_samples, fit_forest
from ledgermesh.operators import relational as R
from ledgermesh.operators.ordered import numbered, running_sum, with_previous
from ledgermesh.operators.skew import join_unique
from ledgermesh.sources import loaders as L
from ledgermesh.sources import sinks as K

from .test_graph import by_id, plain_labels


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- orders and joins


def test_numbers_and_sums_over_partitions(spark):
    rng = random.Random(3)
    values = [(rng.randrange(50), i) for i in range(700)]
    frame = spark.createDataFrame(values, "a long, b long").repartition(9)
    wanted = sorted(values)
    assert [(r.a, r.b) for r in numbered(frame, "a", "b").orderBy("at").collect()] == wanted
    assert sorted(r["at"] for r in numbered(frame).collect()) == list(range(700))
    sums = {(r.a, r.b): r.before for r in running_sum(frame, "a", "a", "b").collect()}
    assert [sums[x] for x in wanted] == [sum(a for a, _ in wanted[:i]) for i in range(700)]
    before = {(r.a, r.b): r.previous and r.previous.b for r in with_previous(frame, ["b"], "a", "b").collect()}
    assert [before[x] for x in wanted] == [None, *(b for _, b in wanted[:-1])]
    assert numbered(frame.limit(0), "a").count() == 0 and running_sum(frame.limit(0), "a", "a").count() == 0


def test_heavy_keys_are_joined_in_place(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), "id")  # a third is null
    rows = rows.union(spark.range(2_000).select(F.lit(5).cast("long"), "id"))
    keyed = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), (F.max("k") * 2).alias("v"))
    got = join_unique(rows, keyed, ["k"], "n", 5_000)
    assert got.count() == 4_000 and got.filter("v <> 2 * k").isEmpty() and got.columns == ["k", "id", "v"]


# ---------------------------------------------------------------- isolation forest


def test_every_part_of_a_table_is_drawn_alike(spark):
    n = 60_000
    frame = spark.range(n).select("id", (F.col("id") / n).alias("x"))
    drawn = bounded_samples(frame, ["x"], 12, 256, 7)
    assert [len(s) for s in drawn] == [256] * 12 and len({s.tobytes() for s in drawn}) == 12
    tenths = np.histogram(np.concatenate(drawn), bins=10, range=(0, 1))[0]
    assert abs(tenths - 307.2).max() < 5 * 307.2**0.5
    again = bounded_samples(frame.orderBy(F.desc("id")).repartition(7), ["x"], 12, 256, 7)
    assert all((a == b).all() for a, b in zip(drawn, again, strict=True))


def test_equal_rows_are_drawn_by_their_number(spark):
    frame = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, -1.0).otherwise(F.col("id").cast("double")).alias("x"))
    share = [(s == -1).mean() for s in bounded_samples(frame, ["x"], 30, 200, 1)]
    assert abs(np.mean(share) - 1 / 3) < 0.05 and np.std(share) > 0.01
    same = bounded_samples(frame.select(F.lit(2.0).alias("x")), ["x"], 2, 200, 1)
    assert [s.tolist() for s in same] == [[[2.0]] * 200] * 2
    few = bounded_samples(frame.filter("x between 1 and 8"), ["x"], 3, 200, 1)
    assert all(sorted(s[:, 0]) == [1.0, 2.0, 4.0, 5.0, 7.0, 8.0] for s in few)
    assert [s.shape for s in bounded_samples(frame.limit(0), ["x"], 2, 9, 1)] == [(0, 1)] * 2


def test_scores_do_not_hang_on_the_order_of_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(4_000, 2)), rng.normal(size=(1_000, 2)) + 3])  # the last fifth is another population
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, x double, y double")
    scores = lambda f: {r.i: r.score for r in fit_forest(f, ["x", "y"]).score(frame).collect()}
    assert scores(frame) == scores(frame.orderBy(F.rand(1)).repartition(5))


# ---------------------------------------------------------------- graphs


def test_edges_stay_in_their_buckets(spark):
    edges = spark.range(5_000).select((F.col("id") % 700).alias("src"), (F.col("id") * 13 % 701).alias("dst"))
    kept = lay_out(edges, 8)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(kept.receive(vertices_of(edges).select(F.col("id").alias("src"), F.col("id").alias("value"))).groupBy("dst").agg(F.sum("value")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    lines = text.splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x)
    join = max(i for i in range(at) if "SortMergeJoin" in lines[i] or "ShuffledHashJoin" in lines[i])
    assert not any("Exchange" in x for x in lines[join:at])
    kept.drop()


def test_a_hub_is_dealt_out(spark):
    leaves = 1_000_000
    star = spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    for edges in (star, star.select(F.col("dst").alias("src"), F.col("src").alias("dst"))):
        kept = lay_out(edges, 8)
        sizes = [r["count"] for r in kept.edges.groupBy(F.col("_metadata.file_path")).count().collect()]
        assert len(sizes) == 8 and sum(sizes) == leaves and max(sizes) <= 2 * sorted(sizes)[4]
        sent = kept.receive(spark.createDataFrame([(0, 1.0), (7, 2.0)], "src long, value double"))
        assert sent.agg(F.sum("value")).first()[0] == (leaves if edges is star else 2.0)
        kept.drop()
    ranks = static_pagerank(star, 1)
    assert ranks.filter("id = 0").first()["rank"] == pytest.approx(0.15) and ranks.count() == leaves + 1
    assert ranks.filter("id > 0").select(F.round("rank", 12)).distinct().count() == 1
    assert connected_components(vertices_of(star), star).filter("component <> 0").isEmpty()


@pytest.mark.parametrize("sends, rounds", [("always", 200), ("changed", 100), ("changed_twice", 200)])
def test_labels_to_the_last_round(spark, sends, rounds):
    rng = random.Random(rounds + len(sends))
    edges = [(rng.randrange(1, 40), rng.randrange(1, 40)) for _ in range(60)] + [(50, 51), (51, 52), (60, 61)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert by_id(propagate_labels(frame, rounds, sends), "label") == plain_labels(edges, rounds, sends)


def test_long_chains_have_few_rounds(spark):
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + n - 1) % n).alias("dst"))  # the smallest goes round last
    lead = spark.range(n, n + 3_000).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst")).union(spark.createDataFrame([(n, 17), (5, -1), (-1, -2)], "src long, dst long"))
    status = spark._jsparkSession.sharedState().statusStore()
    before = status.executionsCount()
    got = strong_components(ring.union(lead), 3)
    sizes = {r.component: r["count"] for r in got.groupBy("component").count().filter("count > 1").collect()}
    assert sizes == {0: n} and got.count() == n + 3_003
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert before >= 1_000 or status.executionsCount() - before < 400  # the store keeps a thousand; rounds are twice log2 n in each chase


def test_strong_components_of_random_graphs(spark):
    for seed in (1,):
        rng = random.Random(seed)
        n = 60
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(75)] + [(i, i + 1) for i in range(100, 120)] + [(120, 100), (110, 130), (130, 131)]
        to = {}
        for v in {x for e in edges for x in e}:
            seen, left = {v}, [v]
            while left:
                at = left.pop()
                for a, b in edges:
                    if a == at and b not in seen:
                        seen.add(b)
                        left.append(b)
            to[v] = seen
        wanted = {v: min(w for w in to[v] if v in to[w]) for v in to}
        frame = spark.createDataFrame(edges, "src long, dst long")
        assert by_id(strong_components(frame, 60), "component") == wanted


# ---------------------------------------------------------------- relational


def test_a_hot_card_lies_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1 if i % 3 == 0 else i % 97, rng.randrange(20), i, rng.randrange(10**6)) for i in range(3_000)]
    events = spark.createDataFrame(rows, "card long, mchnt long, seq long, at long").repartition(6)
    wanted = sorted(tuple(r) for r in R.transitions_by_lag(events, "card", "mchnt", F.col("at"), ["seq"]).collect())
    assert len(wanted) == 3_000 - len({r[0] for r in rows})
    got = R.transitions_by_lag(events, "card", "mchnt", F.col("at"), ["seq"], dense=100)
    assert sorted(tuple(r) for r in got.collect()) == wanted
    spread = with_previous(events.filter("card = 1"), ["mchnt"], "card", "seq").groupBy("previous.mchnt").count()
    assert spread.agg(F.sum("count")).first()[0] == sum(r[0] == 1 for r in rows)


def test_evidence_of_many_columns(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(4), str(i % 50), float(i % 2)) for i in range(600)]
    frame = spark.createDataFrame(rows, "i long, a string, b int, c string, label double")
    wanted = frame
    for c in "abc":
        wanted = E.encode_evidence(wanted, c)
    names = ["i", "a_WOE", "b_WOE", "c_WOE"]
    rounded = lambda f: {r.i: tuple(r[c] if r[c] in (float("inf"), float("-inf")) else round(r[c], 9) for c in names[1:]) for r in f.collect()}
    for mapped in (1_000, 5):
        got = E.encode_all(frame, ["a", "b", "c"], mapped=mapped)
        assert got.columns == [*frame.columns, *names[1:]] and rounded(got) == rounded(wanted)
    assert E.encode_all(frame.limit(0), ["a", "b"]).count() == 0


def test_weights_compute_their_statistics_once(spark):
    stats = spark.createDataFrame([(1, 2, 3, 2, 6.0), (2, 1, 5, 5, 0.0), (3, 1, 1, 1, 2.0)], "src long, dst long, n long, cards long, total double")
    text = plan(R.min_max_weights(stats))
    assert text.count("FileScan") == 1 and "Join" not in text
    got = {(r.src, r.dst): r.weight for r in R.min_max_weights(stats).collect()}
    assert got == pytest.approx({(1, 2): 0.5 + 0.25 + 0.0, (2, 1): 1.0 + 1.0 + 1.0})
    assert R.min_max_weights(stats.limit(0)).count() == 0 and R.z_score_weights(stats.limit(0)).count() == 0
    assert R.min_max_weights(stats.filter("n > 9")).count() == 0


def test_keyed_hash_equals_the_standard_library(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcXYZ019 -中é", k=rng.randint(0, n)))
    rows = [(i, word(80), word(90)) for i in range(5_000)] + [(5_000, None, "k"), (5_001, "t", None)]
    frame = spark.createDataFrame(rows, "i int, t string, k string")
    got = frame.select("i", S.hmac_md5("t", "k").alias("h"), S.keyed_hash("t", "k").alias("n"), S.hmac_md5("t", b"\x00secret").alias("s")).collect()
    for (_, t, k), r in zip(rows, sorted(got), strict=True):
        digest = None if t is None or k is None else hmac.new(k.encode(), t.encode(), "md5").hexdigest()
        assert r.h == digest
        assert r.n == (None if digest is None else abs(int.from_bytes(bytes.fromhex(digest), "big", signed=True)) % 10**15)
        assert r.s == (None if t is None else hmac.new(b"\x00secret", t.encode(), "md5").hexdigest())


# ---------------------------------------------------------------- files


def test_many_days_are_one_scan(spark, tmp_path):
    names = ["a b", "a", "a b c", "day%20x", "ä"] + [f"d{i}" for i in range(60)]
    days = {}
    for i, name in enumerate(names):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_text(f'"{name}","{i}"\n')
        days[f"2016{i:04d}"] = str(tmp_path / name)
    (tmp_path / "single.txt").write_text('"single","-1"\n')
    days["20170101"] = str(tmp_path / "single.txt")
    days["20170102"] = str(tmp_path / "a")  # one folder for two days
    frame = L.raw_days(spark, days, ["name", "number"])
    got = {(r.pdate, r.name, r.number) for r in frame.collect()}
    wanted = {(f"2016{i:04d}", name, str(i)) for i, name in enumerate(names)} | {("20170101", "single", "-1"), ("20170102", "a", "1")}
    assert got == wanted and frame.count() == len(wanted)
    assert plan(frame).count("FileScan") == 1
    with pytest.raises(FileNotFoundError):
        L.raw_days(spark, {"20160101": str(tmp_path / "nowhere")}, ["name"])


def test_days_of_a_table_are_folders(spark, tmp_path):
    rows = spark.range(900).select("id", F.format_string("201607%02d", F.col("id") % 30 + 1).alias("day"))
    L.ensure_table(spark, "folders", "empty_days", "id bigint, day string", "day")
    K.write_days(rows, "folders.moves", "day", str(tmp_path / "moves"))
    table = spark.table("folders.moves")
    few = L.days_of_table(table, "day", "20160704", "20160705")
    files = {r[0] for r in few.select(F.col("_metadata.file_path")).distinct().collect()}
    assert few.count() == 60 and {p.split("/")[-2] for p in files} == {"day=20160704", "day=20160705"}
    assert "PartitionFilters: [isnotnull(day" in plan(few)
    asked = L.rows_on_days(table, "day", spark.createDataFrame([("20160709", 1), ("20160703", 2), ("20160703", 3)], "d string, x int").filter("x < 3"))
    assert asked.count() == 60 and "dynamicpruning" in plan(asked)
    spark.sql("DROP DATABASE folders CASCADE")
    spark.sql("USE default")
