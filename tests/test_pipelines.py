"""Loaders, writers, relational operators, evidence, models and flows on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermesh.ml import evidence as E
from ledgermesh.ml import features as M
from ledgermesh.ml.isolation_forest import Forest, average_path, fit_forest, grow, whole_path
from ledgermesh.operators import relational as R
from ledgermesh.plans import flows
from ledgermesh.sources import loaders as L
from ledgermesh.sources import schema as C
from ledgermesh.sources import sinks as K


def test_column_lists():
    assert (len(C.USED), len(C.CATEGORIES), len(C.LABELLED), len(C.LABELLED_ALL), len(C.CODES)) == (75, 67, 74, 76, 9)
    assert C.LABELLED[:5] == ["pri_acct_no_conv", "tfr_dt_tm", "day_week", "hour", "trans_at"] and C.LABELLED[-2:] == ["settle_rcv_ins_id_cd_RG", "label"]
    assert len(C.indexed_names([f"b{i}" for i in range(178)])) == 245


def test_edge_list_and_names(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# note\n0\t6\n1 6\n\n6\t7\n")
    vertices, edges = L.edge_list(spark, str(tmp_path / "e.txt"))
    assert sorted(map(tuple, edges.collect())) == [(0, 6, 1), (1, 6, 1), (6, 7, 1)] and vertices.count() == 4
    (tmp_path / "n.txt").write_text("m1\x01Shop\nm2\nm3\x01\n")
    assert [tuple(r) for r in L.merchant_names(spark, str(tmp_path / "n.txt")).collect()] == [("m1", "Shop"), (None, " "), ("m3", "")]
    (tmp_path / "t.txt").write_text("c1\x01m2\x01m1\x0112.5\n")
    assert tuple(L.transitions(spark, str(tmp_path / "t.txt")).first()) == ("c1", "m2", "m1", 12.5)


def test_text_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",".join(f"v{i}" for i in range(75)) + "\n")
    assert L.processed(spark, str(tmp_path / "p.csv")).first()["term_id_filled"] == "v74"
    (tmp_path / "l.csv").write_text(",".join(["card", "1001123000", *(f"v{i}" for i in range(70))]) + "\n")
    row = L.labelled(spark, str(tmp_path / "l.csv")).first()
    assert (row.day_week, row.hour, row.trans_at, row.label, len(row)) == ("6", "12", "v0", "v69", 74)
    (tmp_path / "a.csv").write_text(",".join(map(str, range(76))) + "\n")
    assert L.labelled_all(spark, str(tmp_path / "a.csv")).first()["label"] == "75"
    (tmp_path / "i.csv").write_text(",".join(map(str, range(74))) + "\n")
    row = L.indexed(spark, str(tmp_path / "i.csv")).first()
    assert (row[0], row[1], row[73]) == ("0", 1.0, 73.0)
    (tmp_path / "f.csv").write_text(",".join(map(str, range(69))) + "\n")
    assert len(L.features(spark, str(tmp_path / "f.csv"), ["x", "y"]).columns) == 69
    (tmp_path / "d.csv").write_text("1,2,3,4,0\n")
    assert tuple(L.doubles_csv(spark, str(tmp_path / "d.csv"), list("abcde")).first()) == (1.0, 2.0, 3.0, 4.0, 0.0)
    (tmp_path / "h.csv").write_text("id,x,y\n7,1.5,oops\n")
    assert tuple(L.headed_numbers(spark, str(tmp_path / "h.csv")).first()) == (1.5, None)
    (tmp_path / "c.csv").write_text("9," + ",".join(map(str, range(16))) + "\n\n")
    row = L.component_features(spark, str(tmp_path / "c.csv")).first()
    assert row.label == 9 and list(row.features) == list(map(float, range(16)))
    assert R.word_count(L.text_lines(spark, str(tmp_path / "h.csv"))).count() == 2


def test_fraud_extraction(spark, tmp_path):
    names = [*[c for c in C.USED if not c.endswith(("_BK", "_RG"))], *C.CODES, "sys_tra_no"]
    line = lambda card, trace: '"' + '","'.join({"pri_acct_no_conv": card, "sys_tra_no": trace, "acq_ins_id_cd": "12345678", "term_id": ""}.get(n, "v") for n in names) + '"'
    for day, rows in {"20160901": [("c1", "t1"), ("c1", "t9")], "20160902": [("c2", "t1"), ("c3", "t1")]}.items():
        (tmp_path / f"{day}_correct").write_text("\n".join(line(*r) for r in rows) + "\n")
    (tmp_path / "fraud.tsv").write_text("t1\tc1\tm\t20160901\t04\nt8\tc2\tm\t20160902\t04\nt9\tc1\tm\t20160901\t01\nt1\tc3\tm\t20161001\t04\n")
    days = {d: str(tmp_path / f"{d}_correct") for d in ("20160901", "20160902")}
    raw = L.raw_days(spark, days, names)
    assert raw.count() == 4 and {r.pdate for r in raw.collect()} == set(days) and raw.first()["pri_acct_no_conv"] == "c1"
    found = flows.extract_fraud(spark, str(tmp_path / "fraud.tsv"), days, names, str(tmp_path / "out"))
    assert found.columns == [f"{c}_filled" for c in C.USED]
    assert sorted((r.pri_acct_no_conv_filled, r.acq_ins_id_cd_BK_filled, r.term_id_filled) for r in found.collect()) == [("c1", "1234", "NANs"), ("c2", "1234", "NANs")]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/cards")).collect()) == ["c1", "c2"]
    assert spark.read.text(str(tmp_path / "out/transactions")).count() == 2
    assert L.fraud_list_of_day(spark, str(tmp_path / "fraud.tsv"), "20160902").count() == 1
    assert L.filled_of_day(spark, "20160901", days["20160901"], names).count() == 2


def test_transfers_and_catalog(spark):
    L.ensure_table(spark, "tele", "moves", "tfr_in_acct_no string, tfr_out_acct_no string, fwd_settle_at double, hp_settle_dt string, loc_trans_tm string, acpt_ins_id_cd string, trans_md string, cross_dist_in string, trans_id string")
    spark.sql("INSERT INTO moves VALUES ('a','b',1.0,'20160701','t','i','m','x','S33'),('a','b',2.5,'20160702','t','i','m','x','S33'),('a','c',9.0,'20160703','t','i','m','x','S33'),('a','c',9.0,'20160701','t','i','m','x','S10')")
    rows = L.transfers(spark.table("moves"), "20160701", "20160702")
    assert rows.columns == C.TRANSFER_NAMES
    assert [tuple(r) for r in R.transfer_sums(rows).collect()] == [("a", "b", 3.5)] and flows.transfer_vertex_count(rows) == 2
    spark.sql("DROP DATABASE tele CASCADE")
    spark.sql("USE default")


ROWS = [("c1", "B", "A", 2.0), ("c1", "B", "A", 2.0), ("c2", "B", "A", 0.0), ("c1", "C", "B", 0.0), ("c3", "C", "B", 0.0), ("c1", "A", "C", 5.0)]


def test_transition_weights(spark):
    rows = spark.createDataFrame(ROWS, C.TRANSITIONS)
    stats = {(r.src, r.dst): (r.n, r.cards, r.total) for r in R.transition_stats(rows).collect()}
    assert stats == {("A", "B"): (3, 2, 4.0), ("B", "C"): (2, 2, 0.0), ("C", "A"): (1, 1, 5.0)}
    weights = {(r.src, r.dst): r.weight for r in R.min_max_weights(R.transition_stats(rows)).collect()}
    t = {"AB": 0.75, "BC": 10.0, "CA": 0.2}
    assert weights == pytest.approx({("A", "B"): 1 + 1 + (t["AB"] - 0.2) / 9.8, ("B", "C"): 0.5 + 1 + 1})
    assert [tuple(r) for r in R.grouped_edges(rows).collect()] == [("A", "B", 3, 2, 4 / 3)]
    for literal in (False, True):
        z = {(r.src, r.dst): r.weight for r in R.z_score_weights(R.transition_stats(rows), literal).collect()}
        n, c, g = np.array([3, 2, 1.0]), np.array([2, 2, 1.0]), np.array([4 / 3, 0, 5.0])
        wanted = (n - n.mean()) / n.std(ddof=1) + (g - g.mean()) / g.std(ddof=1) + ((c - g.mean()) / g.std(ddof=1) if literal else (c - c.mean()) / c.std(ddof=1))
        assert [z["A", "B"], z["B", "C"], z["C", "A"]] == pytest.approx(wanted.tolist())
    assert {(r.src, r.dst) for r in flows.z_score_edges(rows).collect()} != set(z)
    one = R.min_max_weights(R.transition_stats(rows.limit(1)))
    assert one.count() == 0


def test_merchant_ranks_and_writers(spark, tmp_path):
    rows = spark.createDataFrame(ROWS * 2 + [("c9", "D", "A", 1.0)] * 3, C.TRANSITIONS)
    names = spark.createDataFrame([("A", "Alpha"), ("A", "Aaa"), ("B", None)], "mchnt string, name string")
    ranks = flows.merchant_ranks(rows, names)
    assert ranks.columns == ["id", "rank", "name"] and {r.name for r in ranks.collect()} == {"Aaa", " "}
    flows.write_best(ranks, str(tmp_path / "best"), 2)
    top = [float(r.value.split(",")[1]) for r in spark.read.text(str(tmp_path / "best_DESC")).collect()]
    assert top == sorted(top, reverse=True) and len(top) == 2 and len(list((tmp_path / "best_DESC").glob("part-*"))) == 1
    flows.export_weights(rows, str(tmp_path / "edges"))
    assert all(len(r.value.split(",")) == 3 for r in spark.read.text(str(tmp_path / "edges")).collect())
    K.write_csv(ranks, str(tmp_path / "csv"), header=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ranks.columns
    K.console(ranks, 1)
    assert flows.frequent_transitions(rows).count() >= 2


def test_evidence_and_confusion(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 3 + [("a", 0.0)] + [("b", 0.0)] * 3 + [("b", 1.0), ("c", 1.0), ("b", 7.0)], "v string, label double")
    woe = {r.value: r.woe for r in E.evidence(rows, "v").collect()}
    assert woe["a"] == pytest.approx(math.log((3 / 5) / (1 / 4))) and woe["c"] == math.inf
    assert E.encode_evidence(rows, "v").filter("v_WOE is null").count() == 0
    assert math.isfinite({r.value: r.woe for r in E.evidence(rows, "v", smoothing=0.5).collect()}["c"])
    r = E.confusion(spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (1.0, 1.0)], "label_idx double, prediction double")).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.precision, r.recall) == (2, 1, 1, 1, 2 / 3, 2 / 3)
    assert math.isnan(E.confusion(spark.createDataFrame([], "label_idx double, prediction double")).first().precision)


def test_feature_stages(spark):
    rows = spark.createDataFrame([(0, [-2.0, 2.3, 0.0])], "i int, v array<double>").select("i", M.vector(F.col("v")).alias("u"))
    named = M.name_slots(rows, "u", ["f1", "f2", "f3"])
    assert list(M.slice_slots(named, "u", "o", [0, 2]).first().o) == [-2.0, 0.0]
    assert list(M.slice_slots(named, "u", "o", names=["f2", "f3"]).first().o) == [2.3, 0.0]
    assert list(M.slice_slots(named, "u", "o", [0], ["f2"]).first().o) == [-2.0, 2.3]
    assert list(M.normalise(rows, float("inf"), "u", "o").first().o) == pytest.approx([-2 / 2.3, 1.0, 0.0])
    cats = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "c_filled string")
    assert sorted(r.c_CatVec for r in M.filled_vectors(cats, ["c"]).collect()) == [0.0, 0.0, 1.0]


def test_models(spark):
    rng = np.random.default_rng(1)
    points = [(i, float(x), float(y), float(i % 2)) for i, (x, y) in enumerate(rng.normal(size=(200, 2)) + np.repeat([[0, 0], [6, 6]], 100, axis=0)[np.argsort(np.arange(200) % 2, kind="stable").argsort()])]
    rows = spark.createDataFrame(points, "i int, x double, y double, label double")
    out, centres, cost = M.k_means(M.assemble(rows, ["x", "y"]))
    assert out.groupBy("prediction").count().count() == 2 and len(centres) == 2 and cost < 1000
    model, predictions, accuracy = M.random_forest(rows, ["x", "y"])
    assert accuracy > 0.9 and "Tree 4" in K.model_text(model, 2) and predictions.filter("predictedLabel is null").count() == 0
    odd = rows.union(spark.createDataFrame([(999, 60.0, -60.0, 0.0)], rows.schema))
    for published in (False, True):
        scored = fit_forest(odd, ["x", "y"], published=published).score(odd).collect()
        assert all(0 < r.score <= 1 for r in scored)
        assert max(scored, key=lambda r: r.score).i == 999
    assert fit_forest(rows.limit(0), ["x", "y"]).score(rows.limit(0)).count() == 0
    assert average_path(2) == 1.0 and whole_path(256) == 11.0


def test_rows_beyond_what_was_drawn_are_set_apart(spark):
    x = np.random.default_rng(2).random((4000, 4)) * [50, 1e5, 0.1, 0.08]
    for seed in range(12):  # an outlier that no tree saw; which samples missed it was a matter of the seed
        rng = np.random.default_rng(seed)
        trees = [grow(x[rng.choice(len(x), 256, replace=False)], 8, rng) for _ in range(10)]
        steps = np.mean([t.depth(np.vstack([x, [[1e9] * 4], [[-1e9] * 4]]), average_path) for t in trees], axis=0)
        assert steps[-2:].max() < steps[:-2].min()
    plain = trees[0].depth(x, average_path, ends=False)
    within = np.abs(trees[0].depth(x, average_path) - plain) < 1e-12
    assert within.mean() > 0.5 and (plain == plain.round()).any()
    same = grow(np.ones((9, 1)), 3, rng)  # a range of 0
    assert same.depth(np.array([[1.0], [1.5], [0.5]]), average_path)[1:].tolist() == [2.0, 2.0]
    frame = spark.createDataFrame(x[:500].tolist() + [[1e9] * 4], "a double, b double, c double, d double")
    scored = Forest(list("abcd"), trees, 256).score(frame).collect()
    assert max(scored, key=lambda r: r.score).a == 1e9


def test_streamed_transfers(spark, tmp_path):
    from ledgermesh.streaming.transfers import windowed_transfers

    rows = spark.createDataFrame([("a", "b", 1.0, "2016-07-01 10:00:00"), ("a", "b", 2.0, "2016-07-01 11:00:00"), ("a", "b", 4.0, "2016-07-02 11:00:00")], "srccard string, dstcard string, money double, ts string")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("srccard string, dstcard string, money double, ts timestamp").parquet(str(tmp_path / "in"))
    job = windowed_transfers(stream).writeStream.outputMode("complete").format("memory").queryName("moves_by_day").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert sorted(r.money for r in spark.table("moves_by_day").collect()) == [3.0, 4.0]
