"""Operators on whole corpora: near-duplicates, passages, mixing, search, language models and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermesh.graph.components import component_members
from ledgermesh.llm import kneser_ney, mixing, near_dedup, quality, substring_dedup, toxicity, vector_search

from .helpers import TEXTS, awkward, documents, empty, labels, lower, words


def random_texts(seed, n=120):
    """Texts with exact and near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(1, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            w = rng.choices(vocabulary, k=rng.randint(0, 120))
            if rng.random() < 0.4:
                at = rng.randint(0, len(w))
                w[at:at] = passage[rng.randint(0, 8) : rng.randint(20, 30)]
            texts.append(rng.choice([" ", "\n", "  "]).join(w))
    return texts


# ---------------------------------------------------------------- near-duplicates


def components(texts, k, percent):
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("k, seed", [(4, 1), (5, 2)])
def test_near_duplicates_equal_brute_force(spark, k, seed):
    texts = TEXTS + random_texts(seed)
    sizes, wanted = components(texts, k, 80)
    for r in near_dedup.near_duplicates(documents(spark, texts), k, 80).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], wanted[r.doc_id], wanted[r.doc_id] == r.doc_id)


def test_near_duplicates_of_a_dense_region(spark):
    """Hundreds of copies of one text that are mostly a little too far apart to link: more rows share a prefix than a row meets."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = rng.choices(vocabulary, k=160)
    texts = []
    for _ in range(700):
        w = list(base)
        for at in rng.sample(range(160), 3):
            w[at] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    _, wanted = components(texts, 5, 80)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, texts), 5, 80).collect()}
    assert 50 < len(set(wanted)) < 650
    assert got == dict(enumerate(wanted))


def test_candidates_do_not_depend_on_partitions(spark):
    """Pairs at the borders of range partitions are found, whatever the partitions are; the window is brute force over each whole order."""
    rng = random.Random(31)
    base = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(5):
            own = list(b)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(60)] = f"v{rng.randrange(3000)}"
            texts.append(" ".join(own))
    sig = near_dedup.signatures(documents(spark, texts), 4).select(F.col("doc_id").alias("id"), "sig", "low").persist()
    rows = {r.id: (np.frombuffer(r.sig, ">u4"), np.frombuffer(r.low, np.uint8)) for r in sig.collect()}
    wanted = {}
    for t in range(near_dedup.ORDERS):
        order = sorted((tuple(np.roll(s, -near_dedup.LEAST_DEPTH * t)[: near_dedup.DEEPEST].tolist()), i) for i, (s, _) in rows.items())
        for x in range(len(order)):
            for y in range(x + 1, min(len(order), x + 1 + near_dedup.NEIGHBOURS)):
                if order[x][0][: near_dedup.LEAST_DEPTH] == order[y][0][: near_dedup.LEAST_DEPTH]:
                    a, b = sorted((order[x][1], order[y][1]))
                    est = ((rows[a][1] == rows[b][1]).mean() - 1 / 256) / (1 - 1 / 256)
                    if est >= near_dedup.LEAST_ESTIMATE:
                        wanted[(a, b)] = round(est, 9)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", n == 1)
            assert {(r.a, r.b): round(r.est, 9) for r in near_dedup.candidates(sig).collect()} == wanted, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_near_duplicates_awkward(spark):
    docs = awkward(spark)
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) + 4
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert ids.count(0) == 1 and ids.count(1) == 0 and ids.count(7) == 1 and ids.count(None) == 2
    assert near_dedup.near_duplicates(empty(spark)).count() == 0 and near_dedup.one_of_each(empty(spark)).count() == 0


def test_components_in_several_tasks(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    for contracted in (20, 10_000):
        got = {r.id: r.component for r in component_members(frame, contracted=contracted).collect()}
        assert got == {x: find(x) for x in range(300) if find(x) != x}


# ---------------------------------------------------------------- passages


def without_repeats(texts, length=13):
    split = [words(t) for t in texts]
    first = {}
    for i, w in enumerate(split):
        for j in range(len(w) - length + 1):
            first.setdefault(tuple(w[j : j + length]), i)
    out = []
    for i, w in enumerate(split):
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < i:
                gone[j : j + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed, parts", [(3, 1), (3, 40), (4, 7)])
def test_passages_equal_brute_force(spark, seed, parts):
    """Whatever documents meet in a slice, the rows are the same."""
    texts = TEXTS + random_texts(seed) + ["x y " * 40, "x y " * 30]
    wanted = without_repeats(texts)
    for r in substring_dedup.remove_repeats(documents(spark, texts).repartition(parts)).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == wanted[r.doc_id]


def test_common_passage_brings_one_row_a_slice(spark):
    """A window that all documents share is compared once a slice; every other row of it is spread."""
    texts = [f"{i} before " + " ".join(f"p{j}" for j in range(13)) + f" after {i}" for i in range(400)]
    docs = documents(spark, texts).select("doc_id", "text").repartition(5)
    found = substring_dedup.anchors(docs, 13).cache()
    common = found.groupBy("h").agg(F.count_distinct("doc_id").alias("n")).filter("n = 400").select("h")
    rows = found.join(common, "h").groupBy("h", "salt").count().agg(F.max("count")).first()[0]
    assert common.count() >= 1
    assert rows <= 5
    windows = substring_dedup.extended(docs.join(found.groupBy("doc_id").agg(F.collect_list("h").alias("anchors")), "doc_id"), 13)
    most = windows.groupBy("w1", "w2", "salt").count().agg(F.max("count")).first()[0]
    assert most <= 5  # one slice a partition
    wanted = without_repeats(texts)
    for r in substring_dedup.remove_repeats(docs).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == wanted[r.doc_id]


def test_passages_awkward(spark):
    rows = substring_dedup.remove_repeats(awkward(spark), with_text=True).collect()
    assert len(rows) == len(TEXTS) + 4
    assert {r.n_removed for r in rows if r.doc_id in (0, None)} == {0}
    assert [r.kept_text for r in rows if r.doc_id == 1] == [""]
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


# ---------------------------------------------------------------- mixing


def test_schedule_is_pfair():
    rng = random.Random(8)
    for _ in range(20):
        parts = mixing.shares([rng.random() + 0.01 for _ in range(rng.randint(1, 12))], 200)
        slots = mixing.schedule(parts)
        assert sorted(t for s in slots for t in s) == list(range(200))
        for c, own in zip(parts, slots, strict=True):
            for t in range(1, 201):
                assert abs(sum(x < t for x in own) - c * t / 200) < 1
    assert sum(mixing.shares([1e9] + [1.0] * 50, 60)) == 60 and min(mixing.shares([1e9] + [1.0] * 50, 60)) == 1


def test_slots_keep_the_weights_as_they_are():
    """A hot source and nineteen others over many more slots than a period of whole shares has, and more sources than that."""
    rows = [4_000_000] + [421_053 - 7 * i for i in range(19)]
    weights = [n**mixing.TEMPERATURE for n in rows]
    blocks = [-(-n // mixing.BLOCK) for n in rows]
    slots = mixing.block_slots(weights, blocks)
    assert [len(s) for s in slots] == blocks and all(s == sorted(s) for s in slots) and len({t for s in slots for t in s}) == sum(blocks)
    last = min(s[-1] for s in slots)
    for w, own in zip(weights, slots, strict=True):
        at = np.array(own)[np.array(own) <= last]
        exact = w / sum(weights) * np.append(at, last + 1)
        n = np.arange(len(exact))
        assert np.abs(n - exact).max() < 1 and np.abs(n[1:] - (exact[:-1] + w / sum(weights))).max() < 1
    many = mixing.block_slots([10_000.0] + [1.0] * 12_000, [100] + [1] * 12_000)
    assert many[0][-1] < 250


def test_mixture_keeps_weights_and_rows(spark):
    rows = [(i, ["a", "b", "c"][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.mix_order(docs, weights, block=10).orderBy("position").collect()
    assert sorted(r.doc_id for r in got) == list(range(6000)) and len({r.position for r in got}) == 6000
    end = min(max(r.slot for r in got if r.source == s) for s in weights)
    blocks = sorted({(r.slot, r.source) for r in got if r.slot <= end})
    assert [t for t, _ in blocks] == list(range(end + 1))
    seen = Counter()
    for t, s in blocks:
        seen[s] += 1
        assert all(abs(seen[x] - w * (t + 1)) < 1 for x, w in weights.items())
    small = mixing.RANKED
    try:
        mixing.RANKED = 100
        again = mixing.mix_order(docs, weights, block=10).orderBy("position").collect()
    finally:
        mixing.RANKED = small
    assert Counter((r.source, r.block) for r in again) == Counter((r.source, r.block) for r in got)


def test_mixing_awkward(spark):
    docs = awkward(spark)
    assert mixing.mix_order(docs).count() == len(TEXTS) + 4
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.exceptAll(docs).count() == 0 and mixed.count() == docs.count()
    assert mixing.mix_order(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_order(docs, {"s0": 1.0})


def test_many_labels_are_joined_by_shuffle_and_written_once(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i % 380, " ".join(rng.choice(("kind words of a calm day", "you vile rotten fool")).split() + [f"w{rng.randrange(50)}"])) for i in range(400)]  # repeated ids
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    own = labels(spark, [(i, None, int("vile" in t)) for i, t in dict(rows).items()])
    few = sorted((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.toxicity_documents(docs, own).collect())
    monkeypatch.setattr(kneser_ney, "BROADCAST_LABELS", 0)
    assert "table-" in kneser_ney.labelled(docs, own, "toxic").inputFiles()[0]
    assert sorted((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.toxicity_documents(docs, own).collect()) == few


def test_texts_under_one_id_are_documents(spark):
    long_text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long_text, "a"), (1, other, "b"), (1, other, "b"), (1, long_text + " end", "c"), (2, other + " end", "d"), (3, "alone here", "e"), (None, other, "f"), (4, None, "g"), (4, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = near_dedup.one_of_each(docs, each_text=True)
    assert left.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in left.collect()]
    first = [x for x in texts if x[0] == 1 and x[1].startswith("w0")]
    assert len(first) == 1 and len([x for x in texts if x[1] and x[1].startswith("v0") and x[0] is not None]) == 1
    assert {(3, "alone here"), (None, other), (4, None), (4, "")} <= set(texts) and len(texts) == 6
    top = spark.createDataFrame([((1 << 63) - 1, "one two three", "a"), ((1 << 63) - 1, "four five six", "b")], "doc_id long, text string, lang string")
    assert near_dedup.one_of_each(top, each_text=True).count() == 2


def test_frames_give_the_schedule_of_one_pass(spark, monkeypatch):
    rng = random.Random(5)
    rows = {f"s{i}": rng.randint(1, 900) for i in range(7)}
    docs = spark.createDataFrame([(1000 * k + n, s) for k, (s, m) in enumerate(rows.items()) for n in range(m)], "doc_id long, source string")
    whole = mixing.block_slots([float(rows[s]) ** mixing.TEMPERATURE for s in sorted(rows)], [-(-rows[s] // 5) for s in sorted(rows)])
    for size in (1, 37, 100_000):
        monkeypatch.setattr(mixing, "FRAME", size)
        monkeypatch.setattr(mixing, "RANKED", 40)  # several groups a block, and several blocks a group
        got = mixing.mix_order(docs, block=5).collect()
        assert {(r.source, r.block, r.slot) for r in got} == {(s, j, t) for s, own in zip(sorted(rows), whole, strict=True) for j, t in enumerate(own)}
        assert len(got) == sum(rows.values()) == len({r.position for r in got})


def test_mixing_spreads_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 50)
    texts = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
    got = mixing.mix_documents(texts).collect()
    assert sorted(r.text for r in got) == sorted(f"text {i}" for i in range(2000))
    groups = mixing._ranked(texts.select("doc_id", "source", F.xxhash64("text").alias("_other")), None, 64).groupBy("_group").count().collect()
    assert len(groups) == 40 and max(r["count"] for r in groups) < 100
    same = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source"))  # nothing tells these apart
    assert sorted(r.position for r in mixing.mix_order(same).collect()) == list(range(300))


# ---------------------------------------------------------------- search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute_search(rows, every, k):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = sum(x[:, d] * q[d] for d in range(x.shape[1]))
            keep = ids != i
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out[int(i)] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def test_search_is_exact_when_all_parts_are_probed(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:260] = x[100]  # one vector many times: ties by id
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    wanted = brute_search(rows, 20, 20)
    got = vector_search.nearest(vectors(spark, rows), aim=1.1).collect()
    for q, near in wanted.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.vec_id, r.score) for r in own] == near


def test_search_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    wanted = brute_search(rows, 20, 20)
    got = Counter()
    for r in vector_search.nearest(vectors(spark, rows)).collect():
        got[r.query_id] += r.vec_id in {v for v, _ in wanted[r.query_id]}
    assert sum(got.values()) / (20 * len(wanted)) >= 0.9


@pytest.mark.parametrize("small", [12, 20])
def test_search_returns_k_of_uneven_clusters(spark, small):
    """A small cluster has fewer rows than k: its queries go on to other parts."""
    rng = np.random.default_rng(small)
    centres = 5 * np.eye(8)[:2]
    rows = [(i, (centres[int(i >= 180)] + 0.1 * rng.normal(size=8)).tolist()) for i in range(180 + small)]
    rows += [(20, rows[20][1])] * 30  # an id many times: its rows are no candidates of its own
    got = Counter(r.query_id for r in vector_search.nearest(vectors(spark, rows), parts=16).collect())
    assert set(got.values()) == {20} and set(got) == set(range(0, 180 + small, 20))


def test_parts_grow_with_the_rows():
    assert [vector_search.parts_for(n, min(n, vector_search.SAMPLE)) for n in (10, 1_000, 10_000, 100_000, 10_000_000)] == [1, 8, 32, 128, 128]


def test_search_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, None]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (10, [1.0, 2.0, 3.0])]
    docs = vectors(spark, rows).withColumn("part", F.lit("x")).withColumn("v", F.lit(1)).withColumn("rank", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.nearest(docs).collect())
    assert got == [(0, 1, 9, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 0.0), (20, 1, 9, 1.0), (20, 2, 9, 1.0), (20, 3, 0, 0.0)]
    assert vector_search.nearest(vectors(spark, [])).count() == 0
    assert vector_search.nearest(vectors(spark, [(1, [1.0])])).count() == 0


# ---------------------------------------------------------------- language models


def readings(text, streams, order=kneser_ney.ORDER):
    """(symbols, place of the first predicted one) of a text's words, or of the text as a stream."""
    own = words(text)
    if streams:
        return [(b"\n" * (order - 1) + b" ".join(w.encode() for w in own) + b"\n", order - 1)]
    return [(b" " + w.encode() + b"\n", 1) for w in own]


def plain_model(texts, order=kneser_ney.ORDER, streams=False, classes=None):
    """Interpolated modified Kneser-Ney over bytes, by dictionaries. classes: the class of each text; then loglik takes a class too (None: all)."""
    raw, of_class = Counter(), {}
    for i, t in enumerate(texts):
        for s, first in readings(t, streams):
            for i_ in range(first, len(s)):
                g = s[max(0, i_ - order + 1) : i_ + 1]
                raw[g] += 1
                if classes:
                    of_class.setdefault(classes[i], Counter())[g] += 1
    grams = {g[j:] for g in raw for j in range(len(g))}
    before = Counter(g[1:] for g in grams if len(g) > 1)
    own_count = lambda g: len(g) == order or (not streams and g[:1] == b" ")

    def tables(counts):
        count = {g: counts(g) for g in grams}
        disc = {k: kneser_ney.discounts([sum(1 for g in grams if len(g) == k and count[g] == i) for i in range(1, 5)]) for k in range(1, order + 1)}
        off = {g: 0 if not count[g] else disc[len(g)][min(count[g], 3) - 1] for g in grams}
        stats = {}
        for g in grams:
            s = stats.setdefault(g[:-1], [0, 0.0])
            s[0] += count[g]
            s[1] += off[g]
        return count, off, stats

    common = tables(lambda g: raw[g] if own_count(g) else before[g])
    by_class = {c: tables(lambda g, r=r: r[g] if own_count(g) else 0) for c, r in of_class.items()}

    def step(table, h, byte, p):
        count, off, stats = table
        if h not in stats or not stats[h][0]:
            return p
        g = h + byte
        return ((count[g] - off[g]) if g in grams else 0) / stats[h][0] + stats[h][1] / stats[h][0] * p

    def prob(context, byte, cls):
        p = kneser_ney.UNIFORM
        for j in range(len(context), -1, -1):
            h, lower = context[j:], p
            p = step(common, h, byte, lower)
        return p if cls is None else step(by_class[cls], context, byte, p)  # a class has its own table of the highest order; it hands down to the common one

    def loglik(text, cls=None):
        total = 0.0
        for s, first in readings(text, streams):
            for i in range(first, len(s)):
                total += np.log(max(prob(s[max(0, i - order + 1) : i], s[i : i + 1], cls), 1e-12))
        return total

    return loglik


@pytest.mark.parametrize("streams", [False, True])
def test_kneser_ney_equals_plain_version(spark, streams):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    more = texts + ["zzz abca  éé", "", "ab\tab ab"]
    docs = documents(spark, more).select("doc_id", "text")
    model = kneser_ney.build_model(docs.filter("doc_id < 40").select("text", F.lit(0).alias("class")), words=not streams)
    loglik = plain_model(texts, streams=streams)
    for r in kneser_ney.score(docs, model, words=not streams).collect():
        t = more[r.doc_id]
        assert r.n_words == len(words(t)) and r.n_symbols == sum(len(w.encode()) + 1 for w in words(t))
        assert r.ll == pytest.approx(loglik(t) if words(t) else 0.0, rel=1e-4, abs=1e-6)


def test_class_models_equal_plain_version(spark):
    rng = random.Random(21)
    texts = [" ".join("".join(rng.choices(["ab", "ba", "cd"][i % 2 :], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 30))) for i in range(40)]
    classes = [int(i % 3 == 0) for i in range(40)]
    docs = documents(spark, texts).select("doc_id", "text")
    model = kneser_ney.build_model(docs.select("text", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("class")), classes=2)
    got = kneser_ney.score(docs, model, sums={"zero": lambda ll: ll[1], "one": lambda ll: ll[2]}).collect()
    loglik = plain_model(texts, classes=classes)
    for r in got:
        for value, c in ((r.ll, None), (r.zero, 0), (r.one, 1)):
            assert value == pytest.approx(loglik(texts[r.doc_id], c), rel=1e-4, abs=1e-6)


def test_a_block_without_answers_raises():
    import pyarrow as pa

    known = pa.table({"key": pa.array([], pa.int64()), "a": pa.array([], pa.float32()), "g": pa.array([], pa.float32())})
    with pytest.raises(RuntimeError):
        kneser_ney._answers(known, [""], 1, False)
    assert len(kneser_ney._answers(known, [""], 1, True)[0]) == 0


def word_list(rng, stems, n):
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(n))


def test_quality_rejects_junk(spark):
    rng = random.Random(12)
    clean = [word_list(rng, ["th", "er", "on", "an"], 80) for _ in range(400)]
    noise = ["".join(rng.choices("#$%&!*QXZ", k=200)) for _ in range(10)]
    over = [" ".join(["thonanerth".upper()] * 60) for _ in range(5)]  # a word over and over
    marked = [" | ".join(word_list(rng, ["th", "er", "on", "an"], 80).split()) for _ in range(5)]
    docs = documents(spark, clean + noise + over + marked)
    own = labels(spark, [(i, 1, 0) for i in range(300)] + [(400, 0, 0)])
    got = {r.doc_id: r for r in quality.quality_documents(docs, own).collect()}
    assert sum(got[i].keep for i in range(400)) >= 392 and not any(got[i].keep for i in range(400, 420))
    left = quality.keep_documents(docs, own)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in got if got[i].keep}


def test_word_order_counts(spark):
    """The same words in another order have another perplexity: n-grams run over word boundaries."""
    docs = documents(spark, ["on the hill by the sea"] * 30 + ["the on hill the by sea"])
    got = {r.doc_id: r.perplexity for r in quality.quality_documents(docs, labels(spark, [(i, 1, 0) for i in range(25)])).collect()}
    assert got[30] is not None and (got[0] == got[29])
    texts = ["on the hill by the sea"] * 20
    model = kneser_ney.build_model(documents(spark, texts).select("text", F.lit(0).alias("class")), words=False)
    a, b = (r.ll for r in kneser_ney.score(documents(spark, [texts[0], "the on hill the by sea"]).select("doc_id", "text"), model, words=False).orderBy("doc_id").collect())
    assert a > b + 1


def test_quality_thresholds_equal_plain_version(spark):
    """Thresholds are quantiles by language and length band of trusted documents that the model wasn't counted on."""
    rng = random.Random(22)
    texts = [word_list(rng, ["th", "er", "on", "an"], rng.choice([2, 8, 40])) for _ in range(500)]
    docs = documents(spark, texts)  # languages en, de and null by turns
    rows = {r.doc_id: r for r in quality.quality_documents(docs, labels(spark, [(i, 1, 0) for i in range(450)])).collect()}
    tags = {r.doc_id: r.t for r in docs.select("doc_id", F.xxhash64("text").alias("t")).collect()}
    held = [i for i in range(450) if tags[i] % quality.HELD_OUT == 0]
    loglik = plain_model([texts[i] for i in range(450) if i not in held], streams=True)
    size = {i: sum(len(w.encode()) + 1 for w in words(texts[i])) for i in rows}
    own = {i: -loglik(texts[i]) / size[i] for i in rows if i in held or i % 20 == 0}
    assert all(np.log(rows[i].perplexity) == pytest.approx(x, rel=1e-4) for i, x in own.items())
    which = {i: (["en", "de", None][i % 3], sum(size[i] >= n for n in quality.BANDS)) for i in rows}
    logs = {i: np.ceil(np.log(rows[i].perplexity) * 1000) / 1000 for i in held}
    for i, r in rows.items():
        groups = [[x for j, x in logs.items() if which[j] == which[i]], [x for j, x in logs.items() if which[j][0] == which[i][0]], [x for j, x in logs.items() if which[j][1] == which[i][1]]]
        of = next((g for g in groups if len(g) >= quality.LEAST_TRUSTED), list(logs.values()))
        assert np.log(r.threshold) == pytest.approx(np.quantile(of, quality.QUANTILE, method="inverted_cdf"), abs=1e-6)
        assert r.keep == (r.perplexity <= r.threshold)


def test_quality_awkward(spark):
    docs = awkward(spark)
    own = labels(spark, [(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, None, None), (999, 1, 0)])
    rows = quality.quality_documents(docs, own).collect()
    assert len(rows) == len(TEXTS) + 4
    assert all(not r.keep and r.perplexity is None for r in rows if r.doc_id in (4, 5, 6))
    assert quality.keep_documents(docs, own).columns == docs.columns
    none = quality.quality_documents(docs, labels(spark, []))
    assert {r.keep for r in none.collect() if r.n_words} == {True}
    assert quality.quality_documents(empty(spark), own).count() == 0


def test_toxicity_finds_words_and_holds_out(spark):
    rng = random.Random(13)
    texts, marks = [], []
    for i in range(600):
        w = word_list(rng, ["th", "er", "on", "an", "st"], 60).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["grumblefoot", "snotwit"])
        texts.append(" ".join(w))
        marks.append((i, 1, int(bad)))
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in toxicity.toxicity_documents(docs, labels(spark, marks)).collect()}
    for i, (_, _, bad) in enumerate(marks):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3)
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == marks[i][2] for i in held]) > 0.97
    # labels of held-out rows change nothing
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in marks]
    again = {r.doc_id: r.score for r in toxicity.toxicity_documents(docs, labels(spark, other)).collect()}
    assert all(again[i] == pytest.approx(got[i].score, abs=1e-9) for i in got)


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    rows = toxicity.toxicity_documents(docs, labels(spark, [(0, 1, 1), (None, 1, 1), (9, 1, 0)])).collect()
    assert len(rows) == len(TEXTS) + 4 and all(r.score is not None and r.held_out is not None for r in rows)
    assert toxicity.toxicity_documents(empty(spark), labels(spark, [])).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline
    from ledgermesh.session import stored

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = spark.read.parquet(f"{sf}/labels.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mix", "tokens"]
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
        out.append({r.doc_id: r for r in docs.collect()})
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = {r.doc_id for r in own.collect() if r.quality == 1}
    assert good <= set(out[0]) | {i for i in good if i not in before}
    kept = sorted(out[0])
    _, wanted = components([out[0][i].text for i in kept], 5, 80)
    assert set(out[1]) == {kept[i] for i in range(len(kept)) if wanted[i] == i}
    assert set(out[1]) == set(out[2]) == set(out[3]) == set(out[4])
    assert all(out[3][i] == out[2][i] for i in out[3])
    assert all(out[4][i].decoded_sha256 == hashlib.sha256(out[3][i].text.encode()).hexdigest() for i in out[4])


def test_pipeline_rows_hold_the_mixture(spark):
    import corpus_pipeline

    texts = [f"text {i}" for i in range(3000)]
    docs = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") % 10 < 7, "a").when(F.col("doc_id") % 10 < 9, "b").otherwise("c"))
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mix"](spark, docs, "").repartition(5)  # as files are read in any order
    rows = sorted(stages["tokens"](spark, mixed, "").collect(), key=lambda r: r.position)
    assert len({r.position for r in rows}) == 3000
    weight = {s: n**mixing.TEMPERATURE for s, n in (("a", 2100), ("b", 600), ("c", 300))}
    total, seen = sum(weight.values()), Counter()
    blocks = sorted({(r.position // mixing.BLOCK, r.source) for r in rows})
    last = min(max(t for t, s in blocks if s == x) for x in weight)
    for t, s in blocks[: last + 1]:
        seen[s] += 1
        assert all(abs(seen[x] - w / total * (t + 1)) < 1.01 for x, w in weight.items())
