"""Conversation tries, URL templates and whitening against plain versions and SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermesh.llm.prefix_trie import member_hashes, prefix_trie
from ledgermesh.llm.queries import OP11_SQL
from ledgermesh.llm.url_templates import RULES, Growth, judge_urls
from ledgermesh.llm.whitening import whiten

from .helpers import CLASHES

# ---------------------------------------------------------------- prefix trie

TURNS = "conv_id long, turn long, role string, text string"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_trie(rows):
    """By dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), (r or "", x or "")))
    own = {c: [z[-1] for z in sorted(v, key=lambda z: z[:3])] for c, v in own.items()}
    members, full = defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    saved, leaves = Counter(), Counter()
    for k, own_members in members.items():
        w = (len(own_members) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += w
            leaves[k[:d]] += k not in kids
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if full[c] == k).encode()).hexdigest()
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), kids[k], leaves[k], saved[k], sha(k)) for k in members)


def trie_rows(frame):
    return sorted(tuple(r[c] for c in OUT) for r in prefix_trie(frame).collect())


def sql_rows(frame):
    con = duckdb.connect()
    con.register("conversations", frame.select("conv_id", "turn", "role", "text").toArrow())
    found = con.execute(OP11_SQL)
    at = [[c[0] for c in found.description].index(c) for c in OUT]
    return sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_trie_equals_plain_version_and_sql(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ä😀", ""])) for c in rng.sample(range(-150, 900), 120) for t in range(rng.choice([1, 2, 3, 5, 8, 13]))]
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    wanted = plain_trie(rows)
    assert trie_rows(frame) == wanted == sql_rows(frame)


def test_trie_of_hot_and_long_conversations(spark):
    """A conversation with more turns than all others, and one turn that most conversations begin with."""
    rows = [(100, t, "user", str(t % 7)) for t in range(700)] + [(c, t, "user", "same" if c % 3 else str(c)) for c in range(1000, 1300) for t in range(2)]
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    assert trie_rows(frame) == plain_trie(rows)


def test_trie_awkward(spark):
    rows = [(0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "b", "y"), (7, 3, "user", "x"), (-7, 0, "", "z"), (None, 1, "user", "lost"), (205, None, "user", "w " * 40_000), (300, 2, None, "q"), (9_223_372_036_854_775_807, 0, "user", "x"), (-9_223_372_036_854_775_808, 0, "user", "x")]
    frame = spark.createDataFrame(rows, TURNS)
    clashing = frame.select("*", *(F.lit("x").alias(c) for c in (*CLASHES, "depth", "node", "d", "at", "name", "own", "start", "total", "digest")))
    assert trie_rows(clashing) == plain_trie(rows) == sql_rows(frame)
    assert prefix_trie(frame.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x")], TURNS)
    assert prefix_trie(lost).count() == 0


def test_member_hashes_go_on_over_packed_rows(spark):
    got = {r.node: r.sha for r in member_hashes(spark.range(2_000).select((F.col("id") % 2 * 5).alias("node"), (F.col("id") - 700).alias("conv_id")).repartition(3)).collect()}
    assert got == {n * 5: hashlib.sha256(",".join(str(c - 700) for c in range(n, 2_000, 2)).encode()).hexdigest() for n in (0, 1)}


# ---------------------------------------------------------------- URL templates


def plain_parts(url):
    before, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r[0].split("/", 1)[0] or host.endswith("." + r[0].split("/", 1)[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def plain_shape(segment):
    runs = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", segment))
    words = re.sub(r"a(?:[-_+ ][a9]+)+", "a-a", runs)
    return "{" + ("*" if len(words) > 16 else words) + "}"


def plain_verdicts(urls, grown):
    """The tree by dictionaries: {(host, path): (template, verdict of the method)}."""
    pages = Counter(plain_parts(u) for u in urls)
    verdict = {p: plain_rule(*p)[1] for p in pages}
    bad, good = ({p: n if verdict[p] == v else 0 for p, n in pages.items()} for v in ("block", "allow"))
    segments = {p: p[1].split("/")[1:] for p in pages}
    segments = {p: s if len(s) <= grown.levels else [*s[: grown.levels], "**"] for p, s in segments.items()}
    node = {p: "" for p in pages}

    def side(own, n, rest, m):
        if n == 0 or m == 0:
            return 0
        bound = math.sqrt(0.5 * math.log(2 / grown.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return (own / n - rest / m > bound) - (own / n - rest / m < -bound)

    for level in range(max(map(len, segments.values()))):
        below = defaultdict(list)
        for p, s in segments.items():
            if len(s) > level:
                below[p[0], node[p]].append(p)
        for at, own in below.items():
            seen = Counter()
            for p in own:
                seen[segments[p][level]] += pages[p]
            new = sum(n == 1 for n in seen.values()) / (sum(seen.values()) + 2) > grown.variable
            token = {s: plain_shape(s) if new and n < grown.support else s for s, n in seen.items()}
            sums = defaultdict(lambda: np.zeros(5, int))
            for p in own:
                s = segments[p]
                more = len(s) > level + 1 and re.fullmatch("[0-9]+", s[level + 1])
                sums[token[s[level]]] += np.array([pages[p], bad[p], good[p], pages[p] * (len(s) == level + 1), pages[p] * bool(more)])
            total = sum(sums.values())
            sides = {}
            for t, x in sums.items():
                (n, b, g, e, k), (rn, rb, rg, re_, rk) = x.tolist(), (total - x).tolist()
                sides[t] = (side(e, n, re_, rn), side(k, n, rk, rn), side(b + g, n, rb + rg, rn), side(b, b + g, rb, rb + rg))
            alike = defaultdict(list)
            for t, x in sides.items():
                alike[x].append(t)
            name = {t: min(ts, key=lambda z: z.encode()) + ("~" if len(ts) > 1 else "") for ts in alike.values() for t in ts}
            for p in own:
                node[p] = at[1] + "/" + name[token[segments[p][level]]]
    b, g = Counter(), Counter()
    for p in pages:
        b[p[0], node[p]] += bad[p]
        g[p[0], node[p]] += good[p]
    base = min(0.5, sum(bad.values()) / max(sum(bad.values()) + sum(good.values()), 1))
    purity = lambda k: (b[k] + grown.prior * base) / (b[k] + g[k] + grown.prior)
    return {p: (node[p], "block" if purity((p[0], node[p])) >= grown.purity else "allow") for p in pages}


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")


def check_verdicts(spark, urls, grown=Growth()):
    wanted = plain_verdicts(urls, grown)
    got = {r.page_id: r for r in judge_urls(pages(spark, urls).repartition(3), grown=grown).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        p, r = plain_parts(u), got[i]
        rule, verdict = plain_rule(*p)
        assert (r.host, r.path, r.rule, r.verdict, r.template) == (*p, rule, verdict or wanted[p][1], wanted[p][0]), u
    return got


def test_verdicts_equal_plain_version(spark):
    rng = random.Random(1)
    hosts = ["a.example.com", "www.example.com", "shop.net", "b.shop.net", "x.org"]
    word = lambda: rng.choice([str(rng.randrange(900)), f"{rng.randrange(900)}.html", "en", "es", "fr", "de", f"post-{rng.randrange(99)}-on-tax", "Über", "", "tag"])
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/" + "/".join(word() for _ in range(rng.randrange(4))) + rng.choice(["", "?q=1", "#top"]) for _ in range(700)]
    check_verdicts(spark, urls + urls[:40])


def test_method_rejects_templates_of_blocked_pages(spark):
    """Where a language's pages are blocked, its pages under another name that look alike go with them; others stay."""
    urls = [f"http://s.net/{lang}/{i}/x" for lang in ("es", "fr") for i in range(60)] + [f"http://s.net/en/{i}" for i in range(60)] + [f"http://q.org/en/{i}" for i in range(30)]
    got = check_verdicts(spark, urls)
    assert {got[i].verdict for i in range(120, 210)} == {"allow"}
    mixed = [f"http://s.net/{lang}/{i}" for lang in ("es", "fr") for i in range(60)] + ["http://s.net/", "http://s.net/e/5"]
    got = check_verdicts(spark, mixed)
    assert got[121].verdict == "block" and got[121].template == got[0].template and got[121].rule is None


def test_verdicts_awkward(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.com", "http://example.com/", "HTTP://User@Example.COM:80/en/x?y://z", "a://b://c/d", "http://net/es/", "http://xnet/es/", "http://ÄÖ.net/fr/1\n2", "http://www.example.com/en/" + "a/" * 3_000, "http://q.org/" + "z" * 100_000, "http://q.org?x", "http://q.org#/en/"] * 2
    short = Growth(levels=3)
    check_verdicts(spark, urls, short)
    frame = pages(spark, urls).withColumn("page_id", F.when(F.col("page_id") > 2, F.col("page_id")))
    clashing = frame.select("*", *(F.lit("x").alias(c) for c in (*CLASHES, "host", "path", "pages", "bad", "good", "node", "segments", "fit", "template", "rule", "verdict")))
    assert judge_urls(clashing, grown=short).count() == len(urls)
    assert judge_urls(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_whitening(vectors, k=4):
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors], dtype=object)
    fit = sorted({tuple(v) for v in x.tolist()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x.tolist()]
    rows = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    covariance = rows.T @ rows / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    own = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x.tolist()])
    return n, deviation, own @ axes / np.sqrt(values), values / np.trace(covariance)


def test_whitening_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(150, 7)) * [5, 4, 3, 2, 1, 1, 1] + 2).tolist()
    vectors += vectors[:60] + [vectors[0]] * 40
    got = whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], VECTORS).repartition(5)).toPandas()
    n, deviation, white, share = plain_whitening(vectors)
    assert n == 150 and len(got) == 4 * len(vectors) and set(got["n"]) == {n}
    for c, own in got.sort_values("vec_id").groupby("component"):
        assert own["deviation"].tolist() == deviation
        sign = np.sign(own["whitened"].iloc[0] * white[0, c - 1])
        assert np.allclose(own["whitened"] * sign, white[:, c - 1], atol=1e-9)
        assert np.allclose(own["explained"], share[c - 1], rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_whitening_awkward(spark):
    odd = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (None, [-0.001, 4.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [1.0, float("nan")], 1), (5, [float("inf"), 0.0], 1), (6, [3.0], 1), (7, [], 1)]
    clashing = spark.createDataFrame(odd, VECTORS).select("*", *(F.lit("x").alias(c) for c in (*CLASHES, "x", "component", "whitened", "deviation")))
    got = whiten(clashing).toPandas()
    assert Counter(got["vec_id"].fillna(-1)) == {0: 4, -1: 2, 6: 2, 7: 2}
    n, deviation, *_ = plain_whitening([[1.0, 2.0], [-0.001, 4.0], [3.0, 0.0], [0.0, 0.0]])
    assert sorted(got["deviation"]) == sorted(2 * [deviation[0]] * 2 + 2 * deviation[1:]) and n == 4
    none = whiten(clashing.limit(0))
    assert none.count() == 0 and none.columns == got.columns.tolist()
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, VECTORS)).toPandas()
    assert len(one) == 6 and one["whitened"].isna().all() and set(one["deviation"]) == {0} and set(one["identity_error"]) == {0.0}
    flat = whiten(spark.createDataFrame([(i, [float(i), 1.0, 2.0], 0) for i in range(5)], VECTORS)).toPandas()
    assert flat[flat.component == 1]["whitened"].notna().all() and flat[flat.component > 1]["whitened"].isna().all()
    assert whiten(spark.createDataFrame([(1, [], 0)], VECTORS)).count() == 0


def test_whitening_of_huge_entries(spark):
    got = whiten(spark.createDataFrame([(1, [3.0e16, 1.0], 0), (2, [-3.0e16, 2.0], 0), (3, [1.0e38, 3.0], 0)], VECTORS)).toPandas()
    assert len(got) == 6 and got[got.component == 1]["whitened"].notna().all()


def test_registered_queries_over_the_smallest_tables(spark):
    from ledgermesh.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    found = spark.read.parquet(f"{sf}/conversations.parquet")
    assert sorted(tuple(r[c] for c in OUT) for r in queries()["op11_prefix_trie"](spark, sf).collect()) == sql_rows(found)
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert queries()["op12_url_templates"](spark, sf).count() == len(urls)
    assert queries()["op13_whitening"](spark, sf).count() == 4 * spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    from .helpers import empty, labels

    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
