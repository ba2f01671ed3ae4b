"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a neighbour graph is cut into balanced parts and a small network learns to tell the part of
a vector. All rows are indexed under their likeliest part; a query goes to its most probable parts, as many as a
recall measured on the sample asks for, and is ranked there against the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows at most on which partitions and network are fitted, by the smallest hashes of vec_id.
SAMPLE = 16_000
#: Rows of the sample that a part has at least, and sample rows that are kept from fitting to measure recall on.
PART_ROWS = 64
MEASURED = 400
GRAPH_NEIGHBOURS = 10
HIDDEN = 64
EPOCHS = 12
#: Recall at the number of neighbours that the choice of the probed parts aims at, on the sample.
AIM = 0.97
#: Rows, and queries, of one block that are scored together.
BLOCK_ROWS = 4_096


# ---------------------------------------------------------------- fitting


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row, the k other rows of largest inner product."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int64)
    for a in range(0, n, 256):
        s = x[a : a + 256] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[a : a + 256]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Part of each row: medians of principal directions to begin with, then moves towards the neighbours' parts within the capacity."""
    n = len(x)
    part = np.zeros(n, np.int64)
    groups = [np.arange(n)]
    while len(groups) < parts:
        nxt = []
        for g in groups:
            c = x[g] - x[g].mean(axis=0)
            axis = np.linalg.svd(c[: min(len(c), 2048)], full_matrices=False)[2][0] if len(c) > 1 else np.zeros(x.shape[1])
            order = g[np.argsort(c @ axis, kind="stable")]
            nxt += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = nxt
    for i, g in enumerate(groups):
        part[g] = i
    both = np.concatenate([np.column_stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()]), np.column_stack([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])])
    most = int(np.ceil(n / len(groups) * slack))
    for _ in range(rounds):
        votes = np.zeros((n, len(groups)), np.int64)
        np.add.at(votes, (both[:, 0], part[both[:, 1]]), 1)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=len(groups))
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < most:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if moved < n / 500:
            break
    return part


class Router:
    """One hidden layer and a softmax over the parts."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, parts: int, seed: int = 7) -> Router:
        rng = np.random.default_rng(seed)
        scale = np.sqrt((x**2).sum(axis=1).mean()) or 1.0
        w = [rng.normal(0, 2.0 / scale, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, parts)), np.zeros(parts)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 256):
                i = order[a : a + 256]
                hidden = np.maximum(x[i] @ w[0] + w[1], 0)
                z = hidden @ w[2] + w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(i)), part[i]] -= 1
                p /= len(i)
                back = (p @ w[2].T) * (hidden > 0)
                step += 1
                for k, g in enumerate([x[i].T @ back, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return cls(w)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the most probable first."""
        w = self.weights
        return np.argsort(-(np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]), axis=1, kind="stable")


def parts_for(rows: int, sample: int) -> int:
    """A power of two: half the root of the rows, as far as the sample has PART_ROWS for each."""
    return 1 << max(0, min(int(np.sqrt(rows) / 2), sample // PART_ROWS).bit_length() - 1)


def fit_index(x: np.ndarray, k: int, parts: int, aim: float = AIM) -> tuple[Router, int]:
    """The router and the number of parts to probe: the fewest with the aimed recall of k neighbours, for sample rows that neither partition nor router were fitted on."""
    parts = 1 << max(0, min(parts, max(1, len(x) // PART_ROWS)).bit_length() - 1)
    if parts < 2:
        return Router([np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)]), 1
    asked = np.arange(min(MEASURED, len(x) // 8))
    seen = x[len(asked) :]
    part = balanced_parts(seen, neighbour_graph(seen, GRAPH_NEIGHBOURS), parts)
    router = Router.fit(seen, part, parts)
    order = router.ranked(x)
    near = neighbour_graph_of(x, asked, k)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    needed = place[asked[:, None], order[:, 0][near]]
    recall = [(needed < m).mean() for m in range(1, parts + 1)]
    return router, int(next(m for m, r in enumerate(recall, 1) if r >= aim or m == parts))


def neighbour_graph_of(x: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
    s = x[which] @ x.T
    s[np.arange(len(which)), which] = -np.inf
    k = min(k, len(x) - 1)
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


# ---------------------------------------------------------------- search


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows with an id and a vector that is not null, empty or zero and holds finite numbers only."""
    v = F.col(column)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda c: c != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k rows of largest inner product with q, ties by smaller id, `own` left out. Products are added up in the order of the components, so equal vectors score equally."""
    score = np.zeros(len(x))
    for d in range(x.shape[1]):
        score += x[:, d] * q[d]
    keep = ids != own
    score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def top_of_block(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    """For each query its k best rows of the block. A matrix product finds what may be among them, and sums in order give the scores."""
    out_q: list[int] = []
    out_v: list[int] = []
    out_s: list[float] = []
    if not len(x):
        return out_q, out_v, out_s
    near = queries @ x.T
    wide = min(k + 1, len(x))
    cut = np.partition(near, len(x) - wide, axis=1)[:, len(x) - wide]
    margin = 1e-9 * (np.abs(queries).max(axis=1) * np.abs(x).max() * x.shape[1] + 1e-300)
    for i in range(len(queries)):
        may = np.flatnonzero(near[i] >= cut[i] - margin[i])
        v, s = best(queries[i], x[may], ids[may], int(query_ids[i]), k)
        out_q += [int(query_ids[i])] * len(v)
        out_v += v.tolist()
        out_s += s.tolist()
    return out_q, out_v, out_s


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, column: str = "embedding", parts: int | None = None, aim: float = AIM, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row whose vec_id is divisible by `every`.

    Nearness is the largest inner product, in double precision, ties by smaller vec_id; the query's own row (any row of its vec_id) is left out.
    Null, zero, empty and non-finite vectors and null ids take no part, nor do vectors of another length than the most frequent one.
    A query id that repeats is searched once, with the largest of its vectors. Equal rows are told apart by vec_id only. Fewer than k candidates: all of them.
    A query is asked of as many parts as hold k candidates, whatever the aim. parts: parts_for the rows by default.
    """
    rows = usable(vectors, column).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim, total = int(sizes["d"]), int(sizes["n"])
    rows = rows.filter(F.size("v") == dim)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()  # `sample` rows at most
    router, probes = fit_index(np.stack(drawn["v"].to_numpy()).astype(np.float64), k, parts or parts_for(total, len(drawn)), aim)
    weights = router.weights

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Router(weights)
        for batch in batches:
            if batch.num_rows:
                home = here.ranked(_matrix(batch.column("v"), dim))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column("vec_id"), batch.column("v")], names=["part", "vec_id", "v"])

    shape = "part int, vec_id long, v array<double>"
    index = rows.mapInArrow(at_home, shape)
    held = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each part

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Router(weights)
        for batch in batches:
            if batch.num_rows:
                order = here.ranked(_matrix(batch.column("v"), dim))
                inside = np.cumsum(np.array([held.get(p, 0) for p in range(order.shape[1])])[order], axis=1)
                short = inside < (k + batch.column("own").to_numpy())[:, None]  # the parts so far hold too few others
                width = np.minimum(np.maximum(short.sum(axis=1) + 1, probes), order.shape[1])
                again = np.repeat(np.arange(batch.num_rows), width)
                nth = np.arange(len(again)) - np.repeat(np.cumsum(width) - width, width)
                yield pa.RecordBatch.from_arrays([pa.array(order[again, nth].astype(np.int32)), batch.column("vec_id").take(pa.array(again)), batch.column("v").take(pa.array(again))], names=["part", "vec_id", "v"])

    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"), F.count("*").alias("own"))
    queries = asked.mapInArrow(routed, shape)
    posed = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = [(p, -(-held[p] // BLOCK_ROWS), -(-posed[p] // BLOCK_ROWS)) for p in held if posed.get(p)]
    if not blocks:
        return vectors.sparkSession.createDataFrame([], empty)
    plan = F.broadcast(vectors.sparkSession.createDataFrame(blocks, "part int, row_blocks long, query_blocks long"))
    h = F.xxhash64("vec_id")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    index = index.join(plan, "part").select("part", F.pmod(h, "row_blocks").alias("rb"), F.explode(spread("query_blocks")).alias("qb"), "vec_id", "v")
    queries = queries.join(plan, "part").select("part", F.explode(spread("row_blocks")).alias("rb"), F.pmod(h, "query_blocks").alias("qb"), "vec_id", "v")

    def search(q: pa.Table, x: pa.Table) -> pa.Table:
        q, x = q.combine_chunks(), x.combine_chunks()
        found: tuple[list, list, list] = ([], [], [])
        if q.num_rows and x.num_rows:
            xm, xi = _matrix(x.column("v").combine_chunks(), dim), x.column("vec_id").to_numpy()
            qm, qi = _matrix(q.column("v").combine_chunks(), dim), q.column("vec_id").to_numpy()
            for a in range(0, len(qm), 512):
                for into, new in zip(found, top_of_block(qm[a : a + 512], qi[a : a + 512], xm, xi, k), strict=True):
                    into.extend(new)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    keys = ["part", "rb", "qb"]
    hits = queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
