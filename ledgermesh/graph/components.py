"""Connected components on an edge DataFrame, by contraction within partitions and large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.operators.skew import join_unique
from ledgermesh.session import drop_cut, gathered


def _contract(edges: DataFrame) -> DataFrame:
    """(src, dst) with the same components: each node of a partition's edges, and the smallest node it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while x != top:
                parent[x], x = top, parent.get(x, x)
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["src", "dst"])

    return edges.mapInArrow(run, "src long, dst long")


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """most: not fewer than the edges both ways. A hub's edges stay where they are, its smallest neighbour comes to them."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"), F.count("*").alias("_n"))
    return join_unique(both.filter("dst > src"), least, ["src"], "_n", most).select(F.col("dst").alias("src"), F.col("least").alias("dst")).filter("src <> dst")


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"), F.count("*").alias("_n"))
    moved = join_unique(down, least, ["src"], "_n", most).select(F.col("dst").alias("src"), F.col("least").alias("dst")).filter("src <> dst")
    return moved.union(least.select("src", "least")).distinct()


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("src", "dst")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 30)))).first())


#: Edges that one task contracts in its memory.
CONTRACTED = 250_000


def component_members(edges: DataFrame, max_rounds: int = 100, contracted: int = CONTRACTED) -> DataFrame:
    """(id, component) of each node of an edge that isn't its component's smallest one.

    edges: src, dst (long). Nulls and loops are left out, and direction and repeats don't matter.
    Edges are contracted in tasks of about `contracted` rows first; what several tasks hold is then joined by
    rounds that cut their lineage.
    """
    edges = gathered(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst"), contracted)
    tasks = edges.rdd.getNumPartitions()
    state = gathered(_contract(edges), contracted)
    before = None if tasks == 1 else _mark(state)  # one task has seen every edge
    for _ in range(max_rounds):
        if before is None:
            break
        most = 2 * before[0]
        wide = gathered(_large_star(state, most), contracted)
        held, state = state, gathered(_small_star(wide, most), contracted)
        drop_cut(held, wide)
        now = _mark(state)
        before = None if now == before else now
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    return state.select(F.col("src").alias("id"), F.col("dst").alias("component"))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex: the smallest id that it reaches, whatever the edges' direction.

    vertices: id; ids that only edges name are added.
    """
    ids = vertices.select(F.col("id").cast("long").alias("id")).union(edges.select("src")).union(edges.select("dst")).filter("id is not null").distinct()
    return ids.join(component_members(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
