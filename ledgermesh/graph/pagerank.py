"""PageRank variants along directed edges, in rounds.

A vertex sends to each target; what it sends, and when, makes the variant. In the default mode a silent vertex sends nothing, as the
message-passing original has it; with standard=True every vertex sends in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.graph.core import vertices_of
from ledgermesh.graph.layout import lay_out
from ledgermesh.graph.pregel import pregel
from ledgermesh.operators.skew import join_unique
from ledgermesh.session import stored

RESET = 0.15


def _stored_edges(edges: DataFrame, weighted: bool) -> DataFrame:
    """The edges computed once: vertices, their number and factors are all taken from them."""
    return stored(edges.select("src", "dst", *(["weight"] if weighted else [])))


def _factors(edges: DataFrame, kind: str) -> DataFrame:
    """src, dst, factor: 1 / out-degree, weight / out-degree, or weight / sum of out-weights."""
    value = {"one": 1 / F.col("_degree"), "weight": F.expr("try_divide(weight, _degree)"), "weight_share": F.expr("try_divide(weight, _weights)")}[kind]
    sums = [F.sum("weight").alias("_weights")] if kind == "weight_share" else []
    by = edges.groupBy("src").agg(F.count("*").alias("_degree"), F.count("*").alias("_n"), *sums)
    return join_unique(edges, by, ["src"], "_n", edges.count()).select("src", "dst", value.cast("double").alias("factor"))


def _ids(vertices: DataFrame | None, edges: DataFrame) -> DataFrame:
    return vertices_of(edges) if vertices is None else vertices.select("id").union(vertices_of(edges)).distinct()


def _run(vertices: DataFrame | None, edges: DataFrame, kind: str, start: dict, what: str, send: str, update: dict, rounds: int, standard: bool) -> DataFrame:
    ids = _ids(vertices, edges)
    factors = lay_out(_factors(edges, kind))

    def messages(state: DataFrame) -> DataFrame:
        senders = state.filter("active" if standard else f"active and {send}").select(F.col("id").alias("src"), F.col(what).alias("_value"))
        return factors.receive(senders).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("_value") * F.col("factor")).alias("m"))

    state = ids.select("id", *(F.lit(v).cast("double").alias(c) for c, v in start.items()), F.lit(True).alias("active"))
    out = pregel(state, messages, update, rounds, every_vertex_active=standard).select("id", F.col("pr").alias("rank"))
    factors.drop()
    return out


def static_pagerank(edges: DataFrame, rounds: int, vertices: DataFrame | None = None, reset: float = RESET, standard: bool = False) -> DataFrame:
    """id, rank after so many rounds of reset + (1 - reset) * sum(rank / out-degree)."""
    update = {"pr": F.lit(reset) + (1 - reset) * F.coalesce("m", F.lit(0.0))}
    return _run(vertices, _stored_edges(edges, False), "one", {"pr": reset}, "pr", "true", update, rounds, standard)


def delta_pagerank(edges: DataFrame, tolerance: float, rounds: int = 200, weighted: bool = False, vertices: DataFrame | None = None, reset: float = RESET) -> DataFrame:
    """id, rank until no change beyond the tolerance is left to hand on: vertices send their changes only.

    weighted: edges carry weight, which is divided by the out-degree (weights over 1 can grow without end: rounds bounds that).
    """
    gain = (1 - reset) * F.col("m")
    update = {"pr": F.col("pr") + gain, "delta": gain}
    return _run(vertices, _stored_edges(edges, weighted), "weight" if weighted else "one", {"pr": reset, "delta": reset}, "delta", f"delta > {tolerance!r}", update, rounds, False)


def modified_pagerank(edges: DataFrame, tolerance: float, rounds: int = 200, weighted: bool = False, vertices: DataFrame | None = None, reset: float = RESET, standard: bool = False) -> DataFrame:
    """id, rank with reset / N as base: a vertex takes reset / N + (1 - reset) * sum(rank * factor) of the sources that still change.

    weighted: the factor is the edge's share of its source's out-weights. Vertices without a message keep reset / N + reset.
    standard: all sources send in every round, so the value is the formula's own.
    """
    edges = _stored_edges(edges, weighted)
    total = _ids(vertices, edges).count()
    base = reset / max(total, 1)
    new = F.lit(base) + (1 - reset) * F.coalesce("m", F.lit(0.0))
    update = {"pr": new, "delta": new - F.col("pr")}
    return _run(vertices, edges, "weight_share" if weighted else "one", {"pr": base + reset, "delta": base + reset}, "pr", f"delta > {tolerance!r}", update, rounds, standard)
