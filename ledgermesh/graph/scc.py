"""Strongly connected components by trimming, colouring and walking back; chains are followed by pointers that double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.graph.core import among, vertices_of
from ledgermesh.session import cut, discard, drop_cut, last_stored, stored

ROWS = 200_000


def _chase(steps: DataFrame) -> DataFrame:
    """id, to, low: where each chain of steps ends, and the smallest id on it. steps: id, to for every vertex; an end steps to itself.

    Pointers double in each round, so a chain of n steps takes log2 n rounds. A cycle of steps has no end: its vertices stop at one of them, with the
    whole cycle's smallest id.
    """
    # tables, not checkpoints: these hand on what is known of their columns, which doubles with each round's least()
    spark = steps.sparkSession
    state, path = stored(steps.select("id", "to", F.least("id", "to").alias("low"))), last_stored()
    left = state.filter("id <> to").count()
    rounds = left.bit_length()  # then each pointer has gone over every vertex that steps
    while left and rounds >= 0:
        onward = state.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))  # one row an id, so a join splits a hub's rows
        new, next_path = stored(state.join(onward, "to").select("id", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("_to") != F.col("to")).alias("moved"))), last_stored()
        left, rounds = new.filter("moved").count(), rounds - 1
        discard(spark, path)
        state, path = new.select("id", "to", "low"), next_path
    return state


def _neighbours(ids: DataFrame, edges: DataFrame, near: str, far: str) -> DataFrame:
    """id, n, one: how many edges have the id as `near`, and the smallest other end."""
    return ids.join(edges.groupBy(F.col(near).alias("id")).agg(F.count("*").alias("n"), F.min(far).alias("one")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "one")


def _only(known: DataFrame) -> DataFrame:
    return known.select("id", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("id")).alias("to"))


def _passed(edges: DataFrame) -> DataFrame:
    """id: vertices with edges in and edges out; no other is on a cycle."""
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")


def _trim(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without vertices that no cycle reaches or that reach none: chains go as a whole, from their ends."""
    size = -1
    while size != (size := ids.count()) and size:
        for near, far in (("dst", "src"), ("src", "dst")):
            known = cut(_neighbours(ids, edges, near, far), ROWS)
            bare = known.filter("n = 0")
            if not bare.isEmpty():
                ends = _chase(_only(known))
                ids = cut(ends.join(bare.select(F.col("id").alias("to")), "to", "left_anti").select("id"), ROWS)
                edges = cut(among(edges, ids), ROWS)
    return ids, edges


def _colour(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, colour: the smallest id that reaches the vertex.

    A vertex with one edge in is reached by what reaches that edge's source, so chains of these are followed by doubling pointers, and
    rounds go only over vertices with more edges in.
    """
    known = cut(_neighbours(ids, edges, "dst", "src"), ROWS)
    chains = _chase(_only(known))
    heads = known.filter("n > 1").select(F.col("id").alias("dst"))
    ends = chains.select(F.col("id").alias("src"), F.col("to").alias("_from"), "low")
    step = cut(edges.join(heads, "dst", "left_semi").join(ends, "src").groupBy(F.col("_from").alias("src"), "dst").agg(F.min("low").alias("low")), ROWS)
    state = cut(chains.join(chains.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select("id", F.col("low").alias("colour")), ROWS)
    while True:
        least = step.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.least("colour", "low")).alias("m"))
        new = cut(state.join(least, "id", "left").select("id", F.least("colour", "m").alias("colour"), (F.col("m") < F.col("colour")).alias("moved")), ROWS)
        drop_cut(state)
        state = new
        if new.filter("moved").isEmpty():
            break
    return cut(chains.join(state.select(F.col("id").alias("to"), "colour"), "to").select("id", F.least("low", "colour").alias("colour")), ROWS)


def _back(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """id, colour of the vertices that reach their colour's root within the colour. Chains of one edge out are followed by doubling pointers."""
    own = colours.select(F.col("id").alias("src"), F.col("colour"))
    inner = cut(edges.join(own, "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("_c")), "dst").filter("colour = _c").select("src", "dst").distinct(), ROWS)
    known = cut(_neighbours(colours.filter("id <> colour").select("id"), inner, "src", "dst"), ROWS)
    roots = colours.filter("id = colour").select("id", F.col("id").alias("to"))
    ends = _chase(_only(known).union(roots))
    to = ends.select(F.col("id").alias("dst"), F.col("to").alias("_to"))
    forks = cut(inner.join(known.filter("n > 1").select(F.col("id").alias("src")), "src", "left_semi").join(to, "dst").select("src", F.col("_to").alias("dst")).distinct(), ROWS)
    found = cut(roots.select("id"), ROWS)
    fresh = found
    while not fresh.isEmpty():
        fresh = cut(forks.join(fresh.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(found, "id", "left_anti"), ROWS)
        found = cut(found.union(fresh), ROWS)
    return cut(ends.join(found.select(F.col("id").alias("to")), "to", "left_semi").join(colours, "id").select("id", "colour"), ROWS)


def strong_components(edges: DataFrame, iterations: int, vertices: DataFrame | None = None) -> DataFrame:
    """id, component: the smallest id of the strongly connected component; vertices that so many iterations don't resolve keep their own id."""
    edges = stored(edges.select("src", "dst"))  # what makes the edges runs once
    ids = cut(vertices_of(edges) if vertices is None else vertices.select("id").union(vertices_of(edges)).distinct(), ROWS)
    left, live = ids, cut(edges.select("src", "dst").filter("src <> dst").distinct(), ROWS)  # a loop joins nothing
    done = None
    if left.count() > (passed := cut(_passed(live), ROWS)).count():  # in a graph from one side to another nothing is left, and chains needn't be followed
        left = passed
        live = live.limit(0) if left.isEmpty() else cut(among(live, left), ROWS)
    for _ in range(iterations):
        left, live = _trim(left, live)
        if left.isEmpty():
            break
        found = _back(_colour(left, live), live)
        done = found if done is None else cut(done.union(found), ROWS)
        left = cut(left.join(found, "id", "left_anti"), ROWS)
        live = cut(among(live, left), ROWS)
    if done is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(done, "id", "left").select("id", F.coalesce("colour", "id").alias("component"))
