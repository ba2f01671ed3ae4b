"""Degrees, subgraphs, pruning and merging of parallel edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE_DEGREES = 2


def ends(edges: DataFrame) -> DataFrame:
    """The ids of both ends of every edge, once for each end."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def vertices_of(edges: DataFrame) -> DataFrame:
    return ends(edges).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree of every vertex with an edge; a loop counts twice."""
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))


def with_attribute(vertices: DataFrame, attributes: DataFrame, **defaults) -> DataFrame:
    """vertices with the columns of attributes by id; the defaults where a vertex has none."""
    out = vertices.join(attributes, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def triplets(vertices: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """edges with the named vertex columns of both ends, as src_<c> and dst_<c>."""
    side = lambda end: vertices.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def among(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges with both ends among the vertices."""
    src, dst = (vertices.select(F.col("id").alias(end)) for end in ("src", "dst"))
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select(*edges.columns)


def subgraph(vertices: DataFrame, edges: DataFrame, vertex: Column | None = None, edge: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges that satisfy the predicates; an edge goes with either of its ends."""
    if vertex is not None:
        vertices = vertices.filter(vertex)
        edges = among(edges, vertices)
    return vertices, edges if edge is None else edges.filter(edge)


def core(edges: DataFrame, literal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, degree) and edges without isolated single edges: an edge stays if the degrees of its ends sum up to more than 2.

    One pass; degrees are counted anew on what stays. literal: the source's degree is taken for both ends.
    """
    known = degrees(edges)
    rows = triplets(known, edges, "degree")
    other = "src_degree" if literal else "dst_degree"
    kept = rows.filter(F.col("src_degree") + F.col(other) > CORE_DEGREES).select(*edges.columns)
    return degrees(kept), kept


def merge_parallel(edges: DataFrame, **sums: str) -> DataFrame:
    """One edge for each (src, dst), with the number of its parallel edges and sums of columns (name=column)."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))


def out_weights(edges: DataFrame, weight: str = "weight") -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum(weight).alias("out_weight"))


def counts(vertices: DataFrame, edges: DataFrame) -> tuple[int, int]:
    return vertices.count(), edges.count()
