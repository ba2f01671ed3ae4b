"""Edges kept in one layout through all rounds of a message-passing operator.

Edges are written once, in buckets by their source. A round brings the vertices' values to the buckets, so edges are never shuffled again; what
leaves a bucket is summed by target there first. A source with many edges is a hub: its edges are dealt out over pieces, which lie in
buckets of their own, and its value is sent to each piece.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.session import discard, stored_buckets

#: Pieces of a bucket: a piece has about a bucket's edges over this, so that buckets come out even however the edges lie.
PIECES = 32
#: Edges of a bucket at most, so that what a task sorts and sums doesn't grow with the graph.
BUCKET = 500_000


@dataclass
class EdgeLayout:
    """edges: src, _piece, dst and attributes, in buckets by (src, _piece). hubs: src, _pieces; PIECES rows for each bucket at most."""

    edges: DataFrame
    hubs: DataFrame
    path: str
    total: int

    def receive(self, values: DataFrame) -> DataFrame:
        """The edges with the columns of values (src, ...), by the edges' sources; edges of other sources don't come."""
        many = values.join(F.broadcast(self.hubs), "src", "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces") - 1, F.lit(0))))).drop("_pieces")
        return self.edges.join(many, ["src", "_piece"]).drop("_piece")

    def drop(self) -> None:
        discard(self.edges.sparkSession, self.path)


def lay_out(edges: DataFrame, buckets: int | None = None) -> EdgeLayout:
    """edges (src, dst, ...) in buckets; if no number is given, as many as shuffles have partitions, and more where these would hold over BUCKET edges each."""
    spark = edges.sparkSession
    degree = edges.groupBy("src").agg(F.count("*").alias("n"))
    total = degree.agg(F.sum("n")).first()[0] or 0
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    size = max(1, total // (buckets * PIECES))
    hubs = degree.filter(F.col("n") > size).select("src", F.ceil(F.col("n") / size).cast("int").alias("_pieces"))
    # a hub has more than a piece, so there are fewer hubs than pieces in all
    hubs = spark.createDataFrame(hubs.collect() if size > 1 else [], hubs.schema)
    dealt = edges.join(F.broadcast(hubs), "src", "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("dst"), "_pieces"), F.lit(0)).cast("int")).drop("_pieces")
    kept, path = stored_buckets(dealt, buckets, "src", "_piece")
    return EdgeLayout(kept, hubs, path, total)
