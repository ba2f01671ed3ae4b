"""Label propagation: each edge carries labels both ways, and a vertex takes the most frequent one; ties go to the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.graph.core import vertices_of
from ledgermesh.graph.layout import lay_out
from ledgermesh.graph.pregel import pregel
from ledgermesh.session import dealt, discard, last_stored, stored


def propagate_labels(edges: DataFrame, rounds: int, sends: str = "always", vertices: DataFrame | None = None) -> DataFrame:
    """id, label after so many rounds, or once nothing is sent.

    sends: 'always'; 'changed', while a vertex's label differs from its last one; 'changed_twice', while it differs from the
    one before the last, which damps cycles of two. The last labels are 0 to begin with, so a vertex 0 is silent at first. A vertex
    without a message keeps all it has. Labels often end in swapping for ever: a state that was there before ends the rounds early, with
    the labels that all of them would give.
    """
    edges = stored(edges.select("src", "dst"))
    held = last_stored()
    ids = vertices_of(edges) if vertices is None else vertices.select("id").union(vertices_of(edges)).distinct()
    both = lay_out(edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    may = {"always": "true", "changed": "label <> last", "changed_twice": "label <> last2"}[sends]

    def messages(state: DataFrame) -> DataFrame:
        # an edge may send if either of its ends got a message: votes are summed for both cases before the receiver's own state is asked
        senders = state.filter(may).select(F.col("id").alias("src"), F.col("label").alias("_label"), F.col("active").alias("_sender"))
        votes = both.receive(senders).groupBy("dst", "_label").agg(F.count("*").alias("_all"), F.count_if("_sender").alias("_some"))
        votes = votes.join(state.select(F.col("id").alias("dst"), "active"), "dst").withColumn("_n", F.when(F.col("active"), F.col("_all")).otherwise(F.col("_some")))
        return votes.filter("_n > 0").groupBy(F.col("dst").alias("id")).agg(F.max_by("_label", F.struct("_n", -F.col("_label"))).alias("m"))

    state = ids.select("id", F.col("id").alias("label"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("last2"), F.lit(True).alias("active"))
    update = {"label": F.col("m"), "last": F.col("label"), "last2": F.col("last")}
    with dealt(edges.sparkSession, both.total):  # there may be as many votes as edges
        out = pregel(state, messages, update, rounds, repeats=True).select("id", "label")
    both.drop()
    discard(edges.sparkSession, held)
    return out
