"""Composite pipelines: transfer graphs, merchant rankings, fraud selection, clustering and forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.functions.scalars import bkdr_hash, md5_long
from ledgermesh.graph.components import connected_components
from ledgermesh.graph.core import core, vertices_of, with_attribute
from ledgermesh.graph.pagerank import modified_pagerank
from ledgermesh.graph.scc import strong_components
from ledgermesh.ml.features import k_means, normalise
from ledgermesh.operators.relational import account_vertices, fraud_transactions, grouped_edges, min_max_weights, transfer_sums, transition_stats, with_names, z_score_weights
from ledgermesh.session import stored
from ledgermesh.sources import loaders, sinks
from ledgermesh.sources.schema import USED

TOLERANCE, ROUNDS, BEST = 0.001, 1000, 500


def transfer_vertex_count(transfers: DataFrame) -> int:
    """How many accounts take part in transfers."""
    return account_vertices(transfer_sums(transfers)).count()


def transfer_graph(transfers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, account) and edges (src, dst, money) of the summed transfers."""
    sums = transfer_sums(transfers)
    return account_vertices(sums), sums.select(bkdr_hash("srccard").alias("src"), bkdr_hash("dstcard").alias("dst"), "money")


def transfer_strong_components(transfers: DataFrame, iterations: int = 2) -> DataFrame:
    """id, component on the transfer graph without isolated edges."""
    _, edges = transfer_graph(transfers)
    return strong_components(core(stored(edges.select("src", "dst")))[1], iterations)


def component_sizes(vertices: DataFrame, edges: DataFrame, strong: int = 0) -> DataFrame:
    """vertices with component and size, by connected components, or by strong ones in so many iterations."""
    ids = vertices.select("id")
    labels = strong_components(edges, strong, ids) if strong else connected_components(ids, edges)
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    return vertices.join(labels.join(sizes, "component", "left"), "id", "left")


def merchant_edges(transitions: DataFrame) -> DataFrame:
    """transition_stats with merchants as digests' numbers, for numeric graph ids."""
    return transition_stats(transitions.select("card", md5_long("mchnt").alias("mchnt"), md5_long("last_mchnt").alias("last_mchnt"), "time_diff"))


def merchant_ranks(transitions: DataFrame, names: DataFrame | None = None, parts: tuple[str, ...] = ("n", "cards", "time"), tolerance: float = TOLERANCE, rounds: int = ROUNDS, hashed: bool = True) -> DataFrame:
    """id, rank (and name) of merchants on the pruned graph of weighted transitions.

    parts: ('n',) for ranks by counts only. names: mchnt, name. hashed=False: merchants are numbers already.
    """
    stats = merchant_edges(transitions) if hashed else transition_stats(transitions)
    edges = core(min_max_weights(stats, parts))[1]
    ranks = modified_pagerank(edges, tolerance, rounds, weighted=True)
    if names is None:
        return ranks
    return with_names(ranks, names.select((md5_long("mchnt") if hashed else F.col("mchnt")).alias("_mchnt"), "name"), "_mchnt")


def write_best(ranks: DataFrame, path: str, k: int = BEST) -> None:
    """The k highest and the k lowest ranks, each as one file named by its order."""
    sinks.write_top(ranks, k, f"{path}_DESC", F.desc("rank"), F.asc("id"))
    sinks.write_top(ranks, k, f"{path}_ASC", F.asc("rank"), F.asc("id"))


def export_weights(transitions: DataFrame, path: str) -> None:
    sinks.write_edges(min_max_weights(merchant_edges(transitions)), path)


def z_score_edges(transitions: DataFrame, literal: bool = False) -> DataFrame:
    """Weighted edges from the current to the last merchant, the other way than min_max_weights."""
    weights = z_score_weights(merchant_edges(transitions), literal)
    return weights.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def frequent_transitions(transitions: DataFrame, more_than: int = 2) -> DataFrame:
    return grouped_edges(transitions, more_than)


def extract_fraud(spark: SparkSession, fraud_path: str, days: dict[str, str], names: list[str] | str, out: str, fraud_type: str = "04") -> DataFrame:
    """Fraud cards and transactions of a type, written as lines under `out`; the transactions' filled columns."""
    first, last = min(days), max(days)
    fraud = loaders.fraud_list(spark, fraud_path, first, last)
    sinks.write_lines(fraud.filter(F.col("fraud_tp") == fraud_type).select("pri_acct_no_conv").distinct(), "pri_acct_no_conv", f"{out}/cards")
    rows = loaders.filled(loaders.split_codes(loaders.raw_days(spark, days, names)))
    found = fraud_transactions(fraud, rows, fraud_type, columns=[f"{c}_filled" for c in USED if f"{c}_filled" in rows.columns])
    sinks.write_rows(found, f"{out}/transactions")
    return found


def cluster_components(features: DataFrame, k: int = 2, seed: int = 1) -> tuple[DataFrame, list, float]:
    """K-means on vectors of norm 1."""
    return k_means(normalise(features, 2.0), k, seed, "normed")


def graph_with_degrees(edges: DataFrame) -> DataFrame:
    """id, degree of the pruned graph, 0 for vertices that pruning takes away."""
    return with_attribute(vertices_of(edges), core(edges)[0], degree=0)
