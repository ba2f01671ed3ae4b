"""F1 pipeline: an executor starts processes for each file that it writes, so small tables are few files however many partitions shuffles have."""

from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgermesh import session
from ledgermesh.graph.components import component_members
from ledgermesh.llm.near_dedup import near_duplicates
from ledgermesh.llm.pii import _by, scored_graph


def files_of(run):
    """What run() gives, and how many files with rows it leaves in the checkpoint folder."""
    at = Path(urlparse(session.checkpoints(SparkSession.active())).path)
    listed = lambda: {p for p in at.rglob("part-*") if ".crc" not in p.name}
    before = listed()
    return run(), len(listed() - before)


@pytest.fixture
def many_parts(spark):
    """Shuffles have 40 partitions, however few rows there are."""
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


def test_small_tables_are_not_a_file_for_each_shuffle_partition(many_parts):
    edges = many_parts.range(300).select((F.col("id") % 100).alias("src"), (F.col("id") % 100 + 1000).alias("dst")).distinct()
    got, files = files_of(lambda: {(r.id, r.component) for r in component_members(edges).collect()})
    assert got == {(i + 1000, i) for i in range(100)} and files == 2  # 41 before
    found = many_parts.createDataFrame([([f"p{i % 3}"], f"v{i}", "email") for i in range(30)], "patterns array<string>, value string, kind string")
    (patterns, values), files = files_of(lambda: scored_graph(found))
    assert files == 11 and patterns.count() == 3 and values.count() == 30  # 440 files before


def test_docs_are_dealt_into_few_files_by_near_duplicates(many_parts):
    text = " ".join(f"w{i}" for i in range(60))
    docs = many_parts.createDataFrame([(i, text + f" end{i}") for i in range(30)] + [(100 + i, f"other {i} text {i * 7} of {i * 11} its own {i}") for i in range(30)], "doc_id long, text string")
    got, files = files_of(lambda: {r.doc_id for r in near_duplicates(docs).filter("kept").collect()})
    assert got == {0, *range(100, 130)} and files < 100  # 227 before


def test_gathered_rows_are_whole_and_a_cached_table_stays_cached(many_parts):
    rows = many_parts.range(1000).repartition(40, "id")
    kept = session.gathered(rows, 300)
    assert kept.rdd.getNumPartitions() == 4 and sorted(r.id for r in kept.collect()) == list(range(1000))
    assert not rows.storageLevel.useDisk and session.gathered(rows.filter("id < 0"), 300).count() == 0
    rows.cache()
    assert session.gathered(rows, 300).count() == 1000 and rows.storageLevel.useMemory
    rows.unpersist()


def test_salted_joins_are_not_broadcast(many_parts):
    known = many_parts.createDataFrame([("p", 1.0)], "pattern string, confidence double")
    joined = _by(many_parts.createDataFrame([("p", f"v{i}") for i in range(50)], "pattern string, value string"), known, "pattern", "value")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 50
