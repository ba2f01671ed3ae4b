"""Session settings that the library relies on."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir of the session, or a temporary one on a local master where it is unset."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ledgermesh-checkpoints-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame, rows: int = 0) -> DataFrame:
    """The rows of df, computed once and kept in the checkpoint folder, without their lineage.

    rows: gather them in partitions of about so many rows, so that a small table doesn't go on in many tasks.
    """
    checkpoints(df.sparkSession)
    kept = df.checkpoint()
    return kept.coalesce(max(1, -(-kept.count() // rows))) if rows else kept


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """As cut(df, rows), for rows whose order is nothing: they are counted and gathered before they are written.

    On a local or mounted file system without Hadoop's native library an executor starts two processes (chmod) for each file, each of which has all
    of the executor's memory for a moment; so a small table doesn't become a file for each shuffle partition. Until it is written it waits on the executors' disks.
    """
    checkpoints(df.sparkSession)
    level = df.storageLevel
    own = not (level.useDisk or level.useMemory)  # what the caller has cached stays so
    if own:
        df.persist(StorageLevel.DISK_ONLY)
    try:
        return df.coalesce(max(1, -(-df.count() // rows))).checkpoint()
    finally:
        if own:
            df.unpersist()


@contextlib.contextmanager
def dealt(spark: SparkSession, rows: int, each: int = 500_000) -> Iterator[None]:
    """Shuffles of what runs within have at least a partition for `each` of so many rows, so that a task's share doesn't grow with them.

    Where that is more than the session's number, small partitions are gathered up to 8 MB only: a sum of packed rows of 64 MB takes over 1 GB in a task.
    """
    tasks = tasks_for(spark, rows, each)
    wanted = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"} if tasks else {}
    held = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def tasks_for(spark: SparkSession, rows: int, each: int = 1_000_000) -> int:
    """Partitions that so many rows need beyond the number that shuffles have; 0 if that is enough."""
    tasks = -(-rows // each)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def drop_cut(*frames: DataFrame) -> None:
    """Delete the checkpoints of frames that cut() or gathered() gave and nothing will read again."""
    for df in frames:
        spark, rdd = df.sparkSession, df._jdf.queryExecution().logical()
        while rdd.children().nonEmpty():  # a coalesce stands above the kept rows
            rdd = rdd.children().head()
        kept = rdd.rdd().getCheckpointFile() if hasattr(rdd, "rdd") else None
        if kept is not None and kept.isDefined():
            _delete(spark, kept.get())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python where it isn't on the path that they inherit."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    inherited = {os.path.realpath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), ""]}
    if str(root) in inherited or app in _SHIPPED:
        return
    place = tempfile.mkdtemp(prefix="ledgermesh-package-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, place, True)
    path = os.path.join(place, "ledgermesh.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted((root / "ledgermesh").rglob("*.py")):
            out.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


@contextlib.contextmanager
def _tidied(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: the table has its rows, and without this they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written as a Parquet table in the checkpoint folder and read back: for wide rows, that cut() would keep uncompressed.

    The table goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoints(spark)}/table-{uuid.uuid4().hex}"
    with _tidied(spark):
        df.write.parquet(path)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stored_buckets(df: DataFrame, buckets: int, *columns: str) -> tuple[DataFrame, str]:
    """The rows of df as a table in the checkpoint folder, in sorted buckets by the columns, and its path: joins on these don't shuffle it.

    discard() drops it; else it goes when the driver's Python ends.
    """
    spark = df.sparkSession
    name = f"ledgermesh_{uuid.uuid4().hex}"
    path = f"{checkpoints(spark)}/{name}"
    with _tidied(spark):
        df.repartition(buckets, *columns).write.bucketBy(buckets, *columns).sortBy(*columns).format("parquet").option("path", path).saveAsTable(name)
    _remember(spark, path)
    _NAMED[path] = name
    return spark.table(name), path


_STORED: list[str] = []
_NAMED: dict[str, str] = {}


def _remember(spark: SparkSession, path: str) -> None:
    if not _STORED:
        atexit.register(_drop, spark)
    _STORED.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() or stored_buckets() wrote and nothing will read again."""
    _STORED.remove(path)
    if path in _NAMED:
        spark.sql(f"DROP TABLE IF EXISTS {_NAMED.pop(path)}")
    _delete(spark, path)


def size_on_disk(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a table that stored() wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def last_stored() -> str:
    """Path of the table that stored() wrote last."""
    return _STORED[-1]


def _drop(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        for path in _STORED:
            _delete(spark, path)
