"""Writers of lines, CSV and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions.scalars import joined_row


def write_lines(frame: DataFrame, column: str, path: str) -> None:
    """The values of one string column, a line each."""
    frame.select(column).write.text(path)


def write_rows(frame: DataFrame, path: str, sep: str = ",") -> None:
    """All columns as unquoted lines; nulls as the word null."""
    frame.select(joined_row(*(F.col(f"`{c}`") for c in frame.columns), sep=sep).alias("value")).write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """src,weight,dst lines."""
    edges.select(joined_row("src", "weight", "dst").alias("value")).write.text(path)


def top(frame: DataFrame, k: int, *order: Column) -> DataFrame:
    return frame.orderBy(*order).limit(k)


def write_top(frame: DataFrame, k: int, path: str, *order: Column) -> None:
    """The first k rows of an order in a single file: k is the feature."""
    top(frame, k, *order).coalesce(1).sortWithinPartitions(*order).select(joined_row(*frame.columns).alias("value")).write.text(path)


def write_days(frame: DataFrame, table: str, day: str, path: str | None = None) -> None:
    """frame as a catalog table with a folder for each day. Rows of a day meet in few tasks, so days are few files; a large day is split.
    A table of that name is replaced.

    path: where the files go, if not in the warehouse.
    """
    writer = frame.hint("rebalance", day).write.partitionBy(day).format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_csv(frame: DataFrame, path: str, header: bool = False) -> None:
    """Atomic columns as CSV."""
    frame.write.option("header", header).csv(path)


def console(frame: DataFrame, n: int = 20) -> None:
    frame.printSchema()
    frame.show(n)


def model_text(model, stage: int | None = None) -> str:
    """The trees of a fitted model, or of a stage of a pipeline model."""
    return (model if stage is None else model.stages[stage]).toDebugString
