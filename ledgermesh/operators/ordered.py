"""Row numbers and running sums over an order of the whole table, by range partitions: no key's rows meet in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.session import stored

_PART, _PLACE = "_part", "_place"


def _placed(frame: DataFrame, order: tuple[str | Column, ...]) -> DataFrame:
    """The sorted rows as a table, each with its partition's number and its place there.

    Both are written with the row, so they hold however often a task runs and however the table is cut when it is read.
    """
    rows = frame.orderBy(*order) if order else frame
    return stored(rows.withColumns({_PART: F.spark_partition_id(), _PLACE: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))


def _starts(held: DataFrame, value: Column) -> DataFrame:
    """_part, _first: the value's sum over all partitions before; a row for each partition."""
    sums = sorted((r[0], r[1] or 0) for r in held.groupBy(_PART).agg(F.sum(value)).collect())
    rows, total = [], 0
    for part, own in sums:
        rows.append((part, total))
        total += own
    return F.broadcast(held.sparkSession.createDataFrame(rows, f"{_PART} int, _first long"))


def numbered(frame: DataFrame, *order: str | Column, name: str = "at") -> DataFrame:
    """frame with numbers 0, 1, ... without gaps, in the order if one is given.

    Rows that the order doesn't tell apart stay in one task: end it with a column that does where they may be many.
    """
    held = _placed(frame, order)
    return held.join(_starts(held, F.lit(1)), _PART).select(*frame.columns, (F.col("_first") + F.col(_PLACE)).alias(name))


def running_sum(frame: DataFrame, value: str, *order: str | Column, name: str = "before") -> DataFrame:
    """frame with the sum of a whole-number column over all rows before the row in the order. A null counts as 0."""
    held = _placed(frame, order)
    own = F.coalesce(F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy(_PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_own", own).join(_starts(held, F.coalesce(value, F.lit(0))), _PART).select(*frame.columns, (F.col("_first") + F.col("_own")).alias(name))


def quantiles(frame: DataFrame, column: str, shares: list[float]) -> list[float]:
    """The exact quantiles of a number column, between two values in proportion, as percentile() gives them; the distinct values don't meet in one task."""
    counts = frame.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("m"))
    placed = running_sum(counts, "m", column)
    n = placed.agg(F.sum("m")).first()[0] or 0
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    places = frame.sparkSession.createDataFrame([(p,) for p in sorted({f(a) for a in at for f in (math.floor, math.ceil)})], "_at long")
    found = placed.join(F.broadcast(places), (F.col("_at") >= F.col("before")) & (F.col("_at") < F.col("before") + F.col("m")))
    value = {r["_at"]: float(r[column]) for r in found.collect()}
    low = [math.floor(a) for a in at]
    return [value[i] if a == i else (i + 1 - a) * value[i] + (a - i) * value[i + 1] for a, i in zip(at, low, strict=True)]


def with_previous(frame: DataFrame, columns: list[str], *order: str | Column, name: str = "previous") -> DataFrame:
    """frame with a struct of the columns of the row before in the order (null for the first row): a partition's first row takes the last one of
    the partition before, which is handed on as one row for each partition."""
    held = _placed(frame, order)
    own = F.struct(*columns)
    lasts = sorted(held.groupBy(_PART).agg(F.max_by(own, _PLACE).alias("last")).collect(), key=lambda r: r[_PART])
    schema = held.select(_PART, own.alias("_border")).schema
    border = held.sparkSession.createDataFrame([(b[_PART], a["last"]) for a, b in zip(lasts, lasts[1:], strict=False)], schema)
    inner = F.lag(own).over(Window.partitionBy(_PART).orderBy(_PLACE))
    return held.withColumn("_inner", inner).join(F.broadcast(border), _PART, "left").select(*frame.columns, F.coalesce("_inner", "_border").alias(name))
