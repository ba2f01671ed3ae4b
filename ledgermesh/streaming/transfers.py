"""Sums of transfers that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_transfers(stream: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """window start, srccard, dstcard, money of a stream with an event time; rows later than `late` are left to the watermark."""
    sums = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "srccard", "dstcard").agg(F.sum("money").alias("money"))
    return sums.select(F.col("w.start").alias("start"), "srccard", "dstcard", "money")
