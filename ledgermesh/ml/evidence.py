"""Weight of evidence and confusion figures, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions.scalars import natural_log, ratio
from ledgermesh.operators.skew import join_unique
from ledgermesh.session import stored


def evidence(frame: DataFrame, column: str, label: str = "label", smoothing: float = 0.0) -> DataFrame:
    """value, woe: ln of the value's share of bad rows (label 1) over its share of good ones (label 0); other labels don't count.

    A value without bad or good rows is infinite, as doubles have it, unless smoothing is added to its counts.
    """
    bad, good = (F.sum(F.when(F.col(label).cast("double") == v, 1.0).otherwise(0.0)) for v in (1.0, 0.0))
    by = frame.groupBy(F.col(column).alias("value")).agg((bad + smoothing).alias("bad"), (good + smoothing).alias("good"))
    totals = F.broadcast(by.agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good")))  # one row
    return by.crossJoin(totals).select("value", natural_log(ratio(ratio(F.col("bad"), F.col("all_bad")), ratio(F.col("good"), F.col("all_good")))).alias("woe"))


def encode_evidence(frame: DataFrame, column: str, label: str = "label", smoothing: float = 0.0) -> DataFrame:
    """frame with `<column>_WOE`."""
    table = evidence(frame, column, label, smoothing).select(F.col("value").alias("_value"), F.col("woe").alias(f"{column}_WOE"))
    return frame.join(table, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


#: Values of all columns together that are looked up in one map; more are joined.
MAPPED = 1_000


def evidence_of_all(frame: DataFrame, columns: list[str], label: str = "label", smoothing: float = 0.0) -> DataFrame:
    """column, value (as text), woe, n of each value of each column, counted in one pass over columns turned into rows. n: rows of the value."""
    kind = F.col(label).cast("double")
    long = frame.select(kind.alias("_label"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))).alias("_at"))
    bad, good = (F.sum(F.when(F.col("_label") == v, 1.0).otherwise(0.0)) for v in (1.0, 0.0))
    by = long.groupBy("_at.column", "_at.value").agg(F.count("*").alias("n"), (bad + smoothing).alias("bad"), (good + smoothing).alias("good"))
    by = stored(by)
    totals = F.broadcast(by.groupBy("column").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good")))  # a row a column
    woe = natural_log(ratio(ratio(F.col("bad"), F.col("all_bad")), ratio(F.col("good"), F.col("all_good"))))
    return by.join(totals, "column").select("column", "value", woe.alias("woe"), "n")


def encode_all(frame: DataFrame, columns: list[str], label: str = "label", smoothing: float = 0.0, mapped: int = MAPPED) -> DataFrame:
    """frame with `<c>_WOE` for each column: counted in one pass, and put back by one map of (column, value) where there are few, else by a join a column."""
    table = stored(evidence_of_all(frame, columns, label, smoothing))
    if table.count() <= mapped:
        one = table.agg(F.map_from_entries(F.collect_list(F.struct(F.struct("column", "value"), "woe"))).alias("_woe"))  # one row
        found = [F.element_at("_woe", F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))).alias(f"{c}_WOE") for c in columns]
        return frame.crossJoin(F.broadcast(one)).select(*(F.col(f"`{c}`") for c in frame.columns), *found)
    total = table.filter(F.col("column") == columns[0]).agg(F.sum("n")).first()[0] or 0
    out = frame
    for c in columns:
        own = table.filter(F.col("column") == c).select(F.struct("value").alias("_value"), F.col("woe").alias(f"{c}_WOE"), F.col("n").alias("_n"))
        out = join_unique(out.withColumn("_value", F.struct(F.col(f"`{c}`").cast("string").alias("value"))), own, ["_value"], "_n", total).drop("_value")
    return out.select(*(F.col(f"`{c}`") for c in frame.columns), *(F.col(f"`{c}_WOE`") for c in columns))


def confusion(frame: DataFrame, label: str = "label_idx", prediction: str = "prediction") -> DataFrame:
    """One row: tp, tn, fp, fn, precision, recall (NaN for 0 / 0)."""
    y, p = F.col(label), F.col(prediction)
    figures = frame.agg(F.count_if((y == p) & (y == 1)).alias("tp"), F.count_if((y == p) & (y == 0)).alias("tn"), F.count_if((y != p) & (p == 1)).alias("fp"), F.count_if((y != p) & (p == 0)).alias("fn"))
    return figures.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
