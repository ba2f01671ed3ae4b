"""Transfers, merchant transitions, edge weights and fraud selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.functions.scalars import bkdr_hash, min_max, z_score
from ledgermesh.operators.ordered import with_previous
from ledgermesh.session import stored, tasks_for


def transfer_sums(transfers: DataFrame, repartition: int | None = None) -> DataFrame:
    """srccard, dstcard and the sum of money of each pair."""
    return (transfers.repartition(repartition) if repartition else transfers).groupBy("srccard", "dstcard").agg(F.sum("money").alias("money"))


def account_vertices(sums: DataFrame) -> DataFrame:
    """Distinct (id, account) of both sides; ids are string hashes. What makes the sums runs once for both sides."""
    accounts = sums.select(F.explode(F.array("srccard", "dstcard")).alias("account")).distinct()
    return accounts.select(bkdr_hash("account").alias("id"), "account")


#: Events of a card that one task sorts.
DENSE = 1_000_000


def transitions_by_lag(events: DataFrame, card: str, merchant: str, time: Column, order: list[str], dense: int = DENSE) -> DataFrame:
    """card, mchnt, last_mchnt, time_diff: each event of a card with the one before it. `order` must tell all of a card's events apart.

    A card's events are sorted in one task, save those of cards with `dense` events and a thousandth of all: they lie over many tasks, by range.
    Tasks get about a million events each, where shuffles alone would give them more.
    """
    keys = [f"_{i}" for i in range(len(order))]
    named = lambda frame: frame.select(F.col(card).alias("card"), F.col(merchant).alias("mchnt"), time.alias("_time"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)))
    rows = named(events)
    counts = rows.groupBy("card").agg(F.count("*").alias("n"))
    n, most = counts.agg(F.sum("n"), F.max("n")).first()
    tasks = tasks_for(events.sparkSession, n or 0)
    told = (most or 0) >= dense
    out = lambda last, at: (F.col("card"), F.col("mchnt"), last.alias("last_mchnt"), (F.col("_time") - at).cast("double").alias("time_diff"))
    w = Window.partitionBy("card").orderBy(*keys)
    by_card = lambda frame: frame.select(*out(F.lag("mchnt").over(w), F.lag("_time").over(w)))
    if not told:
        # dealt as they are, for what names and times repeat needn't be shuffled
        return by_card(named(events.repartition(tasks, card)) if tasks else rows).filter("last_mchnt is not null")
    heavy = F.broadcast(counts.filter((F.col("n") >= dense) & (F.col("n") * 1000 >= n)).select("card"))  # a thousand cards at most
    last = with_previous(rows.join(heavy, "card", "left_semi"), ["card", "mchnt", "_time"], "card", *keys)
    same = last.filter(F.col("previous.card") == F.col("card")).select(*out(F.col("previous.mchnt"), F.col("previous._time")))
    others = rows.join(heavy, "card", "left_anti")
    return by_card(others.repartition(tasks, "card") if tasks else others).unionByName(same).filter("last_mchnt is not null")


def transition_stats(transitions: DataFrame) -> DataFrame:
    """src (last merchant), dst (merchant), n, cards (distinct), total of time_diff for each pair."""
    return transitions.groupBy(F.col("last_mchnt").alias("src"), F.col("mchnt").alias("dst")).agg(F.count("*").alias("n"), F.countDistinct("card").alias("cards"), F.sum("time_diff").alias("total"))


def time_weight(n: Column, total: Column) -> Column:
    """n / total, or 10 where the total is 0."""
    return F.when(total != 0, F.try_divide(n.cast("double"), total)).otherwise(F.lit(10.0))


def _measured(rows: DataFrame, **figures: Column) -> tuple[DataFrame, dict[str, Column]]:
    """The rows as a table, and figures over it as literals: what makes the rows runs once. An Observation would take the figures while the table
    is written, but a session that has had one can't be serialised, and MLlib's evaluators then fail in it."""
    held = stored(rows)
    return held, {k: F.lit(v).cast("double") for k, v in held.agg(*(c.alias(k) for k, c in figures.items())).first().asDict().items()}


def min_max_weights(stats: DataFrame, parts: tuple[str, ...] = ("n", "cards", "time")) -> DataFrame:
    """src, dst, weight: the sum of the min-max norms of n (from 1), cards and time weight; pairs seen once go, after the extremes are taken.

    parts: which norms the weight sums. The statistics are computed once and kept; their extremes are read from that table.
    """
    rows = stats.select("src", "dst", "n", "cards", time_weight(F.col("n"), F.col("total")).alias("time"))
    rows, ends = _measured(rows, high_n=F.max("n"), **{f"{e}_{c}": f(c) for c in ("cards", "time") for e, f in (("low", F.min), ("high", F.max))})
    ends["low_n"] = F.lit(1)
    norms = rows.select("src", "dst", *(min_max(c, ends[f"low_{c}"], ends[f"high_{c}"]).alias(c) for c in ("n", "cards", "time")))
    return norms.filter((F.col("n") > 0) & ~F.isnan("n")).select("src", "dst", sum((F.col(c) for c in parts[1:]), F.col(parts[0])).alias("weight"))


def z_score_weights(stats: DataFrame, literal: bool = False) -> DataFrame:
    """src, dst, weight: the sum of the z-scores of n, cards and mean gap, by sample deviations. The statistics are computed once and kept.

    literal: mean gap and cards are both measured by the mean gap's figures, as the published pipeline does it.
    """
    rows = stats.select("src", "dst", F.col("n").cast("double").alias("n"), F.col("cards").cast("double").alias("cards"), F.try_divide(F.col("total"), F.col("n")).alias("gap"))
    rows, figures = _measured(rows, **{f"{e}_{c}": f(c) for c in ("n", "cards", "gap") for e, f in (("mean", F.avg), ("dev", F.stddev_samp))})
    by = {"n": "n", "cards": "gap" if literal else "cards", "gap": "gap"}
    value = {"n": "n", "cards": "gap" if literal else "cards", "gap": "cards" if literal else "gap"}
    scores = [z_score(value[c], figures[f"mean_{by[c]}"], figures[f"dev_{by[c]}"]) for c in ("n", "cards", "gap")]
    return rows.select("src", "dst", sum(scores[1:], scores[0]).alias("weight"))


def grouped_edges(transitions: DataFrame, more_than: int = 2) -> DataFrame:
    """src, dst, n, cards, mean_gap of pairs seen more than so often."""
    stats = transition_stats(transitions).filter(F.col("n") > more_than)
    return stats.select("src", "dst", "n", "cards", F.try_divide(F.col("total"), F.col("n")).alias("mean_gap"))


def column_extremes(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of each column in one pass."""
    return frame.agg(*(f(c).alias(f"{e}_{c}") for c in columns for e, f in (("min", F.min), ("max", F.max))))


def column_statistics(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample variance of each column in one pass."""
    return frame.agg(*(f(c).alias(f"{e}_{c}") for c in columns for e, f in (("mean", F.avg), ("var", F.var_samp))))


def members(frame: DataFrame, column: str, of: DataFrame, key: str | None = None) -> DataFrame:
    """Rows whose value is among those of another frame: a semi join where a collected list would be an isin."""
    keys = of.select(F.col(key or column).alias("_key")).distinct()
    return frame.join(keys, F.col(column) == F.col("_key"), "left_semi")


def fraud_transactions(fraud: DataFrame, transactions: DataFrame, fraud_type: str = "04", card: str = "pri_acct_no_conv", trace: str = "sys_tra_no", columns: list[str] | None = None) -> DataFrame:
    """Transactions whose card and whose trace number both occur among the frauds of a type (not necessarily in one of them)."""
    own = fraud.filter(F.col("fraud_tp") == fraud_type)
    found = members(members(transactions, card, own), trace, own)
    return found.select(*columns) if columns else found


def word_count(lines: DataFrame, column: str = "value", pattern: str = r"\s+") -> DataFrame:
    """word and n; an empty word counts as one."""
    return lines.select(F.explode(F.split(column, pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def with_names(ranks: DataFrame, names: DataFrame, key: str, by: str = "id", blank: str = " ") -> DataFrame:
    """ranks with the name whose key is their `by` (blank without one); of several names the smallest counts."""
    one = names.groupBy(F.col(key).alias("_key")).agg(F.min("name").alias("name"))
    return ranks.join(one, F.col(by) == F.col("_key"), "left").drop("_key").withColumn("name", F.coalesce("name", F.lit(blank)))
