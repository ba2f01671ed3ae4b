"""Joins with a side of unique keys where some keys of the other side are very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with one of so many equal shares of the rows is heavy, so at most so many keys are.
SHARES = 1000


def join_unique(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, shares: int = SHARES) -> DataFrame:
    """The inner join of rows with keyed, which has each key once and in `count` how many of the rows have it (the column goes).

    total: how many rows there are. Keys with a share of them are `shares` at most, so these are broadcast and their rows stay where they
    are; the others shuffle, and none of these keys has a share.
    """
    heavy = F.col(count) * shares >= max(total, 1)
    held = F.broadcast(keyed.filter(heavy).drop(count))
    few = rows.join(held, keys)
    many = rows.join(held.select(*keys), keys, "left_anti").join(keyed.filter(~heavy).drop(count), keys)
    return few.unionByName(many)
