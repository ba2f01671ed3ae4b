"""Message passing in rounds on DataFrames.

First the initial message reaches every vertex and every edge may send. Then, while any message exists, a vertex that got one
takes it, and only edges next to such vertices may send.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.session import discard, last_stored, stored


def pregel(
    state: DataFrame,
    messages: Callable[[DataFrame], DataFrame],
    update: dict[str, Column],
    rounds: int,
    every_vertex_active: bool = False,
    repeats: bool = False,
) -> DataFrame:
    """The state after at most `rounds` rounds, or once no message exists.

    state: id, attributes and active (boolean), as the initial message leaves it.
    messages: from a state, one row for each id that gets a message.
    update: new attributes of a vertex that got one, from its own and the message's columns.
    every_vertex_active: all vertices send in every round, and one without a message takes a null one.
    repeats: a round's state is compared with the earlier ones by a digest of 128 bits. What follows depends on the state alone, so once a state
    is there again, only what is left of the rounds after whole repetitions is done.
    A round's state is a table in the checkpoint folder; the one before goes as soon as the next one is written.
    """
    spark = state.sparkSession
    names = [c for c in state.columns if c not in ("id", "active")]
    state, path = stored(state), last_stored()
    seen: dict[tuple, int] = {}
    done = 0
    while done < rounds:
        sent = messages(state).withColumn("_got", F.lit(True))
        joined = state.join(sent, "id", "left")
        got = F.coalesce("_got", F.lit(False))
        takes = F.lit(True) if every_vertex_active else got
        new = joined.select("id", *(F.when(takes, update[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in names), (F.lit(True) if every_vertex_active else got).alias("active"))
        new, next_path = stored(new), last_stored()
        mark = _mark(new) if repeats else ()
        if not every_vertex_active and not (mark[0] if repeats else not new.filter("active").isEmpty()):
            discard(spark, next_path)
            return state
        discard(spark, path)
        state, path, done = new, next_path, done + 1
        if mark in seen and repeats:
            rounds, repeats = done + (rounds - done) % (done - seen[mark]), False
        seen[mark] = done
    return state


def _mark(state: DataFrame) -> tuple:
    """(active vertices, digest, digest): one pass over a state, whose ids are unique."""
    names = sorted(state.columns)
    return tuple(state.agg(F.count_if("active"), F.bit_xor(F.xxhash64(*names)), F.bit_xor(F.xxhash64(F.lit(7), *reversed(names)))).first())
