"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. With weight w, its block j (from 0) is released at slot floor(j / w) and due at slot
ceil((j + 1) / w); earliest deadline first over the released blocks keeps every source less than one block from its target
share. The schedule is made on the driver with the weights as they are, in whole numbers, over all blocks there are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.operators.ordered import running_sum

#: Slots of a period of whole shares, at least; one for each source at any rate.
PERIOD = 10_000
BLOCK = 64
#: Default weights are the sources' row counts to this power.
TEMPERATURE = 0.7
#: Rows of one source that are ranked together.
RANKED = 2_000
#: Blocks of a frame: the driver keeps a number for each source and frame, a task schedules a frame.
FRAME = 16_384

SOURCES = "_i int, _source string, _groups long, _start long"
FRAMES = "frame long, t long, after array<long>"
SLOTS = "_i int, _block long, _t long"


def shares(weights: list[float], period: int = PERIOD) -> list[int]:
    """Whole shares, 1 at least, of a period of max(period, sources) slots by largest remainders."""
    total, period = sum(map(Fraction, weights)), max(period, len(weights))
    exact = [Fraction(w) / total * period for w in weights]
    out = [max(1, int(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    k = 0
    while sum(out) < period:
        out[order[k % len(out)]] += 1
        k += 1
    for _ in range(sum(out) - period):  # where least shares of 1 took more than the period has
        out[max((i for i in range(len(out)) if out[i] > 1), key=lambda i: (out[i] - exact[i], i))] -= 1
    return out


def schedule(parts: list[int]) -> list[list[int]]:
    """The slots of each source in one period of sum(parts) slots, by earliest deadline first."""
    return block_slots(parts, parts)


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


def earliest_first(parts: list[int], blocks: list[int], t: int = 0, after: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of all blocks, by earliest deadline first, from slot t on; after: each source's next block there."""
    period = sum(parts)
    release = lambda i, j: j * period // parts[i]
    due = lambda i, j: -(-(j + 1) * period // parts[i])
    waiting = [(release(i, j), i, j) for i, j in enumerate(after or [0] * len(parts)) if j < blocks[i]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    while waiting or ready:
        if not ready:  # the slots of sources that have no block left stay empty
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(i, j), i, j))
        d, i, j = heapq.heappop(ready)
        if d <= t:
            raise AssertionError("a deadline is missed")
        yield i, j, t
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, (release(i, j + 1), i, j + 1))
        t += 1


def block_slots(weights: list[float], blocks: list[int]) -> list[list[int]]:
    """The slot of each of a source's blocks: the whole schedule, a number a block."""
    slots: list[list[int]] = [[] for _ in blocks]
    for i, _, t in earliest_first(whole_weights(weights), blocks):
        slots[i].append(t)
    return slots


def frames(parts: list[int], blocks: list[int], size: int) -> list[tuple[int, int, list[int]]]:
    """(frame, first slot, each source's next block) for every `size` blocks of the schedule."""
    after, out = [0] * len(parts), []
    for k, (i, j, t) in enumerate(earliest_first(parts, blocks)):
        if k % size == 0:
            out.append((k // size, t, list(after)))
        after[i] = j + 1
    return out


def _slots(spark, weights: list[float], blocks: list[int]) -> DataFrame:
    """_i, _block, _t: the slot of every block, made frame by frame in tasks."""
    parts, size = whole_weights(weights) if weights else [], FRAME

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                i, j, t = zip(*islice(earliest_first(parts, blocks, row["t"], row["after"]), size), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int64()), pa.array(t, pa.int64())], names=["_i", "_block", "_t"])

    return spark.createDataFrame(frames(parts, blocks, size), FRAMES).repartition("frame").mapInArrow(replay, SLOTS)


def _ranked(docs: DataFrame, weights: dict[str | None, float] | None, block: int) -> DataFrame:
    """docs with _block, _slot and _position. docs: doc_id, source and _other, a hash that tells rows without doc_id apart."""
    spark = docs.sparkSession
    source = F.col("source").cast("string")
    counts = docs.groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).orderBy("source").collect()  # a row for each source, as the weights are
    target = weights or {r["source"]: float(r["n"]) ** TEMPERATURE for r in counts}
    rest = [r["source"] for r in counts if target.get(r["source"], 0) <= 0]
    if rest:
        raise ValueError(f"no positive target weight for sources {rest[:5]}")
    starts = [0]
    for r in counts:
        starts.append(starts[-1] + r["n"])
    plan = F.broadcast(spark.createDataFrame([(i, r["source"], max(1, -(-r["n"] // RANKED)), starts[i]) for i, r in enumerate(counts)], SOURCES))
    slots = _slots(spark, [target[r["source"]] for r in counts], [-(-r["n"] // block) for r in counts])
    h = F.xxhash64(F.col("doc_id").cast("string"))
    if any(r["ids"] < r["n"] for r in counts):
        h = F.when(F.col("doc_id").isNull(), F.col("_other")).otherwise(h)
    rows = docs.join(plan, source.eqNullSafe(F.col("_source"))).withColumn("_hash", h).withColumn("_group", F.pmod("_hash", "_groups"))
    keyed = docs.select(source.alias("_s"), h.alias("_h")).join(plan, F.col("_s").eqNullSafe(F.col("_source")))
    groups = keyed.groupBy("_i", "_start", F.pmod("_h", "_groups").alias("_group")).agg(F.count("*").alias("_rows"))
    # how many of the source's rows come before a group's, and the slots of the blocks that the group has rows of
    groups = running_sum(groups, "_rows", "_i", "_group", name="_before").withColumn("_before", F.col("_before") - F.col("_start"))
    of = lambda rank: F.floor(rank / block).cast("long")
    spans = groups.withColumn("_block", F.explode(F.sequence(of(F.col("_before")), of(F.col("_before") + F.col("_rows") - 1)))).join(slots, ["_i", "_block"])
    spans = spans.groupBy("_i", "_group", "_before").agg(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_t"))), lambda x: x["_t"]).alias("_slots"))
    # rank and join deal the rows out by the same keys, once
    rows = rows.withColumn("_within", F.row_number().over(Window.partitionBy("_i", "_group").orderBy("_hash", "doc_id"))).join(spans, ["_i", "_group"])
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_within") - 1).withColumn("_block", of(F.col("_rank")))
    rows = rows.withColumn("_slot", F.get("_slots", (F.col("_block") - of(F.col("_before"))).cast("int")))
    return rows.withColumn("_position", F.col("_slot") * block + F.pmod("_rank", F.lit(block)))


def _other(docs: DataFrame) -> Column:
    """What orders rows without a doc_id: a hash of their text, if docs has texts."""
    return (F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")).alias("_other")


def mix_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, block, slot and position of each row: the mixture is the rows in order of position.

    Until the first source has no block left, every prefix of slots holds each source less than one block from its weight; after
    that its slots stay empty and the rest go on in their proportion. No row is dropped or repeated. Within a source rows
    are in the order of a hash of doc_id (of the text, where doc_id is null), then doc_id. A null source is a source; null doc_ids are rows like others.
    weights: target weight by source (None: counts to the power TEMPERATURE); a source without one is an error. Other columns are left out.
    """
    ids = docs.select("doc_id", "source", _other(docs))
    return _ranked(ids, weights, block).select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))


def placed(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """All rows and columns of docs, and each row's position in the mixture."""
    packed = docs.select("doc_id", "source", _other(docs), F.struct("*").alias("_row"))
    return _ranked(packed, weights, block).select("_row.*", F.col("_position").alias("position"))


def mix_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """All rows and columns of docs in the order of the mixture: partitions are ranges of it, sorted within."""
    packed = docs.select("doc_id", "source", _other(docs), F.struct("*").alias("_row"))  # so that no column's name can clash
    ranked = _ranked(packed, weights, block).select("_row", "_position")
    return ranked.repartitionByRange(F.col("_position")).sortWithinPartitions("_position").select("_row.*")
