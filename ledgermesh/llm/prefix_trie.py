"""Prefix trie of conversations, by prefix-doubling names.

Distinct turns get dense numbers. Blocks of 2, 4, 8, ... turns that start at a multiple of their length are pairs of blocks of half the
length, and get dense numbers by these pairs, one round a power of two. A prefix of d turns is the blocks of d's binary digits, so
prefixes are pairs of a shorter prefix and a block, named from the largest power down. A name is a node.

Positions, sums along a conversation and hashes of members go by range partitions of a sort, and rows of frequent keys are joined by
broadcasts of a bounded number of keys, so neither a long conversation nor a common turn meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.operators.ordered import numbered, running_sum
from ledgermesh.operators.skew import join_unique
from ledgermesh.session import stored

#: A conversation takes over fewer turns of another one than this; conversations of one hundred share the first of them.
HEADS, FAMILY = 6, 100
ROOT = 0
EMPTY = hashlib.sha256(b"").hexdigest()


def read_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, chars, row: a digest stands for the role and the text, and chars counts the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.filter("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))


def _named(rows: DataFrame, keys: list[str], name: str, in_order: bool = False, **kept) -> tuple[DataFrame, DataFrame, int]:
    """(rows with the dense number of their keys instead of these, a row for each number with its count n and aggregates, their number).

    in_order: numbers follow the keys' order.
    """
    groups = numbered(rows.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in kept.items())), *(keys if in_order else []), name=name)
    size = groups.agg(F.count("*"), F.sum("n")).first()
    out = join_unique(rows, groups.select(*keys, name, "n"), keys, "n", size[1] or 0)
    return out.drop(*keys), groups, size[0]


def original_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, name, chars: all turns in one order, by conversation, turn (null first), then the digest of role and text."""
    turns = stored(read_turns(conversations))
    named = _named(turns, ["digest"], "name", in_order=True)[0]
    return numbered(named, "conv_id", F.asc_nulls_first("turn"), "name", "row").select("conv_id", "at", "name", "chars")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, d, name, chars) of every turn of the rebuilt conversations, d from 1; (conv_id, total) of every one, turnless too)."""
    turns = original_turns(conversations)
    found = stored(turns.groupBy("conv_id").agg(F.min("at").alias("start"), F.count("*").alias("own")))
    head = F.col("conv_id") - F.col("conv_id") % FAMILY
    known = found.withColumns({"family": head, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    first = found.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.col("own").alias("_own"))
    known = known.join(first, "family", "left").withColumn("taken", F.least("h", F.coalesce("_own", F.lit(0))))
    convs = stored(known.select("conv_id", "family", "start", "own", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")))
    size = convs.agg(F.sum("own")).first()[0] or 0
    placed = join_unique(turns, convs.select("conv_id", "start", "h", "taken", F.col("own").alias("_n")), ["conv_id"], "_n", size).withColumn("p", F.col("at") - F.col("start"))
    own = placed.filter("p >= h").select("conv_id", (F.col("p") - F.col("h") + F.col("taken") + 1).alias("d"), "name", "chars")
    heads = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("p") < HEADS)).select(F.col("conv_id").alias("family"), "p", "name", "chars")
    borrowed = convs.select("conv_id", "family", "taken").join(heads, "family").filter("p < taken")  # six turns for each conversation at most
    rows = own.union(borrowed.select("conv_id", (F.col("p") + 1).alias("d"), "name", "chars"))
    return stored(rows), convs.select("conv_id", "total")


def _blocks(rows: DataFrame, longest: int) -> list[DataFrame]:
    """For each power of two, (conv_id, q, block, chars): the name of the q-th block of so many turns, and its last turn's length."""
    out = [rows.select("conv_id", (F.col("d") - 1).alias("q"), F.col("name").alias("block"), "chars")]
    while 2 << len(out) - 1 <= longest:
        half = lambda odd, c: F.max(F.when(F.col("q") % 2 == odd, F.col(c)))
        pairs = out[-1].groupBy("conv_id", F.expr("shiftright(q, 1)").alias("_q")).agg(half(0, "block").alias("a"), half(1, "block").alias("b"), half(1, "chars").alias("chars"))
        pairs = stored(pairs.filter("a is not null and b is not null").withColumnRenamed("_q", "q"))
        out.append(stored(_named(pairs, ["a", "b"], "block")[0].select("conv_id", "q", "block", "chars")))
    return out


def _prefixes(rows: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """((conv_id, d, node) of each prefix with a turn, (node, depth, n_convs, conv_id, chars) of each node but the root)."""
    paths, nodes, next_name = [], [], ROOT + 1
    blocks = _blocks(rows, longest)
    for j in reversed(range(len(blocks))):
        even = blocks[j].filter("q % 2 = 0").select("conv_id", (F.expr("q + 1") * (1 << j)).alias("d"), (F.col("q") * (1 << j)).alias("_d"), "block", "chars")
        if paths:
            before = _union(paths).select("conv_id", F.col("d").alias("_d"), F.col("node").alias("prefix"))
            even = even.join(before, ["conv_id", "_d"], "left").withColumn("prefix", F.coalesce("prefix", F.lit(ROOT)))
        else:
            even = even.withColumn("prefix", F.lit(ROOT))
        even = stored(even.select("conv_id", "d", "prefix", "block", "chars"))
        named, groups, count = _named(even, ["prefix", "block"], "node", depth=F.min("d"), conv_id=F.min("conv_id"), chars=F.max("chars"))
        shift = F.col("node") + next_name
        paths.append(stored(named.select("conv_id", "d", shift.alias("node"))))
        nodes.append(groups.select(shift.alias("node"), "depth", F.col("n").alias("n_convs"), "conv_id", "chars"))
        next_name += count
    return _union(paths), _union(nodes)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


#: Members that one row of the hash's input holds.
MEMBERS = 256


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation to (node, first, text): members of one node, joined by commas."""
    node, ids = None, []
    out: list[tuple[int, int, str]] = []
    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != node or len(ids) == MEMBERS:
                if ids:
                    out.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = n, []
            ids.append(c)
        if len(out) >= 2_000:
            yield _packed(out)
            out = []
    if ids:
        out.append((node, ids[0], ",".join(map(str, ids))))
    yield _packed(out)


def _packed(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (("node", pa.int64()), ("first", pa.int64()), ("text", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by node and first member to (node, sha): the hash goes on from row to row, so a node's text is never held."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["node", "sha"])
    node, state = None, None
    for batch in batches:
        out = []
        for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n == node:
                state.update(b",")
            else:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            state.update(text.encode())
        yield made(out)
    yield made([] if node is None else [(node, state.hexdigest())])


def member_hashes(members: DataFrame) -> DataFrame:
    """node, sha of (node, conv_id) rows, each pair once: the hash of a node's members, ascending and joined by commas.

    A hash reads its text from front to back, so a node's packed members pass through one task, as a stream.
    """
    packed = members.select("node", "conv_id").orderBy("node", "conv_id").mapInArrow(_pack, "node long, first long, text string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hash, "node long, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    conversations: conv_id, turn, role, text. A conversation takes the first h turns of the one that begins its hundred, h by its own number, then
    its own turns after the first h.
    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id belong to no conversation. A null role or text is empty, a null turn comes first; turns of equal number are
    ordered by the digest of role and text, and repeated rows are turns of their own. An empty table has no nodes. Other columns are not read.
    """
    rows, convs = rebuilt_turns(conversations)
    size = convs.agg(F.count("*"), F.max("total"), F.sum("total"), F.min("conv_id")).first()
    paths, nodes = _prefixes(rows, size[1] or 1)
    n_rows = size[2] or 0
    root = convs.groupBy().agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    nodes = nodes.unionByName(root.select(F.lit(ROOT).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("chars")))

    up = paths.select("conv_id", (F.col("d") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = nodes.join(up, ["conv_id", "depth"], "left").withColumn("parent", F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(F.col("parent")))
    nodes = stored(nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("chars")))
    below = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(running_sum(nodes, "weight", "conv_id", "depth"))

    # all nodes whose smallest member is a conversation stand at the end of its path; a conversation ends in one leaf at most
    own = nodes.groupBy("conv_id").agg(F.sum("weight").alias("all"), F.min("before").alias("start"), F.count_if(F.col("n_children") == 0).alias("leaf"), F.count("*").alias("_nodes"))
    own = stored(own.join(convs, "conv_id"))
    each = join_unique(paths, own.select("conv_id", "all", "leaf", "total"), ["conv_id"], "total", n_rows)
    sums = each.groupBy("node").agg(F.sum("all").alias("all_below"), F.sum("leaf").alias("n_leaves"))
    sums = sums.union(own.groupBy().agg(F.lit(ROOT).cast("long").alias("node"), F.sum("all"), F.sum("leaf")))
    count = nodes.count()
    nodes = join_unique(nodes, own.select("conv_id", "start", "_nodes"), ["conv_id"], "_nodes", count).join(sums, "node")
    # what all members' paths have, without what the smallest one's has above the node; the nodes of the others are all below it
    nodes = nodes.withColumn("saved_tokens", F.expr("all_below - (before - start)"))

    ends = convs.filter("total > 0").join(paths.withColumnRenamed("d", "total"), ["conv_id", "total"]).select("node", "conv_id")
    ends = ends.union(convs.filter("total = 0").select(F.lit(ROOT).cast("long"), "conv_id"))
    nodes = stored(nodes.join(member_hashes(ends), "node", "left"))
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256")]
    inner = join_unique(nodes.filter("parent is not null"), parents, ["parent"], "_n", count)
    return inner.select(*columns).union(nodes.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns))
