"""MinHash near-duplicates by an LSH forest: sorted signature orders with longest-common-prefix neighbours.

Documents of one shingle set are one class. For each order the classes' signatures are sorted as a whole
(a range partitioning, so no key can be hot), and each row meets the next rows as long as they share a prefix: the
common prefix, and so the depth, adapts to how dense the region is. Candidates are confirmed on full sets: first
each class's likeliest partner with a smaller id, then every other candidate whose ends are still apart. Where more rows share a
prefix than a row meets, and not all of them are joined by then, the rest of that run's pairs are compared on full sets, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.graph.components import component_members
from ledgermesh.llm.text import WHITE, mix, shingle_sets, slices, texts_of, tidy, words_of
from ledgermesh.operators.ordered import numbered
from ledgermesh.session import cut, gathered, stored

#: Orders of the forest and signature values that the sort takes into account.
ORDERS = 20
LEAST_DEPTH = 4
DEEPEST = 12
SLOTS = ORDERS * LEAST_DEPTH
#: Next rows of an order that a row meets.
NEIGHBOURS = 8
#: Rows of a block of a long run; two blocks meet in one task.
BLOCK_ROWS = 500
#: Shingles whose counts are taken in one matrix product, and shares that the rows of a run are joined by.
COLUMNS, SALTS = 4_096, 64
#: Rows of a partition of tables that are cut: classes with their signatures, and pairs.
CLASS_ROWS, PAIR_ROWS = 10_000, 200_000
#: Candidates below this share of equal signature values aren't confirmed. Of 80 values, a pair of similarity 0.8 has so few equal ones once in
#: nine million times (binomial), far more rarely than all orders miss it.
LEAST_ESTIMATE = 0.55


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(rows: np.ndarray, values: np.ndarray, n: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have values, and for each its n smallest hashes (one of each hash function)."""
    own, first = np.unique(rows, return_index=True)
    out = np.empty((len(own), n), dtype=np.uint32)
    if len(own):
        a, b = _family(n)
        with np.errstate(over="ignore"):
            for i in range(n):
                out[:, i] = np.minimum.reduceat(((values * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), first)
    return own, out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (128 bits that name the set; null without one), sig (SLOTS big-endian 32-bit values) and low (their last bytes)."""
    rows = texts_of(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                r, v = shingle_sets(words_of(part.column("text"), WHITE, lower=True), k)
                own, sig = minhash(r, v)
                count = np.bincount(r, minlength=part.num_rows)
                s1, s2 = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                packed, low = [None] * part.num_rows, [None] * part.num_rows
                if len(own):
                    first = np.searchsorted(r, own)
                    s1[own] = np.add.reduceat(mix(v, 21), first).view(np.int64)
                    s2[own] = np.bitwise_xor.reduceat(mix(v, 22), first).view(np.int64)
                    big, last = sig.astype(">u4"), sig.astype(np.uint8)
                    for i, row in enumerate(own.tolist()):
                        packed[row], low[row] = big[i].tobytes(), last[i].tobytes()
                none = count == 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(s1, mask=none), pa.array(s2, mask=none), pa.array(packed, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "sig", "low"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, s1 long, s2 long, sig binary, low binary")


def _orders(classes: DataFrame) -> DataFrame:
    """A row for each class and order: tree, key (the first DEEPEST values of the order), id, low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 5000):
                part = batch.slice(a, 5000)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(part.num_rows, SLOTS * 4)
                for t in range(ORDERS):
                    turned = np.roll(sig, -4 * LEAST_DEPTH * t, axis=1)[:, : 4 * DEEPEST]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, t, np.int32)), pa.array([x.tobytes() for x in turned], pa.binary()), part.column("id"), part.column("low")], names=["tree", "key", "id", "low"])

    return classes.select("id", "sig", "low").mapInArrow(tidy(run), "tree int, key binary, id long, low binary")


SCANNED = "a long, b long, est double, place long, tree int, key binary, id long, low binary"


def _scan(batches: Iterator[pa.RecordBatch], borders: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of sorted rows (tree, key, id, low) that are NEIGHBOURS rows apart at most and share the prefix.

    borders: the partition's number; then its first and last NEIGHBOURS rows are returned too, with their place among those
    of all partitions. None: rows come with `place`, and only pairs of different partitions are returned.
    """
    names = [x.split()[0] for x in SCANNED.split(", ")]
    none = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
    tree, key, low, ids, part = np.zeros(0, np.int32), np.zeros((0, DEEPEST), np.uint32), np.zeros((0, SLOTS), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen, tail = 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        old = len(ids[-NEIGHBOURS:])
        tree = np.concatenate([tree[-NEIGHBOURS:], batch.column("tree").to_numpy()])
        key = np.concatenate([key[-NEIGHBOURS:], np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint32).reshape(-1, DEEPEST)])
        low = np.concatenate([low[-NEIGHBOURS:], np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(-1, SLOTS)])
        ids = np.concatenate([ids[-NEIGHBOURS:], batch.column("id").to_numpy()])
        part = np.concatenate([part[-NEIGHBOURS:], batch.column("place").to_numpy() >> 32 if borders is None else np.zeros(n, np.int64)])
        for step in range(1, NEIGHBOURS + 1):
            right = np.arange(max(old, step), len(ids))
            left = right - step
            same = (tree[left] == tree[right]) & (key[left, :LEAST_DEPTH] == key[right, :LEAST_DEPTH]).all(axis=1) & (ids[left] != ids[right])
            if borders is None:
                same &= part[left] != part[right]
            left, right = left[same], right[same]
            est = ((low[left] == low[right]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)  # unequal values share a byte once in 256
            like = est >= LEAST_ESTIMATE
            left, right = ids[left[like]], ids[right[like]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(est[like]), *none(len(left), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())], names=names)
        if borders is not None:
            own = batch.select(["tree", "key", "id", "low"]).append_column("place", pa.array((borders << 32) + seen + np.arange(n)))
            head = own.slice(0, max(0, NEIGHBOURS - seen))
            if head.num_rows:
                yield pa.RecordBatch.from_arrays([*none(head.num_rows, pa.int64(), pa.int64(), pa.float64()), *(head.column(c) for c in names[3:])], names=names)
            rest = own.slice(head.num_rows)
            tail = pa.Table.from_batches([rest] if tail is None else [*tail.to_batches(), rest])
            tail = tail.slice(max(0, tail.num_rows - NEIGHBOURS))
            seen += n
    if tail is not None and tail.num_rows:
        yield pa.RecordBatch.from_arrays([*none(tail.num_rows, pa.int64(), pa.int64(), pa.float64()), *(tail.column(c).combine_chunks() for c in names[3:])], names=names)


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, est): neighbours in any order, a < b, whose estimated similarity (by one byte of each signature value) is LEAST_ESTIMATE at least.

    An order is cut into range partitions. Each hands on its first and last rows, which one task scans in order for the pairs that
    the cuts part: 2 * NEIGHBOURS rows a partition, so their number is bounded by that of partitions, and the scan holds NEIGHBOURS of them.
    """
    ordered = _orders(classes).repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    scanned = cut(ordered.mapInArrow(tidy(lambda batches: _scan(batches, TaskContext.get().partitionId())), SCANNED))
    ends = scanned.filter("place is not null").select("place", "tree", "key", "id", "low").coalesce(1).sortWithinPartitions("place")
    parted = ends.mapInArrow(tidy(lambda batches: _scan(batches, None)), SCANNED)
    pairs = scanned.filter("place is null").select("a", "b", "est").union(parted.select("a", "b", "est"))
    return pairs.groupBy("a", "b").agg(F.max("est").alias("est"))


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(src, dst) of the pairs (a, b) whose full sets' intersection is percent of their union at least. texts: id, text."""
    joined = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x"):
                sides = [shingle_sets(words_of(part.column(c), WHITE, lower=True), k) for c in "xy"]
                n = part.num_rows
                sizes = [np.bincount(r, minlength=n) for r, _ in sides]
                rows = np.concatenate([r for r, _ in sides])
                values = np.concatenate([v for _, v in sides])
                order = np.lexsort((values, rows))
                rows, values = rows[order], values[order]
                both = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (values[1:] == values[:-1])], minlength=n) if len(rows) else np.zeros(n, np.int64)
                use = (both > 0) & (100 * both >= percent * (sizes[0] + sizes[1] - both))
                yield pa.RecordBatch.from_arrays([pa.array(part.column(c).to_numpy()[use]) for c in "ab"], names=["src", "dst"])

    return joined.mapInArrow(tidy(run), "src long, dst long")


def run_blocks(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(tree, prefix, x, y, main, side, id, component) of the rows of runs of a common prefix that are longer than a row meets and not yet of one component.

    A run's main rows are its largest component's. Its other rows, in blocks x, meet main rows in blocks y and (main is false) each other;
    side is 0 for rows of x, 1 for rows of y, and 2 where x and y are one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, SLOTS * 4)
            for t in range(ORDERS):
                pair = np.ascontiguousarray(sig[:, 4 * LEAST_DEPTH * t : 4 * LEAST_DEPTH * (t + 1)]).view(np.uint64)
                prefix = mix(mix(pair[:, 0], 31) + pair[:, 1], 32).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(prefix), batch.column("id"), batch.column("component")], names=["tree", "prefix", "id", "component"])

    own = classes.select("id", "sig").join(found, "id", "left").select("id", "sig", F.coalesce("component", "id").alias("component"))
    rows = own.mapInArrow(tidy(run), "tree int, prefix long, id long, component long")
    sizes = rows.groupBy("tree", "prefix", "component").agg(F.count("*").alias("n"))
    runs = sizes.groupBy("tree", "prefix").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", -F.col("component"))).alias("chief"))
    runs = gathered(runs.filter((F.col("n") > NEIGHBOURS + 1) & (F.col("n") > F.col("most"))), PAIR_ROWS)
    salted = runs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hashed = F.xxhash64("id")
    rows = rows.withColumn("salt", F.pmod(hashed, F.lit(SALTS)).cast("int")).join(salted, ["tree", "prefix", "salt"])
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    rows = rows.withColumns({"main": F.col("component") == F.col("chief"), "mains": blocks(F.col("most")), "others": blocks(F.col("n") - F.col("most"))})
    at = F.pmod(F.xxhash64(hashed), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("at", at)
    meet = lambda x, y, main, side: F.struct(x.alias("x"), y.alias("y"), F.lit(main).alias("main"), side.cast("int").alias("side"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_main = F.transform(each("others"), lambda x: meet(x, F.col("at"), True, F.lit(1)))
    of_other = F.concat(
        F.transform(each("mains"), lambda y: meet(F.col("at"), y, True, F.lit(0))),
        F.transform(each("others"), lambda y: meet(F.least(F.col("at"), y), F.greatest(F.col("at"), y), False, F.when(F.col("at") == y, 2).when(F.col("at") < y, 0).otherwise(1))),
    )
    return rows.select("tree", "prefix", "id", "component", F.explode(F.when(F.col("main"), of_main).otherwise(of_other)).alias("b")).select("tree", "prefix", "b.*", "id", "component")


def _common(rows: list[np.ndarray], values: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """How many values each row of the first side shares with each of the second."""
    both = np.intersect1d(values[0], values[1])
    out = np.zeros(sizes, np.float32)
    sides = []
    for r, v in zip(rows, values, strict=True):
        at = np.searchsorted(both, v)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == v[hit]
        order = np.argsort(at[hit], kind="stable")
        sides.append((r[hit][order], at[hit][order]))
    for a in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - a)
        parts = []
        for (r, c), n in zip(sides, sizes, strict=True):
            lo, hi = np.searchsorted(c, [a, a + width])
            part = np.zeros((n, width), np.float32)
            part[r[lo:hi], c[lo:hi] - a] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def links_of_blocks(blocks: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(src, dst): links that join all of a block pair's components that any of its pairs joins, on full sets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, component, side = (table.column(c).to_numpy() for c in ("id", "component", "side"))
        r, v = shingle_sets(words_of(table.column("text").combine_chunks(), WHITE, lower=True), k)
        size = np.bincount(r, minlength=len(ids))
        rows, values, own = [], [], []
        for at in (np.flatnonzero(side != 1), np.flatnonzero(side != 0)):
            place = np.full(len(ids), -1)
            place[at] = np.arange(len(at))
            use = place[r] >= 0
            rows.append(place[r[use]])
            values.append(v[use])
            own.append(at)
        left, right = own
        both = _common(rows, values, [len(left), len(right)]).astype(np.int64)
        linked = (both > 0) & (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (component[left][:, None] != component[right][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out: list[tuple[int, int]] = []
        for i, j in np.argwhere(linked).tolist():
            a, b = left[i], right[j]
            x, y = root(int(component[a])), root(int(component[b]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids[a]), int(ids[b])))
        return pa.table({"src": pa.array([a for a, _ in out], pa.int64()), "dst": pa.array([b for _, b in out], pa.int64())})

    rows = blocks.join(texts, "id").select("tree", "prefix", "x", "y", "main", "side", "id", "component", "text")
    return rows.groupBy("tree", "prefix", "x", "y", "main").applyInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs.

    Texts are lower-cased (A-Z) and cut at white space; a set holds the distinct k-word shingles, or the whole
    sequence of fewer words. Rows link at `percent` of Jaccard similarity or more; component_id is the
    smallest doc_id that links reach, and kept says whether it is the row's own. A text that is null or without words has an empty set and
    links with nothing. Rows that repeat a doc_id are one node, linked as any of them is. A null doc_id takes no part:
    its component_id is null and it is kept. Other columns are left out.
    """
    sig = cut(signatures(docs, k))
    classes = sig.filter("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "sig", "low")).alias("m")).select(F.col("m.doc_id").alias("id"), F.col("m.sig").alias("sig"), F.col("m.low").alias("low"), "s1", "s2", "n_shingles")
    classes = gathered(classes, CLASS_ROWS)
    pairs = gathered(candidates(classes), PAIR_ROWS)
    likeliest = gathered(pairs.groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a")), PAIR_ROWS)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = stored(texts_of(docs, "doc_id").withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi"))
    links = gathered(confirmed(likeliest, texts, k, percent).distinct(), PAIR_ROWS)
    found = component_members(links)
    tested = likeliest
    for final in (False, True):  # first each one's likeliest partner with a larger id, then all that are still apart
        left, right = (found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        # what is apart now was apart before, so settled pairs aren't looked at again
        pairs = gathered(pairs.join(left, "a", "left").join(right, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "est"), PAIR_ROWS)
        apart = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        if not final:
            apart = apart.groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
            tested = gathered(tested.select("a", "b").union(apart.select("a", "b")), PAIR_ROWS)
            apart = tested.join(likeliest.select("a", "b"), ["a", "b"], "left_anti")
        more = gathered(confirmed(apart, texts, k, percent).distinct(), PAIR_ROWS)
        if not more.isEmpty():
            links = links.union(more)
            found = component_members(links)
    blocks = gathered(run_blocks(classes, found), PAIR_ROWS)
    more = gathered(links_of_blocks(blocks, texts_of(docs, "doc_id").withColumnRenamed("doc_id", "id"), k, percent).distinct(), PAIR_ROWS)
    if not more.isEmpty():
        found = component_members(links.union(more))
    # nodes of one class, and rows of one doc_id in several classes, belong together
    of_class = sig.filter("n_shingles > 0 and doc_id is not null").join(classes.select("s1", "s2", "n_shingles", "id"), ["s1", "s2", "n_shingles"]).select("doc_id", "id").distinct()
    home = of_class.join(found, "id", "left").select("doc_id", F.coalesce("component", "id").alias("c"))
    split = home.groupBy("doc_id").agg(F.min("c").alias("c"), F.max("c").alias("top"))
    torn = split.filter("c <> top")
    if not torn.isEmpty():  # a doc_id of several texts ties components together
        ties = component_members(home.join(torn.select("doc_id"), "doc_id").select(F.col("doc_id").alias("src"), F.col("c").alias("dst")))
        split = split.join(ties.select(F.col("id").alias("c"), "component"), "c", "left").select("doc_id", F.coalesce("component", "c").alias("c"))
    out = sig.select("doc_id", "n_shingles").join(split.select("doc_id", "c"), "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _renamed(named: DataFrame) -> DataFrame:
    """named (_id, _tag, ...) with an _id of its own for each further _tag under one _id."""
    torn = named.groupBy("_id").agg(F.min("_tag").alias("_least"), F.max("_tag").alias("_most")).filter("_least <> _most")
    if torn.isEmpty():
        return named
    further = named.join(torn, "_id").filter("_tag <> _least").select("_id", "_tag").distinct()
    further = numbered(further, "_id", "_tag", name="_at")
    (low, high), more = named.agg(F.min("_id"), F.max("_id")).first(), further.count()
    first = high + 1 if high + more < 1 << 63 else low - more
    return stored(named.join(further, ["_id", "_tag"], "left").withColumn("_id", F.coalesce(F.col("_at") + F.lit(first), "_id")).drop("_at"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, each_text: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps: one of each doc_id, and every row without one.

    each_text: further texts under a doc_id that is there already are documents of their own, behind all others, so only rows that repeat doc_id and text
    are one document.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_tag"))
    named = rows.filter("_id is not null")
    if each_text:
        named = _renamed(named)
    ids = near_duplicates(named.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text")), k, percent)
    kept = ids.filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    place = F.row_number().over(Window.partitionBy("_id").orderBy("_tag"))
    one = named.join(kept, F.col("_id") == F.col("_kept"), "left_semi").withColumn("_n", place).filter("_n = 1")
    return one.select("_row.*").unionByName(rows.filter("_id is null").select("_row.*"))
