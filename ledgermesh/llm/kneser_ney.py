"""Interpolated modified Kneser-Ney models of byte n-grams, as sharded tables.

Two readings of a text share the tables. As a stream, a text is its words with one space between them, between edge marks, and n-grams
run over word boundaries. As a set of words, each word is a begin mark, its bytes and an end mark, and no n-gram reaches over a
word's begin. n-grams are packed into one long (order and bytes), so keys are exact. Counting, continuation
counts, discounts and interpolation terms are grouped joins over those keys. For scoring, each block of
documents asks only once for each n-gram that it holds; the answers are joined to the requests by
key and come back to the block, so what moves is a block's distinct n-grams and not its text.

A model of several classes holds them beside the common one (columns suffixed by the class number).
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgermesh.llm.text import LOWER, WHITE, mix, release, rolled, slices, tidy, words_of
from ledgermesh.session import cut, stored

BEGIN, END = 0x20, 0x0A
SHIFT = 48
#: Highest order of the n-grams: five bytes, with the begin mark as one.
ORDER = 5
#: An unseen byte has this probability where no n-gram is known.
UNIFORM = 1.0 / 257.0
#: Bytes of text of a block, whose distinct n-grams are asked for together.
BLOCK_BYTES = 10 << 20
#: Words whose likelihoods are computed together.
WORDS_AT_ONCE = 50_000
#: Class labels on at most so many documents are sent to each executor; beyond it they are joined by shuffle.
BROADCAST_LABELS = 200_000
#: The mark at both edges of a stream, and how much of a stream is handled together.
EDGE = 0x0A
STREAM_PIECE = 1 << 20
#: Bytes of a block of texts that are read as streams: its distinct n-grams grow slowly.
STREAM_BLOCK_BYTES = 20 << 20


# ---------------------------------------------------------------- words of a block


class Vocabulary:
    """Distinct words of a block and, for each word of each row, its number among them."""

    def __init__(self, batch: pa.RecordBatch, lower: bool):
        hashes, parts, numbers, counts, base = [], [], [], [], 0
        for part in slices(batch):
            w = words_of(part.column("text"), WHITE)
            counts.append(w.counts())
            if not len(w.start):
                continue
            buf = LOWER[w.buf] if lower else w.buf
            w.buf = buf
            own, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
            start, end = w.start[first], w.end[first]
            hashes.append(own)
            parts.append((gather(buf, start, end), end - start))
            numbers.append(inverse.astype(np.int32) + np.int32(base))
            base += len(own)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if not hashes:
            self.bytes, self.length, self.number = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        _, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        number = inverse.astype(np.int32)[np.concatenate(numbers)]
        del numbers
        order = np.argsort(-np.bincount(number, minlength=len(first)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.number = rank[number]
        data, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        at = np.cumsum(length) - length
        pick = first[order]
        self.bytes, self.length = gather(data, at[pick], at[pick] + length[pick]), length[pick]


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of the ranges, one after another."""
    length = end - start
    out = np.empty(int(length.sum()), np.uint8)
    done = 0
    for a in range(0, len(length), WORDS_AT_ONCE):
        own = length[a : a + WORDS_AT_ONCE]
        n = int(own.sum())
        at = np.arange(n)
        at += np.repeat(start[a : a + WORDS_AT_ONCE] - (np.cumsum(own) - own), own)
        out[done : done + n] = buf[at]
        done += n
    return out


def pieces(data: np.ndarray, length: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The words in portions of WORDS_AT_ONCE: their numbers, bytes and lengths."""
    edge = np.concatenate([[0], np.cumsum(length)])
    for a in range(0, len(length), WORDS_AT_ONCE):
        b = min(len(length), a + WORDS_AT_ONCE)
        yield slice(a, b), data[edge[a] : edge[b]], length[a:b]


def symbols_of(data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' symbols with their marks, the place of each in its word, and its word."""
    begin = np.cumsum(length + 2) - (length + 2)
    word = np.repeat(np.arange(len(length), dtype=np.int32), length + 2)
    place = np.arange(len(word), dtype=np.int64)
    place -= begin[word]
    place = place.astype(np.int32)
    symbols = np.empty(len(word), np.uint8)
    symbols[begin] = BEGIN
    symbols[begin + length + 1] = END
    symbols[(place > 0) & (place <= length[word])] = data
    return symbols, place, word


def gram_keys(symbols: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    """For each order in turn, the key of the n-gram that ends at each symbol (0 where none does)."""
    value = np.zeros(len(symbols), np.int64)
    for k in range(1, ORDER + 1):
        value[1:] = value[:-1].copy()
        value[:1] = 0
        value <<= 8
        value |= symbols
        yield np.where(place >= k - 1, value | (k << SHIFT), 0)


def gram_counts(words: Vocabulary, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order: distinct n-grams that predict a symbol, and the sums of the words' weights (one column a class)."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for which, data, length in pieces(words.bytes, words.length):
        symbols, place, word = symbols_of(data, length)
        own_weight = weight[:, which]
        for into, own in zip(found, gram_keys(symbols, place), strict=True):
            use = (own > 0) & (place > 0)
            distinct, inverse = np.unique(own[use], return_inverse=True)
            of = word[use]
            into.append((distinct, np.stack([np.bincount(inverse, weights=x[of], minlength=len(distinct)) for x in own_weight], axis=1)))
    for of_order in found:
        if of_order:
            distinct, inverse = np.unique(np.concatenate([k for k, _ in of_order]), return_inverse=True)
            counts = np.concatenate([c for _, c in of_order])
            yield distinct, np.stack([np.bincount(inverse, weights=counts[:, c], minlength=len(distinct)) for c in range(len(weight))], axis=1).astype(np.int64)


def gram_set(words: Vocabulary) -> Iterator[np.ndarray]:
    """By order: the distinct n-grams of the words, begin marks included."""
    found: list[list[np.ndarray]] = [[] for _ in range(ORDER)]
    for _, data, length in pieces(words.bytes, words.length):
        symbols, place, _ = symbols_of(data, length)
        for into, own in zip(found, gram_keys(symbols, place), strict=True):
            into.append(np.unique(own[own > 0]))
    return (np.unique(np.concatenate(x)) for x in found if x)


# ---------------------------------------------------------------- streams


@dataclass
class Streams:
    """Texts as symbols: ORDER - 1 edge marks, the words with one space between them, and an edge mark. first: begin of each text, and the end of all."""

    symbols: np.ndarray
    first: np.ndarray
    words: np.ndarray


def streams_of(texts: pa.Array, lower: bool) -> Streams:
    w = words_of(texts, WHITE, lower)
    size = np.where(w.counts() > 0, 0, 1)  # bytes of each text's part: its words with an end each, or the end of an empty text
    length = w.end - w.start + 1
    size = size + np.bincount(w.row, weights=length, minlength=len(size)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size + ORDER - 1)])
    out = np.full(int(first[-1]), EDGE, np.uint8)
    at = np.cumsum(length) - length + (ORDER - 1) * (w.row + 1)
    empty = np.cumsum(np.where(w.counts() > 0, 0, 1))  # an empty text has an end of its own
    at += empty[w.row] if len(w.row) else 0
    for a in range(0, len(at), WORDS_AT_ONCE):
        own = slice(a, a + WORDS_AT_ONCE)
        n = length[own] - 1
        shift = np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[shift] = gather(w.buf, w.start[own], w.end[own])
        out[(at[own] + n)] = BEGIN
    out[first[1:] - 1] = EDGE
    return Streams(out, first, w.counts())


def stream_keys(symbols: np.ndarray) -> np.ndarray:
    """The n-gram of the highest order, without its order, that ends at each symbol; what ends before the ORDER-th symbol is cut short."""
    value = np.zeros(len(symbols), np.int64)
    for i in range(ORDER):
        value[i:] |= symbols[: len(symbols) - i].astype(np.int64) << (8 * i)
    return value


def predicted(streams: Streams) -> np.ndarray:
    """Whether a symbol is predicted: all but the marks at a text's begin."""
    use = np.ones(len(streams.symbols), bool)
    for i in range(ORDER - 1):
        use[streams.first[:-1] + i] = False
    return use


def _keyed(grams: np.ndarray, k: int) -> np.ndarray:
    """Keys of the last k symbols of the n-grams."""
    return np.unique(grams & ((1 << 8 * k) - 1)) | (k << SHIFT)


def stream_set(grams: np.ndarray) -> Iterator[np.ndarray]:
    """By order: the keys that the probabilities of these n-grams of the highest order ask for, as n-grams or as contexts; the empty context first."""
    yield np.zeros(1, np.int64)
    for k in range(1, ORDER + 1):
        held = _keyed(grams, k)
        yield held if k == ORDER else np.union1d(held, _keyed(grams >> 8, k))


def count_streams(docs: DataFrame, classes: int, lower: bool) -> DataFrame:
    """key and n0..: occurrences of each n-gram of the highest order in the streams of each class; the shorter ones with 0. docs: text and class."""
    names = [f"n{c}" for c in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("class")))
            for block in slices(batch, "text", BLOCK_BYTES):
                found = []
                for part in slices(block, "text", STREAM_PIECE):
                    streams = streams_of(part.column("text"), lower)
                    use = predicted(streams)
                    number, distinct = pd.factorize(stream_keys(streams.symbols)[use])
                    of = np.repeat(part.column("class").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(streams.first))[use]
                    found.append((distinct, np.stack([np.bincount(number[of == c], minlength=len(distinct)) for c in range(classes)], axis=1)))
                if not found:
                    continue
                number, distinct = pd.factorize(np.concatenate([k for k, _ in found]))
                counts = np.concatenate([c for _, c in found])
                sums = np.stack([np.bincount(number, weights=counts[:, c], minlength=len(distinct)) for c in range(classes)], axis=1).astype(np.int64)
                for k in range(1, ORDER + 1):
                    keys = _keyed(distinct, k) if k < ORDER else distinct | (ORDER << SHIFT)
                    own = sums if k == ORDER else np.zeros((len(keys), classes), np.int64)
                    for a in range(0, len(keys), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), *(pa.array(own[a : a + 100_000, c]) for c in range(classes))], names=["key", *names])

    parts = docs.select("text", F.col("class").cast("int").alias("class")).mapInArrow(tidy(run), "key long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("key").agg(*(F.sum(n).alias(n) for n in names))


# ---------------------------------------------------------------- model


def _order(key: Column) -> Column:
    return F.shiftright(key, SHIFT)


def _raw(key: Column, k: int, words: bool) -> Column:
    """Whether the n-gram's own count stands: of the highest order, or at a word's begin."""
    top = _order(key) == ORDER
    return top if not words else top | (F.shiftrightunsigned(key.bitwiseAND(F.lit((1 << SHIFT) - 1)), 8 * (k - 1)) == BEGIN)


def _by_order(key: Column, of: Callable[[int], Column]) -> Column:
    out = None
    for k in range(1, ORDER + 1):
        out = F.when(_order(key) == k, of(k)) if out is None else out.when(_order(key) == k, of(k))
    return out


def suffix(key: Column) -> Column:
    """Key of the n-gram without its first symbol."""
    return _by_order(key, lambda k: key.bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).bitwiseOR(F.lit((k - 1) << SHIFT)))


def context(key: Column) -> Column:
    """Key of the n-gram without its last symbol; 0 for the empty one."""
    return _by_order(key, lambda k: F.shiftright(key.bitwiseAND(F.lit((1 << SHIFT) - 1)), 8).bitwiseOR(F.lit((k - 1) << SHIFT)))


def discounts(n: list[float]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams with counts 1 to 4; usual values where these are missing."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def count_grams(docs: DataFrame, classes: int, lower: bool) -> DataFrame:
    """key and n0..: occurrences of each n-gram in the texts of each class. docs: text (no nulls) and class (0.., null: not counted)."""
    names = [f"n{c}" for c in range(classes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("class")))
            for block in slices(batch, "text", BLOCK_BYTES):
                words = Vocabulary(block, lower)
                of = np.repeat(block.column("class").to_numpy(zero_copy_only=False).astype(np.int64), words.counts)
                weight = np.stack([np.bincount(words.number[of == c], minlength=len(words.length)) for c in range(classes)]) if len(of) else np.zeros((classes, 0))
                for keys, counts in gram_counts(words, weight):
                    for a in range(0, len(keys), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000]), *(pa.array(counts[a : a + 100_000, c]) for c in range(classes))], names=["key", *names])

    parts = docs.select("text", F.col("class").cast("int").alias("class")).mapInArrow(tidy(run), "key long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("key").agg(*(F.sum(n).alias(n) for n in names))


def build_model(docs: DataFrame, classes: int = 1, lower: bool = False, words: bool = True) -> DataFrame:
    """The model of the texts, read as words or as streams. docs: text (no nulls) and class (0.., null: not counted)."""
    return model_of((count_grams if words else count_streams)(docs, classes, lower), classes, words)


def model_of(grams: DataFrame, classes: int, words: bool) -> DataFrame:
    """key, a, g: what each n-gram adds to the probability of its last symbol, and the weight it hands down as a context, less 1.

    These are of the interpolated model of all classes together. With several classes, a0, g0.. are those of each class, whose
    weight goes to the common model of the same order: rare expressions are smoothed by shared backoff counts.
    The table is written to the checkpoint folder.
    """
    cs = range(classes) if classes > 1 else range(0)
    grams = cut(grams)
    key = F.col("key")
    pooled = sum((F.col(f"n{c}") for c in range(1, classes)), F.col("n0"))
    before = grams.filter(_order(key) >= 2).groupBy(suffix(key).alias("key")).agg(F.count("*").alias("different"))  # symbols before it
    own = _by_order(key, lambda k: _raw(key, k, words))
    parts = ["", *map(str, cs)]
    counted = cut(
        grams.join(before, "key", "left")
        .select("key", context(key).alias("ctx"), F.when(own, pooled).otherwise(F.coalesce("different", F.lit(0))).alias("c"), *(F.when(own, F.col(f"n{c}")).otherwise(0).alias(f"c{c}") for c in cs))
    )
    tally = counted.groupBy(_order(key).alias("k")).agg(*(F.sum((F.col(f"c{c}") == i).cast("long")).alias(f"t{c}_{i}") for c in parts for i in range(1, 5))).collect()  # ORDER rows at most
    d = {(r["k"], c): discounts([r[f"t{c}_{i}"] or 0 for i in range(1, 5)]) for r in tally for c in parts}

    def off(c: str) -> Column:
        def pick(k: int) -> Column:
            one, two, more = d.get((k, c), discounts([0, 0, 0, 0]))
            return F.when(F.col(f"c{c}") == 0, 0.0).when(F.col(f"c{c}") == 1, one).when(F.col(f"c{c}") == 2, two).otherwise(more)

        return _by_order(key, pick)

    lowered = counted.select("*", *(off(c).alias(f"o{c}") for c in parts))
    total = lowered.groupBy("ctx").agg(*(F.sum(f"c{c}").alias(f"s{c}") for c in parts), *(F.sum(f"o{c}").alias(f"w{c}") for c in parts))
    adds = lowered.join(total, "ctx").select("key", *(F.when(F.col(f"s{c}") > 0, (F.col(f"c{c}") - F.col(f"o{c}")) / F.col(f"s{c}")).otherwise(0.0).alias(f"a{c}") for c in parts), *(F.lit(0.0).alias(f"g{c}") for c in parts))
    hands = total.select(F.col("ctx").alias("key"), *(F.lit(0.0).alias(f"a{c}") for c in parts), *(F.when(F.col(f"s{c}") > 0, F.col(f"w{c}") / F.col(f"s{c}") - 1).otherwise(0.0).alias(f"g{c}") for c in parts))
    both = adds.unionByName(hands).groupBy("key").agg(*(F.sum(x).cast("float").alias(x) for c in parts for x in (f"a{c}", f"g{c}")))
    return cut(both)


# ---------------------------------------------------------------- scoring


def _pack(x: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte and compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _block_id(batch: pa.RecordBatch) -> int:
    """A number of the block made from its ids and text lengths, so that it is the same whenever the block is read."""
    h = np.uint64(len(batch))
    ids = batch.column(0)
    ids = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.zeros(len(batch))
    size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
    both = np.concatenate([ids.astype(np.int64).view(np.uint64), size.astype(np.uint64)])
    if len(both):
        h = rolled(both[-64:], min(64, len(both)), 3)[0] ^ mix(np.array([mix(both).sum()], np.uint64))[0] ^ h
    return int(h) & ((1 << 62) - 1)


def word_scores(words_bytes: np.ndarray, length: np.ndarray, keys: np.ndarray, adds: list[np.ndarray], hands: list[np.ndarray]) -> list[np.ndarray]:
    """Log-likelihood of each word in the common model, then in each class, from a model's sorted keys and their columns."""
    if len(length) > WORDS_AT_ONCE:
        parts = [word_scores(data, own, keys, adds, hands) for _, data, own in pieces(words_bytes, length)]
        return [np.concatenate(x) for x in zip(*parts, strict=True)]
    symbols, place, word = symbols_of(words_bytes, length)
    n = len(word)
    empty = len(keys) and keys[0] == 0
    p = [np.full(n, UNIFORM) for _ in adds]
    hand = [np.full(n, 1.0 + (h[0] if empty else 0.0)) for h in hands]  # the weight that this order's context hands down
    for own in gram_keys(symbols, place):
        reach = own > 0
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        hit = (keys[at] == own) & reach if len(keys) else np.zeros(n, bool)
        for c in range(len(adds)):
            add = np.where(hit, adds[c][at], 0.0) if len(keys) else np.zeros(n)
            p[c] = np.where(reach, add + hand[c] * p[0], p[c])
            following = np.ones(n)
            if len(keys):
                following[1:] = np.where(hit, 1.0 + hands[c][at], 1.0)[:-1]
            hand[c] = following
    predicted = place > 0
    return [np.bincount(word[predicted], weights=np.log(np.maximum(x[predicted], 1e-12)), minlength=len(length)) for x in p]


def gram_scores(grams: np.ndarray, keys: np.ndarray, add: np.ndarray, hand: np.ndarray) -> np.ndarray:
    """Log-probability in the common model of the last symbol of each n-gram of the highest order, from a model's sorted keys and their columns."""
    p = np.full(len(grams), UNIFORM)

    def known(own: np.ndarray, values: np.ndarray, without: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(own), without)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return np.where(keys[at] == own, values[at], without)

    for k in range(1, ORDER + 1):
        last = grams & ((1 << 8 * k) - 1)
        before = (last >> 8) | ((k - 1) << SHIFT) if k > 1 else np.zeros(len(grams), np.int64)
        p = known(last | (k << SHIFT), add, 0.0) + (1.0 + known(before, hand, 0.0)) * p
    return np.log(np.maximum(p, 1e-12))


def _asked_and_shipped(docs: DataFrame, model: DataFrame, parts: list[str], keys_of: Callable, packed_of: Callable, size: int) -> tuple[DataFrame, DataFrame]:
    """The model's answers to each block's n-grams, and the blocks themselves: block, rows and columns of packed_of."""

    # the scan is cut into the same blocks each time it runs: parts of an Arrow batch; where that fails, _answers raises
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from slices(batch, "text", size)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            block = _block_id(batch)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0])], names=["block", "key"])
            for keys in keys_of(batch):
                keys = keys[keys != 0]
                for a in range(0, len(keys), 100_000):
                    part = keys[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part)], names=["block", "key"])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            packed = packed_of(batch)
            yield pa.RecordBatch.from_arrays([pa.array([_block_id(batch)]), *(pa.array([x], pa.binary()) for x in packed.values())], names=["block", *packed])

    names = ["rows", "numbers", "lengths", "bytes"]
    asked = docs.mapInArrow(tidy(ask), "block long, key long").join(model, "key").select("block", "key", *(x for c in parts for x in (f"a{c}", f"g{c}")))
    return asked, docs.mapInArrow(tidy(ship), "block long, " + ", ".join(f"{n} binary" for n in names))


def _answers(known: pa.Table, parts: list[str], blocks: int, empty: bool) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted keys of a block's answers, and their columns. Every block asks for the empty context, which every model but an empty one has."""
    known = known.combine_chunks()
    keys = known.column("key").to_numpy()
    order = np.argsort(keys)
    keys = keys[order]
    if blocks and not empty and not (len(keys) and keys[0] == 0):
        raise RuntimeError("a block's rows were read in another order than its requests: no answer belongs to it")
    adds, hands = ([known.column(x + c).to_numpy()[order].astype(np.float64) for c in parts] for x in "ag")
    return keys, adds, hands


def score(docs: DataFrame, model: DataFrame, lower: bool = False, sums: dict[str, Callable[[list[np.ndarray]], np.ndarray]] | None = None, words: bool = True) -> DataFrame:
    """All columns of docs but text, n_words, n_symbols, ll: natural log-likelihood of the whole text in the common model, and `sums`.

    sums (of texts as words): name -> function of the words' log-likelihoods (common model, classes) whose values are summed over each document's words.
    docs: an integer id as first column, and text without nulls. words: as for build_model.
    """
    sums = {"ll": lambda ll: ll[0]} | (sums or {})
    parts = [c[1:] for c in model.columns if c[0] == "a"]
    kept = [f for f in docs.schema.fields if f.name != "text"]
    nothing = model.isEmpty()

    def rows_of(batch: pa.RecordBatch, **more: np.ndarray) -> bytes:
        return _ipc(pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(x, pa.int64()) for x in more.values()], names=[f.name for f in kept] + list(more)))

    def word_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return gram_set(Vocabulary(batch, lower))

    def word_pack(batch: pa.RecordBatch) -> dict[str, bytes]:
        own = Vocabulary(batch, lower)
        return {"rows": rows_of(batch, n_words=own.counts), "numbers": _pack(own.number), "lengths": _pack(own.length), "bytes": zstandard.compress(own.bytes.tobytes(), 1)}

    def stream_keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        found = []
        for part in slices(batch, "text", STREAM_PIECE):
            streams = streams_of(part.column("text"), lower)
            found.append(pd.unique(stream_keys(streams.symbols)[predicted(streams)]))
        return stream_set(pd.unique(np.concatenate(found))) if found else iter(())

    def stream_pack(batch: pa.RecordBatch) -> dict[str, bytes]:
        own = [streams_of(part.column("text"), lower) for part in slices(batch, "text", STREAM_PIECE)]
        rows = rows_of(batch, n_words=np.concatenate([x.words for x in own]))
        return {"rows": rows, "numbers": b"", "lengths": _pack(np.concatenate([np.diff(x.first) for x in own])), "bytes": zstandard.compress(np.concatenate([x.symbols for x in own]).tobytes(), 3)}

    def word_sums(table: pa.Table, numbers: bytes, lengths: bytes, data: bytes, keys: np.ndarray, adds: list, hands: list) -> list[np.ndarray]:
        number, length = _unpack(numbers), _unpack(lengths)
        ll = word_scores(np.frombuffer(zstandard.decompress(data), np.uint8), length, keys, adds, hands)
        edge = np.concatenate([[0], np.cumsum(table.column("n_words").to_numpy())])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[number])])[edge])
        return [total((length + 1).astype(np.float64)), *(total(of(ll)) for of in sums.values())]

    def stream_sums(table: pa.Table, numbers: bytes, lengths: bytes, data: bytes, keys: np.ndarray, adds: list, hands: list) -> list[np.ndarray]:
        length, symbols = _unpack(lengths), np.frombuffer(zstandard.decompress(data), np.uint8)
        ll, edge = np.zeros(len(length)), np.concatenate([[0], np.cumsum(length)])
        a = 0
        while a < len(length):  # pieces of whole texts
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + STREAM_PIECE, "right")) - 1)
            own = Streams(symbols[edge[a] : edge[b]], edge[a : b + 1] - edge[a], length[a:b])
            use = predicted(own)
            number, grams = pd.factorize(stream_keys(own.symbols)[use])
            of = np.repeat(np.arange(b - a), length[a:b])[use]
            ll[a:b] = np.bincount(of, weights=gram_scores(grams, keys, adds[0], hands[0])[number], minlength=b - a)
            a = b
        some = table.column("n_words").to_numpy() > 0
        return [np.where(some, length - (ORDER - 1), 0), np.where(some, ll, 0.0)]

    keys_of, packed_of, sums_of = (word_keys, word_pack, word_sums) if words else (stream_keys_of, stream_pack, stream_sums)
    asked, shipped = _asked_and_shipped(docs, model, parts, keys_of, packed_of, BLOCK_BYTES if words else STREAM_BLOCK_BYTES)
    names = [f.name for f in kept] + ["n_words", "n_symbols", *sums]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words long, n_symbols long", *(f"`{c}` double" for c in sums)])
    types = [to_arrow_type(f.dataType) for f in kept] + [pa.int64(), pa.int64(), *(pa.float64() for _ in sums)]

    def answer(known: pa.Table, blocks: pa.Table) -> pa.Table:
        keys, adds, hands = _answers(known, parts, blocks.num_rows, nothing)
        out = []
        for rows, *packed in zip(*(blocks.column(n).to_pylist() for n in ("rows", "numbers", "lengths", "bytes")), strict=True):
            table = pa.ipc.open_stream(rows).read_all()
            n, *values = sums_of(table, *packed, keys, adds, hands)
            table = table.append_column("n_symbols", pa.array(np.rint(n).astype(np.int64), pa.int64()))
            for name, value in zip(sums, values, strict=True):
                table = table.append_column(name, pa.array(value.astype(np.float64)))
            out.append(table)
        release()
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})

    return asked.groupBy("block").cogroup(shipped.groupBy("block")).applyInArrow(answer, schema)


def labelled(docs: DataFrame, labels: DataFrame, *names: str) -> DataFrame:
    """docs with the label columns (null without a label; the largest where a doc_id has several labels).

    Labels of a checked size are broadcast; more of them are joined by shuffle, and what comes of it is written once: score() reads
    its rows several times and needs them in the same order.
    """
    own = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_id")).agg(*(F.max(n).alias(f"_{n}") for n in names))
    few = labels.count() <= BROADCAST_LABELS
    rows = docs.join(F.broadcast(own) if few else own, docs["doc_id"] == F.col("_label_id"), "left").drop("_label_id")
    return rows if few else stored(rows)
