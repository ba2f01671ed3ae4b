"""Vectorised word handling over Arrow string columns.

Texts are handled as one UTF-8 byte buffer a slice, so that words, hashes and
shingles are NumPy operations and no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

try:
    _LIBC = ctypes.CDLL(None)
except (OSError, TypeError):  # a system without a C library to name
    _LIBC = None

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes outside words of letters, digits and non-ASCII characters, after lower-casing A-Z.
PUNCT = np.zeros(256, dtype=bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def release() -> None:
    """Give memory that is no longer in use back to the system: a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, with memory released at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def texts_of(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of `keep` and `text`, a null text as an empty one."""
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values; `salt` selects another one."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & _MASK)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_POW: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        up, down = _powers(size, _BASE), _powers(size, _BASE_INV)
        if n > 4 * SLICE_BYTES:  # tables for a single giant text are not kept
            return up, down
        _POW.update(up=up, down=down)
    return _POW["up"], _POW["down"]


@dataclass
class Words:
    """The words of a slice: byte ranges in `buf`, 64-bit hashes, and the row of each."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # of each row and one more: index of its first word
    n_rows: int

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        up, down = _power_tables(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
            h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array, separators: np.ndarray, lower: bool = False) -> Words:
    """Words of texts without nulls: maximal runs of bytes that are no separators."""
    ended = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary())) if len(texts) else pa.array([], pa.large_binary())
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    offsets = np.frombuffer(ended.buffers()[1], dtype=np.int64)[ended.offset : ended.offset + len(ended) + 1] if len(ended) else np.zeros(1, np.int64)
    data = ended.buffers()[2] if len(ended) else None
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        buf = LOWER[buf]
    inside = ~separators[buf]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]  # every text ends in a separator, so edges pair up
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buf, start, end, row, first, len(texts))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batch with about `most` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size + 64) - (size + 64)) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def rolled(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of the k values from each position on; the last k - 1 positions are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, own = np.zeros(n, dtype=np.uint64), mix(h, salt)
    base = np.uint64((0xD6E8FEB86659FD93 + 2 * salt) & _MASK)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * base + own[i : i + n]
    return mix(out, salt + 7)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct k-word shingles, sorted by row and hash.

    A row with fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    h = words.hashes()
    count = words.counts()
    rolls = rolled(h, k, 0)
    at = np.arange(len(rolls))
    whole = words.row[at] == words.row[at + k - 1] if len(rolls) else np.zeros(0, bool)
    rows, values = words.row[at[whole]], rolls[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        more = np.array([int(mix(rolled(h[words.first[r] : words.first[r + 1]], int(count[r]), 0), 11 + int(count[r]))[0]) for r in short], dtype=np.uint64)
        rows, values = np.concatenate([rows, short]), np.concatenate([values, more])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(rows):
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[new], values[new]
    return rows, values
