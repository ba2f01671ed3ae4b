"""Repeated passages by seed and extend: winnowed anchors, extension around shared ones, removal of maximal repeats.

Each window of `length` words owns the anchor that winnowing picks in it (the smallest hash of its ANCHOR-word runs),
so two equal windows own equal anchors. Anchors that stand in one document only are dropped. Around each remaining
anchor the match is extended both ways, one window after the other, and compared for all documents of the anchor at once by
window (128 bits), never pair by pair; a run of windows that repeat is a maximal repeat of `length` words or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.llm.text import WHITE, Words, mix, rolled, slices, texts_of, tidy, words_of

ANCHOR = 5


def _windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, row, anchor hash) of each window that lies within a row."""
    h = words.hashes()
    if len(h) < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    start = np.arange(len(h) - length + 1)
    runs = rolled(h, min(ANCHOR, length), 1)
    width = length - min(ANCHOR, length) + 1
    anchor = runs[: len(start)].copy()
    for i in range(1, width):
        np.minimum(anchor, runs[i : i + len(start)], out=anchor)
    inside = words.row[start] == words.row[start + length - 1]
    return start[inside], words.row[start[inside]], anchor[inside]


def _distinct(row: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct combinations, sorted by row."""
    order = np.lexsort((*values[::-1], row))
    columns = [x[order] for x in (row, *values)]
    if not len(row):
        return columns
    new = np.ones(len(row), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return [x[new] for x in columns]


def _span(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the smallest and the largest id among those of equal keys."""
    if not len(ids):
        return ids, ids
    order = np.lexsort((ids, *keys[::-1]))
    new = np.ones(len(ids), bool)
    new[1:] = np.logical_or.reduce([(k := x[order])[1:] != k[:-1] for x in keys])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    low, high = np.empty_like(ids), np.empty_like(ids)
    group = np.cumsum(new) - 1
    low[order], high[order] = ids[order][first][group], ids[order][last][group]
    return low, high


def _salts(ids: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """0 for what is open, and an odd number of the id for what is settled."""
    return np.where(settled, (mix(ids.view(np.uint64), 23) | np.uint64(1)).view(np.int64), 0)


def anchors(rows: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, salt): the distinct anchors of each document.

    salt is 0 unless another doc_id of the slice has the anchor; the smallest of these has a row of salt 0 besides its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, row, anchor = _windows(words_of(part.column("text"), WHITE), length)
                row, anchor = _distinct(row, anchor)
                ids = part.column("doc_id").to_numpy()[row]
                low, high = _span(ids, anchor)
                salt = _salts(ids, low < high)
                for_all = (low < high) & (ids == low)
                columns = [np.concatenate([x, x[for_all]]) for x in (anchor.view(np.int64), ids)] + [np.concatenate([salt, np.zeros(for_all.sum(), np.int64)])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "doc_id", "salt"])

    return rows.mapInArrow(tidy(run), "h long, doc_id long, salt long")


def _sorted_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the lists' values, sorted."""
    flat = column.flatten().to_numpy().view(np.uint64)
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    row, flat = _distinct(row, flat)
    return row, flat


def _member(row: np.ndarray, value: np.ndarray, in_row: np.ndarray, in_value: np.ndarray) -> np.ndarray:
    """Whether (row, value) is among the distinct (in_row, in_value)."""
    n = len(in_row)
    rows, values = np.concatenate([in_row, row]), np.concatenate([in_value, value])
    order = np.lexsort((np.arange(len(rows)), values, rows))
    group = np.zeros(len(rows), np.int64)
    r, v = rows[order], values[order]
    if len(r):
        group[1:] = np.cumsum((r[1:] != r[:-1]) | (v[1:] != v[:-1]))
    number = np.empty(len(rows), np.int64)
    number[order] = group
    known = np.zeros(int(group[-1]) + 1 if len(group) else 1, bool)
    known[number[:n]] = True
    return known[number[n:]]


def _window_hashes(words: Words, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    h = words.hashes()
    return (rolled(h, length, 2)[start], rolled(h, length, 3)[start]) if len(start) else (np.zeros(0, np.uint64),) * 2


def extended(hits: DataFrame, length: int) -> DataFrame:
    """(w1, w2, doc_id, salt): the distinct windows around the anchors that a document shares. hits: doc_id, text, anchors.

    salt is 0 unless a smaller doc_id of the slice has the window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), WHITE)
                start, row, anchor = _windows(words, length)
                use = _member(row, anchor, *_sorted_lists(part.column("anchors")))
                w1, w2 = _window_hashes(words, start[use], length)
                row, w1, w2 = _distinct(row[use], w1, w2)
                ids = part.column("doc_id").to_numpy()[row]
                salt = _salts(ids, _span(ids, w1, w2)[0] < ids)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1.view(np.int64), w2.view(np.int64), ids, salt)], names=["w1", "w2", "doc_id", "salt"])

    return hits.mapInArrow(tidy(run), "w1 long, w2 long, doc_id long, salt long")


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _untouched(rows: DataFrame) -> DataFrame:
    """doc_id, n_words and the digest of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                split = [x.as_buffer().to_pybytes().split() for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(w) for w in split], pa.int64()), pa.array([_digest(w) for w in split], pa.string())], names=["doc_id", "n_words", "whole"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, whole string")


def _cut_out(hits: DataFrame, length: int) -> DataFrame:
    """doc_id, whole, n_removed, kept_sha256, kept_text of documents with repeats. hits: doc_id, text, repeats (w1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), WHITE)
                start, row, _ = _windows(words, length)
                w1, _ = _window_hashes(words, start, length)
                covered = np.zeros(len(words.start) + 1, np.int64)
                first = start[_member(row, w1, *_sorted_lists(part.column("repeats")))]
                np.add.at(covered, first, 1)
                np.add.at(covered, first + length, -1)
                gone = np.cumsum(covered)[:-1] > 0
                whole, removed, kept, texts = [], [], [], []
                for i, x in enumerate(part.column("text")):
                    own = x.as_buffer().to_pybytes().split()
                    mask = gone[words.first[i] : words.first[i + 1]]
                    left = [w for w, g in zip(own, mask.tolist(), strict=True) if not g]
                    whole.append(_digest(own))
                    removed.append(int(mask.sum()))
                    kept.append(_digest(left))
                    texts.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(whole), pa.array(removed, pa.int64()), pa.array(kept), pa.array(texts, pa.string())], names=["doc_id", "whole", "n_removed", "kept_sha256", "kept_text"])

    return hits.mapInArrow(tidy(run), "doc_id long, whole string, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, length: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs, without passages that a smaller doc_id holds.

    Words are runs of anything but ASCII white space, unchanged. A word goes if a window of `length` words over it
    starts in a document with a smaller doc_id as well; windows are those of the input. A null text counts as empty, and a
    text of fewer words than a window keeps all. A row with a null doc_id keeps all and takes nothing from others.
    Rows that repeat a doc_id take nothing from each other and lose the same windows. Other columns are left out.
    with_text: kept_text too, null for a row that loses nothing.
    """
    rows = texts_of(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rows.filter("doc_id is not null")
    by_anchor = Window.partitionBy("h", "salt")
    shared = anchors(named, length).withColumns({"low": F.min("doc_id").over(by_anchor), "high": F.max("doc_id").over(by_anchor)}).filter("salt <> 0 or low < high")
    hits = named.join(shared.groupBy("doc_id").agg(F.collect_list("h").alias("anchors")), "doc_id").select("doc_id", "text", "anchors")
    by_window = Window.partitionBy("w1", "w2", "salt")
    repeats = extended(hits, length).withColumn("low", F.min("doc_id").over(by_window)).filter("salt <> 0 or low < doc_id")
    losing = named.join(repeats.groupBy("doc_id").agg(F.collect_list("w1").alias("repeats")), "doc_id").select("doc_id", "text", "repeats")
    cut_out = _cut_out(losing, length)
    if not with_text:
        cut_out = cut_out.drop("kept_text")
    out = _untouched(rows).join(cut_out.dropDuplicates(["doc_id", "whole"]), ["doc_id", "whole"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), *(["kept_text"] if with_text else []))
