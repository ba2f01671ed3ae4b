"""Isolation forest: trees grown on small samples, scores by vectorised descent."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.session import dealt, stored

EULER = 0.5772156649


@dataclass
class Tree:
    """Nodes as arrays: split column (-1 for a leaf), split value, left and right child, rows of a leaf, ends of the node's values in the split column."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def depth(self, x: np.ndarray, cost, ends: bool = True) -> np.ndarray:
        """Path lengths. ends: a value beyond the ends of a node's values is set apart there by as much of the chance as its distance is
        of the range with it, as a split would do had the row been drawn; otherwise it goes with the outermost values, however far it is."""
        at, steps, there = np.zeros(len(x), np.int64), np.zeros(len(x)), np.ones(len(x))
        while True:
            inner = self.column[at] >= 0
            if not inner.any():
                break
            i = np.flatnonzero(inner)
            node = at[i]
            v = x[i, self.column[node]]
            at[i] = np.where(v < self.value[node], self.left[node], self.right[node])
            steps[i] += there[i]
            if ends:
                beyond = np.maximum(self.low[node] - v, v - self.high[node])
                out = np.flatnonzero(beyond > 0)
                with np.errstate(divide="ignore", over="ignore"):  # a range of 0: the row is set apart for certain
                    there[i[out]] /= 1 + beyond[out] / (self.high - self.low)[node[out]]
        return steps + there * np.array([cost(s) if s > 1 else 1.0 for s in self.size])[at] + (1 - there)


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n if n > 2 else 1.0 if n == 2 else 0.0


def whole_path(n: int) -> float:
    """As average_path, cut to a whole number and with a whole quotient, as the published pipeline computes it."""
    return float(int(2 * (math.log(n - 1) + EULER) - 2 * (n - 1) // n)) if n > 1 else 0.0


def grow(x: np.ndarray, height: int, rng: np.random.Generator) -> Tree:
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, len(rows), 0.0, 0.0])
        if depth < height and len(rows) > 1:
            c = int(rng.integers(x.shape[1]))
            low, high = x[rows, c].min(), x[rows, c].max()
            split = low + rng.random() * (high - low)
            below = x[rows, c] < split
            nodes[me][:2] = c, split
            nodes[me][5:] = low, high
            nodes[me][2] = add(rows[below], depth + 1)
            nodes[me][3] = add(rows[~below], depth + 1)
        return me

    add(np.arange(len(x)), 0)
    return Tree(*(np.array(a) for a in zip(*nodes, strict=True)))


@dataclass
class Forest:
    columns: list[str]
    trees: list[Tree]
    rows: int
    whole: bool = False

    def score(self, frame: DataFrame, out: str = "score") -> DataFrame:
        """frame with the score: 2 ** (-mean path / average path), near 1 for what is easily set apart. A null or non-number counts as 0."""
        trees, cost, ends = self.trees, whole_path if self.whole else average_path, not self.whole
        scale, names = cost(self.rows) or 1.0, self.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.nan_to_num(batch[names].to_numpy(dtype=np.float64))
                yield batch.assign(**{out: 2.0 ** -(np.mean([t.depth(x, cost, ends) for t in trees], axis=0) / scale) if len(x) else np.zeros(0)})

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
        return frame.mapInPandas(run, f"{kinds}, `{out}` double")


def _uniform(*parts) -> Column:
    """A number from 0 to 1, the same for the same parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def _copies(key: int, tree: int, first: float, count: int, top: float, seed: int) -> list[float]:
    """The smallest of `count` uniform numbers, rising, as far as `top`, where the smallest is known: each is drawn from what lies above the last."""
    rng = np.random.default_rng([seed, tree, key & (1 << 64) - 1])
    out, x = [first], first
    for left in range(count - 1, 0, -1):
        x = 1 - (1 - x) * (1 - rng.random()) ** (1 / left)
        if x >= top:
            break
        out.append(x)
    return out


def bounded_samples(frame: DataFrame, columns: list[str], samples: int, size: int, seed: int, rows: int | None = None) -> list[np.ndarray]:
    """`samples` independent uniform samples of `size` rows (of all, if there are fewer), without replacement, as arrays of the columns.

    A row's number in a sample comes from a hash of its values and the sample's own, and the rows of the smallest numbers are drawn. So
    every row has the same chance, wherever it stands, and the same rows in another order or other partitions give the same samples. Equal
    rows are counted (by a hash of 8 bytes a row), and get as many numbers as there are: the smallest of m uniform numbers is drawn at once.
    Only rows of numbers below a bound reach the driver: about size * samples in all, however large the table is.
    A null or non-number counts as 0. rows: how many there are, if that is known; equal rows are counted in as many tasks as these need.
    """
    with dealt(frame.sparkSession, frame.count() if rows is None else rows):
        return _samples(frame, columns, samples, size, seed)


def _samples(frame: DataFrame, columns: list[str], samples: int, size: int, seed: int) -> list[np.ndarray]:
    hashed = [f.name for f in frame.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = frame.select(F.xxhash64(*(F.col(f"`{c}`") for c in hashed)).alias("_key"), *(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(columns)))
    counts = stored(rows.groupBy("_key").agg(F.count("*").alias("m")))
    n = counts.agg(F.sum("m")).first()[0] or 0
    wanted, top = min(size, n), 0.0
    if not wanted:
        return [np.zeros((0, len(columns)))] * samples
    bound = (wanted + 6 * math.sqrt(wanted) + 30) / n
    each = counts.select("_key", "m", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("tree"))
    each = each.withColumn("first", -F.expm1(F.log1p(-_uniform(F.col("_key"), F.col("tree"), F.lit(seed))) / F.col("m")))
    drawn: list[list[int]] = []
    while not drawn:
        top = 2.0 if bound >= 1 else bound
        found: list[list[tuple[float, int]]] = [[] for _ in range(samples)]
        for r in each.filter(F.col("first") < top).collect():  # about the bound times n for each sample
            found[r["tree"]] += ((x, r["_key"]) for x in _copies(r["_key"], r["tree"], r["first"], r["m"], top, seed))
        if all(len(own) >= wanted for own in found):
            drawn = [[key for _, key in sorted(own)[:wanted]] for own in found]
        bound *= 4
    keys = frame.sparkSession.createDataFrame([(k,) for k in sorted({k for own in drawn for k in own})], "_key long")
    first = rows.join(F.broadcast(keys), "_key", "left_semi").groupBy("_key").agg(F.min(F.array(*(f"_{i}" for i in range(len(columns))))).alias("x"))
    known = {r["_key"]: np.nan_to_num(np.array(r["x"], np.float64)) for r in first.collect()}  # as many as were drawn
    return [np.array([known[k] for k in own]) for own in drawn]


def fit_forest(frame: DataFrame, columns: list[str], trees: int = 10, sample: int = 256, seed: int = 7, published: bool = False) -> Forest:
    """A forest of trees grown on `sample` rows each, drawn for each tree anew: what reaches the driver is about trees * sample rows.

    The rows' order and partitions don't matter. published: one sample for all trees, natural-logarithm height, whole path costs by the number of all
    rows, as the published pipeline has it; otherwise the algorithm as its authors describe it, save that a row beyond the drawn values is
    set apart by its distance.
    """
    height = math.ceil(math.log(sample) if published else math.log2(sample))
    drawn = bounded_samples(frame, columns, 1 if published else trees, sample, seed)
    rng = np.random.default_rng(seed)
    own = [drawn[0] if published else drawn[t] for t in range(trees)]
    grown = [grow(x, height, rng) if len(x) else Tree(*(np.array([v]) for v in (-1, 0.0, 0, 0, 0, 0.0, 0.0))) for x in own]
    return Forest(columns, grown, frame.count() if published else max(len(drawn[0]), 1), published)
