"""Embedding whitening: exact centring, the Gramian matrix of an MLlib RowMatrix, a local eigendecomposition, whitening by a broadcast.

Entries become whole numbers, so sums are exact, and n * x - S is n times the centred row without any rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.session import stored

#: Steps of a unit; whole numbers up to this are exact as doubles and leave room for sums of 64 bits.
STEPS = 256
EXACT = 1 << 53
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array of long): floor(256 * entry). A null vector, or one with a null or non-finite entry, has no row."""
    entries = F.col("embedding").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))
    kept = embeddings.filter(F.col("embedding").isNotNull()).filter(~F.exists(entries, bad))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(c * STEPS).cast("long")).alias("x"))


def _filled(x: Column, width: int) -> Column:
    """x with zeros behind it up to the width."""
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


@dataclass
class Whitening:
    """What fit() learned: n x-vectors with sums S, the leading eigenvectors (columns) and eigenvalues of their covariance, its trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    least: float

    def transform(self, spark, rows: DataFrame) -> DataFrame:
        """A row for each vector and component: vec_id, component, n, deviation, whitened, explained."""
        model = spark.sparkContext.broadcast(self)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = model.value
            for batch in batches:
                yield m.rows_of(batch["vec_id"], batch["x"])

        return rows.mapInPandas(run, OUT)

    def covered(self, rows: DataFrame) -> DataFrame:
        """white (array of double) of each row's x: its components with variance."""
        model = rows.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = model.value
            for batch in batches:
                yield pd.DataFrame({"white": list(m.project(m.centred(batch["x"]))[:, m.values > m.least])})

        return rows.select("x").mapInPandas(run, "white array<double>")

    def centred(self, xs: pd.Series) -> np.ndarray:
        """n * x - S, exact: as 64 bits where their squares' sum fits, else as Python's numbers."""
        x = np.stack([np.asarray(v, np.int64) for v in xs]) if len(xs) else np.zeros((0, len(self.sums)), np.int64)
        top = max(map(abs, self.sums), default=0) + self.n * int(max(x.max(initial=0), -int(x.min(initial=0))))
        exact = top * top * len(self.sums) < 1 << 63
        return x * self.n - np.array(self.sums, np.int64) if exact else x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        told = self.values > self.least
        return np.where(told, (centred / self.n).astype(np.float64) @ self.vectors / np.sqrt(np.where(told, self.values, 1.0)), np.nan)

    def rows_of(self, ids: pd.Series, xs: pd.Series) -> pd.DataFrame:
        k, centred = len(self.values), self.centred(xs)
        deviation = (centred * centred).sum(axis=1)
        fits = [int(v) if v < 1 << 63 else None for v in deviation]
        out = pd.DataFrame({"vec_id": pd.array(ids.array, "Int64").repeat(k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(xs)), "n": np.full(len(xs) * k, self.n), "deviation": pd.array(fits, "Int64").repeat(k)})
        out["whitened"] = [None if np.isnan(v) else v for v in self.project(centred).ravel()]
        out["explained"] = np.tile(self.values / self.trace if self.trace else np.full(k, np.nan), len(xs))
        return out


def fit_whitening(fit: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the rows' x (arrays of long of one length, of 1 at least); None without rows. What reaches the driver is the dimension squared."""
    ends = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("double"))))).alias("top")).first()
    n, sums = ends["n"], [0] * (ends["width"] or 0)
    if not n:
        return None
    for r in fit.select(F.posexplode("x").alias("slot", "v")).groupBy("slot").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s")).collect():  # a row a dimension
        sums[r["slot"]] = int(r["s"])
    if n * ends["top"] + max(map(abs, sums)) < EXACT:
        by_slot = F.array(*(F.lit(s).cast("long") for s in sums))
        centred = F.zip_with("x", by_slot, lambda a, s: (a * n - s).cast("double"))
    else:  # beyond whole doubles, so rounded once
        by_slot = F.array(*(F.lit(float(s)) for s in sums))
        centred = F.zip_with("x", by_slot, lambda a, s: a.cast("double") * n - s)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("row")), "row"))
    covariance = matrix.computeGramianMatrix().toArray() / n / n / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values)[:components]
    least = max(float(values.max()), 0.0) * len(sums) * np.finfo(float).eps * 8
    return Whitening(n, sums, vectors[:, order], np.maximum(values[order], 0.0), float(np.trace(covariance)), least)


def identity_error(model: Whitening, fit: DataFrame) -> float:
    """Largest absolute entry of the covariance (centred, divided by n) of the fitted rows' whitened components, minus the identity."""
    told = range(int((model.values > model.least).sum()))
    pairs = [(a, b) for a in told for b in told if a <= b]
    if not pairs:
        return 0.0
    found = model.covered(fit).agg(*(F.covar_pop(F.col("white")[a], F.col("white")[b]).alias(f"{a}_{b}") for a, b in pairs)).first()
    return max(abs(found[f"{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: the leading components of each vector, whitened.

    Rows whose vector is null or holds null or non-finite entries go. Vectors shorter than the longest one count as filled with
    zeros. Repeated vectors are fitted once, and each of their rows comes out; a null vec_id stays null. A component without variance (one
    distinct vector, or fewer than dimensions) has whitened null and doesn't count in identity_error, which is 0 if none does; explained
    is NaN where nothing varies. deviation is null beyond 64 bits. An empty table, or empty vectors only, give no rows. Other columns
    are not read.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.withColumn("x", _filled(F.col("x"), width))
    fit = stored(rows.select("x").distinct())
    model = fit_whitening(fit, components) if width else None
    if model is None:
        return spark.createDataFrame([], OUT + ", identity_error double")
    return model.transform(spark, rows).withColumn("identity_error", F.lit(identity_error(model, fit)))
