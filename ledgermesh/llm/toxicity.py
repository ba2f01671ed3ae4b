"""Toxicity: class-conditional Kneser-Ney models with shared backoff counts, compared by length-normalised log-likelihood."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.kneser_ney import build_model, labelled, score
from ledgermesh.llm.text import texts_of
from ledgermesh.session import cut

#: A word speaks for a class if its log-likelihood ratio is beyond FREE; what is beyond counts up to MOST.
FREE, MOST = 2.0, 6.0
#: Labelled documents at most (by the smallest hashes of doc_id) on which the calibration is fitted.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
#: Of the calibration: the log-likelihood ratio by word and by root of words, that of the words that speak for the toxic class, and the words' number.
FEATURES = ["ratio", "_z", "_rate", "_strong", "_length"]


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and coefficients (the last one is the intercept) of a ridge logistic regression by Newton's steps."""
    mean, dev = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, dev, w


def toxicity_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs, with n_words and the log-likelihood ratio by symbol.

    Labels are learnt only where the crc32 of doc_id isn't 2 modulo 4; of those, a quarter by another hash
    serves to calibrate the score and the rest to count n-grams. Scores depend on the text alone. A text that
    is null or has no words has a ratio of 0, whose score the calibration gives. Without labels of
    both classes scores are 0.5 by the same rule. Repeated rows repeat; other columns are left out.
    """
    rows = labelled(texts_of(docs, "doc_id"), labels, "toxic")
    learn = F.coalesce(remainder(F.col("doc_id")) != 2, F.lit(False)) & F.col("_toxic").isNotNull()
    calibrates = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(4)) == 0
    rows = rows.withColumn("_toxic", F.when(learn, F.when(F.col("_toxic") > 0, 1).otherwise(0))).withColumn("_fit", learn & calibrates)
    model = build_model(rows.select("text", F.when(~F.col("_fit"), F.col("_toxic")).alias("class")), classes=2, lower=True)
    scored = score(rows, model, lower=True, sums={"llr": lambda ll: ll[2] - ll[1], "strong": lambda ll: np.clip(ll[2] - ll[1] - FREE, 0, MOST)})
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    scored = cut(scored.select("doc_id", "_fit", "_toxic", "n_words", (F.col("llr") / n).alias("ratio"), (F.col("llr") / F.sqrt(n)).alias("_z"), (F.col("strong") / n).alias("_rate"), F.log1p("strong").alias("_strong"), F.log1p("n_words").alias("_length")))
    sample = scored.filter("_fit").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(CALIBRATION_ROWS).select(*FEATURES, "_toxic").toPandas()  # CALIBRATION_ROWS rows at most
    if sample["_toxic"].nunique() < 2:
        points = F.lit(0.0)
    else:
        mean, dev, w = fit_logistic(sample[FEATURES].to_numpy(np.float64), sample["_toxic"].to_numpy(np.float64))
        points = sum(((F.col(c) - float(m)) / float(s) * float(v) for c, m, s, v in zip(FEATURES, mean, dev, w, strict=False)), F.lit(float(w[-1])))
    out = scored.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(points, F.lit(30.0)), F.lit(-30.0)))))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "ratio")
