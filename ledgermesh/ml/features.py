"""Feature stages and small pipelines over vectors and categories."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, MinMaxScaler, Normalizer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_META = "ml_attr"


def vector(values: Column) -> Column:
    """A dense vector of an array of numbers."""
    return array_to_vector(F.transform(values, lambda x: x.cast("double")))


def assemble(frame: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(frame)


def normalise(frame: DataFrame, p: float = 2.0, column: str = "features", out: str = "normed") -> DataFrame:
    """Vectors over their p-norm; float('inf') for the largest magnitude."""
    return Normalizer(inputCol=column, outputCol=out, p=p).transform(frame)


def standardise(frame: DataFrame, column: str = "features", out: str = "scaled", with_mean: bool = False) -> DataFrame:
    """Vectors over their slots' sample deviations."""
    return StandardScaler(inputCol=column, outputCol=out, withStd=True, withMean=with_mean).fit(frame).transform(frame)


def min_max_scale(frame: DataFrame, column: str = "features", out: str = "scaled") -> DataFrame:
    return MinMaxScaler(inputCol=column, outputCol=out).fit(frame).transform(frame)


def name_slots(frame: DataFrame, column: str, names: list[str]) -> DataFrame:
    """The vector column with names for its slots."""
    attrs = {"attrs": {"numeric": [{"idx": i, "name": n} for i, n in enumerate(names)]}, "num_attrs": len(names)}
    return frame.withMetadata(column, {SLOT_META: attrs})


def slice_slots(frame: DataFrame, column: str, out: str, indices: list[int] = (), names: list[str] = ()) -> DataFrame:
    """The slots of the given indices, then those of the given names."""
    return VectorSlicer(inputCol=column, outputCol=out, indices=list(indices), names=list(names)).transform(frame)


def index_categories(frame: DataFrame, columns: list[str], tail_in: str = "", tail_out: str = "_idx") -> DataFrame:
    """`<c><tail_out>` for each `<c><tail_in>`: numbers by falling frequency, ties by value; rows with an unseen or null value are skipped."""
    indexer = StringIndexer(inputCols=[c + tail_in for c in columns], outputCols=[c + tail_out for c in columns], handleInvalid="skip", stringOrderType="frequencyDesc")
    return indexer.fit(frame).transform(frame)


def filled_vectors(frame: DataFrame, columns: list[str]) -> DataFrame:
    """`<c>_CatVec` for each `<c>_filled`."""
    return index_categories(frame, columns, "_filled", "_CatVec")


def k_means(frame: DataFrame, k: int = 2, seed: int = 1, column: str = "features"):
    """(frame with prediction, centres, cost): the cost is the sum of squared distances to the centres."""
    model = KMeans(featuresCol=column, k=k, seed=seed).fit(frame)
    return model.transform(frame), model.clusterCenters(), model.summary.trainingCost


def random_forest(frame: DataFrame, features: list[str], label: str = "label", trees: int = 5, seed: int = 7, train: float = 0.8):
    """(model, predictions on the rest, accuracy): labels are indexed, and predictions turned back into labels."""
    labels = StringIndexer(inputCol=label, outputCol="indexedLabel").fit(frame)
    stages = [labels, VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(labelCol="indexedLabel", featuresCol="features", numTrees=trees, seed=seed), IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=labels.labels)]
    fit, rest = frame.randomSplit([train, 1 - train], seed)
    model = Pipeline(stages=stages).fit(fit)
    out = model.transform(rest)
    accuracy = MulticlassClassificationEvaluator(labelCol="indexedLabel", predictionCol="prediction", metricName="accuracy").evaluate(out)
    return model, out, accuracy
