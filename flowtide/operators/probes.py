"""Classifiers fitted with MLlib on prefix features."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _regression(features: str = "features", label: str = "label") -> LogisticRegression:
    return LogisticRegression(
        featuresCol=features, labelCol=label, family="multinomial", regParam=1e-3, maxIter=50
    )


def prefix_regression(flows: DataFrame, k: int) -> DataFrame:
    """Fit on known training rows' first 2K features; predict every known row."""
    known = flows.where(F.col("label") >= 0).select(
        "flow_id", "split", "label", array_to_vector(F.slice("x", 1, 2 * k)).alias("features")
    )
    model = _regression().fit(known.where("split = 'train'"))
    return model.transform(known).select(
        "flow_id", "split", "label", F.col("prediction").cast("int").alias("pred")
    )


def linear_accuracy(flows: DataFrame) -> DataFrame:
    """Linear probe on the frozen vectors: fit on one half, accuracy on the other."""
    rows = flows.select(
        F.col("class_id").alias("label"), F.pmod("flow_id", F.lit(2)).alias("half"),
        array_to_vector("x").alias("features"),
    )
    model = _regression().fit(rows.where("half = 0"))
    return (
        model.transform(rows.where("half = 1"))
        .agg(
            F.count("*").alias("n"),
            F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        )
    )
