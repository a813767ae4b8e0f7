"""Next-value forecasts from sequences with Spark ML."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.scaling import unscale


def flat_vectors(sequenced: DataFrame) -> DataFrame:
    """The sequence ``x`` as one vector ``features``."""
    return sequenced.withColumn("features", array_to_vector(F.flatten("x"))).drop("x")


def fit_forecast(vectors: DataFrame, method: str = "linear", rounds: int = 100):
    """A model of ``y`` on the rows marked train; rows marked validation stop a boosted model early.

    One model serves all series: features are scaled per series, so their patterns are comparable.
    """
    if method == "linear":
        learner = LinearRegression(labelCol="y", maxIter=rounds, regParam=1e-3, elasticNetParam=0.0)
        return learner.fit(vectors.filter(F.col("split") != "test"))
    if method == "boosted":
        learner = GBTRegressor(labelCol="y", maxIter=rounds, maxDepth=4, seed=42, validationIndicatorCol="held_out")
        return learner.fit(vectors.filter(F.col("split") != "test").withColumn("held_out", F.col("split") == "validation"))
    raise ValueError(f"unknown method {method!r}")


def predict(model, vectors: DataFrame) -> DataFrame:
    """Predictions for the test rows."""
    return model.transform(vectors.filter(F.col("split") == "test")).withColumnRenamed("prediction", "predicted")


def comparison(predicted: DataFrame, fitted: DataFrame, feature: str = "close", key: str = "symbol", time: str = "t") -> DataFrame:
    """Actual and predicted in price units by test time."""
    scaled = predicted.select(key, time, F.col("y").alias("actual"), "predicted")
    return unscale(scaled, ["actual", "predicted"], fitted, feature, key)
