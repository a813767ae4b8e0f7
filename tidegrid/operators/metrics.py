"""Errors of a forecast per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted", key: str = "symbol") -> DataFrame:
    """``mse, mae, r2`` per series in one aggregation; a constant target scores 1 if met exactly, else 0."""
    error = F.col(actual) - F.col(predicted)
    both = F.col(predicted).isNotNull() & F.col(actual).isNotNull()
    sums = (
        df.filter(both)
        .groupBy(key)
        .agg(
            F.count("*").alias("n"),
            F.avg(error * error).alias("mse"),
            F.avg(F.abs(error)).alias("mae"),
            F.var_pop(actual).alias("_variance"),
        )
    )
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("_variance") == 0, flat).otherwise(1 - F.try_divide(F.col("mse"), F.col("_variance")))
    return sums.withColumn("r2", r2).drop("_variance")


def scaled_loss(df: DataFrame, actual: str = "y", predicted: str = "predicted", key: str = "symbol") -> DataFrame:
    """Mean squared error on the scaled target."""
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(key).agg(F.avg(error * error).alias("loss"))


def article_counts(articles: DataFrame, time: str = "created_at") -> DataFrame:
    return articles.groupBy("symbol", F.to_date(time).alias("day")).agg(F.count("*").alias("articles"))
