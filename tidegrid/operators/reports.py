"""Tables behind the charts: price overlay, news markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.asof import asof_price
from tidegrid.operators.series import Laid

THRESHOLD = 0.5


def previous_close(laid: Laid, target: str = "close") -> DataFrame:
    """Baseline forecast: the value one row before."""
    laid.require(back=1)
    before = F.lag(target, 1).over(laid.window)
    return laid.with_columns({"predicted": before, "actual": F.col(target)}).rows()


def price_overlay(bars: DataFrame, compared: DataFrame) -> DataFrame:
    """Every close, with actual and predicted where the test part has them."""
    return bars.select("symbol", "t", "close").join(compared.select("symbol", "t", "actual", "predicted"), ["symbol", "t"], "left")


def marked_news(sentiment: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Articles that are clearly positive or clearly negative, with their kind."""
    kind = F.when(F.col("positive") > threshold, "positive").when(F.col("negative") > threshold, "negative")
    return sentiment.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def news_markers(sentiment: DataFrame, bars: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Clearly positive and negative articles with the close at or before their time."""
    marked = marked_news(sentiment, threshold).select("symbol", "t", "article_id", "kind")
    return asof_price(marked, bars)
