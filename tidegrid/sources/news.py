"""News as landed response pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.times import parse_utc
from tidegrid.schemas import NEWS_PAGE
from tidegrid.sources.bars import date_range

PAGE_LIMIT = 50


def read_news_pages(
    spark: SparkSession, path: str, start=None, end=None, symbol: str | None = None, drop_contentless: bool = False
) -> DataFrame:
    """``article_id, symbol, created_at, headline, content``, one row per article and symbol; without symbols one row."""
    pages = spark.read.schema(NEWS_PAGE).option("mode", "FAILFAST").json(path)
    articles = pages.select(F.inline("news")).select(
        F.col("id").alias("article_id"),
        F.explode_outer("symbols").alias("symbol"),
        parse_utc("created_at").alias("created_at"),
        "headline",
        "content",
    )
    articles = date_range(articles.withColumn("symbol", F.upper("symbol")), start, end, "created_at")
    if symbol is not None:
        articles = articles.filter(F.col("symbol") == symbol.upper())
    return with_content(articles, F.col("content")) if drop_contentless else articles


def with_content(articles: DataFrame, cleaned: Column) -> DataFrame:
    """Articles whose cleaned content is not empty."""
    return articles.filter(F.length(cleaned) > 0)


def newest_first(articles: DataFrame) -> DataFrame:
    return articles.orderBy(F.col("created_at").desc(), F.col("article_id").desc())


def write_news_pages(articles: DataFrame, path: str, limit: int = PAGE_LIMIT) -> None:
    """Articles as pages, one JSON text per page; ids numbered densely give pages of at most ``limit`` articles."""
    item = F.struct(
        F.col("article_id").alias("id"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        "headline",
        "content",
        F.array("symbol").alias("symbols"),
    )
    pages = articles.groupBy(F.floor(F.col("article_id") / limit).alias("_page")).agg(F.collect_list(item).alias("news"))
    pages.select(F.to_json(F.struct("news", F.lit(None).cast("string").alias("next_page_token"))).alias("value")).write.text(path)
