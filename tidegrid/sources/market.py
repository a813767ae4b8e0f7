"""Ticks, bars, articles and the calendar as views over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.resample import resample_ticks
from tidegrid.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def _number(value: Column) -> Column:
    """NaN stands for a missing number, as NULL does."""
    return F.when(~F.isnan(value), value)


def event_ticks(events: DataFrame) -> DataFrame:
    """Events as ticks: one symbol per event type, few and long. A table or a stream."""
    size = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        _number(F.col("value")).alias("price"),
        _number(size).alias("size"),
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return event_ticks(table(spark, folder, "events"))


def wide_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as trades: one symbol per supplier, many and shorter."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        _number(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).cast("double")).alias("price"),
        _number(F.col("l_quantity").cast("double")).alias("size"),
    )


def bars(spark: SparkSession, folder: str, timeframe: str = "30 minutes") -> DataFrame:
    return resample_ticks(ticks(spark, folder), timeframe)


def wide_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars; all trades of a day carry the same time, so the sequence number alone orders them."""
    return resample_ticks(wide_ticks(spark, folder), "1 day", order="seq")


def document_articles(documents: DataFrame) -> DataFrame:
    """Documents as news, with a fixed rule for symbol and time of publication. A table or a stream."""
    symbols = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    minute = F.pmod(F.col("doc_id") * 37, F.lit(43200))
    return documents.select(
        F.col("doc_id").alias("article_id"),
        F.element_at(symbols, (F.pmod("doc_id", F.lit(5)) + 1).cast("int")).alias("symbol"),
        F.timestamp_seconds(F.lit(1704067200) + minute * 60).alias("created_at"),
        F.substring("text", 1, 80).alias("headline"),
        F.col("text").alias("content"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return document_articles(table(spark, folder, "documents"))


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(F.col("page_id").alias("article_id"), F.col("html").alias("content"))


def trading_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which anything traded, weekends left out: the calendar ``session_date``."""
    day = F.to_date("ts")
    return (
        table(spark, folder, "events")
        .select(day.alias("session_date"))
        .filter(F.weekday("session_date") < 5)
        .distinct()
    )
