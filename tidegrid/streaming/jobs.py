"""Streams of ticks and articles kept up to date as tables of bars and sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.text import CLASSES, article_tokens, strip_html
from tidegrid.operators.resample import resample_ticks
from tidegrid.operators.sentiment import lexicon_scores
from tidegrid.session import scratch_path
from tidegrid.sources.market import document_articles, event_ticks

def follow_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A warehouse table, a file or a folder of files, as a file stream with its own schema."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch's changed rows to a folder of its own; a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last written state of every key."""
    written = spark.read.parquet(path)
    values = [c for c in written.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*values), F.col("batch")).alias("_newest")
    return written.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def stream_bars(ticks: DataFrame, timeframe: str, delay: str) -> DataFrame:
    """Tumbling bars from a tick stream; ticks later than ``delay`` behind the newest are dropped."""
    return resample_ticks(ticks.withWatermark("ts", delay), timeframe)


def bars_to_table(
    spark: SparkSession, folder: str, timeframe: str = "30 minutes", delay: str = "30 days"
) -> DataFrame:
    ticks = event_ticks(follow_table(spark, folder, "events"))
    path, checkpoint = scratch_path(spark, "stream-bars"), scratch_path(spark, "stream-bars-log")
    upsert_batches(stream_bars(ticks, timeframe, delay), path, checkpoint).awaitTermination()
    return latest_rows(spark, path, ["symbol", "t"])


def first_articles(articles: DataFrame, delay: str) -> DataFrame:
    """An article stream in which an article that comes again within ``delay`` counts once."""
    return articles.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["article_id"])


def minute_sums(articles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``symbol, t, articles`` and the sums of the class scores by symbol and minute; sums of parts add up to those of the whole."""
    words = article_tokens("headline", strip_html("content"))
    scored = lexicon_scores(articles, lexicon, words, ["symbol", "created_at"])
    minute = F.date_trunc("minute", "created_at").alias("t")
    return scored.groupBy("symbol", minute).agg(F.count("*").alias("articles"), *[F.sum(name).alias(name) for name in CLASSES])


def follow_sentiment(articles: DataFrame, lexicon: DataFrame, path: str, checkpoint: str, delay: str = "30 days"):
    """Scores the new articles of every batch and writes their sums to a folder of its own; a repeated batch overwrites itself.

    Words are joined with the lexicon as in a batch job, so it may be of any size; Spark decides how.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        minute_sums(batch, lexicon).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        first_articles(articles, delay)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def minute_means(spark: SparkSession, path: str) -> DataFrame:
    """Per symbol and minute the number of articles and their mean class scores, over all batches written so far."""
    written = spark.read.parquet(path).groupBy("symbol", "t")
    sums = written.agg(*[F.sum(name).alias(name) for name in ("articles", *CLASSES)])
    return sums.select("symbol", "t", "articles", *[(F.col(name) / F.col("articles")).alias(name) for name in CLASSES])


def sentiment_to_table(spark: SparkSession, folder: str, lexicon: DataFrame, delay: str = "30 days") -> DataFrame:
    articles = document_articles(follow_table(spark, folder, "documents"))
    path = scratch_path(spark, "stream-news")
    follow_sentiment(articles, lexicon, path, scratch_path(spark, "stream-news-log"), delay).awaitTermination()
    return minute_means(spark, path)
