"""Chains of news pages followed as they land, in any order.

A batch gives out the pages that now connect to the part of the chain given out before; the others wait in a table. Every
batch writes its tables into folders of its own, so a batch that is run again after a failure overwrites itself, and
a restarted stream goes on from the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import cut_lineage, scratch_path
from tidegrid.sources.paging import CHAINED_PAGE, FIRST, LINK, chain_places, page_rows, refuse, refuse_forks, with_digest, write_news_chain

HEADS = "symbol string, head string, pages long"
PAGE = ["symbol", "page_token", "digest"]
#: Links of about 300 bytes up to which they are sent to every task.
MOST_SENT_LINKS = 100_000


def _written(spark: SparkSession, path: str, table: str, batch_id: int, empty: DataFrame) -> DataFrame:
    return spark.read.schema(empty.schema).parquet(f"{path}/{table}/batch={batch_id}") if batch_id >= 0 else empty


def _earlier(spark: SparkSession, path: str, table: str, batch_id: int, empty: DataFrame) -> DataFrame:
    """What all batches before this one wrote."""
    if batch_id <= 0:
        return empty
    written = T.StructType([*empty.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(written).parquet(f"{path}/{table}").filter(F.col("batch") < batch_id).select(*empty.columns)


def _sent(rows: DataFrame) -> DataFrame:
    """Links to be joined with whole pages: sent to all tasks, if their number allows that, so that the pages stay where they are."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= MOST_SENT_LINKS else rows


def take_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Writes ``news`` (articles given out), ``links`` (their pages), ``waiting`` (new pages not connected yet) and ``heads``.

    ``heads`` holds per symbol the cursor of the page to come (NULL at the end of a chain) and the number of pages so far. Pages
    that come again alike are left out; a cursor that comes again with another page is an error, as are forks. All that is decided on
    links; a page is written once while it waits, once when it is given out, and is dealt anew only if a batch holds it twice.
    """
    spark = batch.sparkSession
    fresh = with_digest(batch)
    landed = cut_lineage(fresh.select(*LINK))
    distinct = cut_lineage(landed.distinct())
    if distinct.count() < landed.count():
        fresh = fresh.dropDuplicates(LINK)
    heads = _written(spark, path, "heads", batch_id - 1, spark.createDataFrame([], HEADS))
    released = _earlier(spark, path, "links", batch_id, spark.createDataFrame([], distinct.schema))
    held = _earlier(spark, path, "waiting", batch_id, spark.createDataFrame([], fresh.schema))
    given = released.select(*PAGE)
    before = held.select(*LINK).join(given, PAGE, "left_anti")
    new = cut_lineage(distinct.join(given, PAGE, "left_anti").join(before.select(*PAGE), PAGE, "left_anti"))
    links = cut_lineage(new.unionByName(before))
    refuse_forks(links)
    refuse(links.join(released, ["symbol", "page_token"], "left_semi").select("symbol", "page_token"), "different pages under one cursor")
    # the page to come stands in for the first one, so places count from there
    expected = F.when(F.col("page_token") == F.coalesce("head", F.lit(FIRST)), F.lit(FIRST)).otherwise(F.col("page_token"))
    from_head = links.join(heads, "symbol", "left").select("symbol", expected.alias("page_token"), "next_page_token")
    places = chain_places(from_head).join(heads, "symbol", "left")
    token = F.when(F.col("page_token") == FIRST, F.coalesce("head", F.lit(FIRST))).otherwise(F.col("page_token"))
    page = F.col("place") + F.coalesce("pages", F.lit(0))
    placed = places.filter(F.col("place").isNotNull()).select("symbol", token.alias("page_token"), page.alias("page"))
    out = cut_lineage(links.join(placed, ["symbol", "page_token"]))
    moved = out.groupBy("symbol").agg(F.max_by("next_page_token", "page").alias("head"), (F.max("page") + 1).alias("pages"))
    kept = heads.join(moved, "symbol", "left_anti").unionByName(moved)
    # a page that waited may land once more in the batch that gives it out
    ready = {kind: _sent(out.select(*PAGE, "page").join(new.select(*PAGE), PAGE, kind)) for kind in ("left_semi", "left_anti")}
    later = _sent(new.select(*PAGE).join(out.select(*PAGE), PAGE, "left_anti"))
    for table, rows in (
        ("news", page_rows(fresh.join(ready["left_semi"], PAGE).unionByName(held.join(ready["left_anti"], PAGE)))),
        ("links", out.select(*LINK)),
        ("waiting", fresh.join(later, PAGE, "left_semi").select(*fresh.columns)),
        ("heads", kept),
    ):
        rows.write.mode("overwrite").parquet(f"{path}/{table}/batch={batch_id}")


def follow_news_chain(spark: SparkSession, landed: str, path: str, checkpoint: str, files_per_batch: int = 1000):
    """Follows a folder of landed pages until all present files are read."""
    pages = spark.readStream.schema(CHAINED_PAGE).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(landed)
    return (
        pages.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: take_batch(batch, batch_id, path))
        .start()
    )


def followed_news(spark: SparkSession, path: str) -> DataFrame:
    """All articles given out so far."""
    return spark.read.parquet(f"{path}/news").drop("batch")


def open_chains(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, head, pages`` of chains whose next page has not come, from the last batch."""
    heads = spark.read.parquet(f"{path}/heads")
    last = heads.agg(F.max("batch").alias("batch"))
    return heads.join(last, "batch").filter(F.col("head").isNotNull()).select("symbol", "head", "pages")


def chain_to_table(spark: SparkSession, articles: DataFrame, files: int = 6, files_per_batch: int = 2) -> DataFrame:
    """Articles landed as chains over several files and followed in several batches."""
    landed, path = scratch_path(spark, "news-chain"), scratch_path(spark, "stream-chain")
    write_news_chain(articles, landed, files=files)
    follow_news_chain(spark, landed, path, scratch_path(spark, "stream-chain-log"), files_per_batch).awaitTermination()
    refuse(open_chains(spark, path), "missing pages")
    return followed_news(spark, path)
