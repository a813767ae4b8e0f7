"""News landed page by page, each page under the cursor it was asked for with and naming the next one.

Cursors say nothing about order, and pages land in any file and any order. The place of a page in its chain is found by
pointer doubling: each page looks up where its predecessor points, so the distance known doubles with every join and a
chain of n pages takes about log2(n) joins of small rows. Articles are not moved for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.times import parse_utc
from tidegrid.operators.series import ROW, ROWS, number_rows
from tidegrid.schemas import NEWS_PAGE
from tidegrid.session import cut_lineage
from tidegrid.sources.news import PAGE_LIMIT

CHAINED_PAGE = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("page_token", T.StringType()), *NEWS_PAGE.fields])
LINK = ["symbol", "page_token", "next_page_token", "digest"]
FIRST = ""  # the cursor of the first page, which is asked for without one
SHOWN_FAULTS = 5


def write_news_chain(articles: DataFrame, path: str, limit: int = PAGE_LIMIT, files: int | None = None) -> None:
    """Articles newest first as one chain of pages per symbol, one JSON text per page, dealt over ``files`` files."""
    place = F.col(ROWS) - 1 - F.col(ROW)
    numbered = number_rows(articles, "symbol", "created_at", ["article_id"])
    item = F.struct(
        F.col("article_id").alias("id"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        "headline",
        "content",
        F.array("symbol").alias("symbols"),
    )
    pages = numbered.groupBy("symbol", F.floor(place / limit).alias("_page")).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), item.alias("item")))).alias("_items"), F.max(ROWS).alias("_count")
    )

    def cursor(page: Column) -> Column:
        return F.when(page > 0, F.sha2(F.concat_ws("|", F.col("symbol"), page.cast("string")), 256))

    following = F.col("_page") + 1
    page = F.struct(
        "symbol",
        cursor(F.col("_page")).alias("page_token"),
        F.transform("_items", lambda i: i["item"]).alias("news"),
        F.when(following * limit < F.col("_count"), cursor(following)).alias("next_page_token"),
    )
    texts = pages.select(F.to_json(page, {"ignoreNullFields": "false"}).alias("value"))
    (texts.repartition(files, F.xxhash64("value")) if files else texts).write.text(path)


def with_digest(pages: DataFrame) -> DataFrame:
    """Pages with the symbol in capitals, the first page's cursor as an empty text, and a digest of the whole page."""
    following = F.when(F.col("next_page_token") != FIRST, F.col("next_page_token"))
    plain = pages.withColumns(
        {"symbol": F.upper("symbol"), "page_token": F.coalesce("page_token", F.lit(FIRST)), "next_page_token": following}
    )
    return plain.withColumn("digest", F.sha2(F.to_json(F.struct(*pages.columns)), 256))


def refuse(faults: DataFrame, what: str) -> None:
    """An error that names some of the rows, if there are any."""
    rows = faults.limit(SHOWN_FAULTS).collect()
    if rows:
        raise ValueError(f"{what}: {', '.join(str(tuple(row)) for row in rows)}")


def refuse_forks(links: DataFrame) -> None:
    """Chains must be chains: a symbol for every page, one page per cursor, one page before each."""
    refuse(links.filter(F.col("symbol").isNull()).select("page_token"), "pages without a symbol")
    refuse(links.groupBy("symbol", "page_token").count().filter("count > 1"), "different pages under one cursor")
    after = links.filter(F.col("next_page_token").isNotNull())
    refuse(after.groupBy("symbol", "next_page_token").count().filter("count > 1"), "several pages lead to one cursor")


def chain_places(links: DataFrame) -> DataFrame:
    """``symbol, page_token, place``: pages between a page and the first one of its symbol; NULL where the first is not reached.

    A page is not reached if one before it is missing or if it is on a cycle. Cursors and successors have to be unique
    (``refuse_forks``). Runs a job per round, about log2 of the number of pages.
    """
    tokens = links.select("symbol", "page_token", "next_page_token")
    before = tokens.filter(F.col("next_page_token").isNotNull()).select(
        "symbol", F.col("page_token").alias("at"), F.col("next_page_token").alias("page_token")
    )
    first = F.col("page_token") == FIRST
    state = cut_lineage(
        tokens.join(before, ["symbol", "page_token"], "left").select(
            "symbol",
            "page_token",
            F.when(first, F.lit(FIRST)).otherwise(F.col("at")).alias("at"),
            F.when(first, 0).otherwise(1).cast("long").alias("hops"),
        )
    )
    rounds = state.count().bit_length() + 1
    moving = F.col("at").isNotNull() & (F.col("at") != FIRST)
    for _ in range(rounds):
        going = state.filter(moving)
        if going.isEmpty():
            break
        ahead = state.select("symbol", F.col("page_token").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"))
        moved = going.join(ahead, ["symbol", "at"], "left").select(
            "symbol", "page_token", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops")
        )
        state = cut_lineage(state.filter(~moving | F.col("at").isNull()).unionByName(moved))
    return state.select("symbol", "page_token", F.when(F.col("at") == FIRST, F.col("hops")).alias("place"))


def page_rows(pages: DataFrame) -> DataFrame:
    """``article_id, symbol, created_at, headline, content, page, place`` of pages that know their place ``page``."""
    rows = pages.select("symbol", "page", F.posexplode("news").alias("place", "_item"))
    return rows.select(
        F.col("_item.id").alias("article_id"),
        "symbol",
        parse_utc("_item.created_at").alias("created_at"),
        F.col("_item.headline").alias("headline"),
        F.col("_item.content").alias("content"),
        "page",
        "place",
    )


def read_news_chain(spark: SparkSession, path: str) -> DataFrame:
    """Articles of all pages below ``path`` with the place of their page in its chain and their place in the page.

    Raises ``ValueError`` if a page is missing, lies on a cycle, has no symbol, or if two different pages have one cursor or one
    successor. A page landed twice alike counts once; malformed pages are an error; no pages give no rows.
    """
    pages = with_digest(spark.read.schema(CHAINED_PAGE).option("mode", "FAILFAST").json(path))
    landed = cut_lineage(pages.select(*LINK))
    links = landed.distinct()
    refuse_forks(links)
    wanted = links.filter(F.col("next_page_token").isNotNull()).select("symbol", F.col("next_page_token").alias("page_token"))
    refuse(wanted.join(links, ["symbol", "page_token"], "left_anti"), "missing pages")
    places = chain_places(links)
    refuse(places.filter(F.col("place").isNull()).select("symbol", "page_token"), "pages not reached from a first page")
    if links.count() < landed.count():
        pages = pages.dropDuplicates(["symbol", "page_token"])
    return page_rows(pages.join(places.withColumnRenamed("place", "page"), ["symbol", "page_token"]))
