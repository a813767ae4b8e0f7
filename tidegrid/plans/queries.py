"""The registered queries: every operator over the warehouse tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import text, times
from tidegrid.operators import (
    asof,
    calendar,
    fill,
    forecast,
    indicators,
    metrics,
    psar,
    reports,
    resample,
    scaling,
    selection,
    sentiment,
    sequences,
)
from tidegrid.operators.series import ROW, ROWS, Laid, lay_out
from tidegrid.plans import jobs
from tidegrid.plans.lexicon import lexicon
from tidegrid.session import cut_lineage, scratch_path
from tidegrid.sources import bars as bar_source
from tidegrid.sources import market, news, paging
from tidegrid.streaming import indicators as live_indicators
from tidegrid.streaming import jobs as live_jobs
from tidegrid.streaming import late as live_late
from tidegrid.streaming import paging as live_paging

Query = Callable[[SparkSession, str], DataFrame]

TODAY = date(2024, 1, 30)
DIGITS = 6
TOLERANCE_SECONDS = 15 * 60
RANKED = ["open", "high", "low", "v", "n"]
#: All that can be ranked for the forecast: bar values, indicators and class scores.
CANDIDATES = [*[name for name in jobs.MODEL_COLUMNS if name != "close"], *text.CLASSES]
VALUES = ["open", "high", "low", "close", "v", "n", "vw"]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def rounded(df: DataFrame, columns: Sequence[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """Rounded doubles and zone-free times, the form in which results are compared.

    Rounding is one multiplication, floor and division, the same in every engine; the little more than a half decides
    values that end exactly halfway.
    """
    scale = F.lit(10.0**digits)
    shown = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if columns is None or field.name in columns:
            if isinstance(field.dataType, T.DoubleType):
                # beyond that the scaled value leaves the whole numbers; infinite values and NaN stay as they are
                fits = F.abs(column) < F.lit(2.0**63 / 10.0**digits)
                column = F.when(fits, F.floor(column * scale + F.lit(0.503)) / scale).otherwise(column)
            elif isinstance(field.dataType, T.TimestampType):
                column = column.cast("timestamp_ntz")
            shown.append(column.alias(field.name))
    return df.select(*shown)


def laid_bars(spark: SparkSession, folder: str) -> Laid:
    """The layout reads its bars several times, so they are made from the ticks once."""
    return lay_out(cut_lineage(market.bars(spark, folder)))


def _sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return sentiment.sentiment_series(market.articles(spark, folder), lexicon(spark))


def _indicator(run: Callable[[Laid], Laid], outputs: Sequence[str]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(run(laid_bars(spark, folder)).rows(), ["symbol", "t", *outputs])

    return query


QUERIES |= {
    "sma": _indicator(indicators.sma, ["MA20", "MA50", "MA200"]),
    "ema": _indicator(indicators.ema, ["EMA20"]),
    "wma": _indicator(indicators.wma, ["WMA20"]),
    "rsi": _indicator(indicators.rsi, ["RSI"]),
    "macd": _indicator(indicators.macd, ["MACD", "Signal"]),
    "bollinger": _indicator(indicators.bollinger, ["UpperBB", "MiddleBB", "LowerBB"]),
    "obv": _indicator(indicators.on_balance_volume, ["OBV"]),
    "stochastic": _indicator(indicators.stochastic, ["SlowK", "SlowD"]),
    "atr": _indicator(indicators.atr, ["ATR"]),
    "mfi": _indicator(indicators.mfi, ["MFI"]),
    "ichimoku": _indicator(indicators.ichimoku, ["Tenkan", "Kijun", "SenkouA", "SenkouB", "Chikou"]),
    "roc": _indicator(indicators.roc, ["ROC"]),
    "chaikin": _indicator(indicators.chaikin, ["CMF"]),
    "cci": _indicator(indicators.cci, ["CCI"]),
    "psar": _indicator(psar.parabolic_sar, ["PSAR"]),
    "features_all": _indicator(indicators.all_features, [*VALUES, *indicators.FEATURES]),
}


def laid_in_blocks(spark: SparkSession, folder: str) -> Laid:
    """Short blocks, so that series of a thousand bars take several: carries, copied rows and agreement rounds all run."""
    return lay_out(cut_lineage(market.bars(spark, folder)), bucket_seconds=86400, block=512)


def _in_blocks(run: Callable[[Laid], Laid], outputs: Sequence[str]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(run(laid_in_blocks(spark, folder)).rows(), ["symbol", "t", *outputs])

    return query


QUERIES |= {
    "sma_blocks": _in_blocks(indicators.sma, ["MA20", "MA50", "MA200"]),
    "macd_blocks": _in_blocks(indicators.macd, ["MACD", "Signal"]),
    "obv_blocks": _in_blocks(indicators.on_balance_volume, ["OBV"]),
    "atr_blocks": _in_blocks(indicators.atr, ["ATR"]),
    "ichimoku_blocks": _in_blocks(indicators.ichimoku, ["Tenkan", "Kijun", "SenkouA", "SenkouB", "Chikou"]),
    "psar_blocks": _in_blocks(psar.parabolic_sar, ["PSAR"]),
}
BLOCK_TWINS = {name: name.removesuffix("_blocks") for name in QUERIES if name.endswith("_blocks")}


# Averages that reach back beyond the copied rows of a block
QUERIES |= {
    "ema_long": _in_blocks(lambda laid: indicators.ema(laid, 200), ["EMA200"]),
    "rsi_long": _in_blocks(lambda laid: indicators.rsi(laid, 100), ["RSI"]),
}


@register
def pivot_points(spark: SparkSession, folder: str) -> DataFrame:
    shown = ["PP", "R1", "S1", "R2", "S2", "R3", "S3"]
    return rounded(indicators.pivot_points(market.bars(spark, folder)), ["symbol", "t", *shown])


@register
def features_wide(spark: SparkSession, folder: str) -> DataFrame:
    """All indicators over many symbols: daily bars of suppliers' order lines."""
    laid = lay_out(cut_lineage(market.wide_bars(spark, folder)), bucket_seconds=8192 * 86400)
    return rounded(indicators.all_features(laid).rows(), digits=3)


# -- sources and sinks


@register
def scan_bars(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(market.prepare(spark), "bar-pages")
    bar_source.write_bar_pages(market.bars(spark, folder), path, limit=500)
    return rounded(bar_source.read_bar_pages(spark, path))


@register
def union_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Early and late half-months as two pages, put together again."""
    bars = market.bars(spark, folder)
    middle = F.lit("2024-01-16").cast("timestamp")
    return rounded(bar_source.union_pages([bars.filter(F.col("t") < middle), bars.filter(F.col("t") >= middle)]))


@register
def scan_news(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(market.prepare(spark), "news-pages")
    news.write_news_pages(market.articles(spark, folder), path)
    read = news.read_news_pages(spark, path, "2024-01-05", "2024-01-25", drop_contentless=True)
    return rounded(news.newest_first(read))


@register
def bars_sink(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(market.prepare(spark), "bars")
    bar_source.write_bars(market.bars(spark, folder), path)
    return rounded(bar_source.read_bars(spark, path))


@register
def resample_bars(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(market.bars(spark, folder))


@register
def resample_coarser(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(resample.resample_bars(market.bars(spark, folder), "4 hours"))


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    """Share splits: on large returned last lines, 2 for 1 or 3 for 1 by the tax band."""
    lines = market.table(spark, folder, "lineitem")
    return lines.filter((F.col("l_linenumber") == 7) & (F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R")).select(
        F.col("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("effective_date"),
        F.when(F.col("l_tax") >= 0.04, 2.0).otherwise(3.0).alias("ratio"),
    )


@register
def split_adjust(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(resample.split_adjust(market.wide_bars(spark, folder), _splits(spark, folder)))


# -- projections, filters, time


@register
def time_to_eastern(spark: SparkSession, folder: str) -> DataFrame:
    lines = market.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("at"))
    day_time = F.col("at") + F.make_dt_interval(F.lit(0), F.pmod("l_orderkey", F.lit(24)).cast("int"))
    shown = lines.withColumn("at", day_time)
    return rounded(
        shown.select(
            "l_orderkey",
            "l_linenumber",
            times.eastern("at").alias("eastern"),
            times.iso_eastern("at").alias("iso"),
        )
    )


@register
def floor_minute(spark: SparkSession, folder: str) -> DataFrame:
    ticks = market.ticks(spark, folder)
    return rounded(ticks.select(F.col("seq").alias("event_id"), times.upper_symbol("symbol").alias("symbol"), times.floor_minute("ts").alias("minute")))


@register
def paged_news(spark: SparkSession, folder: str) -> DataFrame:
    """News landed as chains of pages over many files, read back with the places of page and article."""
    path = scratch_path(market.prepare(spark), "news-chain")
    paging.write_news_chain(market.articles(spark, folder), path, files=16)
    return rounded(paging.read_news_chain(spark, path))


@register
def news_with_content(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose text is left after cleaning."""
    pages = market.html_pages(spark, folder)
    cleaned = pages.select("article_id", text.clean_html_text("content").alias("content"))
    return news.with_content(cleaned, F.col("content")).select("article_id", F.length("content").alias("length"))


@register
def positive_negative_news(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reports.marked_news(_sentiment(spark, folder)), ["symbol", "t", "article_id", "positive", "negative", "kind"])


@register
def date_range_filter(spark: SparkSession, folder: str) -> DataFrame:
    ticks = market.ticks(spark, folder)
    return rounded(bar_source.date_range(ticks, "2024-01-10 00:00:00", "2024-01-20 12:00:00", time="ts"))


# -- text


@register
def strip_html(spark: SparkSession, folder: str) -> DataFrame:
    return market.html_pages(spark, folder).select("article_id", text.strip_html("content").alias("text"))


@register
def clean_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return market.html_pages(spark, folder).select("article_id", text.clean_html_text("content").alias("text"))


@register
def prepare_text(spark: SparkSession, folder: str) -> DataFrame:
    """The scorer's input: all tokens of headline and content."""
    return market.articles(spark, folder).select("article_id", text.prepare_text("headline", "content").alias("text"))


@register
def headline_pad(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts as headlines: longer ones are cut to the width, shorter ones padded."""
    return market.articles(spark, folder).select("article_id", text.headline_pad("content").alias("headline"))


def _logits() -> list[Column]:
    return [F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50]


@register
def softmax3(spark: SparkSession, folder: str) -> DataFrame:
    """Three numbers of every order line as class scores."""
    lines = market.table(spark, folder, "lineitem")
    chances = dict(zip(text.CLASSES, text.softmax(_logits()), strict=True))
    return rounded(lines.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in chances.items()]))


@register
def argmax_label(spark: SparkSession, folder: str) -> DataFrame:
    lines = market.table(spark, folder, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", text.argmax_label(_logits()).alias("label"))


# -- sentiment


@register
def sentiment_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    scored = sentiment.lexicon_scores(market.articles(spark, folder), lexicon(spark), text.tokens("content"), [])
    return rounded(scored, ["article_id", *text.CLASSES])


@register
def sentiment_label(spark: SparkSession, folder: str) -> DataFrame:
    scored = sentiment.lexicon_scores(market.articles(spark, folder), lexicon(spark), text.tokens("content"), [])
    return sentiment.lexicon_label(scored).select("article_id", "sentiment")


@register
def sentiment_series(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_sentiment(spark, folder))


@register
def labelled_articles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sentiment.labelled_articles(market.articles(spark, folder), lexicon(spark), text.clean_html_text))


@register
def sentiment_model(spark: SparkSession, folder: str) -> DataFrame:
    documents = market.table(spark, folder, "documents").select(F.col("doc_id").alias("article_id"), "text")
    labels = sentiment.class_labels(market.table(spark, folder, "labels"))
    model = sentiment.train_sentiment_model(documents.join(labels, "article_id"))
    return rounded(sentiment.model_scores(documents, model, ["article_id"]))


# -- scaling and filling


@register
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scaling.minmax_scale(laid_bars(spark, folder), VALUES).rows())


@register
def minmax_inverse(spark: SparkSession, folder: str) -> DataFrame:
    laid = laid_bars(spark, folder)
    scaled = scaling.minmax_scale(laid, ["close"]).rows().select("symbol", "t", "close")
    return rounded(scaling.unscale(scaled, ["close"], scaling.scalers(market.bars(spark, folder), ["close"]), "close"))


@register
def fit_scaler_train_only(spark: SparkSession, folder: str) -> DataFrame:
    laid = laid_bars(spark, folder)
    return rounded(scaling.minmax_scale(laid, ["close", "v"], scaling.train_rows()).rows(), ["symbol", "t", "close", "v"])


@register
def ffill(spark: SparkSession, folder: str) -> DataFrame:
    laid = indicators.sma(laid_bars(spark, folder), [20])
    return rounded(fill.ffill(laid, ["vw", "MA20"]).rows(), ["symbol", "t", "vw", "MA20"])


@register
def bfill(spark: SparkSession, folder: str) -> DataFrame:
    laid = indicators.sma(laid_bars(spark, folder), [20])
    return rounded(fill.bfill(laid, ["vw", "MA20"]).rows(), ["symbol", "t", "vw", "MA20"])


@register
def fill_both(spark: SparkSession, folder: str) -> DataFrame:
    laid = indicators.sma(laid_bars(spark, folder), [20])
    return rounded(fill.fill(laid, ["vw", "MA20"]).rows(), ["symbol", "t", "vw", "MA20"])


# -- as-of joins


@register
def asof_nearest(spark: SparkSession, folder: str) -> DataFrame:
    bars = market.bars(spark, folder).select("symbol", "t", "close")
    payload = list(text.CLASSES)
    joined = asof.asof_join(bars, _sentiment(spark, folder), payload, "nearest", TOLERANCE_SECONDS)
    return rounded(joined)


@register
def asof_price(spark: SparkSession, folder: str) -> DataFrame:
    articles = market.articles(spark, folder).select("article_id", "symbol", F.col("created_at").alias("t"))
    return rounded(asof.asof_price(articles, market.bars(spark, folder)))


@register
def asof_complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Prices from bars that have their long average and their lagging line."""
    articles = market.articles(spark, folder).select("article_id", "symbol", F.col("created_at").alias("t"))
    laid = laid_bars(spark, folder)
    shown = indicators.run_recipes(laid, [indicators.sma_recipe(laid), indicators.ichimoku_recipe(laid)]).rows()
    return rounded(asof.asof_complete_price(articles, shown, ["MA200", "Chikou"]))


@register
def asof_complete_all(spark: SparkSession, folder: str) -> DataFrame:
    """Prices from bars that have all values and all indicators."""
    articles = market.articles(spark, folder).select("article_id", "symbol", F.col("created_at").alias("t"))
    shown = indicators.all_features(laid_bars(spark, folder)).rows()
    return rounded(asof.asof_complete_price(articles, shown, jobs.MODEL_COLUMNS))


# -- aggregates


def _baseline(spark: SparkSession, folder: str) -> DataFrame:
    return reports.previous_close(laid_bars(spark, folder))


@register
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.regression_metrics(_baseline(spark, folder)))


@register
def scaled_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of the previous-close forecast on the scaled test part."""
    scaled = scaling.minmax_scale(laid_bars(spark, folder), ["close"])
    before = F.lag("close", 1).over(scaled.window)
    frame = scaled.with_columns({"predicted": before, "y": F.col("close")}).numbered()
    split = sequences.time_split(frame, F.col(ROW), F.col(ROWS))
    return rounded(metrics.scaled_loss(split.filter(F.col("split") == "test")), digits=9)


@register
def article_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.article_counts(market.articles(spark, folder))


# -- order and calendar


@register
def sort_time(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(market.bars(spark, folder).orderBy("symbol", "t"))


@register
def tail_n(spark: SparkSession, folder: str) -> DataFrame:
    laid = laid_bars(spark, folder)
    _, total = sequences.sequence_position()
    return rounded(sequences.tail_rows(laid, sequences.test_count(total)), ["symbol", "t", "close"])


@register
def nth_last_session(spark: SparkSession, folder: str) -> DataFrame:
    return calendar.nth_last_session(market.trading_sessions(spark, folder), 5, TODAY)


@register
def session_before_days(spark: SparkSession, folder: str) -> DataFrame:
    return calendar.session_before_days(market.trading_sessions(spark, folder), 5, TODAY)


@register
def news_window(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of the listing's window."""
    first, last = calendar.news_window(market.trading_sessions(spark, folder), 2, TODAY)
    articles = market.articles(spark, folder).select("article_id", "symbol", "created_at")
    return rounded(calendar.within_sessions(articles, F.to_date("created_at"), first, last))


@register
def news_series_window(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of the sentiment series' window: from the fifth last session until today."""
    first = calendar.series_window(market.trading_sessions(spark, folder), 5, TODAY)
    articles = market.articles(spark, folder).select("article_id", "symbol", "created_at")
    day = F.to_date("created_at")
    return rounded(articles.filter((day >= first.scalar()) & (day <= F.lit(TODAY))))


# -- sequences and splits


@register
def sequences_60(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 60 rows of three columns, shown by their corners and sum."""
    made = sequences.sequences(laid_bars(spark, folder), ["open", "close", "v"]).rows()
    flat = F.flatten("x")
    return rounded(
        made.select(
            "symbol",
            "t",
            F.size("x").cast("bigint").alias("length"),
            F.element_at(flat, 1).alias("first_open"),
            F.element_at(flat, -1).alias("last_v"),
            F.aggregate(flat, F.lit(0.0), lambda a, b: a + b).alias("total"),
            "y",
        )
    )


QUERIES["sequences"] = QUERIES.pop("sequences_60")


@register
def label_shift(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sequences.label_shift(laid_bars(spark, folder), rows=10), ["symbol", "t", "close", "label"])


@register
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    """Split of the sequences of every series, by the time of their label."""
    laid = sequences.sequences(laid_bars(spark, folder), ["close"])
    row, total = sequences.sequence_position()
    return rounded(sequences.time_split(laid.numbered().drop("x"), row, total), ["symbol", "t", "y", "split"])


@register
def validation_split(spark: SparkSession, folder: str) -> DataFrame:
    numbered = laid_bars(spark, folder).numbered()
    return rounded(sequences.validation_split(numbered, F.col(ROW), F.col(ROWS)), ["symbol", "t", "close", "split"])


@register
def time_folds(spark: SparkSession, folder: str) -> DataFrame:
    numbered = laid_bars(spark, folder).numbered()
    return rounded(sequences.time_folds(numbered, F.col(ROW), F.col(ROWS)), ["symbol", "t", "close", "fold"])


@register
def shuffled_split(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(sequences.shuffled_split(laid_bars(spark, folder)), ["symbol", "t", "close", "split"])


# -- ranking, selection, forecast, reports


@register
def feature_scores(spark: SparkSession, folder: str) -> DataFrame:
    scaled = scaling.minmax_scale(laid_bars(spark, folder), [*RANKED, "close"]).rows()
    return rounded(selection.feature_scores(scaled, RANKED, "close"), digits=4)


def _training_table(spark: SparkSession, folder: str) -> Laid:
    bars = cut_lineage(market.bars(spark, folder))
    table = jobs.combined_features(bars, _sentiment(spark, folder), TOLERANCE_SECONDS)
    return jobs.recut(cut_lineage(table.numbered()), table)


@register
def feature_scores_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate of the training table in bins of equal size, ranked on six digits: ranks must not hang on the last bit."""
    table = rounded(_training_table(spark, folder).rows())
    scores = selection.feature_scores(table, CANDIDATES, "close", by="quantile")
    return rounded(scores.select("symbol", "feature", "mi", "place"))


@register
def select_features(spark: SparkSession, folder: str) -> DataFrame:
    """Selection from all candidates of the training table."""
    table = _training_table(spark, folder)
    scores = selection.feature_scores(table.rows(), CANDIDATES, "close", by="quantile")
    return rounded(selection.select_features(table, scores, CANDIDATES, "close"))


@register
def feature_union(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with sentiment in the united column list of features and class scores."""
    bars = market.bars(spark, folder)
    joined = asof.asof_join(bars, _sentiment(spark, folder), list(text.CLASSES), "nearest", TOLERANCE_SECONDS)
    return rounded(joined.select("symbol", "t", *selection.feature_union(["close", "v"], text.CLASSES)))


def _trained(spark: SparkSession, folder: str, method: str = "linear") -> jobs.Forecast:
    bars = cut_lineage(market.bars(spark, folder))
    return jobs.train_and_compare(bars, _sentiment(spark, folder), TOLERANCE_SECONDS, method)


@register
def next_close(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted scaled close of the test part, by a linear model of the last 60 rows of the selected columns."""
    return rounded(_trained(spark, folder).scaled)


QUERIES["forecast"] = QUERIES.pop("next_close")


@register
def comparison(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_trained(spark, folder).compared)


@register
def train_and_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job: training table, ranking, selection, forecast and the metrics of its comparison."""
    return rounded(_trained(spark, folder).metrics())


@register
def loss_history(spark: SparkSession, folder: str) -> DataFrame:
    """Train and validation loss by round of the whole job trained with early stopping, and the round whose weights are kept."""
    return rounded(_trained(spark, folder, "descent").loss_history())


@register
def combined_features(spark: SparkSession, folder: str) -> DataFrame:
    """The training table: scaled and filled features with the nearest article's scores."""
    bars = cut_lineage(market.bars(spark, folder))
    return rounded(jobs.combined_features(bars, _sentiment(spark, folder), TOLERANCE_SECONDS).rows())


@register
def price_overlay(spark: SparkSession, folder: str) -> DataFrame:
    laid = laid_bars(spark, folder)
    before = F.lag("close", 1).over(laid.window)
    frame = laid.with_columns({"predicted": before, "actual": F.col("close")}).numbered()
    test = sequences.time_split(frame, F.col(ROW), F.col(ROWS)).filter(F.col("split") == "test")
    return rounded(reports.price_overlay(market.bars(spark, folder), test))


@register
def news_markers(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reports.news_markers(_sentiment(spark, folder), market.bars(spark, folder)))


@register
def daily_ohlc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(resample.resample_ticks(market.ticks(spark, folder), daily=True))


# -- streams


@register
def stream_bars(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(live_jobs.bars_to_table(market.prepare(spark), folder))


@register
def stream_bars_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of three batches out of order with a short delay, after the late ticks were merged in."""
    return rounded(live_late.repaired_bars_to_table(market.prepare(spark), market.ticks(spark, folder)))


@register
def stream_news_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(live_jobs.sentiment_to_table(market.prepare(spark), folder, lexicon(spark)))


@register
def stream_online_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(live_indicators.indicators_to_table(market.prepare(spark), folder))


@register
def stream_paged_news(spark: SparkSession, folder: str) -> DataFrame:
    """The chains of ``paged_news`` followed in three batches of files."""
    return rounded(live_paging.chain_to_table(market.prepare(spark), market.articles(spark, folder)))
