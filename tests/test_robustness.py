"""Missing values, repeated lexicon words, articles of several symbols, huge values."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.text import tokens
from tidegrid.operators import indicators, psar, sentiment
from tidegrid.operators.series import lay_out
from tidegrid.plans import queries
from tidegrid.plans.queries import rounded
from tidegrid.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def series(spark, closes, spread=1.0):
    rows = [
        ("A", START + datetime.timedelta(minutes=k), c, None if c is None else c + spread, None if c is None else c - spread, c, 5.0)
        for k, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, "symbol string, t timestamp, open double, high double, low double, close double, v double")


def walk(n, missing, seed=1):
    rng = np.random.default_rng(seed)
    values = (100 + rng.normal(0, 1, n).cumsum()).tolist()
    return [None if k in missing else v for k, v in enumerate(values)]


def test_means_leave_missing_closes_out(spark):
    closes = walk(700, {3, 4, 120, 301, 302, 303, 600})
    laid = lay_out(series(spark, closes), bucket_seconds=36000, block=512)
    found = indicators.sma(laid).rows().orderBy("t").toPandas()
    plain = pd.Series(closes, dtype=float)
    for period in (20, 50, 200):
        wanted = plain.rolling(period, min_periods=1).mean().where(np.arange(700) >= period - 1)
        assert np.allclose(found[f"MA{period}"].astype(float), wanted, equal_nan=True)
    seeded = indicators.ema(lay_out(series(spark, closes))).rows().orderBy("t").toPandas()["EMA20"]
    assert np.isclose(seeded[19], plain[:20].mean())


@pytest.mark.parametrize("block", [512, 8192])
def test_stops_pass_over_bars_without_prices(spark, block):
    missing = {0, 5, 6, 200, *range(505, 520), 1023, 1024}
    closes = walk(1300, missing, seed=4)
    laid = lay_out(series(spark, closes), bucket_seconds=36000, block=block)
    found = psar.parabolic_sar(laid).rows().orderBy("t").toPandas()
    whole = lay_out(series(spark, [c for c in closes if c is not None]), bucket_seconds=36000, block=8192)
    plain = psar.parabolic_sar(whole).rows().orderBy("t").toPandas()["PSAR"]
    kept = found[found.high.notna()]["PSAR"].reset_index(drop=True)
    assert found[found.high.isna()]["PSAR"].isna().all()
    assert np.allclose(kept.astype(float), plain.astype(float), equal_nan=True)


def test_blocks_of_the_block_queries_are_many(spark):
    laid = queries.laid_in_blocks(spark, "/root/testdata/sf0.01")
    assert laid.frame.filter(laid.is_own).groupBy("symbol").agg(F.count_distinct("_block").alias("n")).agg(F.min("n")).first()[0] >= 3


def test_rows_without_key_or_time_are_errors(spark):
    bad = series(spark, [1.0, 2.0]).withColumn("symbol", F.when(F.col("close") > 1, F.col("symbol")))
    with pytest.raises(Exception, match="no symbol"):
        lay_out(bad).rows().collect()


def lexicon_of(spark, rows):
    return spark.createDataFrame(rows, "word string, class string, weight double")


def test_repeated_words_and_articles_of_two_symbols(spark):
    lexicon = lexicon_of(spark, [("good", "positive", 1.0), ("good", "positive", 0.5), ("bad", "negative", 1.0), (None, "negative", 9.0)])
    rows = [(1, "A", "good good bad"), (1, "B", "good good bad"), (2, "A", ""), (3, "A", None), (4, "A", "good"), (4, "A", "good")]
    articles = spark.createDataFrame(rows, "article_id long, symbol string, content string")
    found = sentiment.lexicon_scores(articles, lexicon, tokens("content"), ["symbol"]).collect()
    got = sorted((r["article_id"], r["symbol"], r["score_positive"], r["score_negative"]) for r in found)
    assert got == [(1, "A", 3.0, 1.0), (1, "B", 3.0, 1.0), (2, "A", 0, 0), (3, "A", 0, 0), (4, "A", 1.5, 0), (4, "A", 1.5, 0)]


def test_many_distinct_weights(spark):
    lexicon = lexicon_of(spark, [(f"w{k}", "positive", 1 + k / 7) for k in range(20_000)])
    articles = spark.createDataFrame([(1, "w0 w7 w19999")], "article_id long, content string")
    found = sentiment.lexicon_scores(articles, lexicon, tokens("content")).first()
    assert found["score_positive"] == round(3 + (7 + 19999) / 7, 9)


def test_rounding_keeps_what_it_cannot_scale(spark):
    values = [5e13, float("inf"), 1.2345674, -1e300]
    frame = spark.createDataFrame([(v,) for v in values] + [(float("nan"),)], "x double")
    got = [r["x"] for r in rounded(frame).collect()]
    assert got[:4] == [5e13, float("inf"), 1.234567, -1e300] and np.isnan(got[4])


def test_streams_follow_folders(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    ours = jobs.bars_to_table(spark, str(tmp_path)).count()
    assert ours == jobs.bars_to_table(spark, "/root/testdata/sf0.001").count() > 0


def test_ticks_that_are_not_numbers_are_null(spark):
    from tidegrid.sources import market

    events = spark.createDataFrame([("a", 1, float("nan"), '{"k": "NaN"}'), ("a", 2, 1.5, '{"k": 2}')], "event_type string, event_id long, value double, props string")
    got = market.event_ticks(events.withColumn("ts", F.current_timestamp())).orderBy("seq").collect()
    assert [(r["price"], r["size"]) for r in got] == [(None, None), (1.5, 2.0)]


def test_splits_on_the_day_of_before_and_after_a_bar(spark):
    from datetime import date, datetime

    from tidegrid.operators.resample import split_adjust

    rows = [("A", datetime(2024, 1, d), 8.0, 100.0) for d in (1, 2, 3, 4)] + [("B", datetime(2024, 1, 1), 8.0, 100.0), ("C", datetime(2024, 1, 1), None, None)]
    bars = spark.createDataFrame(rows, "symbol string, t timestamp, close double, v double")
    for name in ("open", "high", "low", "vw"):
        bars = bars.withColumn(name, F.col("close"))
    splits = spark.createDataFrame(
        [("A", date(2024, 1, 2), 2.0), ("A", date(2024, 1, 4), 4.0), ("A", date(2024, 1, 4), 0.5), ("C", date(2024, 2, 1), 2.0), ("D", date(2024, 1, 1), 3.0), ("B", None, 5.0)],
        "symbol string, effective_date date, ratio double",
    )
    found = {(r["symbol"], r["t"].day): (r["close"], r["v"]) for r in split_adjust(bars, splits).collect()}
    assert found == {("A", 1): (2.0, 400.0), ("A", 2): (4.0, 200.0), ("A", 3): (4.0, 200.0), ("A", 4): (8.0, 100.0), ("B", 1): (8.0, 100.0), ("C", 1): (None, None)}
    assert split_adjust(bars, splits.limit(0)).count() == 6 and split_adjust(bars.limit(0), splits).count() == 0
