import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from tidegrid.operators.asof import asof_complete_price, asof_join, asof_price
from tidegrid.operators.resample import split_adjust

DAY = datetime(2024, 1, 2, 10)
LEFT = "symbol string, t timestamp, close double"
RIGHT = "symbol string, t timestamp, article_id bigint, score double"


def at(minutes, seconds=0):
    return DAY + timedelta(minutes=minutes, seconds=seconds)


def joined(spark, left, right, **options):
    bars = spark.createDataFrame([("A", t, 1.0) for t in left], LEFT)
    news = spark.createDataFrame([("A", t, i, s) for t, i, s in right], RIGHT)
    rows = asof_join(bars, news, ["score"], **options).orderBy("t").collect()
    return [r["score"] for r in rows]


def test_equal_distance_takes_the_earlier(spark):
    got = joined(spark, [at(0), at(1)], [(at(0, 30), 1, 0.1), (at(1, 30), 2, 0.2)], direction="nearest", tolerance_seconds=60)
    assert got == [0.1, 0.1]


def test_several_at_one_time(spark):
    right = [(at(2), 3, 0.3), (at(2), 4, 0.4), (at(11), 5, 0.5), (at(11), 6, 0.6)]
    assert joined(spark, [at(2), at(10)], right, direction="nearest", tolerance_seconds=60) == [0.4, 0.5]


def test_tolerance_is_inclusive(spark):
    assert joined(spark, [at(0)], [(at(1), 1, 0.1)], direction="nearest", tolerance_seconds=60) == [0.1]
    assert joined(spark, [at(0)], [(at(1, 1), 1, 0.1)], direction="nearest", tolerance_seconds=60) == [None]


def test_empty_right_and_null_payload(spark):
    assert joined(spark, [at(0)], [], direction="nearest", tolerance_seconds=60) == [None]
    assert joined(spark, [at(1)], [(at(0), 1, 0.5), (at(1), 2, None)], direction="backward") == [None]


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 90])
def test_equals_a_merge_over_many_buckets(spark, direction, tolerance):
    """A busy and a quiet symbol, times with repeats, buckets much narrower than the gaps."""
    rng = random.Random(5)
    left = sorted({(rng.choice("AAAAB"), at(rng.randint(0, 900), rng.choice([0, 30]))) for _ in range(700)})
    right = [(rng.choice("AAAAB"), at(rng.randint(0, 900)), i, rng.random()) for i in range(500)]
    bars = spark.createDataFrame([(s, t, 1.0) for s, t in left], LEFT)
    news = spark.createDataFrame(right, RIGHT)
    got = asof_join(bars, news, ["score"], direction, tolerance, bucket_seconds=300).orderBy("symbol", "t").toPandas()
    frame = pd.DataFrame(right, columns=["symbol", "t", "article_id", "score"]).sort_values(["t", "article_id"])
    expected = pd.merge_asof(
        pd.DataFrame(left, columns=["symbol", "t"]).sort_values("t"),
        frame,
        on="t",
        by="symbol",
        direction=direction,
        tolerance=None if tolerance is None else pd.Timedelta(seconds=tolerance),
    ).sort_values(["symbol", "t"])
    assert got["score"].fillna(-1).tolist() == expected["score"].fillna(-1).tolist()
    assert len(got) == len(left)


def test_repeated_left_times_all_come_back(spark):
    articles = spark.createDataFrame([("A", at(5), i) for i in range(500)] + [("A", at(0), 900)], "symbol string, t timestamp, article_id bigint")
    bars = spark.createDataFrame([("A", at(1), 10.0), ("A", at(5), 20.0), ("A", at(6), 30.0)], LEFT)
    rows = asof_price(articles, bars).collect()
    assert len(rows) == 501
    assert {r["close"] for r in rows if r["article_id"] < 500} == {20.0}
    assert [r["close"] for r in rows if r["article_id"] == 900] == [None]


def test_complete_rows_give_an_older_price(spark):
    bars = spark.createDataFrame(
        [("A", at(i), float(i), 1.0 if i < 3 else None) for i in range(1, 5)],
        "symbol string, t timestamp, close double, Chikou double",
    )
    articles = spark.createDataFrame([("A", at(9)), ("A", at(0))], "symbol string, t timestamp")
    rows = asof_complete_price(articles, bars, ["close", "Chikou"]).orderBy("t").collect()
    assert [r["close"] for r in rows] == [None, 2.0]


def test_split_factors_multiply(spark):
    columns = "symbol string, t timestamp, open double, high double, low double, close double, v double, n bigint, vw double"
    days = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    bars = spark.createDataFrame([("A", d, 60.0, 60.0, 60.0, 60.0, 1.0, 1, 60.0) for d in days], columns)
    splits = spark.createDataFrame(
        [("A", days[1].date(), 2.0), ("A", days[3].date(), 3.0), ("B", days[3].date(), 5.0)],
        "symbol string, effective_date date, ratio double",
    )
    rows = split_adjust(bars, splits).orderBy("t").collect()
    assert [(r["close"], r["v"]) for r in rows] == [(10.0, 6.0), (20.0, 3.0), (20.0, 3.0), (60.0, 1.0)]
