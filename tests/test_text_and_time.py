import html
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import text, times
from tidegrid.operators import calendar, reports, sentiment
from tidegrid.sources import news


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("a&nbsp;b &mdash; c&ndash;d", "a b — c–d"),
        ("<p>x</p>\n\n\ny", "x\ny"),
        ('<script>var a="<b>";f()</script>t', 'var a="";f()t'),
        ("<a><b></b></a>", ""),
        (" 　 x \x1c", "x"),
        (None, None),
    ],
)
def test_strip_html(spark, given, wanted):
    assert one(spark, given, text.strip_html) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ('<p>a</p><script>var t="</p>";</script> b', "a b"),
        ("<!-- <p>no</p> -->yes<style>p{}</style>", "yes"),
        ("<!DOCTYPE html><title>T</title>\n\n x\t y", "T x y"),
        ("a &amp;lt; b &lt; c &#233; &#x20AC; &eacute;&unknown; & d", "a &lt; b < c é € é&unknown; & d"),
        ("&#128512;&copy;2024", "😀©2024"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("x<script>alert(1)", "x"),
        ("x<!-- open", "x"),
        ('<a title="x>y">t</a> <b c=\'>\'>u</b> <i d=e>v</i> <u f="g>w', "t u v w"),
        ("&#150;&#0;&copy2024 &notit; &bigstar; &am", "–\ufffd©2024 ¬it; ★ &am"),
        ("<b></b>", ""),
        ("", ""),
    ],
)
def test_clean_html_text(spark, given, wanted):
    assert one(spark, given, text.clean_html_text) == wanted


def test_entities_equal_the_standard_library(spark):
    names = sorted(f"&{n}" for n in html.entities.html5)
    given = " ".join(names)
    assert one(spark, given, text.decode_entities) == html.unescape(given)


@pytest.mark.parametrize("length", [0, 99, 100, 101])
def test_headline_pad(spark, length):
    headline = "é" * length
    assert one(spark, headline, text.headline_pad) == headline[:100].ljust(100)


def test_prepare_text_limits_only_where_asked(spark):
    words = " ".join(f"w{i}" for i in range(600))
    df = spark.createDataFrame([("Head Line", words)], "h string, c string")
    limited, whole = df.select(text.prepare_text("h", "c", text.MAX_TOKENS), text.prepare_text("h", "c")).first()
    assert limited.split() == ["head", "line", *words.split()[:510]]
    assert len(whole.split()) == 602


def test_softmax_and_label(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (800.0, 1.0, 0.0)], "a double, b double, c double")
    columns = [F.col(c) for c in "abc"]
    rows = df.select(*[p.alias(n) for p, n in zip(text.softmax(columns), "pqr")], text.argmax_label(columns).alias("l")).collect()
    assert rows[0][:3] == pytest.approx((1 / 3, 1 / 3, 1 / 3)) and rows[0]["l"] == "positive"
    assert rows[1][:3] == pytest.approx((1, 0, 0))


def test_lexicon_counts_the_whole_text_once_per_word(spark):
    lexicon = spark.createDataFrame([("up", "positive", 1.0), ("down", "negative", 0.5)], "word string, class string, weight double")
    long = "filler " * 2000 + "Up, up! down"
    articles = spark.createDataFrame([(1, long), (2, "nothing here"), (3, None)], "article_id bigint, body string")
    rows = {r["article_id"]: r for r in sentiment.lexicon_scores(articles, lexicon, text.tokens("body")).collect()}
    assert (rows[1]["score_positive"], rows[1]["score_negative"]) == (2.0, 0.5)
    for article in (2, 3):
        assert rows[article]["positive"] == pytest.approx(1 / 3)


def test_articles_without_content_are_dropped(spark):
    df = spark.createDataFrame([(1, "<p></p>"), (2, None), (3, "<p>x</p>")], "article_id bigint, content string")
    cleaned = df.withColumn("content", text.clean_html_text("content"))
    assert [r["article_id"] for r in news.with_content(cleaned, F.col("content")).collect()] == [3]


def test_marked_news_is_strict(spark):
    df = spark.createDataFrame([(0.5, 0.4), (0.6, 0.1), (0.1, 0.7)], "positive double, negative double")
    assert [r["kind"] for r in reports.marked_news(df).orderBy("positive").collect()] == ["negative", "positive"]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("2024-03-10T06:59:00Z", "2024-03-10T01:59:00-05:00"),
        ("2024-03-10T07:00:00Z", "2024-03-10T03:00:00-04:00"),
        ("2024-11-03T05:59:00Z", "2024-11-03T01:59:00-04:00"),
        ("2024-11-03T06:00:00Z", "2024-11-03T01:00:00-05:00"),
    ],
)
def test_eastern_time_over_clock_changes(spark, given, wanted):
    assert one(spark, given, lambda c: times.iso_eastern(times.parse_utc_strict(c))) == wanted


def test_bad_time_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)pars"):
        one(spark, "2024-03-10 06:59", times.parse_utc_strict)


def test_calendar(spark):
    days = [date(2024, 1, d) for d in (8, 9, 10, 11, 12, 16, 17)]
    sessions = spark.createDataFrame([(d,) for d in days], "session_date date")
    assert calendar.nth_last_session(sessions, 3, date(2024, 1, 16)).first()[0] == date(2024, 1, 11)
    assert calendar.session_before_days(sessions, 2, date(2024, 1, 12)).first()[0] == date(2024, 1, 11)
    with pytest.raises(Exception, match="fewer than 1 sessions"):
        calendar.session_before_days(sessions, 1, date(2024, 1, 15)).collect()


def test_space_pattern_is_pythons(spark):
    given = "".join(chr(c) for c in range(0x3100) if re.match(r"\s", chr(c)))
    assert one(spark, f"{given}x{given}", text.strip) == "x"


def test_floor_minute(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 9, 30, 59, 999999),)], "t timestamp")
    assert df.select(times.floor_minute("t")).first()[0] == datetime(2024, 1, 1, 9, 30)
