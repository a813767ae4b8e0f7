"""Texts are cleaned, split and scored once, and not moved for it."""

import pytest
from pyspark.sql import functions as F

from tidegrid.functions import text
from tidegrid.operators import sentiment
from tidegrid.plans import jobs

ROWS = [
    (1, "A", "Up up &amp; away"),
    (1, "A", "Up up &amp; away"),
    (1, "B", "down\x85down <b>up</b> <!-- up -->"),
    (2, "A", ""),
    (3, None, None),
    (None, "A", "nothing"),
    (4, "A", "\n\nup\n&lt;\n\n\n& &nbsp;down" * 700),
]


@pytest.fixture
def lexicon(spark):
    words = [("up", "positive", 1.0), ("up", "negative", 0.25), ("down", "negative", 0.5), ("down", "neutral", None), ("", "neutral", 9.0), (None, "neutral", 9.0)]
    return spark.createDataFrame(words, "word string, class string, weight double")


@pytest.fixture
def articles(spark, tmp_path):
    made = spark.createDataFrame(ROWS, "article_id long, symbol string, content string")
    made = made.withColumns({"created_at": F.timestamp_seconds(F.lit(1704067200)), "headline": F.substring("content", 1, 80)})
    made.repartition(3).write.parquet(str(tmp_path / "articles"))
    return spark.read.parquet(str(tmp_path / "articles"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_lexicon_is_sent_and_a_large_one_joined_alike(spark, articles, lexicon, monkeypatch):
    def scored():
        return sentiment.lexicon_scores(articles, lexicon, text.tokens("content"), ["symbol", "content"])

    sent = scored()
    assert "Exchange" not in plan(sent) and "Join" not in plan(sent)
    monkeypatch.setattr(sentiment, "MOST_SENT_WORDS", 1)
    joined = scored()
    assert "Exchange" in plan(joined) and sent.columns == joined.columns
    assert sorted(map(str, sent.collect())) == sorted(map(str, joined.collect())) and sent.count() == len(ROWS)


def test_an_empty_lexicon(spark, articles, lexicon):
    found = sentiment.lexicon_scores(articles, lexicon.limit(0), text.tokens("content")).select("positive").distinct().collect()
    assert [r["positive"] for r in found] == pytest.approx([1 / 3])


def test_content_is_cleaned_once(articles, lexicon):
    found = sentiment.labelled_articles(articles, lexicon, text.clean_html_text)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("template") <= 2 * text.HIDDEN.count("template")  # headline and content
    assert sorted(r["content"][:8] for r in found.collect()) == ["Up up & ", "Up up & ", "down dow", "nothing", "up < & d"]


def test_the_training_table_scores_its_articles_once(spark, articles, lexicon, tmp_path):
    bars = spark.range(30).select(
        F.lit("A").alias("symbol"), F.timestamp_seconds(1704067200 + F.col("id") * 60).alias("t"),
        *[(F.col("id") % 7 + k).cast("double").alias(n) for k, n in enumerate(("open", "high", "low", "close", "v", "n", "vw"))],
    )
    bars.write.parquet(str(tmp_path / "bars"))
    scored = sentiment.sentiment_series(articles, lexicon)
    table = jobs.combined_features(spark.read.parquet(str(tmp_path / "bars")), scored, 60).rows()
    assert "FileScan" not in plan(table) and table.count() == 30
