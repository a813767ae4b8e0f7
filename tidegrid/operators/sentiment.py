"""Article scores: by lexicon, by a trained classifier, and the minute series the forecasts use."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidegrid.functions.text import (
    CLASSES,
    argmax_label,
    article_tokens,
    headline_pad,
    softmax,
    strip_html,
    tokens,
)
from tidegrid.functions.times import floor_minute

# The functions sent to the executors travel by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words of a lexicon up to which it is sent to every task; the words of the articles are joined with a larger one.
MOST_SENT_WORDS = 100_000


def word_weights(lexicon: DataFrame) -> DataFrame:
    """One row per word with its summed weight in every class; a word listed several times counts each of them."""
    sums = [F.sum(F.when(F.col("class") == name, F.col("weight")).otherwise(0.0)).alias(f"_w_{name}") for name in CLASSES]
    return lexicon.filter(F.col("word").isNotNull()).groupBy("word").agg(*sums)


def _with_chances(scored: DataFrame) -> DataFrame:
    chances = softmax([F.col(f"score_{name}") for name in CLASSES])
    return scored.withColumns(dict(zip(CLASSES, chances, strict=True)))


def lexicon_scores(
    articles: DataFrame, lexicon: DataFrame, words: Column, keep: Sequence[str] = (), article: str = "article_id"
) -> DataFrame:
    """Per row the summed weights of its ``words`` by class, and the probabilities made of them.

    The lexicon is counted first. Up to ``MOST_SENT_WORDS`` words it is sent to the tasks, so a row is read once and not moved; a
    larger one is joined with the words. Sums are rounded to nine digits, so that they do not depend on the order of addition and
    equal ones tie.
    """
    weights = word_weights(lexicon).filter("word <> ''")
    few = weights.limit(MOST_SENT_WORDS + 1).collect()
    if len(few) > MOST_SENT_WORDS:
        return _joined_scores(articles, weights, words, [article, *keep])
    named = articles.select(article, *keep, _word_sums(few)(words).alias("_sums"))
    scores = {f"score_{c}": F.round(F.col(f"_sums.{c}"), 9) for c in CLASSES}
    return _with_chances(named.withColumns(scores).drop("_sums"))


def _word_sums(weights: Sequence[Row]) -> Callable[[Column], Column]:
    """The summed weights of a row's words by class, from a table of words that fits into every task."""
    known = pa.array([r["word"] for r in weights], pa.string())
    by_class = [np.array([r[f"_w_{name}"] or 0.0 for r in weights], np.float64) for name in CLASSES]

    def sums(words: pa.Array) -> pa.Array:
        place = pc.index_in(words.flatten(), value_set=known)
        found = place.is_valid()
        rows = pc.list_parent_indices(words).filter(found).to_numpy()
        at = place.filter(found).to_numpy()
        totals = [pa.array(np.bincount(rows, weight[at], len(words))) for weight in by_class]
        return pa.StructArray.from_arrays(totals, names=list(CLASSES))

    return F.arrow_udf(sums, ", ".join(f"{name} double" for name in CLASSES))


def _joined_scores(articles: DataFrame, weights: DataFrame, words: Column, columns: Sequence[str]) -> DataFrame:
    """Scores by a lexicon of any size.

    Only words travel: a row is named by a hash of what it holds, its words are joined with the lexicon, summed per name and
    joined back. Rows that are equal in all columns share a name; an empty word per row counts them, and the sum is shared.
    Which side is broadcast is left to the optimizer.
    """
    seed = [F.xxhash64(*columns, words), F.xxhash64(F.lit("second"), words, *columns)]
    named = articles.select(*columns, F.struct(*seed).alias("_name"), words.alias("_words"))
    every = F.concat(F.coalesce("_words", F.array().cast("array<string>")), F.array(F.lit("")))
    listed = named.select("_name", F.explode(every).alias("word"))
    sums = [F.sum(F.coalesce(f"_w_{c}", F.lit(0.0))).alias(f"_sum_{c}") for c in CLASSES]
    rows = F.count(F.when(F.col("word") == "", 1)).alias("_rows")
    summed = listed.join(weights, "word", "left").groupBy("_name").agg(*sums, rows)
    scores = summed.select("_name", *[F.round(F.col(f"_sum_{c}") / F.col("_rows"), 9).alias(f"score_{c}") for c in CLASSES])
    return _with_chances(named.drop("_words").join(scores, "_name").drop("_name"))


def lexicon_label(scored: DataFrame) -> DataFrame:
    """Hard label from the scores, in the order positive, negative, neutral."""
    return scored.withColumn("sentiment", argmax_label([F.col(f"score_{name}") for name in CLASSES]))


def sentiment_series(articles: DataFrame, lexicon: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """``symbol, t, article_id, positive, negative, neutral, headline`` with time floored to the minute.

    ``articles`` are ``article_id, symbol, created_at, headline, content``. The content loses its markup, headline and
    content are tokenised and scored; ``max_tokens`` limits the scored tokens, by default the whole text counts.
    """
    prepared = articles.select(
        "article_id",
        "symbol",
        floor_minute("created_at").alias("t"),
        headline_pad("headline").alias("headline"),
        article_tokens("headline", strip_html("content"), max_tokens).alias("_words"),
    )
    scored = lexicon_scores(prepared, lexicon, F.col("_words"), ["symbol", "t", "headline"])
    return scored.select("symbol", "t", "article_id", *CLASSES, "headline")


def labelled_articles(articles: DataFrame, lexicon: DataFrame, clean) -> DataFrame:
    """Articles with non-empty cleaned content and their label: ``created_at, headline, content, sentiment``."""
    made = F.struct("article_id", "created_at", clean(F.col("headline")).alias("headline"), clean(F.col("content")).alias("content"))
    # as a row of its own the content is cleaned once; the filter is not moved below a generator
    cleaned = articles.select(F.inline(F.array(made))).filter(F.length("content") > 0)
    scored = lexicon_label(lexicon_scores(cleaned, lexicon, tokens("content"), ["created_at", "headline", "content"]))
    return scored.select("created_at", "headline", "content", "sentiment")


def class_labels(labels: DataFrame) -> DataFrame:
    """Quality and toxicity flags as the three classes, numbered in their order."""
    name = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return labels.select(F.col("doc_id").alias("article_id"), name.alias("class"), _class_number(name).alias("label"))


def _class_number(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), name) - 1).cast("double")


def train_sentiment_model(labelled: DataFrame, text: str = "text", features: int = 1 << 14) -> PipelineModel:
    """Three-class probabilities from hashed, weighted word counts."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="features"),
        LogisticRegression(family="multinomial", labelCol="label", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(labelled)


def model_scores(articles: DataFrame, model: PipelineModel, keep: Sequence[str]) -> DataFrame:
    chances = vector_to_array("probability")
    return model.transform(articles).select(
        *keep, *[chances[i].alias(name) for i, name in enumerate(CLASSES)]
    )
