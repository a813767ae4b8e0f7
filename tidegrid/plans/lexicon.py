"""A small word table over frequent words of the document collection, and its SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.schemas import LEXICON

# Word, class, weight.
WORDS = [
    ("and", "positive", 0.02),
    ("are", "positive", 0.10),
    ("avec", "positive", 0.20),
    ("by", "positive", 0.08),
    ("con", "positive", 0.20),
    ("for", "positive", 0.06),
    ("mit", "positive", 0.25),
    ("thanedble", "positive", 0.50),
    ("und", "positive", 0.05),
    ("with", "positive", 0.08),
    ("at", "negative", 0.12),
    ("dans", "negative", 0.20),
    ("from", "negative", 0.12),
    ("nicht", "negative", 0.25),
    ("on", "negative", 0.07),
    ("pas", "negative", 0.20),
    ("por", "negative", 0.20),
    ("that", "negative", 0.05),
    ("was", "negative", 0.07),
    ("as", "neutral", 0.08),
    ("auf", "neutral", 0.25),
    ("be", "neutral", 0.08),
    ("es", "neutral", 0.10),
    ("it", "neutral", 0.05),
    ("les", "neutral", 0.10),
    ("this", "neutral", 0.08),
]


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORDS, LEXICON)


def lexicon_sql() -> str:
    rows = ", ".join(f"('{word}', '{name}', {weight})" for word, name, weight in WORDS)
    return f"lexicon(word, class, weight) AS (VALUES {rows})"
