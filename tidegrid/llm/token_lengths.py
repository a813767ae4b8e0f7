"""Exact histogram of encoded lengths, and what a limit on the context leaves of a corpus.

Texts are encoded once, map-side sums reduce them to one row per length, and suffix sums over the histogram answer for every
limit: how many documents reach it, how many tokens remain if longer ones are truncated, and which share of documents fits.
The suffix sums work in blocks of lengths, so no task sorts more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.tables import batch_of, only, stored
from tidegrid.llm.tokens import default_path, ids_of

#: Lengths per block of the suffix sums.
BLOCK = 4096


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [len(ids_of(text.as_py() or "", path)) for text in batch.column("text")]
            lengths, documents = np.unique(np.array(found, dtype=np.int64), return_counts=True)
            yield batch_of(length=pa.array(lengths), documents=pa.array(documents.astype(np.int64)))

    return run


def length_histogram(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``text`` -> ``length, documents``: how many texts have each encoded length; null and empty texts have length 0."""
    counted = only(documents, ["text"]).mapInArrow(_lengths(path or default_path()), "length long, documents long")
    return stored(counted.groupBy("length").agg(F.sum("documents").alias("documents")), "lengths")


def limits_table(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each occurring length means as a limit.

    ``length, documents``; ``documents_up_to`` and ``documents_over`` it; ``tokens_up_to`` of the documents that fit whole;
    ``tokens_truncated``: all tokens if longer documents are cut to it; ``tokens_lost`` by that; ``total_documents`` and
    ``total_tokens`` of the corpus. Other limits: ``truncated_total``. An empty histogram gives an empty table.
    """
    rows = histogram.select("length", "documents", F.floor(F.col("length") / block).alias("block"))
    tokens = (F.col("length") * F.col("documents")).alias("tokens")
    sums = rows.groupBy("block").agg(F.sum("documents").alias("block_documents"), F.sum(tokens).alias("block_tokens"))
    over = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = sums.select(
        "block",
        F.coalesce(F.sum("block_documents").over(over), F.lit(0)).alias("later_documents"),
        F.coalesce(F.sum("block_tokens").over(over), F.lit(0)).alias("later_tokens"),
        F.sum("block_documents").over(every).alias("total_documents"),
        F.sum("block_tokens").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    parts = rows.select("*", tokens).select(
        "block",
        "length",
        "documents",
        F.coalesce(F.sum("documents").over(inside), F.lit(0)).alias("more_documents"),
        F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("more_tokens"),
    )
    longer = F.col("more_documents") + F.col("later_documents")
    longer_tokens = F.col("more_tokens") + F.col("later_tokens")
    kept = F.col("total_tokens") - longer_tokens
    return parts.join(after, "block").select(
        "length",
        "documents",
        (F.col("total_documents") - longer).alias("documents_up_to"),
        longer.alias("documents_over"),
        kept.alias("tokens_up_to"),
        (kept + longer * F.col("length")).alias("tokens_truncated"),
        (longer_tokens - longer * F.col("length")).alias("tokens_lost"),
        "total_documents",
        "total_tokens",
    )


def truncated_total(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``limit, tokens_truncated, documents_over`` for any limits, in one pass over the histogram."""
    if not limits or min(limits) < 0:
        raise ValueError("at least one limit, none below 0")
    asked = F.explode(F.array(*[F.lit(int(n)).cast("long") for n in sorted(set(limits))])).alias("limit")
    rows = histogram.select("length", "documents", asked)
    cut = F.sum(F.least("length", "limit") * F.col("documents"))
    over = F.sum(F.when(F.col("length") > F.col("limit"), F.col("documents")).otherwise(0))
    return rows.groupBy("limit").agg(cut.alias("tokens_truncated"), over.alias("documents_over"))


def quantile(limits: DataFrame, share: float) -> DataFrame:
    """The least ``length`` that at least ``share`` of the documents do not exceed."""
    if not 0 <= share <= 1:
        raise ValueError("share is from 0 to 1")
    return limits.filter(F.col("documents_up_to") >= share * F.col("total_documents")).agg(F.min("length").alias("length"))
