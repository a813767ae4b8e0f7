"""Forward and backward fill over blocks.

A block fills from its own rows; what it needs from outside is one value per column, carried over the block summary.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.series import BLOCK, ROW, SUB, Laid


def _edge(name: str, last: bool) -> Column:
    pick = F.max_by if last else F.min_by
    return pick(F.col(name), F.when(F.col(name).isNotNull(), F.col(ROW))).alias(f"_edge_{name}")


def _carried(laid: Laid, columns: Sequence[str], last: bool) -> DataFrame:
    outside = laid.blocks_before() if last else laid.blocks_after()
    return laid.summary([_edge(name, last) for name in columns]).select(
        laid.key, BLOCK, *[F.last(f"_edge_{name}", ignorenulls=True).over(outside).alias(f"_from_{name}") for name in columns]
    )


def _filled(laid: Laid, columns: Sequence[str], last: bool) -> Laid:
    order = laid.frame.columns
    if last:
        nearest = laid.running
    else:
        nearest = (
            Window.partitionBy(laid.key, BLOCK)
            .orderBy(F.col(SUB).desc(), F.col(ROW).desc())
            .rowsBetween(Window.unboundedPreceding, 0)
        )
    local = laid.with_columns({f"_near_{name}": F.last(name, ignorenulls=True).over(nearest) for name in columns})
    done = local.join_blocks(_carried(laid, columns, last)).with_columns(
        {name: F.coalesce(f"_near_{name}", f"_from_{name}") for name in columns}
    )
    return replace(done, frame=done.frame.select(*order))


def ffill(laid: Laid, columns: Sequence[str]) -> Laid:
    """The last value before, where a row has none."""
    return _filled(laid, columns, last=True)


def bfill(laid: Laid, columns: Sequence[str]) -> Laid:
    """The first value after, where a row has none."""
    return _filled(laid, columns, last=False)


def fill(laid: Laid, columns: Sequence[str]) -> Laid:
    """Forward, then backward. After the forward fill only the head of a series is missing, and the value it takes is
    the series' first one, so both need one summary and no second sort."""
    order = laid.frame.columns
    last_names = [_edge(name, True) for name in columns]
    first_names = [
        F.struct(F.min(F.when(F.col(name).isNotNull(), F.col(ROW))).alias("row"), _edge(name, False)).alias(f"_head_{name}")
        for name in columns
    ]
    series = laid.blocks_all()
    table = laid.summary(last_names + first_names).select(
        laid.key,
        BLOCK,
        *[F.last(f"_edge_{n}", ignorenulls=True).over(laid.blocks_before()).alias(f"_from_{n}") for n in columns],
        *[F.min_by(f"_head_{n}._edge_{n}", f"_head_{n}.row").over(series).alias(f"_first_{n}") for n in columns],
    )
    done = (
        laid.with_columns({f"_near_{n}": F.last(n, ignorenulls=True).over(laid.running) for n in columns})
        .join_blocks(table)
        .with_columns({n: F.coalesce(f"_near_{n}", f"_from_{n}", f"_first_{n}") for n in columns})
    )
    return replace(done, frame=done.frame.select(*order))


def zero_without_articles(
    df: DataFrame, articles: DataFrame, columns: Sequence[str], key: str = "symbol"
) -> DataFrame:
    """Zeros for a series that has no articles at all; a series with articles keeps its NULLs."""
    known = articles.select(key).distinct().withColumn("_has_articles", F.lit(True))
    zero = F.when(F.col("_has_articles").isNull(), F.lit(0.0))
    return df.join(known, key, "left").withColumns({n: F.coalesce(F.col(n), zero) for n in columns}).drop("_has_articles")
