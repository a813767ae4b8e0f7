"""Sliding sequences, labels and time-ordered splits. All are decided by row number and series length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.series import ROW, ROWS, Laid

SEQUENCE_ROWS = 60


def sequences(laid: Laid, features: Sequence[str], target: str = "close", rows: int = SEQUENCE_ROWS) -> Laid:
    """For every row from ``rows`` on: ``x``, the features of the ``rows`` rows before it, and ``y``, its own target.

    The result is ``rows`` times as wide as its input: select the features first and take this step last.
    """
    laid.require(back=rows)
    frame = laid.window.rowsBetween(-rows, -1)
    values = F.array(*[F.col(name).cast("double") for name in features])
    made = laid.with_columns({"x": F.collect_list(values).over(frame), "y": F.col(target)})
    kept = made.frame.filter(F.col(ROW) >= rows)
    return Laid(kept, laid.key, laid.time, laid.block, laid.back, laid.ahead)


def label_shift(laid: Laid, target: str = "close", rows: int = 1) -> DataFrame:
    """Each row with the target ``rows`` rows ahead; the last rows have none and are dropped."""
    laid.require(ahead=rows)
    ahead = F.lead(target, rows).over(laid.window)
    return laid.with_columns({"label": ahead}).rows().filter(F.col("label").isNotNull())


def test_count(total: Column, test_size: float = 0.2) -> Column:
    return F.ceil(total * test_size)


def time_split(df: DataFrame, row: Column, total: Column, test_size: float = 0.2) -> DataFrame:
    """``split``: the first rows are train, the last ceil(test_size * total) are test."""
    return df.withColumn("split", F.when(row < total - test_count(total, test_size), "train").otherwise("test"))


def validation_split(
    df: DataFrame, row: Column, total: Column, test_size: float = 0.2, validation: float = 0.2
) -> DataFrame:
    """``split`` with the last part of train set apart: train, validation, test."""
    train = total - test_count(total, test_size)
    cut = F.floor(train * (1 - validation))
    return df.withColumn(
        "split", F.when(row < cut, "train").when(row < train, "validation").otherwise("test")
    )


def sequence_position(rows: int = SEQUENCE_ROWS) -> tuple[Column, Column]:
    """Index of a sequence among those of its series, and their number."""
    return F.col(ROW) - rows, F.greatest(F.col(ROWS) - rows, F.lit(0))


def time_folds(df: DataFrame, row: Column, total: Column, folds: int = 5) -> DataFrame:
    """``fold``: 0 for the first rows, then 1..folds, each of total // (folds + 1) rows.

    Fold k is tested by a model of all rows with a smaller fold number.
    """
    size = F.floor(total / (folds + 1))
    first = total - size * folds
    fold = F.when(row < first, 0).otherwise(F.floor(F.try_divide(row - first, size)) + 1)
    return df.withColumn("fold", fold.cast("int"))


def _shuffled_place(key: str, time: str, seed: int) -> Column:
    """60 bits of the MD5 of key, time in microseconds and seed: a place that any engine can compute."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.unix_micros(time).cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def shuffled_split(laid: Laid, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` by a seeded random order instead of time, with the same part sizes.

    The test part is the ceil(test_size * n) rows with the smallest hash. Rows are ranked by their hash in the same
    way as by time: numbered within slices of the hash range, shifted by the rows in lower slices.
    """
    from pyspark.sql import Window

    order = _shuffled_place(laid.key, laid.time, seed)
    slices = F.greatest(F.ceil(F.col(ROWS) / laid.block), F.lit(1))
    share = order.cast("double") / F.lit(2.0**60)
    base = laid.numbered().withColumn("_order", order).withColumn("_slice", F.least(F.floor(share * slices), slices - 1))
    counts = base.groupBy(laid.key, "_slice").agg(F.count("*").alias("_count"))
    lower = Window.partitionBy(laid.key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(laid.key, "_slice", F.coalesce(F.sum("_count").over(lower), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(laid.key, "_slice").orderBy("_order", ROW)
    ranked = base.withColumn("_rank", F.row_number().over(within)).join(offsets, [laid.key, "_slice"])
    rank = F.col("_offset") + F.col("_rank") - 1
    split = F.when(rank < test_count(F.col(ROWS), test_size), "test").otherwise("train")
    return ranked.withColumn("split", split).drop("_order", "_slice", "_rank", "_offset", ROW, ROWS)


def tail_rows(laid: Laid, count: Column | int) -> DataFrame:
    """The last rows of every series."""
    wanted = F.lit(count) if isinstance(count, int) else count
    return laid.numbered().filter(F.col(ROW) >= F.col(ROWS) - wanted).drop(ROW, ROWS)
