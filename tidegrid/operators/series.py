"""Time series cut into bounded blocks of rows, so that one hot symbol spreads over many tasks.

``lay_out`` numbers the rows of every series and cuts each series into blocks of ``block`` rows. A block
also receives copies of the ``back`` rows before it and the ``ahead`` rows after it. All windows then run on
``(key, block)``: one exchange and one sort serve every indicator, and no task ever holds a whole series.

What reaches further than the copied rows (running totals, fills, whole-series statistics) is computed from one
summary row per block and joined back on ``(key, block)``, which the big side is already partitioned by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROW = "_row"  # 0-based row number within the series
ROWS = "_rows"  # number of rows of the series
BLOCK = "_block"
SUB = "_sub"  # scan segment within the series, see operators.recursion
INTERNAL = (ROW, ROWS, BLOCK, SUB)

SEGMENT = 512
DEFAULT_BLOCK = 16 * SEGMENT
DEFAULT_BACK = 2 * SEGMENT
DEFAULT_AHEAD = 26
DEFAULT_BUCKET_SECONDS = 7 * 86400


@dataclass(frozen=True)
class Laid:
    """A frame laid out in blocks, with the geometry it was laid out with."""

    frame: DataFrame
    key: str
    time: str
    block: int
    back: int
    ahead: int
    sizes: DataFrame | None = None  # length of every series, cheaper to read than the frame

    def has_long_series(self) -> bool:
        """Whether any series takes more than one block. Runs a job over the series' lengths."""
        lengths = self.frame if self.sizes is None else self.sizes
        return not lengths.filter(F.col(ROWS) > self.block).isEmpty()

    @cached_property
    def window(self) -> WindowSpec:
        return Window.partitionBy(self.key, BLOCK).orderBy(SUB, ROW)

    def last_rows(self, count: int) -> WindowSpec:
        """The current row and the ``count - 1`` before it."""
        self.require(back=count - 1)
        if count not in self._sliding:
            self._sliding[count] = self.window.rowsBetween(-(count - 1), 0)
        return self._sliding[count]

    @cached_property
    def _sliding(self) -> dict[int, WindowSpec]:
        return {}

    @cached_property
    def running(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    @cached_property
    def before(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, -1)

    @cached_property
    def segment(self) -> WindowSpec:
        return (
            Window.partitionBy(self.key, BLOCK, SUB)
            .orderBy(ROW)
            .rowsBetween(Window.unboundedPreceding, 0)
        )

    @property
    def is_own(self) -> Column:
        """True for the rows of the block itself, false for copies from its neighbours."""
        return F.col(BLOCK) == F.floor(F.col(ROW) / self.block)

    def require(self, back: int = 0, ahead: int = 0) -> None:
        if back > self.back or ahead > self.ahead:
            raise ValueError(
                f"layout keeps {self.back} rows back and {self.ahead} ahead; {back} and {ahead} are needed"
            )

    def with_columns(self, columns: Mapping[str, Column]) -> Laid:
        return replace(self, frame=self.frame.withColumns(dict(columns))) if columns else self

    def drop(self, *columns: str) -> Laid:
        return replace(self, frame=self.frame.drop(*columns))

    def numbered(self) -> DataFrame:
        """One row per input row, with row number and series length."""
        return self.frame.filter(self.is_own).drop(BLOCK, SUB)

    def rows(self) -> DataFrame:
        """One row per input row, in the input's columns plus those added since."""
        return self.frame.filter(self.is_own).drop(*INTERNAL)

    def summary(self, aggregates: Sequence[Column]) -> DataFrame:
        """One row per block, from the block's own rows."""
        return self.frame.filter(self.is_own).groupBy(self.key, BLOCK).agg(*aggregates)

    def join_blocks(self, table: DataFrame) -> Laid:
        """Bring block-level columns to the rows; the big side keeps its partitioning and order."""
        return replace(self, frame=self.frame.join(table, [self.key, BLOCK], "left"))

    def blocks_before(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    def blocks_after(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)

    def blocks_all(self) -> WindowSpec:
        return Window.partitionBy(self.key)


def time_bucket(time: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(time)) / F.lit(seconds * 1_000_000))


def _bucket_counts(df: DataFrame, key: str, bucket: Column) -> DataFrame:
    return df.select(key, bucket.alias("_bucket")).groupBy(key, "_bucket").agg(F.count("*").alias("_count"))


def _required(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"a row has no {name}")))


def number_rows(
    df: DataFrame,
    key: str = "symbol",
    time: str = "t",
    ties: Sequence[str] = (),
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Row number and length of every series without sorting a whole series in one task.

    Rows are numbered within ``(key, time bucket)`` and shifted by the number of rows in earlier buckets. Choose
    the bucket so that it holds some ten thousand rows of the busiest series. A row without a key or a time is an error.
    """
    df = df.withColumns({name: _required(name) for name in (key, time)})
    bucket = time_bucket(time, bucket_seconds)
    counts = _bucket_counts(df, key, bucket)
    series = Window.partitionBy(key)
    earlier = series.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key,
        "_bucket",
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_count").over(series).alias(ROWS),
    )
    within = Window.partitionBy(key, "_bucket").orderBy(time, *ties)
    return (
        df.withColumn("_bucket", bucket)
        .withColumn("_within", F.row_number().over(within))
        .join(offsets, [key, "_bucket"])
        .withColumn(ROW, F.col("_offset") + F.col("_within") - F.lit(1))
        .drop("_bucket", "_within", "_offset")
    )


def cut(
    numbered: DataFrame,
    key: str = "symbol",
    time: str = "t",
    block: int = DEFAULT_BLOCK,
    back: int = DEFAULT_BACK,
    ahead: int = DEFAULT_AHEAD,
) -> Laid:
    """Cut numbered rows into blocks; a row near an edge is copied to the neighbours that look at it."""
    row, rows = F.col(ROW), F.col(ROWS)
    first = F.greatest(F.lit(0), F.floor((row - ahead) / block))
    last = F.least(F.floor((row + back) / block), F.floor((rows - 1) / block))
    frame = numbered.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(SUB, F.floor(row / SEGMENT))
    return Laid(frame, key, time, block, back, ahead)


def lay_out(
    df: DataFrame,
    key: str = "symbol",
    time: str = "t",
    ties: Sequence[str] = (),
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    block: int = DEFAULT_BLOCK,
    back: int = DEFAULT_BACK,
    ahead: int = DEFAULT_AHEAD,
) -> Laid:
    laid = cut(number_rows(df, key, time, ties, bucket_seconds), key, time, block, back, ahead)
    return replace(laid, sizes=df.groupBy(key).agg(F.count("*").alias(ROWS)))
