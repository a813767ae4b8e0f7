"""Min-max scaling per series, and its inverse."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.series import BLOCK, ROW, ROWS, Laid


def _low(name: str) -> str:
    return f"_low_{name}"


def _high(name: str) -> str:
    return f"_high_{name}"


def train_rows(test_size: float = 0.2) -> Column:
    """Number of leading rows of a series that are not in its test part."""
    return F.col(ROWS) - F.ceil(F.col(ROWS) * test_size)


def _scaled(name: str) -> Column:
    low, high, value = F.col(_low(name)), F.col(_high(name)), F.col(name).cast("double")
    constant = F.when(value.isNotNull(), value - low)
    return F.when(high == low, constant).otherwise(F.try_divide(value - low, high - low))


def minmax_scale(laid: Laid, columns: Sequence[str], fit_rows: Column | None = None, base: Laid | None = None) -> Laid:
    """Each column to [0, 1] over its series; a constant column becomes 0, NULL stays NULL.

    ``fit_rows`` limits the fit to the leading rows of the series, so that nothing is learned from the test part.
    Every block reports its extremes, the extremes of a series are taken over its blocks and come back per block.
    ``base`` may name a layout to read them from, such as a stored one whose columns have only been filled since.
    """
    fitted = F.lit(True) if fit_rows is None else F.col(ROW) < fit_rows
    extremes = []
    for name in columns:
        value = F.when(fitted, F.col(name).cast("double"))
        extremes += [F.min(value).alias(_low(name)), F.max(value).alias(_high(name))]
    series = laid.blocks_all()
    table = (base or laid).summary(extremes).select(
        laid.key,
        BLOCK,
        *[F.min(_low(name)).over(series).alias(_low(name)) for name in columns],
        *[F.max(_high(name)).over(series).alias(_high(name)) for name in columns],
    )
    order = laid.frame.columns
    scaled = laid.join_blocks(table).with_columns({name: _scaled(name) for name in columns})
    return replace(scaled, frame=scaled.frame.select(*order))


def scalers(df: DataFrame, columns: Sequence[str], key: str = "symbol") -> DataFrame:
    """Fitted extremes, one row per series and column: ``symbol, feature, mn, mx``."""
    extremes = []
    for name in columns:
        value = F.col(name).cast("double")
        extremes += [F.min(value).alias(_low(name)), F.max(value).alias(_high(name))]
    rows = [F.struct(F.lit(n).alias("feature"), F.col(_low(n)).alias("mn"), F.col(_high(n)).alias("mx")) for n in columns]
    return df.groupBy(key).agg(*extremes).select(key, F.inline(F.array(*rows)))


def minmax_inverse(df: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    return df.withColumn(column, F.col(column) * (high - low) + low)


def unscale(df: DataFrame, columns: Sequence[str], fitted: DataFrame, feature: str, key: str = "symbol") -> DataFrame:
    """Scaled columns back to the units of ``feature``, with the extremes of ``scalers``."""
    one = fitted.filter(F.col("feature") == feature).select(key, "mn", "mx")
    joined = df.join(one, key, "left")
    for name in columns:
        joined = minmax_inverse(joined, name, F.col("mn"), F.col("mx"))
    return joined.drop("mn", "mx")
