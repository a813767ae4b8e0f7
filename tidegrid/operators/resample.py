"""Ticks to bars, bars to coarser bars, split adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.times import eastern


def _bar_columns(order: Column) -> list[Column]:
    return [
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("v"),
        F.count("*").alias("n"),
        F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vw"),
    ]


def window_start(ts: str, timeframe: str) -> Column:
    return F.window(ts, timeframe).start


def window_end(ts: str, timeframe: str) -> Column:
    return F.window(ts, timeframe).end


def session_day(ts: str) -> Column:
    """Midnight of the Eastern calendar day, the label of a daily bar."""
    return F.date_trunc("day", eastern(ts))


def tick_order() -> Column:
    """(ts, seq) as one number: microseconds above the 64 bits of the sequence number, which may be negative or missing."""
    whole = "decimal(38,0)"
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast(whole)
    sequence = F.coalesce(F.col("seq"), F.lit(0)).cast(whole) + F.lit(str(2**63)).cast(whole)
    return micros * F.lit(str(2**64)).cast("decimal(20,0)") + sequence


def resample_ticks(ticks: DataFrame, timeframe: str = "1 minute", order: str | None = None, daily: bool = False) -> DataFrame:
    """Bars from ticks ``symbol, ts, seq, price, size``; open and close by (ts, seq).

    Time and sequence number are put into one decimal, so the aggregation keeps fixed-width state, stays a hash aggregate and
    avoids sorting the ticks. ``order`` may name one numeric column that orders the ticks of a bar by itself.
    """
    first_to_last = F.col(order) if order else tick_order()
    label = session_day("ts") if daily else window_start("ts", timeframe)
    return ticks.groupBy("symbol", label.alias("t")).agg(*_bar_columns(first_to_last))


def resample_bars(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars from bars; a bar's time orders it, so the state is fixed-width."""
    order = F.unix_micros("t")
    return bars.groupBy("symbol", window_start("t", timeframe).alias("_start")).agg(
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("v").alias("v"),
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("vw") * F.col("v")), F.sum("v")).alias("vw"),
    ).withColumnRenamed("_start", "t")


def split_adjust(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices before a split are divided by its ratio, volumes multiplied; several splits multiply up.

    The splits of a symbol become one row: their days in order, each with the product of its ratio and all later ones. That row is
    joined by symbol and a bar takes the product of the first day after its own, so the bars are read once and never sorted. Which
    side is broadcast, and how a hot symbol is dealt, is left to the optimizer. Splits without a symbol or day are left out.
    """
    known = splits.filter("symbol IS NOT NULL AND effective_date IS NOT NULL")
    later = Window.partitionBy("symbol").orderBy(F.col("effective_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    daily = known.groupBy("symbol", "effective_date").agg(F.product("ratio").alias("_ratio"))
    factors = daily.select("symbol", F.struct("effective_date", F.product("_ratio").over(later).alias("factor")).alias("_split"))
    listed = factors.groupBy("symbol").agg(F.sort_array(F.collect_list("_split")).alias("_splits"))
    joined = bars.join(listed, "symbol", "left")
    after = F.filter("_splits", lambda split: split["effective_date"] > F.to_date("t"))
    factor = F.coalesce(F.try_element_at(after, F.lit(1))["factor"], F.lit(1.0))
    prices = {name: F.col(name) / F.col("_factor") for name in ("open", "high", "low", "close", "vw")}
    return joined.withColumn("_factor", factor).withColumns(prices | {"v": F.col("v") * F.col("_factor")}).select(*bars.columns)
