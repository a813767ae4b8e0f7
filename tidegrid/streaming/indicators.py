"""Running EMA, RSI and parabolic SAR per symbol over a stream of bars that may come in any order.

State is kept per symbol and bucket of time: the bars of the bucket and the dozen numbers that the indicators stood at before it.
A batch touches the buckets from the earliest new bar on, one after the other, and gives their rows again, so readers take the last
row of a bar and the table equals the batch result whatever the order of the files. Only the newest buckets are kept; a bar older
than all of them cannot be worked in any more and comes out marked late, so that none is lost without a word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from tidegrid.operators.psar import advance, opening_state
from tidegrid.session import scratch_path
from tidegrid.sources import market
from tidegrid.streaming.jobs import upsert_batches

# The processor travels to the executors by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHOWN = ("EMA20", "RSI", "PSAR")
COUNT = "bars"
NUMBERS = (
    "high", "low", "close", "total", "ema", "gain", "loss", "up", "stop", "extreme", "pace",
)


def _doubles(names) -> list[StructField]:
    return [StructField(name, DoubleType()) for name in names]


OUTPUT = StructType(
    [
        StructField("symbol", StringType()),
        StructField("t", TimestampType()),
        *_doubles(("high", "low", "close", *SHOWN)),
        StructField("late", BooleanType()),
    ]
)
WRITTEN = StructType([*OUTPUT.fields, StructField("batch", LongType())])
RUNNING = StructType([StructField(COUNT, LongType()), *_doubles(NUMBERS)])
PLACE = StructType([StructField("bucket", LongType())])
#: One bucket: what stood before it, and its bars by time.
BUCKET = StructType(
    [
        *RUNNING.fields,
        StructField("times", ArrayType(LongType())),
        *[StructField(name, ArrayType(DoubleType())) for name in ("highs", "lows", "closes")],
    ]
)
BUCKET_SECONDS, KEPT_BUCKETS = 86_400, 366
EMA_ROWS, RSI_ROWS = 20, 14
STEP, LIMIT = 0.02, 0.2


def step_bar(state: dict, high: float, low: float, close: float) -> dict:
    """The state after one more bar; what is shown for the bar is in ``shown``."""
    new = dict(state)
    i = state["bars"]
    ema = rsi = sar = None
    new["total"] = state["total"] + close if i < EMA_ROWS else state["total"]
    if i == EMA_ROWS - 1:
        ema = new["total"] / EMA_ROWS
    elif i >= EMA_ROWS:
        weight = 2 / (EMA_ROWS + 1)
        ema = weight * close + (1 - weight) * state["ema"]
    new["ema"] = ema
    if i > 0:
        change = close - state["close"]
        gain, loss = max(change, 0.0), max(-change, 0.0)
        if i <= RSI_ROWS:
            new["gain"], new["loss"] = state["gain"] + gain / RSI_ROWS, state["loss"] + loss / RSI_ROWS
        else:
            keep = 1 - 1 / RSI_ROWS
            new["gain"] = state["gain"] * keep + gain / RSI_ROWS
            new["loss"] = state["loss"] * keep + loss / RSI_ROWS
        if i >= RSI_ROWS:
            both = new["gain"] + new["loss"]
            rsi = 0.0 if both < 1e-8 else 100 * new["gain"] / both
        highs, lows = [state["high"], high], [state["low"], low]
        if i == 1:
            run = opening_state(highs, lows, 0, STEP)
        else:
            run = (state["up"], state["stop"], state["extreme"], state["pace"])
        out = [None, None]
        run = advance(highs, lows, 1, 2, run, STEP, LIMIT, 1 if i == 1 else 0, out)
        sar = out[1]
        new["up"], new["stop"], new["extreme"], new["pace"] = run
    new |= {"bars": i + 1, "high": high, "low": low, "close": close}
    new["shown"] = (ema, rsi, sar)
    return new


class RunningIndicators(StatefulProcessor):
    """``bucket_seconds`` bounds what is read and written at once, ``kept_buckets`` how far back a bar may be."""

    def __init__(self, bucket_seconds: int = BUCKET_SECONDS, kept_buckets: int = KEPT_BUCKETS):
        self.bucket_micros, self.kept_buckets = bucket_seconds * 1_000_000, kept_buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getMapState("buckets", PLACE, BUCKET)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, dict[int, tuple[float, float, float]]] = {}
        for batch in rows:
            times = batch["t"].astype("datetime64[us]").astype("int64").tolist()
            for time, *bar in zip(times, batch["high"].tolist(), batch["low"].tolist(), batch["close"].tolist(), strict=True):
                fresh.setdefault(time // self.bucket_micros, {})[time] = tuple(bar)
        held = sorted(place[0] for place in self.buckets.keys())
        oldest = held[0] if len(held) >= self.kept_buckets else None
        for bucket in sorted(fresh):
            if oldest is not None and bucket < oldest:
                yield self._frame([(key[0], t, *bar, None, None, None, True) for t, bar in sorted(fresh.pop(bucket).items())])
        if fresh:
            yield from self._worked_in(key[0], held, fresh)

    def _worked_in(self, symbol, held: list[int], fresh: dict) -> Iterator[pd.DataFrame]:
        """The buckets from the earliest new bar on, each with the state that the one before it leaves."""
        names = RUNNING.names
        every = sorted({*held, *fresh})
        first = every.index(min(fresh))
        state = dict.fromkeys(names, 0.0) | {"bars": 0}
        if first:
            stood, bars = self._read(every[first - 1])
            state, _ = self._run(stood, bars)
        elif held and every[0] == held[0]:
            state, _ = self._read(every[0])
        for bucket in every[first:]:
            bars = self._read(bucket)[1] if bucket in held else {}
            bars |= fresh.get(bucket, {})
            times = sorted(bars)
            columns = [[bars[t][k] for t in times] for k in range(3)]
            self.buckets.updateValue((bucket,), (*[state[name] for name in names], times, *columns))
            state, shown = self._run(state, bars)
            yield self._frame([(symbol, t, *bars[t], *shown[t], False) for t in times])
        for bucket in every[: -self.kept_buckets]:
            self.buckets.removeKey((bucket,))

    def _read(self, bucket: int) -> tuple[dict, dict[int, tuple[float, float, float]]]:
        row = self.buckets.getValue((bucket,))
        state = dict(zip(RUNNING.names, row, strict=False))
        times, highs, lows, closes = row[len(RUNNING.names) :]
        return state, {t: bar for t, *bar in zip(times, highs, lows, closes, strict=True)}

    @staticmethod
    def _run(state: dict, bars: dict) -> tuple[dict, dict[int, tuple]]:
        shown = {}
        for time in sorted(bars):
            state = step_bar(state, *bars[time])
            shown[time] = state.pop("shown")
        return state, shown

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=OUTPUT.names)
        frame["t"] = pd.to_datetime(frame["t"], unit="us")
        return frame.astype(dict.fromkeys(SHOWN, "float64"))

    def close(self) -> None:
        pass


def stream_online_indicators(
    bars: DataFrame, bucket_seconds: int = BUCKET_SECONDS, kept_buckets: int = KEPT_BUCKETS
) -> DataFrame:
    """``symbol, t, high, low, close, EMA20, RSI, PSAR, late``: rows of every bar whose values a batch changes.

    A bar that comes again replaces the earlier one. Bars older than the ``kept_buckets`` newest buckets come out once with
    ``late`` true and no values. Bars without a symbol or time are an error of the source and are left out.
    """
    processor = RunningIndicators(bucket_seconds, kept_buckets)
    return (
        bars.select("symbol", "t", "high", "low", "close")
        .filter("symbol IS NOT NULL AND t IS NOT NULL")
        .groupBy("symbol")
        .transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="Update", timeMode="None")
    )


def follow_indicators(bars: DataFrame, path: str, checkpoint: str, **kept: int) -> None:
    """Runs the stream to the end of what has landed; each batch is a folder of its own below ``path``."""
    spark = bars.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        upsert_batches(stream_online_indicators(bars, **kept), path, checkpoint).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def shown_indicators(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, t, close, EMA20, RSI, PSAR``: the last values of every bar that was worked in."""
    written = spark.read.schema(WRITTEN).parquet(path).filter("NOT late")
    newest = F.max_by(F.struct("close", *SHOWN), "batch").alias("_newest")
    return written.groupBy("symbol", "t").agg(newest).select("symbol", "t", "_newest.*")


def late_bars(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, t, high, low, close`` of the bars that came too late to be worked in."""
    written = spark.read.schema(WRITTEN).parquet(path)
    return written.filter("late").select("symbol", "t", "high", "low", "close")


def indicators_to_table(spark: SparkSession, folder: str, files: int = 4) -> DataFrame:
    """Lands the bars in several files, in no order, follows them one file at a time and returns what is shown."""
    landed, path = scratch_path(spark, "landed-bars"), scratch_path(spark, "stream-indicators")
    market.bars(spark, folder).repartition(files, F.xxhash64("symbol", "t")).write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", 1).parquet(landed)
    follow_indicators(stream, path, scratch_path(spark, "stream-indicators-log"))
    return shown_indicators(spark, path)
