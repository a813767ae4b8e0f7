"""Bars of a tick stream with late ticks in a table of their own, and the repair of the bars that they belong to.

A batch is aggregated by itself. Its bars are parts: they carry the place of their first and last tick, and sums in place of
means, so the parts of a bar from any batches merge into the bar of all its ticks. No state is held between batches but the
newest time of each. A tick is late if its bar had ended ``delay`` before the newest tick of the earlier batches; such ticks wait
in the late table, and the bars that were given out stay as they are until a repair merges them in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.resample import tick_order, window_end, window_start
from tidegrid.session import scratch_path

KEYS = ["symbol", "t"]
PART = "symbol string, t timestamp, open double, first decimal(38,0), high double, low double, close double, last decimal(38,0), v double, n bigint, paid double"
TICK = "symbol string, ts timestamp, seq bigint, price double, size double"
TABLES = {"parts": PART, "late": TICK, "repaired": PART, "newest": "newest timestamp"}


def bar_parts(ticks: DataFrame, timeframe: str) -> DataFrame:
    """One part per symbol and window of ticks ``symbol, ts, seq, price, size``; partial sums shuffle, ticks are not sorted."""
    place = tick_order()
    return ticks.groupBy("symbol", window_start("ts", timeframe).alias("t")).agg(
        F.min_by("price", place).alias("open"),
        F.min(place).alias("first"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", place).alias("close"),
        F.max(place).alias("last"),
        F.sum("size").alias("v"),
        F.count("*").alias("n"),
        F.sum(F.col("price") * F.col("size")).alias("paid"),
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """The bars of all parts: ``symbol, t, open, high, low, close, v, n, vw``."""
    return parts.groupBy(*KEYS).agg(
        F.min_by("open", "first").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last").alias("close"),
        F.sum("v").alias("v"),
        F.sum("n").alias("n"),
        F.try_divide(F.sum("paid"), F.sum("v")).alias("vw"),
    )


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What the batches have written so far; the folder is made with the first batch."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], f"{TABLES[name]}, batch int")
    return spark.read.schema(f"{TABLES[name]}, batch int").parquet(f"{path}/{name}")


def take_ticks(batch: DataFrame, batch_id: int, path: str, timeframe: str, delay: str) -> None:
    """Writes the parts of a batch, its late ticks and its newest time to folders of their own; a repeated batch overwrites itself.

    Ticks without a time have no bar and are left out. Only one time per earlier batch is read.
    """
    spark = batch.sparkSession
    earlier = _table(spark, path, "newest").filter(F.col("batch") < batch_id)
    newest = earlier.agg(F.unix_micros(F.max("newest")).alias("micros")).first()["micros"]
    limit = F.timestamp_micros(F.lit(newest).cast("long")) - F.expr(f"interval {delay}")
    known = batch.filter("ts IS NOT NULL").withColumn("_end", window_end("ts", timeframe))
    late = F.coalesce(F.col("_end") <= limit, F.lit(False))  # with no earlier batch, nothing is late
    names = [name.split()[0] for name in TICK.split(", ")]
    for name, rows in (
        ("parts", bar_parts(known.filter(~late).select(*names), timeframe)),
        ("late", known.filter(late).select(*names)),
        ("newest", batch.agg(F.max("ts").alias("newest"))),
    ):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")


def follow_ticks(ticks: DataFrame, path: str, checkpoint: str, timeframe: str, delay: str):
    """Follows a tick stream until all present files are read."""
    return (
        ticks.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: take_ticks(batch, batch_id, path, timeframe, delay))
        .start()
    )


def late_ticks(spark: SparkSession, path: str) -> DataFrame:
    """All ticks that came late, with the batch that brought them; repaired ones stay listed."""
    return _table(spark, path, "late")


def followed_bars(spark: SparkSession, path: str) -> DataFrame:
    """The bars of the ticks in time and of the late ones that were repaired so far."""
    parts = [_table(spark, path, name).drop("batch") for name in ("parts", "repaired")]
    return merged_parts(parts[0].unionByName(parts[1]))


def repair_late(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """Merges the late ticks of batches not yet repaired into their bars; gives the bars that changed, whole.

    Late ticks become parts like any others, in a folder per batch, so a repair that is run again, or stops halfway and is run
    again, adds nothing twice. ``timeframe`` is that of the stream. Run it while no batch is being written.
    """
    late, done = late_ticks(spark, path), _table(spark, path, "repaired")
    before = [row["batch"] for row in done.select("batch").distinct().collect()]  # one number per repaired batch
    waiting = late.filter(~F.col("batch").isin(before)) if before else late
    batches = sorted(row["batch"] for row in waiting.select("batch").distinct().collect())
    for batch_id in batches:
        parts = bar_parts(late.filter(F.col("batch") == batch_id), timeframe)
        parts.write.mode("overwrite").parquet(f"{path}/repaired/batch={batch_id}")
    changed = _table(spark, path, "repaired").filter(F.col("batch").isin(batches)).select(*KEYS).distinct()
    whole, own = followed_bars(spark, path).alias("whole"), changed.alias("own")
    return whole.join(own, F.expr("whole.symbol <=> own.symbol AND whole.t = own.t"), "left_semi")


def repaired_bars_to_table(
    spark: SparkSession, ticks: DataFrame, timeframe: str = "30 minutes", delay: str = "1 day", batches: int = 3
) -> DataFrame:
    """Ticks landed out of order over several batches, followed with a short delay, then repaired: all bars."""
    landed, path = scratch_path(spark, "late-ticks"), scratch_path(spark, "stream-late")
    named = ticks.selectExpr("CAST(symbol AS string)", "ts", "CAST(seq AS bigint)", "CAST(price AS double)", "CAST(size AS double)")
    dealt = named.withColumn("share", F.pmod(F.xxhash64("seq", "ts"), F.lit(batches)))
    log = scratch_path(spark, "stream-late-log")
    for share in range(batches):
        dealt.filter(F.col("share") == share).drop("share").write.mode("append").parquet(landed)
        stream = spark.readStream.schema(TICK).parquet(landed)
        follow_ticks(stream, path, log, timeframe, delay).awaitTermination()
    repair_late(spark, path, timeframe)
    return followed_bars(spark, path)
