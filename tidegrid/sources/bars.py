"""Bars as landed response pages and as a Parquet table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.times import in_range, parse_utc
from tidegrid.operators.series import ROW, ROWS, number_rows
from tidegrid.schemas import BAR_PAGE, BAR_VALUES, BARS

PAGE_LIMIT = 10_000
_FIELDS = dict(zip(("o", "h", "l", "c", "v", "n", "vw"), BAR_VALUES, strict=True))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column: missing values have one form."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else df


def read_bar_pages(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """All pages below ``path/symbol=...``, fields taken by name; malformed pages are an error."""
    schema = T.StructType([*BAR_PAGE.fields, T.StructField("symbol", T.StringType())])
    pages = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = pages.select("symbol", F.inline("bars"))
    bars = without_nan(
        rows.select(F.upper("symbol").alias("symbol"), parse_utc("t").alias("t"), *[F.col(k).alias(v) for k, v in _FIELDS.items()])
    )
    return date_range(bars, start, end)


def date_range(df: DataFrame, start=None, end=None, time: str = "t") -> DataFrame:
    """Rows between two instants, both included; either may be open."""
    if start is not None and end is not None:
        return df.filter(in_range(time, start, end))
    if start is not None:
        return df.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        return df.filter(F.col(time) <= F.lit(end).cast("timestamp"))
    return df


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """Row union of frames by column name."""
    return reduce(lambda a, b: a.unionByName(b), pages)


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BARS)


def write_bar_pages(bars: DataFrame, path: str, limit: int = PAGE_LIMIT) -> None:
    """Bars as pages of at most ``limit`` bars each, one JSON text per page, one folder per symbol."""
    numbered = number_rows(bars).withColumn("_page", F.floor(F.col(ROW) / limit))
    stamp = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    bar = F.struct(stamp.alias("t"), *[F.col(v).alias(k) for k, v in _FIELDS.items()])
    token = F.when((F.col("_page") + 1) * limit < F.col("_rows_in_series"), (F.col("_page") + 1).cast("string"))
    pages = numbered.groupBy("symbol", "_page").agg(
        F.array_sort(F.collect_list(bar)).alias("bars"), F.max(ROWS).alias("_rows_in_series")
    )
    text = F.to_json(F.struct("bars", token.alias("next_page_token")), {"ignoreNullFields": "false"})
    pages.select("symbol", text.alias("value")).write.partitionBy("symbol").text(path)


def write_bars(bars: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by symbol. A symbol's months are written by different tasks, so a busy symbol is not one task's work."""
    month = F.date_trunc("month", F.col("t"))
    (
        bars.repartition("symbol", month)
        .sortWithinPartitions("symbol", "t")
        .write.mode(mode)
        .partitionBy("symbol")
        .parquet(path)
    )


def read_bars(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    fields = [f for f in BARS.fields if f.name != "symbol"] + [BARS["symbol"]]
    table = spark.read.schema(T.StructType(fields)).parquet(path).select(*BARS.names)
    return date_range(table, start, end)
