"""Reading input tables, tables written to the shared scratch folder, and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import scratch_path


#: Public Spark setting and its value here: rows are whole texts, so a batch of the default 10,000 is tens of megabytes, held by
#: Spark and by its Python worker several times over.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_PER_BATCH = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if int(spark.conf.get(BATCH_ROWS)) > TEXTS_PER_BATCH:
        spark.conf.set(BATCH_ROWS, str(TEXTS_PER_BATCH))
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Public Spark setting: the shuffle files of a query go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: later stages do not depend on the executors that made it.

    What the table was made of is not needed again, so its shuffle files are removed with the end of the write.
    """
    return _written(df, scratch_path(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one job, deleted together once what was made of them is stored itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        self.paths.append(path)
        return _written(df, path)

    def clear(self) -> None:
        """Deletes the tables; data frames that still read them must not be used any more."""
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def only(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns; further columns of the input play no part, whatever their names."""
    return df.select(*[df[f"`{c}`"] for c in columns])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name1``, ``name2`` ... that is no column of the table (in either case of letters)."""
    taken, number, free = {c.lower() for c in df.columns}, 0, name
    while free.lower() in taken:
        number += 1
        free = f"{name}{number}"
    return free


def hash_share(share: float, *columns: str) -> Column:
    """True for about this share of all values, by 63 bits of a hash, so that the smallest share still finds some."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit(max(1, int(share * (1 << 63))))


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
