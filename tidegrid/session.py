"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Fixed value: the JVM does not compile methods above this size, so wide projections are better split up.
JVM_METHOD_LIMIT = "8000"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator assumes: UTC instants, adaptive plans, a shared checkpoint folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JVM_METHOD_LIMIT)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only in local mode when nothing is named (tests)."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} names no folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidegrid-checkpoint-"))
        current = context.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for tables written and read back by one job."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidegrid-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
