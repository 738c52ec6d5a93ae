"""Session helpers shared by every entry point."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

def get_spark(app_name: str = "graphloom", master: str | None = None) -> SparkSession:
    """A session with the settings the library relies on.

    A cluster supplies its own master, memory and shuffle width through
    spark-submit; only semantics (UTC, AQE, state store) are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        cores = "".join(ch for ch in master if ch.isdigit()) or str(os.cpu_count() or 8)
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "16g")
            .config("spark.sql.shuffle.partitions", cores)
        )
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; executors cannot see the driver's disk."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured


def local_checkpoints(spark: SparkSession) -> SparkSession:
    """For tests, the bench and other single-process runs: name a folder where the session has none."""
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        if not spark.conf.get("spark.checkpoint.dir", None):
            spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written in here needs its shuffle files no longer once it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: later steps read the columns they need."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept_while(df: DataFrame) -> Iterator[DataFrame]:
    """As ``kept``, and gone again when the block ends."""
    once = kept(df)
    try:
        yield once
    finally:
        for file in once.inputFiles()[:1]:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives executor loss)."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    with shuffles_dropped(spark):
        return df.select("*").checkpoint(eager=True)  # a new frame: one takes the setting when it is made
