"""Intermediate tables in the shared folder, and the input tables of the queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import checkpoint_root


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """``df`` written once to the folder named by ``spark.checkpoint.dir`` and read back.

    Cuts the lineage, so a lost executor costs a re-read and not a second run of the plan. ``rows_per_file`` is for rows of many
    megabytes (0: no bound): a file's writer looks at what it holds once in a hundred rows only, and its reader takes thousands at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # this write's shuffle files are of no further use
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def keep_until(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """As ``keep``, with a function that deletes the table once everything read off it is written as well."""
    kept = keep(df)
    path = kept.inputFiles()[:1]

    def release() -> None:
        jvm = df.sparkSession.sparkContext._jvm
        for file in path:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    return kept, release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, reading no more than needed to tell."""
    return df.limit(max_rows + 1).count() <= max_rows


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns the operators read, under fixed names and types, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
