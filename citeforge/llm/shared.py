"""Shared folder, written intermediate tables, and columns that all operators need."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where rows are ordered or joined: null sorts last.
LAST_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is named and all run on this machine, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        got = spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="citeforge-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "lz4_raw").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, blob: str) -> tuple[DataFrame, int]:
    """df written, and about how many bytes its rows take in memory."""
    table = written(df, name)
    row = table.agg(F.count("*").alias("n"), F.sum(F.octet_length(blob)).alias("bytes")).first()
    return table, 64 * row.n + (row.bytes or 0)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a finished intermediate through Hadoop's file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Whole texts pass in batches of at most so many rows and bytes, but for a text that is longer by itself.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 2_000_000, "spark.sql.parquet.columnarReaderBatchSize": 512}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch sizes to BATCHES where they are larger; they stay so, since plans that read them run later."""
    for key, most in BATCHES.items():
        got = spark.conf.get(key, None)
        if got is None or int(got.rstrip("bB")) > most:
            spark.conf.set(key, str(most))


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of df's source, for sizing sketches; never for results."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def order_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))
