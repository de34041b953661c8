"""The query log as a stream: late rows up to a watermark, windows, and rows that arrive twice.

Each function takes a batch or a streaming DataFrame with (id, found, source, queried_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 hours"


def read_log(spark: SparkSession, folder: str, schema: str = "id long, found int, source string, queried_at timestamp") -> DataFrame:
    """Parquet files as they arrive in folder."""
    return spark.readStream.schema(schema).parquet(folder)


def once(log: DataFrame, late: str = LATE) -> DataFrame:
    """Each id once, among rows no further apart than the watermark."""
    if not log.isStreaming:
        return log.dropDuplicates(["id"])
    return log.withWatermark("queried_at", late).dropDuplicatesWithinWatermark(["id"])


def windows(log: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """(window, source, n, hits) over tumbling windows, or sliding ones with slide."""
    if log.isStreaming:
        log = log.withWatermark("queried_at", late)
    return log.groupBy(F.window("queried_at", length, slide), "source").agg(F.count("*").alias("n"), F.sum("found").alias("hits"))


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(session_window, source, n): runs of a source's queries without a longer gap."""
    if log.isStreaming:
        log = log.withWatermark("queried_at", late)
    return log.groupBy(F.session_window("queried_at", gap), "source").agg(F.count("*").alias("n"))
