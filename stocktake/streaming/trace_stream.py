"""Traces as a stream. An extension: the batch reports are the measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stocktake.schema import TRACE


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def windowed_counts(trace: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls, failures and the slowest call by time window and operation; later rows than ``late`` are left out."""
    seen = trace.withWatermark("timestamp", late)
    failed = F.col("http_status") >= 400
    return seen.groupBy(F.window("timestamp", window), "operation").agg(F.count("*").alias("calls"), F.count_if(failed).alias("failed"), F.max("latency_ms").alias("max_ms"))


def running_counts(trace: DataFrame) -> DataFrame:
    return trace.groupBy("operation", "http_status").agg(F.count("*").alias("calls"))


def write_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows as Parquet, exactly once; what is there when it starts, then it ends."""
    flat = counts.select(F.col("window.start").alias("start"), "operation", "calls", "failed", "max_ms")
    return flat.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def settle(counts: DataFrame, name: str) -> DataFrame:
    """Run a counting stream over all there is, and return its last result (a row a group)."""
    query = counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)
