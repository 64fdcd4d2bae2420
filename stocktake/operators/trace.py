"""Reports on traces of listing calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocktake.functions.keys import error_class
from stocktake.schema import TRACE

THROTTLED = ("SlowDown", "TooManyRequests", "ThrottlingException")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones show in ``_corrupt_record``."""
    schema = T.StructType([*TRACE.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def by_operation(trace: DataFrame) -> DataFrame:
    return trace.groupBy("operation").agg(F.count("*").alias("calls"))


def by_addressing(trace: DataFrame) -> DataFrame:
    return trace.groupBy("addressing_style").agg(F.count("*").alias("calls"))


def status_histogram(trace: DataFrame) -> DataFrame:
    """Calls by HTTP status; sort by status to show."""
    return trace.groupBy("http_status").agg(F.count("*").alias("calls"))


def error_counts(trace: DataFrame) -> DataFrame:
    return trace.where("s3_error_code is not null").groupBy("s3_error_code").agg(F.count("*").alias("calls"))


def throttles(trace: DataFrame) -> DataFrame:
    """By error code, never by status."""
    return trace.agg(F.count_if(F.col("s3_error_code").isin(*THROTTLED)).alias("throttled"))


def presence(trace: DataFrame, fields: tuple[str, ...] = ("start_after", "continuation_token", "next_continuation_token")) -> DataFrame:
    return trace.agg(*[F.count_if(F.coalesce(F.col(c), F.lit("")) != "").alias(c) for c in fields])


def latency(trace: DataFrame) -> DataFrame:
    return trace.groupBy("operation").agg(F.max("latency_ms").alias("max_ms"), F.expr("percentile(latency_ms, 0.5)").alias("median_ms"))


def error_samples(trace: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` failed calls."""
    failed = trace.where("s3_error_code is not null or http_status >= 400")
    return failed.orderBy("timestamp", "operation", "s3_error_code").limit(n)


def classified(trace: DataFrame) -> DataFrame:
    """Calls by error class."""
    kind = error_class(F.col("s3_error_code"))
    return trace.where("s3_error_code is not null").select(kind.alias("k")).groupBy("k.errno", "k.name", "k.retryable").agg(F.count("*").alias("calls"))


def segment_summary(trace: DataFrame) -> DataFrame:
    """Pages, objects, common prefixes and time of each segment."""
    rows = trace.where("segment_index is not null")
    return rows.groupBy("segment_index").agg(
        F.sum("segment_pages").alias("pages"), F.sum("segment_objects").alias("objects"), F.sum("segment_common_prefixes").alias("common_prefixes"), F.sum("latency_ms").alias("elapsed_ms"), F.max("ended_by").alias("ended_by")
    )
