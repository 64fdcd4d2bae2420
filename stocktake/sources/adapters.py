"""Tables of other kinds as inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.schema import NO_ETAG

EPOCH = 1704067200


def _pad(col: str, width: int) -> Column:
    return F.lpad(F.col(col).cast("string"), width, "0")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listing(key: Column, size: Column, stamp: Column, tag: Column) -> list[Column]:
    return [key.alias("Key"), size.cast("long").alias("Size"), stamp.cast("long").alias("LastModified"), tag.alias("ETag")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), _pad("doc_id", 8), F.lit(".txt"))
    return load(spark, sf_dir, "documents").select(*_listing(key, F.col("n_chars"), F.lit(EPOCH) + F.col("doc_id") * 60, F.md5("text")))


def diff_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two inventories of ``documents`` that lack different rows, and differ in some sizes and tags."""
    docs = load(spark, sf_dir, "documents")
    key = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), _pad("doc_id", 8), F.lit(".txt"))
    stamp, d = F.lit(EPOCH) + F.col("doc_id") * 60, F.col("doc_id")
    left = docs.where(d % 11 != 3).select(*_listing(key, F.col("n_chars"), stamp, F.md5("text")))
    size = F.col("n_chars") + F.when(d % 5 == 0, 1).otherwise(0)
    right = docs.where(d % 7 != 2).select(*_listing(key, size, stamp, F.when(d % 13 == 0, F.lit(NO_ETAG)).otherwise(F.md5("text"))))
    return left, right


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_replace("url", "^https?://", "")
    return load(spark, sf_dir, "pages").select(*_listing(key, F.octet_length("html"), F.lit(EPOCH) + F.col("page_id") * 60, F.md5("html")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("conv/"), _pad("conv_id", 8), F.lit("/"), _pad("turn", 4), F.lit("-"), F.col("role"), F.lit(".txt"))
    return load(spark, sf_dir, "conversations").select(*_listing(key, F.octet_length("text"), F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60, F.md5("text")))


def events_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat, with a sequence number."""
    key = F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    stamp = F.unix_seconds(F.col("ts").cast("timestamp"))
    return load(spark, sf_dir, "events").select(*_listing(key, F.floor(F.col("value") * 100), stamp, F.md5("props")), F.col("event_id").alias("seq"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_columns(load(spark, sf_dir, "events"))


def trace_columns(events: DataFrame) -> DataFrame:
    """Events as calls: sign-ups probe a bucket, errors are failed pages."""
    kind, even = F.col("event_type"), F.col("event_id") % 2 == 0
    bad = kind == "error"
    return events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind == "signup", "HeadBucket").otherwise("ListObjectsV2").alias("operation"),
        F.when(even, "path").otherwise("virtual").alias("addressing_style"),
        F.when(bad & even, 503).when(bad, 500).otherwise(200).alias("http_status"),
        F.when(bad & even, "SlowDown").when(bad, "InternalError").alias("s3_error_code"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("k"), F.col("event_id").cast("string"))).alias("start_after"),
        F.when(F.col("user_id") % 5 == 0, "t").alias("continuation_token"),
        F.when(F.col("user_id") % 7 == 0, "n").alias("next_continuation_token"),
        (F.col("user_id") % 4).alias("segment_index"), F.lit(1).cast("long").alias("segment_pages"), F.col("user_id").cast("long").alias("segment_objects"), F.lit(0).cast("long").alias("segment_common_prefixes"), F.lit("end").alias("ended_by"),
    )
