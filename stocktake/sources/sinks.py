"""Writing inventories, diffs, prefix counts and traces. Spark's committers make each all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.functions import keys
from stocktake.operators.summary import prefix_counts

CODECS = ("uncompressed", "snappy", "gzip", "lz4", "lz4_raw", "zstd", "brotli")
#: Without a codec library in a plain Spark.
MISSING = ("brotli",)


def check_codec(name: str) -> str:
    if name not in CODECS:
        raise ValueError(f"unknown codec {name}; one of {', '.join(CODECS)}")
    if name in MISSING:
        raise ValueError(f"{name} needs a codec library that Spark doesn't ship")
    return name


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", level: int | None = 1, row_group_rows: int = 100_000, mode: str = "errorifexists") -> None:
    w = df.write.mode(mode).option("compression", check_codec(compression)).option("parquet.block.row.count.limit", row_group_rows)
    if level is not None and compression == "zstd":
        w = w.option("parquet.compression.codec.zstd.level", level)
    w.parquet(path)


def write_prefix_counts(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``"prefix","count"`` lines, of an inventory or of its prefix sums, in files that are sorted and follow each other.

    Ranges of prefixes are dealt to tasks, each of which sorts and writes its own; the files' names are in the order of the ranges.
    """
    counts = df.select("Prefix", F.col("objects").alias("count")) if "objects" in df.columns else prefix_counts(df)
    rows = counts.orderBy("Prefix").select("Prefix", F.col("count").cast("string").alias("count"))
    rows.write.mode(mode).option("quoteAll", True).option("escape", '"').option("header", False).csv(path)


def tsv_lines(listing: DataFrame) -> DataFrame:
    return listing.select(F.concat_ws("\t", keys.tsv_escape(F.col("Key")), F.col("Size").cast("string"), F.col("LastModified").cast("string")).alias("value"))


def ndjson_lines(listing: DataFrame) -> DataFrame:
    return listing.select(F.to_json(F.struct(F.col("Key").alias("k"), F.col("Size").alias("s"), F.col("LastModified").alias("m"))).alias("value"))


def write_tsv(listing: DataFrame, path: str, mode: str = "errorifexists") -> None:
    tsv_lines(listing).write.mode(mode).text(path)


def write_ndjson(listing: DataFrame, path: str, mode: str = "errorifexists") -> None:
    ndjson_lines(listing).write.mode(mode).text(path)


def write_trace(trace: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines; fields that are not set are left out."""
    trace.write.mode(mode).option("ignoreNullFields", True).json(path)
