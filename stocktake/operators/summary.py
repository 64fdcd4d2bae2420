"""Counts and sums of inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktake.functions import keys
from stocktake.schema import U64_MAX

TOP = 32


def saturating_sum(size: Column) -> Column:
    """A sum of unsigned 64-bit numbers that stops at their largest."""
    return F.least(F.sum(size.cast("decimal(20,0)")), F.lit(str(U64_MAX)).cast("decimal(30,0)")).cast("decimal(20,0)")


def prefix_stats(listing: DataFrame) -> DataFrame:
    """``(Prefix, objects, bytes)``; summed within tasks first, so a hot prefix costs a row a task."""
    total = saturating_sum(F.col("Size"))
    return listing.groupBy(keys.prefix(F.col("Key")).alias("Prefix")).agg(F.count("*").alias("objects"), total.alias("bytes"))


def top_prefixes(stats: DataFrame, n: int = TOP) -> DataFrame:
    """By objects, then bytes, then name."""
    return stats.orderBy(F.desc("objects"), F.desc("bytes"), "Prefix").limit(n)


def prefix_counts(listing: DataFrame) -> DataFrame:
    """``(Prefix, count)`` as the prefix-count file has it; sort by ``Prefix`` to write."""
    return prefix_stats(listing).select("Prefix", F.col("objects").alias("count"))


def list_metrics(listing: DataFrame, kept: Column) -> DataFrame:
    """One row: what was received, and what of it a filter keeps."""
    key = keys.prefix(F.col("Key"))
    return listing.agg(
        F.count("*").alias("received_objects"), F.count_if(kept).alias("streamed_rows"), F.count_distinct(F.when(kept, key)).alias("unique_prefixes"),
        F.coalesce(saturating_sum(F.when(kept, F.col("Size"))), F.lit(0).cast("decimal(20,0)")).alias("bytes_total"),
    )


def segment_counts(listing: DataFrame, bounds: list[str]) -> DataFrame:
    return listing.groupBy(keys.segment_index(F.col("Key"), bounds).alias("segment_index")).agg(F.count("*").alias("objects"))
