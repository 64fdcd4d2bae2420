"""Scoping, gating and partitioning of one inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.functions import keys
from stocktake.functions.predicate import bindings, compile_filter, keep_column
from stocktake.schema import DIFF, EQUAL, LISTING


def conform(df: DataFrame) -> DataFrame:
    """Inventories written elsewhere: unsigned columns become longs, missing values zero, tags lower case."""
    size = F.coalesce(F.col("Size").cast("long"), F.lit(0).cast("long"))
    stamp = F.coalesce(F.col("LastModified").cast("long"), F.lit(0).cast("long"))
    return df.select(F.col("Key"), size.alias("Size"), stamp.alias("LastModified"), F.coalesce(F.lower("ETag"), F.lit("0" * 32)).alias("ETag"))


def scope(listing: DataFrame, prefix: str = "", start_after: str = "", segment: tuple[str | None, str | None] | None = None) -> DataFrame:
    """Keys below ``prefix`` and after ``start_after``, in ``(start, end]``; all of it reaches the scan as pushed filters."""
    key = F.col("Key")
    if prefix and prefix != "/":
        listing = listing.where(key.startswith(prefix))
    if start_after:
        listing = listing.where(key > start_after)
    low, high = segment or (None, None)
    if low is not None:
        listing = listing.where(key > low)
    if high is not None:
        listing = listing.where(key <= high)
    return listing


def objects_at_level(listing: DataFrame, prefix: str, delimiter: str) -> DataFrame:
    """Keys below ``prefix`` without the delimiter in what follows."""
    scoped = scope(listing, prefix)
    return scoped.where(~F.contains(F.substr("Key", F.lit(len(prefix) + 1)), F.lit(delimiter))) if delimiter else scoped


def common_prefixes(listing: DataFrame, prefix: str, delimiter: str) -> DataFrame:
    """``(Prefix)``: what the other keys below ``prefix`` roll up to, each once."""
    rest = F.substr("Key", F.lit(len(prefix) + 1))
    rolled = scope(listing, prefix).where(F.contains(rest, F.lit(delimiter)))
    return rolled.select(F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter)).alias("Prefix")).distinct()


def gate(listing: DataFrame, filter: str | None, exact_longs: bool = True) -> DataFrame:
    """Rows that the filter doesn't drop. Errors keep a row."""
    if not filter:
        return listing
    bind = bindings({c: F.col(c) for c in ("Size", "LastModified")})
    return listing.where(keep_column(compile_filter(filter), bind, exact_longs))


def with_segment(listing: DataFrame, bounds: list[str]) -> DataFrame:
    return listing.withColumn("segment_index", keys.segment_index(F.col("Key"), bounds))


def remaining(listing: DataFrame, bounds: list[str], completed: list[int]) -> DataFrame:
    """Keys of the segments that a resumed run has still to do, by ranges that the scan can prune."""
    todo = [i for i in range(len(bounds) + 1) if i not in set(completed)]
    inside = F.lit(False)
    for i in todo:
        low = F.lit(True) if i == 0 else F.col("Key") > bounds[i - 1]
        high = F.lit(True) if i == len(bounds) else F.col("Key") <= bounds[i]
        inside = inside | (low & high)
    return listing.where(inside)


def output(listing: DataFrame) -> DataFrame:
    """The five output columns; inventories carry flag 0."""
    return listing.select(*LISTING.names, F.lit(EQUAL).cast("short").alias(DIFF.names[-1]))
