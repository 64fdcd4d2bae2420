"""Key-wise comparison of two inventories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktake.functions import etag
from stocktake.functions.predicate import bindings, compile_filter, keep_column, mentions_target, value_column
from stocktake.operators.summary import prefix_stats
from stocktake.schema import DIFFERENT, EQUAL, LEFT_ONLY, RIGHT_ONLY

VALUES = ("Size", "LastModified", "ETag")


def dedupe_latest(listing: DataFrame, seq: str) -> DataFrame:
    """One row a key, the one with the greatest ``seq``; always the latest, wherever the repeats lie."""
    last = listing.groupBy("Key").agg(F.max_by(F.struct(*VALUES), F.col(seq)).alias("last"))
    return last.select("Key", *[F.col(f"last.{c}").alias(c) for c in VALUES])


def numbered(listing: DataFrame, seq: str = "seq") -> DataFrame:
    """The listing with its rows' order as read, unless it has one."""
    return listing if seq in listing.columns else listing.withColumn(seq, F.monotonically_increasing_id())


def unique(listing: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a key, the latest by ``seq``. Keys are counted by their hashes first; only where some repeat are rows grouped."""
    again = listing.groupBy(F.xxhash64("Key").alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    return listing.drop(seq) if again.isEmpty() else dedupe_latest(listing, seq)


def order_faults(listing: DataFrame, seq: str) -> DataFrame:
    """Rows whose key comes before the key of the row ahead of them, within the parts that the input is read in (or a column ``part``)."""
    parts = Window.partitionBy("part").orderBy(seq)
    cut = listing if "part" in listing.columns else listing.withColumn("part", F.spark_partition_id())
    return cut.withColumn("before", F.lag("Key").over(parts)).where("Key < before").select("Key", "before", seq)


def classify(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Whether a key on both sides differs: by size, or by tag; an unavailable tag always differs."""
    same = (left["Size"] == right["Size"]) & (left["ETag"] == right["ETag"]) & etag.available(left["ETag"])
    return F.when(same, EQUAL).otherwise(DIFFERENT)


@dataclass
class Diff:
    """``merged`` has every key once, with its flag and whether the filter keeps it."""

    merged: DataFrame

    @property
    def rows(self) -> DataFrame:
        return self.merged.where("keep").select("Key", *VALUES, "DiffFlag")

    def counts(self) -> DataFrame:
        """One row: keys by flag, rows, and ignored keys."""
        kept = lambda flag: F.count_if(F.col("keep") & (F.col("DiffFlag") == flag))
        return self.merged.agg(
            F.count_if("keep").alias("rows"), kept(EQUAL).alias("equal"), kept(LEFT_ONLY).alias("left_only"), kept(RIGHT_ONLY).alias("right_only"), kept(DIFFERENT).alias("different"),
            F.count_if(~F.col("keep")).alias("ignored"), F.count("*").alias("keys"),
        )

    def prefix_stats(self) -> DataFrame:
        """Every merged key once, those that the filter ignores too."""
        return prefix_stats(self.merged)


def diff(left: DataFrame, right: DataFrame, filter: str | None = None) -> Diff:
    """Full outer join on ``Key``. Matched keys show the left side's values.

    One-sided keys bind the side they have to SOURCE; a filter that mentions TARGET keeps them all.
    Sides are to be unique by key (``dedupe_latest``). The join shuffles each side once by key and
    spills; neither side is ever broadcast.
    """
    l = left.select("Key", F.struct(*VALUES).alias("l"))  # noqa: E741
    r = right.select("Key", F.struct(*VALUES).alias("r"))
    both = l.join(r, "Key", "full_outer")
    a, b = ({c: F.col(f"{s}.{c}") for c in VALUES} for s in ("l", "r"))
    one_left, one_right = F.col("r").isNull(), F.col("l").isNull()
    own = {c: F.coalesce(F.when(F.col("l").isNotNull(), a[c]), b[c]) for c in VALUES}
    flag = F.when(one_left, LEFT_ONLY).when(one_right, RIGHT_ONLY).otherwise(classify(a, b)).cast("short")
    keep = F.lit(True)
    if filter:
        tree = compile_filter(filter, diff=True)
        pair = keep_column(tree, bindings(a, b))
        alone = F.lit(True) if mentions_target(tree) else F.coalesce(value_column(tree, bindings(own)), F.lit(True))
        keep = F.when(one_left | one_right, alone).otherwise(pair)
    return Diff(both.select("Key", *[own[c].alias(c) for c in VALUES], flag.alias("DiffFlag"), keep.alias("keep")))


def union_parts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
