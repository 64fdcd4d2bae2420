"""Synthetic inventories for tests and timings, made by ``range`` and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = 1704067200


def _little_endian(n: Column) -> Column:
    """Sixteen hex digits of a long, lowest byte first: the bytes are swapped as numbers, then written once."""
    swapped = F.lit(0).cast("long")
    for i in range(8):
        byte = F.shiftrightunsigned(n, 8 * i).bitwiseAND(F.lit(0xFF).cast("long"))
        swapped = swapped.bitwiseOR(F.shiftleft(byte, 56 - 8 * i))
    return F.lower(F.lpad(F.hex(swapped), 16, "0"))


def _row(i: Column, prefixes: int) -> list[Column]:
    group = i % prefixes
    key = F.concat(F.lit("prefix-"), group.cast("string"), F.lit("/object-"), F.lpad(i.cast("string"), 12, "0"), F.lit(".dat"))
    return [key.alias("Key"), (F.lit(1024) + i % 4096).alias("Size"), (F.lit(STAMP) + i).alias("LastModified"), F.concat(_little_endian(i), _little_endian(group)).alias("ETag")]


def synthetic_listing(spark: SparkSession, objects: int, prefixes: int = 512) -> DataFrame:
    return spark.range(objects).select(*_row(F.col("id"), prefixes))


def synthetic_sides(spark: SparkSession, objects: int, prefixes: int = 512, shape: str = "mixed") -> tuple[DataFrame, DataFrame]:
    """``mixed``: by number modulo 4, equal, left only, right only, changed; or ``all-equal``, ``all-changed``."""
    base = spark.range(objects)
    i = F.col("id")
    changed = {"mixed": i % 4 == 3, "all-equal": F.lit(False), "all-changed": F.lit(True)}[shape]
    left = base.where(i % 4 != 2) if shape == "mixed" else base
    right = base.where(i % 4 != 1) if shape == "mixed" else base
    right = right.select(*_row(i, prefixes), changed.alias("changed")).withColumn("Size", F.col("Size") + F.col("changed").cast("long")).drop("changed")
    return left.select(*_row(i, prefixes)), right
