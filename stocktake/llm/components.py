"""Connected components over an edge table by alternating large and small stars.

Every round is two aggregations and two joins on DataFrames, written to the
shared folder, so no link or component reaches the driver; the driver sees two
numbers a round. A hub's edges are reduced by ``min`` before they are shuffled,
and the join that deals them back is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm.common import drop_stash, stash


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return near.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its smallest node.

    Nulls and loops are ignored; an empty table gives an empty table.
    """
    e = edges.where("u is not null and v is not null and u != v")
    e = stash(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    for _ in range(max_rounds):
        n = stash(_small_star(_large_star(e).distinct()).distinct(), "edges")
        drop_stash(e)
        e = n
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
