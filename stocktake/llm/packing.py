"""Packing: optimal length buckets, and token-budget batches inside each.

A global histogram of lengths, counted on the executors, goes to the driver, one
row a distinct length (at most about the root of twice the number of words, as
distinct lengths add up to no more: 100,000 at 30 GB). Dynamic programming over it
chooses the bucket bounds with the least padding, exactly, one convex hull of
lines a bucket. Inside a bucket,
documents in the order of their ids are cut into batches that fit the token
budget at the bucket's length; ranks come from counts by range, so no bucket has
to fit one task.

Defined results: length is the number of words; null and empty texts have 0 and
go to the smallest bucket; a text longer than the budget is a batch of its own;
rows that repeat an id each take a place, in the order of a hash of the text; a
null id is the smallest; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktake.llm.common import doc_keys, public_id, stash, table

BUCKETS = 16
BUDGET = 16_384


def word_count(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding (ties: the smaller last start)."""
    m = len(lengths)
    if m <= buckets:
        return list(lengths)
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    best: list[float] = [lengths[j - 1] * before[j] if j else 0 for j in range(m + 1)]
    cuts: list[list[int]] = [[0] * (m + 1)]
    for _ in range(1, buckets):
        # bucket (i, j] costs lengths[j-1] * (before[j] - before[i]): lines in lengths[j-1] with falling slopes
        new, cut = best[:], [0] * (m + 1)
        hull: list[int] = []
        head = 0
        for j in range(1, m + 1):
            i = j - 1
            while len(hull) - head >= 2:
                a, b = hull[-2], hull[-1]
                if (best[i] - best[a]) * (before[b] - before[a]) <= (best[b] - best[a]) * (before[i] - before[a]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and best[hull[head + 1]] - x * before[hull[head + 1]] < best[hull[head]] - x * before[hull[head]]:
                head += 1
            i = hull[head]
            new[j], cut[j] = best[i] + x * (before[j] - before[i]), i
        best = new
        cuts.append(cut)
    bounds, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = cut[j]
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``(did, rid, doc_id, n_tokens, bucket, bucket_len, batch, slot, padding)``: one row for each of ``docs``.

    ``batch`` counts within the bucket, ``slot`` within the batch.
    """
    sized = stash(doc_keys(docs).select("did", "rid", word_count(F.col("text")).alias("n_tokens")), "lengths")
    histogram = sorted((r[0], r[1]) for r in sized.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    bounds = optimal_bounds([x for x, _ in histogram], [n for _, n in histogram], buckets) or [0]
    bucket, size = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for i in range(len(bounds) - 2, -1, -1):
        fits = F.col("n_tokens") <= bounds[i]
        bucket, size = F.when(fits, i).otherwise(bucket), F.when(fits, bounds[i]).otherwise(size)
    placed = sized.select("did", "rid", "n_tokens", bucket.cast("int").alias("bucket"), size.cast("long").alias("bucket_len"), F.monotonically_increasing_id().alias("tie"))
    dealt = placed.repartitionByRange("bucket", "did", "rid", "tie").select("*", F.spark_partition_id().alias("part"))
    dealt = stash(dealt, "dealt")
    # rows of a bucket in the parts before: one row a part and bucket
    counts = dealt.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    ahead = counts.select("bucket", "part", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("part", "bucket").orderBy("did", "rid", "tie")) - 1
    ranked = dealt.withColumn("own", own).join(ahead, ["bucket", "part"]).withColumn("rank", F.col("own") + F.col("ahead"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    ranked = ranked.withColumn("fit", fit)
    return ranked.select("did", "rid", public_id().alias("doc_id"), "n_tokens", "bucket", "bucket_len", F.floor(F.col("rank") / F.col("fit")).cast("long").alias("batch"), (F.col("rank") % F.col("fit")).cast("long").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding")
