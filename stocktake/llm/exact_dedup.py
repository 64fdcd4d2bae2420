"""Exact dedup: fuse filters per immutable snapshot screen incoming digests.

Batches arrive in order. Every batch that has been taken in is an immutable
snapshot: its distinct digests, written once, and a static binary-fuse filter
for each bucket of them. The digests of a later batch are reduced to one row
each, dealt to the same buckets, and probed; only the positives join the exact
bucket, the rest are new and are grouped among themselves. Every group of more
than one row is then confirmed on whole normalised texts, so a digest shared by
different texts splits.

Defined results: a null text counts as empty; rows that repeat both the id and
the text of the row that stays count in ``group_size`` and are all ``kept``
(they are one document); a null id never beats a real one; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import maybe_broadcast, stash, table
from stocktake.llm.fuse import FuseFilter

#: Distinct digests in one bucket, and so in one filter: what a task holds.
BUCKET_DIGESTS = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def full_digest(sha: Column) -> Column:
    return sha


def _key64(dig: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(d[:8].ljust(8, b"\0"), "big") for d in dig.to_pylist()], np.uint64)


def _build(t: pa.Table) -> pa.Table:
    f = FuseFilter.build(_key64(t["dig"]))
    return pa.table({"bucket": pa.array(t["bucket"].to_pylist()[:1], pa.int64()), "seed": pa.array([str(f.seed)]), "segment": pa.array([f.segment], pa.int64()), "span": pa.array([f.span], pa.int64()), "slots": pa.array([f.slots.tobytes()], pa.binary())})


def _probe(inc: pa.Table, filters: pa.Table) -> pa.Table:
    maybe = np.zeros(inc.num_rows, bool)
    for r in filters.to_pylist():
        f = FuseFilter(int(r["seed"]), r["segment"], r["span"], np.frombuffer(r["slots"], np.uint8))
        maybe |= f.maybe(_key64(inc["dig"]))
    return inc.select(["dig"]).filter(pa.array(maybe))


def exact_dedup(batches: list[DataFrame], digest: Callable[[Column], Column] = full_digest) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of every batch.

    ``digest`` turns the SHA-256 into the digest to screen by; a weaker one only costs more confirming.
    """
    texts = [b.select("doc_id", normalised(F.col("text")).alias("norm")) for b in batches]
    rows = [t.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.lit(i).alias("gen")) for i, t in enumerate(texts)]
    everything = rows[0]
    for r in rows[1:]:
        everything = everything.union(r)
    everything = stash(everything.withColumn("dig", digest(F.col("sha"))), "digests")
    groups: DataFrame | None = None
    for i in range(len(batches)):
        # one row a digest: copies are summed before the shuffle
        inc = everything.where(F.col("gen") == i).groupBy("dig").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        if groups is None:
            groups = stash(inc, "snapshot")
            continue
        inc = stash(inc, "incoming")
        # as many buckets as the larger side asks for: what is built and what is probed both fit a task
        buckets = max(1, math.ceil(2 * max(groups.count(), inc.count()) / BUCKET_DIGESTS))
        bucket = F.pmod(F.xxhash64("dig"), F.lit(buckets)).alias("bucket")
        # the filters of the snapshot, one row a bucket, kept beside it
        filters = stash(groups.select("dig", bucket).groupBy("bucket").applyInArrow(_build, "bucket long, seed string, segment long, span long, slots binary"), "filters")
        maybe = stash(inc.select("dig", bucket).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_probe, "dig binary"), "maybe")
        hits = stash(inc.join(maybe, "dig", "left_semi").join(groups.select("dig", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n")), "dig"), "hits")
        merged = hits.select("dig", F.least("keep_id", "old_id").alias("keep_id"), (F.col("n") + F.col("old_n")).alias("n"))
        untouched = groups.join(hits, "dig", "left_anti")
        fresh = inc.join(hits, "dig", "left_anti")
        groups = stash(untouched.unionByName(fresh).unionByName(merged), "snapshot")
    many = groups.where("n > 1")
    few = many.count()
    # byte check: whole texts of suspected copies meet; copies within a task are summed before the shuffle
    all_texts = texts[0]
    for t in texts[1:]:
        all_texts = all_texts.union(t)
    all_texts = all_texts.withColumn("dig", digest(F.unhex(F.sha2("norm", 256))))
    suspects = all_texts.join(maybe_broadcast(many.select("dig"), few, 64), "dig", "left_semi")
    exact = stash(suspects.groupBy("dig", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).select("dig", F.unhex(F.sha2("norm", 256)).alias("sha"), F.md5("norm").alias("md5"), "keep_id", "n"), "exact")
    clash = stash(exact.groupBy("dig").agg(F.count("*").alias("texts")).where("texts > 1").select("dig"), "clash")
    clashes = clash.count()
    if not clashes:
        sure = everything.join(groups.select("dig", "keep_id", "n"), "dig")
    else:
        apart = all_texts.join(maybe_broadcast(clash, clashes, 64), "dig", "left_semi").select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "dig", F.md5("norm").alias("md5"))
        split = apart.join(exact.select("sha", "md5", "keep_id", "n"), ["sha", "md5"]).select("doc_id", "sha", "keep_id", "n")
        whole = everything.join(clash, "dig", "left_anti").join(groups.select("dig", "keep_id", "n"), "dig").select("doc_id", "sha", "keep_id", "n")
        sure = whole.unionByName(split)
    return sure.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: the lower half of the id range as a first batch, the rest against its snapshot."""
    docs = table(spark, sf_dir, "documents")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    mid = 0 if lo is None else (lo + hi) // 2
    first = F.coalesce(F.col("doc_id") <= mid, F.lit(False))
    return exact_dedup([docs.where(first), docs.where(~first)])


OP9_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
"""
