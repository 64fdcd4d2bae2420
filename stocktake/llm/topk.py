"""Exact top-k inner products by MaxScore over shards of vectors.

Every component is a query term with a signed weight. In a shard, a term's
posting list is its column, and the shift to the column's least favourable value
makes every contribution non-negative, with a known upper bound. For a query,
terms are ordered by bound; the longest tail of terms whose bounds cannot lift a
vector to the current threshold together are non-essential. The essential lists
are traversed for all vectors, the others are probed one after the other for the
vectors that are still competitive. Shards' answers are merged by rank.

Vectors don't move: a shard is the next ``SHARD_ROWS`` vectors of a scan's task, and
queries come to it in broadcast blocks of ``BLOCK_BYTES``, one job a block. Before,
each query is scored against ``SEED_ROWS`` vectors; the k-th best score there is a
lower bound of its last result, so it is every shard's first threshold, and a shard
answers only with vectors that reach it.

Defined results: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; shorter vectors are padded with zeros; candidates
are rows: those that repeat an id, a vector, or both, each count, but for one row
with the query's own id and vector; queries that are repeated are answered each;
scores beyond 64 bits saturate; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocktake.llm.common import stash, table

#: Vectors of a shard, and of the first thresholds.
SHARD_ROWS, SEED_ROWS = 16_384, 4_096
#: Bytes of the queries in a broadcast block, as 64-bit components.
BLOCK_BYTES = 16 << 20
_I64 = 2**63 - 1


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Components of all vectors, one row a term (posting lists), as whole numbers."""
    rows = [np.asarray(v, np.float64) for v in vectors]
    out = np.zeros((width, len(rows)))
    for i, r in enumerate(rows):
        out[: len(r), i] = np.floor(1024.0 * r)
    if not out.size or np.abs(out).max() < 2.0**62:
        return out.astype(np.int64)
    return np.array([[int(x) for x in r] for r in out], object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 8 * k and scores.dtype != object:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def max_score(postings: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """``(places, scores, probed)`` of the k best vectors of one shard for one query, and how many components were read.

    Vectors that score below ``floor`` may be left out.
    """
    worst = np.where(query > 0, low, high)
    best = np.where(query > 0, high, low)
    bound = query * (best - worst)
    base = (query * worst).sum()
    order = np.argsort(-bound, kind="stable")
    # tail[j]: the most that the terms from the j-th on can add
    tail = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
    alive = np.arange(len(ids))
    threshold = base if floor is None else floor
    probed = 0
    if len(alive) > 4 * k:
        # a threshold of the shard: the head of the most weighty posting list
        weight = postings[order[0]] * query[order[0]]
        if weight.dtype == object:
            head = np.array(sorted(range(len(alive)), key=lambda i: -weight[i])[: 4 * k])
        else:
            head = np.argpartition(weight, len(alive) - 4 * k)[len(alive) - 4 * k :]
        threshold = max(threshold, np.sort((postings[:, head] * query[:, None]).sum(axis=0))[-k])
        probed += len(order) * len(head)
    hopeless = base + tail < threshold
    essential = int(np.argmax(hopeless)) if hopeless.any() else len(order)
    total = np.full(len(alive), base, dtype=postings.dtype)
    for j, term in enumerate(order):
        total = total + (postings[term, alive] - worst[term]) * query[term]
        probed += len(alive)
        if j + 1 >= essential:
            fits = total + tail[j + 1] >= threshold
            alive, total = alive[fits], total[fits]
            if not len(alive):
                break
    top = _best(total, ids[alive], k)
    return alive[top], total[top], probed


class Shard:
    """Posting lists of some vectors."""

    def __init__(self, ids: list[int], vectors: list, width: int):
        self.ids = np.array(ids, np.int64)
        self.postings = _matrix(vectors, width)
        self.low, self.high = self.postings.min(axis=1), self.postings.max(axis=1)
        self.most = float(np.abs(self.postings).max(initial=0))

    def search(self, asked: np.ndarray, floors: list[int | None], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query, a column of ``asked``: its number, and places and scores of the k best vectors."""
        wide = asked.dtype == object or self.postings.dtype == object or self.most * float(np.abs(asked).max(initial=0)) * len(asked) * 4 > 2.0**62
        postings, low, high, asked = (x.astype(object) if wide else x for x in (self.postings, self.low, self.high, asked))
        for q, floor in enumerate(floors):
            at, scores, _ = max_score(postings, self.ids, asked[:, q], k, low, high, floor)
            yield q, at, scores


def _clipped(score: int) -> int:
    return max(-_I64, min(_I64, int(score)))


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its k best rows of ``vectors``."""
    context = vectors.sparkSession.sparkContext

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        return v.where(usable(F.col("v")) & F.col("vec_id").isNotNull())

    rows = clean(vectors)
    asked = stash(clean(queries).select("*", F.monotonically_increasing_id().alias("q")), "queries")
    n, widest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    count, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(widest or 0, wide or 0, 1)
    some = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, n // SEED_ROWS))) == 0).limit(2 * SEED_ROWS).collect()
    seeds = context.broadcast(([r[0] for r in some], [r[1] for r in some]))

    def first_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(*seeds.value, width) if seeds.value[0] else None
        for b in batches:
            floors: list[int | None] = [None] * b.num_rows
            if shard and b.num_rows:
                # of k + 1 rows one may be the query's own
                for q, _, scores in shard.search(_matrix(b["v"].to_pylist(), width), floors[:], k + 1):
                    if len(scores) > k and scores[k] > -_I64:
                        floors[q] = _clipped(scores[k])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.int64())], [*b.schema.names, "floor"])

    asked = stash(asked.mapInArrow(first_thresholds, "vec_id long, v array<double>, q long, floor long"), "asked")
    blocks = max(1, math.ceil(count * width * 8 / BLOCK_BYTES))
    found = []
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        held = context.broadcast(([r["q"] for r in block], np.array([r["vec_id"] for r in block], np.int64), _matrix([r["v"] for r in block], width), [r["floor"] for r in block]))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            numbers, owns, matrix, floors = held.value

            def answers(ids: list, vs: list) -> pa.RecordBatch:
                out: tuple[list, ...] = ([], [], [], [])
                shard = Shard(ids, vs, width)
                # one more than k: a row like the query's own is left out behind, once, wherever it is
                for q, at, scores in shard.search(matrix, floors, k + 1):
                    like = (shard.ids[at] == owns[q]) & (shard.postings[:, at] == matrix[:, q : q + 1]).all(axis=0)
                    for o, x in zip(out, ([numbers[q]] * len(at), shard.ids[at].tolist(), map(_clipped, scores), like.tolist())):
                        o += x
                return pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.bool_())], ["q", "vec_id", "score", "like"])

            ids: list = []
            vs: list = []
            for b in batches:
                ids += b["vec_id"].to_pylist()
                vs += b["v"].to_pylist()
                while len(ids) >= SHARD_ROWS:
                    yield answers(ids[:SHARD_ROWS], vs[:SHARD_ROWS])
                    ids, vs = ids[SHARD_ROWS:], vs[SHARD_ROWS:]
            if ids:
                yield answers(ids, vs)

        found.append(stash(rows.mapInArrow(search, "q long, vec_id long, score long, like boolean"), "found"))
    best = reduce(DataFrame.union, found)
    order = F.desc("score"), F.col("vec_id")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order, F.desc("like")))).where(F.col("rank") <= k + 1)
    # of the rows like the query's own, one is its own
    own = F.sum(F.col("like").cast("int")).over(Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    others = ranked.withColumn("seen", own).where(~F.col("like") | (F.col("seen") > 1)).withColumn("rank", F.col("rank") - F.least(F.col("seen"), F.lit(1)))
    return others.where(F.col("rank") <= k).join(asked.select("q", F.col("vec_id").alias("query_id")), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP1_SQL = r"""
WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings),
bad AS (SELECT DISTINCT vec_id FROM v WHERE x IS NULL OR isnan(x) OR isinf(x)),
w AS (SELECT vec_id, d, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM v WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM w q JOIN w c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
