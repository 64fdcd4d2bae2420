"""SimHash near-dedup by the generalised pigeonhole principle.

The bits of a fingerprint are split into parts, correlated bits together, and each
part gets a threshold of its own (-1 leaves it out). Fingerprints are candidates when
some part of theirs is within its threshold. Two aims are planned for:

* *all pairs up to a distance* (``Within``, the query's): the thresholds, each plus
  one, add up to one more than the distance, so that no pair can be missed;
* *texts of a similarity* (``Alike``, the pipeline's, whose distances only scatter
  around a value): the parts together miss such a pair with a stated probability.

Number of parts and thresholds come from dynamic programming on candidate counts
estimated from a bounded sample, so they follow the size of the table. Parts are
probed by flipping bits on both sides half way; candidates in a bucket are verified
on fingerprints that the probes carry.

Buckets of up to ``SMALL`` fingerprints with up to ``DENSE`` links each give all of
them. Others, larger or denser ones, first give
links to their smallest fingerprint, of which each node keeps one; components of these
are found, and those buckets that still hold several are compared whole, in pairs of
blocks, but only across components. So no bucket is held by one task, and no link that
joins two components is left out. Components are found on tables (``components``).

Defined results: null and empty texts have fingerprint zero and are linked like
any other; rows that share an id are one document, and linked; rows without an id
are documents of their own, and their component is named by the smallest id in it,
if any; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import doc_keys, stash, table
from stocktake.llm.components import connected_components

WORD = 64
#: Fingerprints that the plan of parts is estimated from.
SAMPLE = 1024
#: Microseconds, about, to deal out a probe and to verify a candidate.
PROBE_COST, PAIR_COST = 3.0, 0.02
#: Buckets up to this size compare all pairs at once; blocks of larger ones have about so many rows.
SMALL, BLOCK = 256, 4096
#: Links a row from which a bucket counts as a large one.
DENSE = 3


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(w))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``words`` signed 64-bit numbers: a bit is set where over half of the hashes, and of further mixes of them, have it."""
    n = len(hashes)
    if not n:
        return [0] * words
    most = np.zeros(WORD * words, np.int64)
    for lo in range(0, n, 4096):
        h = hashes[lo : lo + 4096, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h[:, 1:] = (h[:, 1:] ^ (h[:, 1:] >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h[:, 1:] = (h[:, 1:] ^ (h[:, 1:] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h[:, 1:] ^= h[:, 1:] >> np.uint64(31)
        most += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return np.packbits(2 * most > n, bitorder="little").view(np.int64).tolist()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(did, rid, f0)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [fingerprint(shingle_hashes(t, words))[0] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["did"], b["rid"], pa.array(f, pa.int64())], ["did", "rid", "f0"])

    return doc_keys(docs).mapInArrow(run, "did long, rid long, f0 long")


@dataclass(frozen=True)
class Within:
    """All pairs that differ in at most ``distance`` bits."""

    distance: int

    def target(self) -> int:
        return self.distance + 1

    def gain(self, width: int, threshold: int) -> int:
        return threshold + 1

    def shapes(self, bits: int, n: int) -> list[int]:
        return list(range(1, min(self.distance + 1, 16) + 1))


@dataclass(frozen=True)
class Alike:
    """Pairs whose bits differ with probability ``apart`` each; at most ``miss`` of them are missed."""

    apart: float
    miss: float

    def target(self) -> int:
        return math.ceil(-100 * math.log(self.miss))

    def gain(self, width: int, threshold: int) -> int:
        met = sum(comb(width, x) * self.apart**x * (1 - self.apart) ** (width - x) for x in range(threshold + 1))
        return int(-100 * math.log(max(1e-9, 1 - met)))

    def shapes(self, bits: int, n: int) -> list[int]:
        usual = max(8, round(math.log2(max(n, 2))) - 6)
        return sorted({max(1, bits // w) for w in range(max(8, usual - 4), usual + 7)})


@dataclass(frozen=True)
class Plan:
    """The places of the bits of each part that is probed, and its threshold."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_matrix(f: np.ndarray) -> np.ndarray:
    """The bits of fingerprints, one row each."""
    return np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into ``parts`` of nearly equal size, each grown by the bit most correlated with it."""
    x = bits - bits.mean(axis=0)
    spread = np.sqrt((x**2).mean(axis=0)) + 1e-9
    like = np.abs(x.T @ x / max(1, len(x)) / np.outer(spread, spread))
    n = like.shape[0]
    left, out = np.ones(n, bool), []
    for i in range(parts):
        size = (n * (i + 1)) // parts - (n * i) // parts
        score = np.where(left, like[:, left].sum(axis=1), -1.0)
        own: list[int] = []
        for _ in range(size):
            b = int(np.argmax(score))
            score = np.where(left, (score if own else 0) + like[b], -1.0)
            left[b], score[b] = False, -1.0
            own.append(b)
        out.append(sorted(own))
    return out


def make_plan(sample: np.ndarray, n: int, aim: Within | Alike) -> Plan:
    """The cheapest parts and thresholds for ``n`` rows with fingerprints like those of ``sample`` (a row each)."""
    bits = bit_matrix(sample).astype(np.float32)
    pairs = max(1, len(bits) * (len(bits) - 1) // 2)
    best: tuple[float, Plan] | None = None
    for count in aim.shapes(bits.shape[1], n):
        parts = group_bits(bits, count)
        state: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for part in parts:
            w = len(part)
            x = bits[:, part]
            ones = x.sum(axis=1)
            apart = np.rint(ones[:, None] + ones[None, :] - 2 * (x @ x.T)).astype(np.int64)
            seen = np.bincount(apart.ravel(), minlength=w + 1)[: w + 1].astype(float)
            seen[0] -= len(bits)
            # thresholds by the cheapest sum that reaches the aim
            options = [(-1, 0, 0.0)]
            for t in range(min(w, 6) + 1):
                even = sum(comb(w, x) for x in range(t + 1)) / 2.0**w
                near = max(seen[: t + 1].sum() / 2 / pairs, even)
                probes = sum(comb(w, x) for x in range((t + 1) // 2 + 1))
                # flipping on both sides meets a pair several times over
                twice = probes * probes / 2.0**w / even
                options.append((t, aim.gain(w, t), PROBE_COST * n * probes + PAIR_COST * 0.5 * n * n * near * max(1.0, twice)))
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (c, ts) in state.items():
                for t, gain, cost in options:
                    to = min(aim.target(), total + gain)
                    if to not in new or c + cost < new[to][0]:
                        new[to] = (c + cost, (*ts, t))
            state = new
        if (found := state.get(aim.target())) and (best is None or found[0] < best[0]):
            used = [k for k, t in enumerate(found[1]) if t >= 0]
            best = found[0], Plan(tuple(tuple(parts[k]) for k in used), tuple(found[1][k] for k in used))
    if best is None:
        raise ValueError("the fingerprints have too few bits for this aim")
    return best[1]


def flips(width: int, radius: int) -> np.ndarray:
    """All ways to flip up to ``radius`` of the lowest ``width`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def probes(plan: Plan, f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, key)`` of all probes of a part, part by part. Equal keys of different parts only make candidates more."""
    bits = bit_matrix(f)
    for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds)):
        packed = np.packbits(bits[:, list(part)], axis=1, bitorder="little")
        own = np.zeros((len(f), 8), np.uint8)
        own[:, : packed.shape[1]] = packed
        ways = flips(len(part), (t + 1) // 2)
        key = (own.view(np.uint64) ^ ways[None, :]) ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)
        yield np.repeat(np.arange(len(f)), len(ways)), key.ravel().view(np.int64)


#: ``near(rows, a, b)``: which of the pairs of rows ``(key, node, ...)`` are links, or candidates to verify
Near = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _pairs(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.column_stack([np.maximum(node[a], node[b]), np.minimum(node[a], node[b])]), axis=0)


def bucket_links(rows: np.ndarray, near: Near, center: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links in small buckets (runs of equal keys in column 0, nodes in column 1); the rows of large ones; and what those link to: the bucket's smallest node, or themselves.

    With ``center``, a row of an earlier part of the bucket, all rows are of one large bucket.
    """
    if center is not None:
        rows = np.concatenate([center, rows])
    new = np.append(True, np.any(rows[1:, :2] != rows[:-1, :2], axis=1))
    rows = rows[new]
    first = np.append(0, np.flatnonzero(np.diff(rows[:, 0]) != 0) + 1)
    size = np.diff(np.append(first, len(rows)))
    large = np.repeat((size > SMALL) | (center is not None), size)
    start, end = np.repeat(first, size), np.repeat(first + size, size)
    found = [(np.zeros(0, np.int64),) * 2]
    at = np.flatnonzero(~large)
    step = 1
    while len(at := at[at + step < end[at]]):
        ok = near(rows, at, at + step)
        found.append((at[ok], at[ok] + step))
        step += 1
    a, b = (np.concatenate(x) for x in zip(*found))
    dense = np.bincount(start[a], minlength=len(rows))[start] > DENSE * (end - start)
    linked = np.zeros(len(rows), bool)
    linked[a] = linked[b] = True
    keep = ~dense[a]
    at = np.flatnonzero(large | dense & linked)[1 if center is not None else 0 :]
    ok = near(rows, start[at], at)
    return _pairs(rows[:, 1], a[keep], b[keep]), rows[at], np.where(ok, rows[start[at], 1], rows[at, 1])


def posted_links(posted: DataFrame, near: Near, verify: Callable[[DataFrame], DataFrame] = lambda links: links, across: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(u, v)``: links between nodes that share a bucket, enough to connect all that links connect.

    ``posted(key, node, ...)``: one row a probe, all columns long. ``near`` decides on its columns in their order;
    ``verify`` keeps those of its links that are real. ``across`` gets the rows ``(key, node, ..., component)`` of
    large buckets with several components and returns the real links between those; else ``near`` finds them.
    """
    names = posted.columns
    further = names[2:]

    def table_of(b: pa.RecordBatch, columns: list[str]) -> np.ndarray:
        return np.column_stack([b[c].to_numpy().astype(np.int64) for c in columns])

    def out(links: np.ndarray, rows: np.ndarray, to: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(links):
            gone = pa.nulls(len(links), pa.int64())
            yield pa.RecordBatch.from_arrays([gone, gone, *[gone] * len(further), pa.array(links[:, 0]), pa.array(links[:, 1])], [*names, "u", "v"])
        if len(rows):
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in (*rows.T, rows[:, 1], to))], [*names, "u", "v"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # an unfinished bucket, or the first row of one that is large
        large = False
        for b in batches:
            if not b.num_rows:
                continue
            rows = table_of(b, names)
            if large:
                more = int(np.searchsorted(rows[:, 0], held[0, 0], "right"))
                if more:
                    yield from out(*bucket_links(rows[:more], near, held))
                    rows = rows[more:]
                    if not len(rows):
                        continue
                held, large = None, False
            if held is not None:
                rows = np.concatenate([held, rows])
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
            if cut:
                yield from out(*bucket_links(rows[:cut], near))
            held = rows[cut:]
            if len(held) > 2 * SMALL:
                links, rows, to = bucket_links(held[1:], near, held[:1])
                yield from out(links, np.concatenate([held[:1], rows]), np.append(held[0, 1], to))
                held, large = held[:1], True
        if held is not None and not large:
            yield from out(*bucket_links(held, near))

    kinds = ", ".join(f"{c} long" for c in (*names, "u", "v"))
    found = stash(posted.repartition("key").sortWithinPartitions("key", "node").mapInArrow(first, kinds), "buckets")
    star = found.where("key is not null and u != v").groupBy("u").agg(F.min("v").alias("v"))
    links = verify(found.where("key is null").select("u", "v").union(star))
    rows = found.where("key is not null").select(*names)
    if rows.isEmpty():
        return links
    links = stash(links, "links")
    named = rows.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stash(named, "named")
    # of the large buckets, those with several components, in pairs of blocks
    per = named.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = per.where("least != most").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    if across:
        return links.union(across(named.join(mixed.select("key"), "key")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    dealt = named.join(mixed, "key").select(*names, "component", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("pair", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    columns = [*names, "component", "own"]

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            comp, own = rows[:, -2], rows[:, -1]
            step = max(1, (1 << 18) // len(rows))
            for lo in range(0, len(rows), step):
                mine = slice(lo, min(lo + step, len(rows)))
                # each pair once; a block with itself, or two blocks with each other
                a, b = np.nonzero((comp[mine, None] < comp[None, :]) & ((own[mine, None] != own[None, :]) | (own[0] == own[-1])) & (rows[mine, None, 0] == rows[None, :, 0]))
                ok = near(rows, a + lo, b)
                links = _pairs(rows[:, 1], a[ok] + lo, b[ok])
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])

        held: list[np.ndarray] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            pair, rows = b["pair"].to_numpy(), table_of(b, columns)
            edge = np.flatnonzero(np.diff(pair, prepend=pair[0] - 1, append=pair[-1] + 1))
            for x, y in zip(edge, edge[1:]):
                if held and pair[x] != now:
                    yield from whole(np.concatenate(held))
                    held = []
                now = pair[x]
                held.append(rows[x:y])
        if held:
            yield from whole(np.concatenate(held))

    return links.union(dealt.select("pair", *columns).repartition("pair").sortWithinPartitions("pair", "own").mapInArrow(second, "u long, v long"))


def sampled(rows: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """How many rows there are, and the fingerprints of ``SAMPLE`` of them."""
    some = rows.select(*names).orderBy(F.xxhash64(*names), *names).limit(SAMPLE).collect()
    return rows.count(), np.array([tuple(r) for r in some] or [(0,) * len(names)], np.int64).view(np.uint64)


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``(did, rid, doc_id, f0, component)`` for every row; ``component`` is the smallest id that links lead to.

    Two rows are linked when their fingerprints differ in at most ``distance`` bits, or when they share an id.
    """
    rows = stash(fingerprints(docs, words).withColumn("doc_id", F.when(F.col("rid").bitwiseAND(F.lit(1)) == 0, F.col("did"))), "fingerprints")
    distinct = stash(rows.groupBy("f0").agg(F.min("doc_id").alias("least")), "distinct")
    plan = make_plan(*reversed(sampled(distinct, ["f0"])), Within(distance))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                f = big.slice(lo, 2000)["f0"]
                for at, key in probes(plan, f.to_numpy().view(np.uint64).reshape(-1, 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(key), f.take(pa.array(at))], ["key", "node"])

    def near(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count((rows[a, 1] ^ rows[b, 1]).view(np.uint64)) <= distance

    links = posted_links(distinct.select("f0").mapInArrow(probe, "key long, node long"), near)
    # fingerprints of rows that share an id, each with the least of them
    shared = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("f0").alias("low"), F.max("f0").alias("high")).where("low != high")
    same = rows.select("doc_id", "f0").join(shared, "doc_id").where("f0 != low").select(F.col("f0").alias("u"), F.col("low").alias("v"))
    found = connected_components(links.union(same))
    named = stash(distinct.join(found.withColumnRenamed("node", "f0"), "f0", "left").select("f0", "least", F.coalesce("component", "f0").alias("group")), "named")
    least = named.groupBy("group").agg(F.min("least").alias("component"))
    return rows.join(named.join(least, "group").select("f0", "component"), "f0").select("did", "rid", "doc_id", "f0", "component")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
