"""Near duplicates by SimHash, verified by the exact Jaccard similarity of shingle sets.

Equal sets are one node, whatever the ids of their rows. Fingerprints are of sets;
a bit differs between sets at the least similarity with probability ``APART``, so a
plan of parts is made that misses such a pair with probability ``MISS`` (``simhash``),
and fewer of those that are more alike. The fingerprints have as many words as that
takes for the number of nodes. Probes carry the first two words: candidates must be
within ``gate`` of their bits (4.5 deviations above the mean at the least similarity).
A candidate becomes a link only when its whole sets (of 64-bit hashes) have the least
similarity.

Of large buckets that still hold several components after their first links, only the
nodes with a candidate in another component go on; these are found in the bucket, on
what probes carry and then on whole fingerprints, and only the nodes are written. They are joined to groups by the
buckets that they share. A group's nodes outside its largest component are compared in
blocks, with each other and with the blocks of that component: whole sets meet there,
the most alike first, and a pair is verified only while it would join two components.
So no pairs of a group are written, but for links, and sets are dealt to pairs of
blocks only where texts are alike, not where large tables fill buckets by chance.

Sets of fewer than ``SMALLEST`` shingles have no other set at the least similarity and
are not probed.

Defined results: null and empty texts have one (empty) set; a text shorter than a
shingle is one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm.common import doc_keys, drop_stash, maybe_broadcast, stash
from stocktake.llm.components import connected_components
from stocktake.llm.simhash import WORD, Alike, fingerprint, make_plan, posted_links, probes, sampled, shingle_hashes

#: Linked from this similarity on, as a fraction.
LEAST = (4, 5)
#: How often a bit differs at that similarity: sets of equal size have a cosine of 2 J / (1 + J), others a greater one.
APART = math.acos(2 * LEAST[0] / (LEAST[0] + LEAST[1])) / math.pi
#: The share of pairs at the least similarity that the plan may miss.
MISS = 0.001
#: The size of the smallest set to which a larger one can have that similarity, and of the smallest sets of equal size.
SMALLEST, EQUAL = -(-LEAST[0] // (LEAST[1] - LEAST[0])), -(-(LEAST[0] + LEAST[1]) // (LEAST[1] - LEAST[0]))


def gate(words: int) -> int:
    """Bits in which fingerprints of ``words`` words may differ: 4.5 deviations above the mean at the least similarity."""
    bits = WORD * words
    return math.ceil(bits * APART + 4.5 * math.sqrt(bits * APART * (1 - APART)))


#: Sets in a block.
BLOCK = 2048
#: Pairs of sets that reach a Python worker at once.
BATCH = 500


def words_for(n: int) -> int:
    """Words of a fingerprint so that parts of a fitting width reach ``MISS``."""
    width = max(8, round(math.log2(max(n, 2))) - 6)
    return math.ceil(width * math.log(MISS) / math.log(1 - (1 - APART) ** width) / WORD) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes are at least ``LEAST`` alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= LEAST[0] * (len(a) + len(b) - both)


def shingle_sets(docs: DataFrame, words: int, size: int) -> DataFrame:
    """``(did, rid, node, hashes, f)`` for every row; the last two only where a task first meets the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                nodes, sets, prints = [], [], []
                for t in b["text"].to_pylist():
                    h = np.unique(shingle_hashes(t, words))
                    raw = h.tobytes()
                    node = xxhash.xxh64_intdigest(raw, 1)
                    fresh = node not in seen and len(h) > 0
                    if len(seen) < 1 << 20:
                        seen.add(node)
                    nodes.append(node)
                    sets.append(raw if fresh else None)
                    prints.append(fingerprint(h, size) if fresh else None)
                node = pa.array(np.array(nodes, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([b["did"], b["rid"], node, pa.array(sets, pa.binary()), pa.array(prints, pa.list_(pa.int64()))], ["did", "rid", "node", "hashes", "f"])

    return doc_keys(docs).mapInArrow(run, "did long, rid long, node long, hashes binary, f array<long>")


def fitting(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether different sets of the sizes ``n[a]`` and ``n[b]`` can have the least similarity."""
    x, y = n[a], n[b]
    return (LEAST[1] * np.minimum(x, y) >= LEAST[0] * np.maximum(x, y)) & ((x != y) | (x >= EQUAL))


def near(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Candidates among rows ``(key, node, n, f0, f1, ...)``: sizes that allow the similarity, and fingerprints within the gate."""
    ok = fitting(rows[:, 2], a, b)
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count((rows[a[at], 3:] ^ rows[b[at], 3:]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= gate(rows.shape[1] - 3)
    return ok


def block_links(rows: dict) -> list[tuple[int, int]]:
    """Links that join components among the rows of one or two blocks: whole sets, nearest fingerprints first."""
    comp, own, n = (np.array(rows[c], np.int64) for c in ("component", "own", "n"))
    f = np.array(rows["f"], np.int64).view(np.uint64)
    sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    found, most = [], gate(f.shape[1])
    for lo in range(0, len(n), 64):
        a, b = np.nonzero((comp[lo : lo + 64, None] < comp[None, :]) & ((own[lo : lo + 64, None] != own[None, :]) | (own[0] == own[-1])))
        a += lo
        fine = fitting(n, a, b)
        a, b = a[fine], b[fine]
        far = np.zeros(len(a), np.int64)
        for k in range(f.shape[1]):
            far += np.bitwise_count(f[a, k] ^ f[b, k])
        order = np.argsort(far, kind="stable")[: int((far <= most).sum())]
        for i, j in zip(a[order].tolist(), b[order].tolist()):
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y and similar(sets[i], sets[j]):
                parent[max(x, y)] = min(x, y)
                found.append((rows["node"][i], rows["node"][j]))
    return found


def block_sizes(rows: DataFrame, by: str) -> DataFrame:
    """``(by, largest, inside, outside)``: the largest component, and blocks inside and outside it, where there are several."""
    per = rows.groupBy(by, "component").agg(F.count("*").alias("m"))
    most = per.groupBy(by).agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("int")
    return most.select(by, F.col("top.component").alias("largest"), blocks(F.col("top.m")).alias("inside"), blocks(F.col("all") - F.col("top.m")).alias("outside")).where("outside > 0")


def block_pairs(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    """``(pair, own, *names)``: rows with ``block_sizes``, once for each pair of blocks that theirs is in."""
    # blocks of the largest component have numbers below 0; they aren't compared with each other
    mine = F.col("component") == F.col("largest")
    own = F.when(mine, -1 - F.pmod(F.xxhash64("node"), F.col("inside"))).otherwise(F.pmod(F.xxhash64("node"), F.col("outside"))).cast("int").alias("own")
    other = F.sequence(F.when(mine, 0).otherwise(-F.col("inside")), F.col("outside") - 1)
    dealt = rows.select("*", own).withColumn("other", F.explode(other))
    dealt = dealt.withColumn("pair", F.xxhash64(by, F.least("own", "other"), F.greatest("own", "other"))).select("pair", "own", *names)
    return dealt.repartition("pair").sortWithinPartitions("pair", "own")


def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one pair of blocks after the other."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        pair = b["pair"].to_numpy()
        edge = np.flatnonzero(np.diff(pair, prepend=pair[:1] - 1, append=pair[-1:] + 1))
        for x, y in zip(edge, edge[1:]):
            if held and pair[x] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = pair[x]
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def with_candidates(rows: np.ndarray) -> np.ndarray:
    """Which rows ``(key, node, n, f0, ..., component, own)`` of one or two blocks have a candidate in another component."""
    comp, own, rows = rows[:, -2], rows[:, -1], rows[:, :-2]
    found = np.zeros(len(rows), bool)
    step = max(1, (1 << 18) // len(rows))
    for lo in range(0, len(rows), step):
        a, b = np.nonzero((comp[lo : lo + step, None] < comp[None, :]) & ((own[lo : lo + step, None] != own[None, :]) | (own[0] == own[-1])))
        ok = near(rows, a + lo, b)
        found[a[ok] + lo] = found[b[ok]] = True
    return found


def met(large: DataFrame, prints: list[str]) -> DataFrame:
    """``(key, node, component)``: rows of large buckets with a candidate of another component in theirs, by the fingerprint's words ``prints``."""
    names = ["key", "node", "n", *prints, "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_pair(batches):
            rows = np.column_stack([t[c].to_numpy().astype(np.int64) for c in (*names, "own")])
            rows = rows[with_candidates(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (0, 1, -2)], ["key", "node", "component"])

    found = block_pairs(large.join(block_sizes(large, "key"), "key"), "key", names).mapInArrow(run, "key long, node long, component long")
    return stash(found.distinct(), "met")


def group_links(large: DataFrame, nodes: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """``(u, v)``: links between components among nodes that share buckets ``large(key, node, n, f0, f1, component)``."""
    some = met(large, ["f0", "f1"])
    prints = nodes.select("node", "n", *[F.col("f")[i].alias(f"f{i}") for i in range(size)])
    printed = stash(some.join(prints, "node"), "printed")
    large = met(printed, [f"f{i}" for i in range(size)])
    for done in (some, printed):
        drop_stash(done)
    least = large.groupBy("key").agg(F.min("node").alias("v"))
    members = stash(large.join(least, "key").select("node", "component", "v"), "members")
    # a node's buckets are joined by the least of their first nodes, so that few links are left
    own = members.groupBy("node").agg(F.min("v").alias("u"))
    links = members.join(own, "node").select("u", "v").distinct().union(own.select(F.col("node").alias("u"), F.col("u").alias("v")))
    found = connected_components(links)
    named = members.select("node", "component").distinct().join(found.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    named = stash(named, "groups")
    drop_stash(members)
    there = stash(named.join(block_sizes(named, "group"), "group"), "there")
    drop_stash(large)
    need = maybe_broadcast(there.select("node"), there.count(), 64)
    own_sets = sets.join(need, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))
    whole = there.join(nodes.join(need, "node", "left_semi"), "node").join(own_sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_pair(batches):
            pairs = block_links(t.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], ["u", "v"])

    return stash(block_pairs(whole, "group", ["node", "component", "n", "f", "hashes"]).mapInArrow(run, "u long, v long"), "links", BATCH)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct ``pairs(u, v)`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b[c].to_pylist() for c in ("x", "y"))
            fine = pa.array([similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["u"].filter(fine), b["v"].filter(fine)], ["u", "v"])

    pairs = stash(pairs.distinct(), "candidates")
    need = stash(pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), "needed")
    few = maybe_broadcast(need, need.count(), 64)
    own = stash(sets.join(few, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    x, y = own.select(F.col("node").alias("u"), F.col("hashes").alias("x")), own.select(F.col("node").alias("v"), F.col("hashes").alias("y"))
    both = pairs.join(x.hint("merge"), "u").join(y.hint("merge"), "v").select("u", "v", "x", "y")
    out = stash(both.mapInArrow(run, "u long, v long"), "links", BATCH)
    for done in (own, pairs, need):
        drop_stash(done)
    return out


def jaccard_components(docs: DataFrame, words: int) -> DataFrame:
    """``(did, rid, component)`` for every row: the connected components of texts that are at least ``LEAST`` alike."""
    size = words_for(docs.count())
    rows = stash(shingle_sets(docs, words, size), "shingles")
    fresh = rows.where("hashes is not null")
    names = [f"f{i}" for i in range(size)]
    nodes = stash(fresh.groupBy("node").agg(F.first((F.length("hashes") / 8).cast("long")).alias("n"), F.first("f").alias("f")), "nodes")
    wide = nodes.where(F.col("n") >= SMALLEST).select("node", "n", *[F.col("f")[i].alias(c) for i, c in enumerate(names)])
    plan = make_plan(*reversed(sampled(wide, names)), Alike(APART, MISS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                f = np.column_stack([b[c].to_numpy() for c in names]).view(np.uint64)
                for at, key in probes(plan, f):
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(b[c].take(at) for c in ("node", "n", "f0", "f1"))], ["key", "node", "n", "f0", "f1"])

    posted = wide.mapInArrow(probe, "key long, node long, n long, f0 long, f1 long")
    sets = fresh.select("node", "hashes")
    links = posted_links(posted, near, lambda pairs: verified(pairs, sets), lambda large: group_links(large, nodes, sets, size))
    labels = connected_components(links)
    out = stash(rows.select("did", "rid", "node").join(labels, "node", "left").select("did", "rid", F.coalesce("component", "node").alias("component")), "labels")
    drop_stash(rows)
    drop_stash(nodes)
    return out
