"""Windows that occur earlier in a corpus, over bytes or words: screening, sharding, and cutting out.

1. Texts are cut into anchored segments (``anchors``). A task reduces its segments
   to distinct ones and deals them by ranges of the anchor, packed: places, anchors
   and digests, no text. Nothing is broadcast but the heavy anchors, see below.
2. A range has all segments of its anchors. Of equal segments (anchor and digest,
   128 bits) the earliest stays, later ones are covered whole. An anchor with one
   distinct segment shares nothing else; the others' places are asked for their text.
3. Only those segments, one of equal ones, are fetched from the texts and dealt by
   anchor to shards. There a segment that agrees with no other far enough around its
   anchor is left out, and an index finds the windows that the rest share; the index
   is the caller's (``find``): a suffix array, or an FM-index.

A shard has about ``SHARD_BYTES`` of text; one anchor with more is one larger shard.
An anchor with very many segments (``HEAVY`` of them, seen in a bounded sample, which
only decides how they are dealt) would not fit one range or shard: its segments are
dealt as their single windows, by the window's own hash, and are resolved in step 2.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm.anchors import CHUNK, Spans, context_hashes, pieces, segments
from stocktake.llm.common import doc_keys, drop_stash, stash
from stocktake.llm.suffix import scratch

#: Bytes of segments in a shard, about.
SHARD_BYTES = 2 << 20
#: Segments in a range of anchors, and those that a task gathers before it deals them, about.
RANGE_SEGMENTS, FLUSH = 1 << 18, 1 << 19
#: Segments of one anchor from which it is heavy; how many segments are looked at, and how often it must be seen.
HEAVY, SAMPLE, SEEN = 100_000, 1_000_000, 20
#: Bytes of a shard that are kept in memory; more go to files.
MEMORY = 64 << 20
_TABLE = (np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: ``(document, start, end, anchor, digest)`` of the segments of some texts
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: ``find(text, sizes, places)``: see ``covered_spans``
Find = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class ByteView:
    """A text as its UTF-8 bytes."""

    bytes_a_symbol = 1

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram

    def segments(self, raws: list[bytes], heavy: np.ndarray | None = None) -> Iterator[Found]:
        for piece in pieces([len(r) for r in raws], self.length):
            h = _TABLE[np.frombuffer(b"".join([raws[i][a:b] for i, a, b in piece]), np.uint8)]
            starts = np.cumsum([0] + [b - a for _, a, b in piece])
            doc, start, end, anchor, digest = segments(h, starts, self.length, self.gram, heavy)
            owner, shift = np.array([i for i, _, _ in piece]), np.array([a for _, a, _ in piece])
            yield owner[doc], start + shift[doc], end + shift[doc], anchor, digest

    @staticmethod
    def contents(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        return [raw[a:b] for a, b in spans]

    @staticmethod
    def symbols(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all symbols, and how many each of the contents has."""
        return _TABLE[np.frombuffer(b"".join(contents), np.uint8)], np.array([len(c) for c in contents], np.int64)


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``raw`` begin and end."""
    gap = _SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    return edge[::2], edge[1::2]


class WordView:
    """A text as its words; a segment's content is its words joined by one space."""

    bytes_a_symbol = 8

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram

    def _hash(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """In slices at word ends, so that the arrays of powers stay small."""
        out, a = [np.zeros(0, np.uint64)], 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
            own = _TABLE[np.frombuffer(raw[starts[a] : ends[b - 1]], np.uint8)]
            out.append(Spans(own).hashes(starts[a:b] - starts[a], ends[a:b] - starts[a]))
            a = b
        return np.concatenate(out)

    def segments(self, raws: list[bytes], heavy: np.ndarray | None = None) -> Iterator[Found]:
        for group in self._groups(raws):
            raw = b" ".join([raws[i] for i in group])
            starts, ends = word_places(raw)
            h = self._hash(raw, starts, ends)
            edge = np.cumsum([0] + [len(raws[i]) + 1 for i in group])
            first = np.searchsorted(starts, edge)
            for piece in pieces(np.diff(first).tolist(), self.length):
                part = np.concatenate([h[first[i] + a : first[i] + b] for i, a, b in piece])
                cuts = np.cumsum([0] + [b - a for _, a, b in piece])
                doc, start, end, anchor, digest = segments(part, cuts, self.length, self.gram, heavy)
                local, shift = np.array([i for i, _, _ in piece]), np.array([a for _, a, _ in piece])
                yield np.array(group)[local[doc]], start + shift[doc], end + shift[doc], anchor, digest

    @staticmethod
    def contents(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        words = raw.split()
        return [b" ".join(words[a:b]) for a, b in spans]

    def symbols(self, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b" ".join(contents)
        return self._hash(raw, *word_places(raw)), np.array([c.count(b" ") + 1 for c in contents], np.int64)

    @staticmethod
    def _groups(raws: list[bytes]) -> Iterator[list[int]]:
        held, size = [], 0
        for i, r in enumerate(raws):
            if held and size + len(r) > CHUNK:
                yield held
                held, size = [], 0
            held.append(i)
            size += len(r)
        if held:
            yield held


View = ByteView | WordView


def _raw(texts: list) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


#: What a packed segment holds.
_PACK = np.dtype([("anchor", "<u8"), ("dig", "<u8"), ("did", "<i8"), ("rid", "<i8"), ("start", "<u4"), ("size", "<u4")])
#: Kinds of rows after step 2: a covered span, and a segment whose text is asked for.
SPAN, ASKED = 0, 1


def _sorted(x: np.ndarray) -> np.ndarray:
    """Packed segments by anchor and digest, equal ones by place."""
    x = x[np.argsort(np.ascontiguousarray(x["anchor"]))]
    same = np.diff(x["anchor"]) == 0
    at = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if len(at):
        y = x[at]
        x[at] = y[np.lexsort((y["start"], y["rid"], y["did"], y["dig"], y["anchor"]))]
    return x


def _first_of_equal(x: np.ndarray) -> np.ndarray:
    """Of sorted packed segments: which are the first of equal ones."""
    return np.concatenate([[True], (x["anchor"][1:] != x["anchor"][:-1]) | (x["dig"][1:] != x["dig"][:-1])])[: len(x)]


def _later_copies(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Those that start later than the first equal one; rows that repeat a document are the same place."""
    head = x[np.flatnonzero(first)][np.cumsum(first) - 1]
    return x[(x["did"] != head["did"]) | (x["rid"] != head["rid"]) | (x["start"] != head["start"])]


def _spans(x: np.ndarray) -> pa.RecordBatch:
    """Spans of packed segments; those of a document that touch become one."""
    x = x[np.lexsort((x["start"], x["rid"], x["did"]))]
    start, end = x["start"].astype(np.int64), x["start"].astype(np.int64) + x["size"]
    cut = np.flatnonzero((np.diff(x["did"]) != 0) | (np.diff(x["rid"]) != 0) | (start[1:] > end[:-1])) + 1
    a, b = np.concatenate([[0], cut])[: len(x)].astype(np.int64), np.concatenate([cut, [len(x)]])[: len(x)].astype(np.int64) - 1
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, SPAN, np.int32)), *(pa.array(c) for c in (x["did"][a], x["rid"][a], start[a], end[b], np.zeros(n, np.int64)))], RESOLVED)


RESOLVED = ["kind", "did", "rid", "start", "end", "anchor"]


def heavy_anchors(keyed: DataFrame, view: View, expected: int) -> np.ndarray:
    """Anchors of at least ``HEAVY`` segments, as far as about ``SAMPLE`` of the segments show them.

    At most ``SAMPLE / SEEN`` of them. They change how segments are dealt, not what is found.
    """
    share = min(1.0, SAMPLE / max(1, expected))
    least = max(SEEN, math.ceil(share * HEAVY))
    if expected < HEAVY:
        return np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, anchor, digest in view.segments(_raw(b["text"].to_pylist())):
                a, n = np.unique(np.unique(np.stack([anchor, digest]), axis=1)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["anchor", "n"])

    seen = keyed.select("text").sample(share, 11).mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r[0] for r in seen.where(F.col("n") >= least).select("anchor").collect()], np.int64).view(np.uint64))


def distinct_segments(keyed: DataFrame, view: View, expected: int) -> DataFrame:
    """Steps 1 and 2: ``(kind, did, rid, start, end, anchor)``."""
    heavy = keyed.sparkSession.sparkContext.broadcast(heavy_anchors(keyed, view, expected))
    log_ranges = max(0, math.ceil(math.log2(max(1, expected) / RANGE_SEGMENTS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = _sorted(np.concatenate(held))
            first = _first_of_equal(x)
            spans = _spans(_later_copies(x, first))
            # these pass through the exchange as they are, spread by their document
            part = -1 - (spans["rid"].to_numpy() & 0xFFF).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.binary()), *(spans[c] for c in RESOLVED[1:5])], DEALT)
            x = x[first]
            part = (x["anchor"] >> np.uint64(64 - log_ranges)).astype(np.int64) if log_ranges else np.zeros(len(x), np.int64)
            edge = np.flatnonzero(np.diff(part, prepend=-1, append=1 << 62))
            blobs = [x[a:b].tobytes() for a, b in zip(edge, edge[1:])]
            gone = pa.nulls(len(blobs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array(blobs, pa.binary()), *[gone] * 4], DEALT)

        for b in batches:
            did, rid = b["did"].to_numpy(), b["rid"].to_numpy()
            for doc, start, end, anchor, dig in view.segments(_raw(b["text"].to_pylist()), heavy.value):
                x = np.empty(len(doc), _PACK)
                x["anchor"], x["dig"], x["did"], x["rid"], x["start"], x["size"] = anchor, dig, did[doc], rid[doc], start, end - start
                held.append(x)
                size += len(x)
                if size > FLUSH:
                    yield from flush()
                    held.clear()
                    size = 0
        if size:
            yield from flush()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def whole() -> Iterator[pa.RecordBatch]:
            x = _sorted(np.concatenate(held))
            first = _first_of_equal(x)
            yield _spans(_later_copies(x, first))
            x = x[first]
            _, at, n = np.unique(x["anchor"], return_inverse=True, return_counts=True)
            x = x[n[at] > 1]
            start = x["start"].astype(np.int64)
            cols = np.full(len(x), ASKED, np.int32), x["did"], x["rid"], start, start + x["size"], x["anchor"].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], RESOLVED)

        for b in batches:
            part = b["part"].to_numpy()
            n = int(np.searchsorted(part, 0))
            if n:
                spans = b.slice(0, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, SPAN, np.int32)), *(spans[c] for c in RESOLVED[1:5]), pa.array(np.zeros(n, np.int64))], RESOLVED)
            for i in range(n, len(part)):
                if held and part[i] != now:
                    yield from whole()
                    held = []
                now = part[i]
                held.append(np.frombuffer(b["blob"][i].as_buffer(), _PACK))
        if held:
            yield from whole()

    dealt = keyed.mapInArrow(deal, "part long, blob binary, did long, rid long, start long, end long")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(resolve, "kind int, did long, rid long, start long, end long, anchor long")


DEALT = ["part", "blob", "did", "rid", "start", "end"]


class Shard:
    """The segments of a shard as they arrive: texts one after the other, in a file beyond ``MEMORY``."""

    def __init__(self, view: View) -> None:
        self.view = view
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts: list[bytes] = []
        self.size = 0
        self.file = None

    def add(self, b: pa.RecordBatch) -> None:
        for lo in range(0, b.num_rows, 2000):
            part = b.slice(lo, 2000)
            texts = part["content"].to_pylist()
            h, n = self.view.symbols(texts)
            contexts = context_hashes(h, np.cumsum(n) - n, n, self.view.length, self.view.gram)
            self.parts.append((*(part[c].to_numpy() for c in ("did", "rid", "start")), np.array([len(t) for t in texts], np.int64), *contexts))
            self.texts.append(b"".join(texts))
            self.size += len(self.texts[-1])
            if self.file or self.size > MEMORY:
                self.file = self.file or tempfile.TemporaryFile()
                self.file.write(b"".join(self.texts))
                self.texts = []

    @staticmethod
    def _like_others(text: np.ndarray, sizes: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segments with a context that another has, and their texts."""
        _, at, n = np.unique(contexts.ravel(), return_inverse=True, return_counts=True)
        own = np.flatnonzero(((n[at].reshape(contexts.shape) > 1) & (contexts != 0)).any(axis=0))
        ends = np.cumsum(sizes)
        out = scratch(int(sizes[own].sum()), np.uint8, MEMORY)
        m = 0
        for lo in range(0, len(own), 10_000):
            x = np.concatenate([text[ends[i] - sizes[i] : ends[i]] for i in own[lo : lo + 10_000].tolist()])
            out[m : m + len(x)] = x
            m += len(x)
        return own, out

    def spans(self, find: Find) -> pa.RecordBatch:
        did, rid, start, sizes, *contexts = (np.concatenate(c) for c in zip(*self.parts))
        if self.file:
            self.file.flush()
            text = np.memmap(self.file, np.uint8, "r")
        else:
            text = np.frombuffer(b"".join(self.texts), np.uint8)
        self.parts, self.texts = [], []
        own, text = self._like_others(text, sizes, np.stack(contexts))
        del contexts
        did, rid, start, sizes = did[own], rid[own], start[own], sizes[own]
        order = np.lexsort((rid, did))
        new = np.concatenate([[False], (np.diff(did[order]) != 0) | (np.diff(rid[order]) != 0)])[: len(own)]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        which, offset = find(text, sizes, (rank << 40) + start)
        order = np.lexsort((offset, which))
        which, offset = which[order], offset[order]
        cut = np.flatnonzero((np.diff(which) != 0) | (np.diff(offset) != 1)) + 1
        a, b = np.concatenate([[0], cut])[: len(which)].astype(np.int64), np.concatenate([cut, [len(which)]])[: len(which)].astype(np.int64) - 1
        w = which[a]
        return pa.RecordBatch.from_arrays([pa.array(did[w]), pa.array(rid[w]), pa.array(start[w] + offset[a]), pa.array(start[w] + offset[b] + self.view.length)], ["did", "rid", "start", "end"])


def covered_spans(docs: DataFrame, view: View, find: Find, expected: int) -> DataFrame:
    """``(did, rid, start, end)``: spans of symbols covered by a window that starts earlier as well.

    ``find(text, sizes, places)`` gets a shard's distinct segments, one after the other in ``text``, and the place
    of the first symbol of each (comparable over the shard), and returns the segments and offsets of the windows
    that begin earlier too. ``expected``: about how many segments there are.
    """
    keyed = doc_keys(docs)
    resolved = stash(distinct_segments(keyed, view, expected), "segments")
    asked = resolved.where(F.col("kind") == ASKED)
    size = (asked.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0) * view.bytes_a_symbol
    shards = max(1, math.ceil(size / SHARD_BYTES))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                b = big.slice(lo, 500)
                rows, start, anchor, out = [], [], [], []
                for i, (d, r, t, own) in enumerate(zip(*(b[c].to_pylist() for c in ("did", "rid", "text", "own")))):
                    if (d, r) == last:  # a row that repeats a document
                        continue
                    last = d, r
                    rows += [i] * len(own)
                    start += [o["start"] for o in own]
                    anchor += [o["anchor"] for o in own]
                    out += view.contents(t.encode("utf-8", "surrogatepass"), [(o["start"], o["end"]) for o in own])
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b["did"].take(at), b["rid"].take(at), pa.array(start, pa.int64()), pa.array(anchor, pa.int64()), pa.array(out, pa.binary())], ["did", "rid", "start", "anchor", "content"])

    own = asked.groupBy("did", "rid").agg(F.collect_list(F.struct("start", "end", "anchor")).alias("own"))
    fetched = keyed.join(own.hint("merge"), ["did", "rid"]).select("did", "rid", "text", "own").mapInArrow(fetch, "did long, rid long, start long, anchor long, content binary")
    contents = stash(fetched.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).drop("anchor"), "contents")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, Shard(view)
        for b in batches:
            key = b["shard"].to_numpy()
            edge = np.flatnonzero(np.diff(key, prepend=key[:1] - 1, append=key[-1:] + 1))
            for a, z in zip(edge, edge[1:]):
                if now is not None and key[a] != now:
                    yield shard.spans(find)
                    shard = Shard(view)
                now = key[a]
                shard.add(b.slice(a, z - a))
        if now is not None:
            yield shard.spans(find)

    windows = stash(contents.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, "did long, rid long, start long, end long"), "windows")
    drop_stash(contents)
    return resolved.where(F.col("kind") == SPAN).select("did", "rid", "start", "end").union(windows)


def with_spans(docs: DataFrame, spans: DataFrame, carry: bool = False) -> DataFrame:
    """``(did, rid, text, spans)``: every row's text with the spans of its document, if any."""
    per = spans.groupBy("did", "rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return doc_keys(docs, carry).join(per.hint("merge"), ["did", "rid"], "left")


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Union of spans, in order; adjacent ones join."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
