"""Substring dedup over words: a compressed FM-index per shard gives matching statistics.

The index of a shard is the Burrows-Wheeler transform of its texts as word numbers,
in a wavelet tree of packed bit vectors with rank counts; two packed bit vectors say
where neighbouring suffixes share fewer words than the threshold, and one word fewer;
a sample of the suffix array, every ``RATE``-th place of the text, gives places. No
array with a number a symbol is kept. Documents' segments are streamed against it in
batches, from their last word to their first, all of a batch abreast: the interval of
the current match is extended to the left by one word (backward search) and, once it
is as long as the threshold, shortened on the right by one word, to the interval that
shares one word fewer. A window whose interval holds more than one suffix is reported;
its suffixes are located by walking to sampled places, and all but the earliest of
them lose their words.

Defined results: null texts have no words; texts shorter than the window lose
nothing; rows that repeat an id with another text are documents of their own
(ordered by a hash of the text), rows that repeat both are one document and get
the same result; a null id is the smallest; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from stocktake.llm.common import public_id, table, text_bytes
from stocktake.llm.passages import WordView, covered_spans, merged, with_spans
from stocktake.llm.suffix import MEMORY, blocks, induced_sort, scratch

LENGTH = 20
GRAM = 12
#: Every so many places of the text are sampled.
RATE = 8
#: Words of segments that are streamed at once, about, and suffixes that are located at once.
BATCH, LOCATED = 1 << 17, 1 << 18


class Bits:
    """A packed bit vector with rank and select."""

    def __init__(self, bit: np.ndarray):
        packed = np.packbits(bit.astype(np.bool_), bitorder="little")
        self.words = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)
        self.total = int(np.count_nonzero(bit))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` bits are set."""
        w = i >> 6
        return self.counts[w].astype(np.int64) + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the ``k``-th set bit is, from 0."""
        w = np.searchsorted(self.counts, k, "right") - 1
        left, word, at = k - self.counts[w], self.words[w], w.astype(np.int64) << 6
        for half in (32, 16, 8, 4, 2, 1):  # down to the bit, by counts of the lower half
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left, at = np.where(up, left - low, left), np.where(up, at + half, at)
            word = np.where(up, word >> np.uint64(half), word)
        return at


class WaveletTree:
    """Rank queries over a sequence of numbers: a packed bit vector a level, by bits from the highest."""

    def __init__(self, sequence: np.ndarray, alphabet: int):
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        s = sequence
        for level in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bit = ((s >> level) & 1).astype(np.bool_)
            self.levels.append(Bits(bit))
            self.zeros.append(len(s) - self.levels[-1].total)
            s = np.concatenate([s[~bit], s[bit]])
        self.base = self._walk(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        top = len(self.levels) - 1
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where((symbol >> (top - k)) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` are ``symbol``."""
        return self._walk(symbol, i) - self.base[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``i``-th symbol, and how many like it come before."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, ones = bits.get(i), bits.rank(i)
            symbol = 2 * symbol + one
            i = np.where(one == 1, zeros + ones, i - ones)
        return symbol, i - self.base[symbol]


class FmIndex:
    """Of a text of numbers below ``alphabet`` that ends with its only 0, for matches of up to ``length`` symbols."""

    def __init__(self, t: np.ndarray, alphabet: int, length: int, memory: int = MEMORY):
        self.size = n = len(t)
        sa, lcp = induced_sort(t, alphabet, length, memory)
        transform = scratch(n, np.int32, memory)
        counts = np.zeros(alphabet, np.int64)
        for a, b in blocks(n, memory):
            transform[a:b] = t[sa[a:b] - 1]
            counts += np.bincount(t[a:b], minlength=alphabet)
        self.tree = WaveletTree(transform, alphabet)
        self.first = np.cumsum(counts) - counts
        self.apart = Bits(lcp < length - 1)
        self.sampled = Bits(sa % RATE == 0)
        self.places = np.asarray(sa[sa % RATE == 0])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of ``symbol`` followed by what the intervals hold."""
        base = self.first[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that share one symbol fewer than the threshold with those at ``low``."""
        k = self.apart.rank(low + 1)
        end = np.full(len(k), self.size, np.int64)
        more = k < self.apart.total
        end[more] = self.apart.select(k[more])
        return self.apart.select(k - 1), end

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Where the suffixes at these ranks start: steps back to a sampled place are counted."""
        out = np.zeros(len(row), np.int64)
        live, at = np.arange(len(row)), row
        for step in range(RATE):
            here = self.sampled.get(at) == 1
            out[live[here]] = self.places[self.sampled.rank(at[here])] + step
            live, at = live[~here], at[~here]
            if not len(live):
                break
            symbol, rank = self.tree.symbol_and_rank(at)
            at = self.first[symbol] + rank
        return out


def repeated_windows(raw: np.ndarray, sizes: np.ndarray, places: np.ndarray, length: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Segments and offsets of windows of ``length`` words that occur at a smaller place too.

    ``raw``: the segments one after the other, of ``sizes`` bytes, words joined by one space; ``places`` of their first words.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(sizes):
        return none
    ends = np.cumsum(sizes)

    def segments(a: int, b: int) -> list[list[bytes]]:
        part = raw[ends[a] - sizes[a] : ends[b - 1]].tobytes()
        edge = (ends[a:b] - (ends[a] - sizes[a])).tolist()
        return [part[x:y].split(b" ") for x, y in zip([0, *edge], edge)]

    # rare words get small numbers, equally rare ones in no order of the text: the sorter's batches end where a successor comes soon after
    counted: Counter[bytes] = Counter()
    count = np.zeros(len(sizes), np.int64)
    for a in range(0, len(sizes), 5000):
        for i, words in enumerate(segments(a, min(a + 5000, len(sizes))), a):
            counted.update(words)
            count[i] = len(words)
    number = {w: i for i, w in enumerate(sorted(counted, key=lambda w: (counted[w], xxhash.xxh3_64_intdigest(w))), 2)}
    starts = np.cumsum(count + 1) - count - 1
    t = scratch(int(count.sum()) + len(count) + 1, np.int32, memory)
    for a in range(0, len(sizes), 5000):
        ids: list[int] = []
        for words in segments(a, min(a + 5000, len(sizes))):
            ids += [number[w] for w in words]
            ids.append(1)
        t[starts[a] : starts[a] + len(ids)] = ids
    index = FmIndex(t, len(number) + 2, length, memory)
    # segments are streamed in batches, those of a batch abreast, right to left
    seen: tuple[list, ...] = ([], [], [], [])
    cuts = np.flatnonzero(np.diff(np.cumsum(count) // BATCH, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(count)]):
        order = a + np.argsort(-count[a:b], kind="stable")
        low, high = np.zeros(len(order), np.int64), np.full(len(order), index.size, np.int64)
        for step in range(int(count[order[0]])):
            k = int(np.searchsorted(-count[order], -step, "left"))  # those with more words than steps
            live, x, y = order[:k], low[:k], high[:k]
            if step >= length:
                x, y = index.shorten(x)
            here = count[live] - 1 - step
            low[:k], high[:k] = index.extend(t[starts[live] + here].astype(np.int64), x, y)
            if step >= length - 1:
                more = high[:k] - low[:k] > 1
                for s, v in zip(seen, (live[more], here[more], low[:k][more], high[:k][more])):
                    s.append(v)
    which, offset, low, high = (np.concatenate([none[0], *s]) for s in seen)
    # the earliest place of each reported interval
    rows, at = np.unique(low, return_inverse=True)
    width = np.zeros(len(rows), np.int64)
    width[at] = high - low
    least = np.full(len(rows), np.iinfo(np.int64).max)
    edge = np.cumsum(width)
    for lo in range(0, int(width.sum()), LOCATED):
        j = np.arange(lo, min(lo + LOCATED, int(edge[-1])))
        own = np.searchsorted(edge, j, "right")
        p = index.locate(rows[own] + j - (edge[own] - width[own]))
        segment = np.searchsorted(starts, p, "right") - 1
        np.minimum.at(least, own, places[segment] + p - starts[segment])
    later = places[which] + offset > least[at]
    return which[later], offset[later]


def fm_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(did, rid, doc_id, kept, n_words, n_removed, kept_sha256)``: ``kept`` are the words left, joined by one space."""
    gram = max(1, min(GRAM, length - length // 3))
    size = text_bytes(docs)
    spans = covered_spans(docs, WordView(length, gram), lambda raw, sizes, places: repeated_windows(raw, sizes, places, length), size // 6 * 2 // (length - gram + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for t, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                words = t.encode("utf-8", "surrogatepass").split()
                n = len(words)
                for a, z in reversed(merged(spans)):
                    del words[a:z]
                left = b" ".join(words)
                for o, x in zip(out, (left.decode("utf-8", "replace"), n, n - len(words), hashlib.sha256(left).hexdigest())):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b["did"], b["rid"], pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["did", "rid", "kept", "n_words", "n_removed", "kept_sha256"])

    cut = with_spans(docs, spans).select("did", "rid", "text", "spans").mapInArrow(run, "did long, rid long, kept string, n_words long, n_removed long, kept_sha256 string")
    return cut.select("did", "rid", public_id().alias("doc_id"), "kept", "n_words", "n_removed", "kept_sha256")


def op3_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
