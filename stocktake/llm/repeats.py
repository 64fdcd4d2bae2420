"""Two Bloom filters, once-seen and twice-seen, over 64-bit hashes of a whole corpus.

Tasks reduce their hashes to distinct ones and deal those by hash range, each with
the document it is from. A range runs the two filters over what arrives: a hash that
the once-seen filter knows, or that a task has met twice, goes into the twice-seen
filter, others into the once-seen one. Then the range's hashes are held against the
twice-seen filter, and those that it may know are suspects. So a range has its own
pair of filters, of a size that fits its hashes, whatever the corpus; nothing is
gathered or broadcast. A hash that occurs twice is never missed; what passes wrongly
is left for the exact step behind.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Hashes in a range, about, and bits a hash of each filter.
RANGE_HASHES, BITS = 1 << 18, 8
PROBES = 3
#: Hashes that a task gathers before it deals them.
FLUSH = 1 << 20
_PACK = np.dtype([("hash", "<u8"), ("did", "<i8"), ("rid", "<i8"), ("again", "?")])


class Bloom:
    def __init__(self, bits: int):
        self.mask = np.uint64((1 << max(6, math.ceil(math.log2(max(1, bits))))) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)

    def _places(self, h: np.ndarray) -> np.ndarray:
        g = h * np.uint64(0x9E3779B97F4A7C15)
        step = (g >> np.uint64(40)) | np.uint64(1)
        return np.stack([(((g >> np.uint64(7)) + np.uint64(i) * step) & self.mask).astype(np.int64) for i in range(PROBES)])

    def add(self, h: np.ndarray) -> None:
        at = self._places(h).ravel()
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        at = self._places(h)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0).astype(bool)


def twice_seen(blocks: list[np.ndarray]) -> np.ndarray:
    """Which rows of the packed ``blocks``, each without repeats in itself, may have a hash that occurs twice."""
    n = sum(len(b) for b in blocks)
    once, twice = Bloom(BITS * n), Bloom(BITS * n)
    for b in blocks:
        seen = once.maybe(b["hash"]) | b["again"]
        twice.add(b["hash"][seen])
        once.add(b["hash"])
    rows = np.concatenate(blocks)
    return rows[twice.maybe(rows["hash"])]


def _suspects(x: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(x[c]).view(np.int64)) for c in ("did", "rid", "hash")]


def suspects(keyed: DataFrame, hashes: Callable[[str], np.ndarray], expected: int) -> DataFrame:
    """``(did, rid, hash)``: every row of ``keyed(did, rid, text)`` with those of its distinct ``hashes`` that may occur in others too.

    ``expected``: about how many hashes there are.
    """
    log_ranges = max(0, math.ceil(math.log2(max(1, expected) / RANGE_HASHES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            x = x[np.argsort(x["hash"], kind="stable")]
            first = np.append(True, x["hash"][1:] != x["hash"][:-1])
            # met twice here: suspects already; the first of them also tells the range
            more = x[~first]
            part = -1 - (more["rid"] >> 3 & 0xFFF)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(more), pa.binary()), *_suspects(more)], names)
            run = np.diff(np.append(np.flatnonzero(first), len(x)))
            x = x[first]
            x["again"] = run > 1
            part = (x["hash"] >> np.uint64(64 - log_ranges)).astype(np.int64) if log_ranges else np.zeros(len(x), np.int64)
            edge = np.flatnonzero(np.diff(part, prepend=-1, append=1 << 62))
            gone = pa.nulls(len(edge) - 1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array([x[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()), gone, gone, gone], names)

        for b in batches:
            did, rid = b["did"].to_numpy(), b["rid"].to_numpy()
            for i, t in enumerate(b["text"].to_pylist()):
                h = hashes(t)
                x = np.zeros(len(h), _PACK)
                x["hash"], x["did"], x["rid"] = h, did[i], rid[i]
                held.append(x)
                size += len(x)
                if size > FLUSH:
                    yield from flush()
                    held.clear()
                    size = 0
        if size:
            yield from flush()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            part = b["part"].to_numpy()
            n = int(np.searchsorted(part, 0))
            if n:
                yield pa.RecordBatch.from_arrays([b[c].slice(0, n) for c in names[2:]], names[2:])
            for i in range(n, len(part)):
                if held and part[i] != now:
                    yield pa.RecordBatch.from_arrays(_suspects(twice_seen(held)), names[2:])
                    held = []
                now = part[i]
                held.append(np.frombuffer(b["blob"][i].as_buffer(), _PACK))
        if held:
            yield pa.RecordBatch.from_arrays(_suspects(twice_seen(held)), names[2:])

    names = ["part", "blob", "did", "rid", "hash"]
    dealt = keyed.select("did", "rid", "text").mapInArrow(deal, "part long, blob binary, did long, rid long, hash long")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(judge, "did long, rid long, hash long")
