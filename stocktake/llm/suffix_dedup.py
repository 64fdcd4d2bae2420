"""Suffix-array dedup: remove text that is covered by a long string which starts earlier as well.

Repeated text is found over whole documents as bytes; a suffix array with
common-prefix values, built by external induced sorting (``suffix``), groups the
windows of a shard, and all but the earliest of a group are removed. The text of a
shard, the sorter's arrays and the least places of the groups go to files beyond
``suffix.MEMORY``; what is held besides is a few numbers a segment.

Defined results: null texts are empty; texts shorter than the window lose
nothing; rows that repeat an id with another text are documents of their own
(ordered by a hash of the text), rows that repeat both are one document and get
the same result; a null id is the smallest; other columns are not read. Matches
never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stocktake.llm.common import public_id, table, text_bytes, with_row
from stocktake.llm.passages import ByteView, covered_spans, merged, with_spans
from stocktake.llm.suffix import MEMORY, blocks, induced_sort, scratch

LENGTH = 100
GRAM = 40


def repeated_windows(raw: np.ndarray, sizes: np.ndarray, places: np.ndarray, length: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Segments and offsets of windows of ``length`` bytes that occur at a smaller place too.

    ``raw``: the bytes of all segments one after the other, of ``sizes``; ``places`` of their first bytes.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(sizes):
        return none
    ends = np.cumsum(sizes)
    starts = ends - sizes + np.arange(len(sizes))  # in the text, with a symbol between segments
    n = int(ends[-1]) + len(sizes)
    t = scratch(n + 1, np.int16, memory)
    for a, b in blocks(len(raw), memory):
        at = np.arange(a, b)
        t[at + np.searchsorted(ends, at, "right")] = raw[a:b].astype(np.int16) + 2
    t[starts + sizes] = 1
    owner = scratch(n + 1, np.int32, memory)
    for a in range(0, len(sizes), 10_000):
        own = np.repeat(np.arange(a, min(a + 10_000, len(sizes))), sizes[a : a + 10_000] + 1)
        owner[starts[a] : starts[a] + len(own)] = own
    sa, lcp = induced_sort(t, 258, length, memory)
    del t

    def windows(a: int, b: int) -> tuple[np.ndarray, ...]:
        """Of the ranks from ``a`` to ``b``: which are whole windows, their segments, offsets and groups."""
        own = np.asarray(sa[a:b])
        which = owner[own]
        offset = own - starts[which]
        group = np.cumsum(lcp[a:b] < length)  # windows with the same first ``length`` bytes are neighbours
        fine = offset + length <= sizes[which]
        return which[fine], offset[fine], group[fine] + groups, int(group[-1])

    groups = 0
    least = scratch(n + 2, np.int64, memory)
    for a, b in blocks(n + 1, memory):
        least[a:b] = np.iinfo(np.int64).max
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for mark in (True, False):
        groups = 0
        for a, b in blocks(n + 1, memory, 1):  # rank 0 is the end of the text
            which, offset, group, more = windows(a, b)
            at = places[which] + offset
            if mark and len(at):
                first = np.flatnonzero(np.diff(group, prepend=-1))
                low = np.minimum.reduceat(at, first)
                own = group[first]
                least[own] = np.minimum(least[own], low)
            elif not mark:
                later = at > least[group]
                found.append((which[later], offset[later]))
            groups += more
    return tuple(np.concatenate([none[0], *x]) for x in zip(*found)) if found else none


def removed_spans(docs: DataFrame, length: int = LENGTH, carry: bool = False) -> DataFrame:
    """``(did, rid, text, spans)``."""
    gram = max(4, min(GRAM, length // 2))
    size = text_bytes(docs)
    spans = covered_spans(docs, ByteView(length, gram), lambda raw, sizes, places: repeated_windows(raw, sizes, places, length), 2 * size // (length - gram + 2))
    return with_spans(docs, spans, carry)


def cut_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they cut."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, carry: bool = False) -> DataFrame:
    """``(did, rid, doc_id, text, n_bytes, n_removed, n_spans, kept_sha256)``, and ``row`` with ``carry``.

    The digest and the counts are of bytes; ``text`` also keeps the characters that a span cuts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for t, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                raw, spans = t.encode("utf-8", "surrogatepass"), merged(spans)
                left = cut_bytes(raw, spans) if spans else raw
                text = cut_bytes(raw, whole_characters(raw, spans)).decode("utf-8", "replace") if spans else t
                for o, x in zip(out, (text, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest())):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b["did"], b["rid"], pa.array(out[0], pa.string()), *(pa.array(o, pa.int64()) for o in out[1:4]), pa.array(out[4], pa.string()), *([b["row"]] if carry else [])], ["did", "rid", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["row"] * carry])

    found = removed_spans(docs, length, carry)
    schema = with_row("did long, rid long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string", found)
    cut = found.select("did", "rid", "text", "spans", *["row"] * carry).mapInArrow(run, schema)
    return cut.select("did", "rid", public_id().alias("doc_id"), "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["row"] * carry)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
