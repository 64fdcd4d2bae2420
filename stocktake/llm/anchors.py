"""Anchored segments: where equal windows of a corpus can be, found by minimizers.

Every window of ``length`` symbols picks the smallest of its hashed ``gram``-symbol
substrings (the leftmost of equals). Equal windows pick the same substring at the
same place in them, so they can only be found in segments with equal anchors; a
segment is the run of consecutive windows of one document that picked the same
place. A window is in exactly one segment. This only screens: which windows are
equal is for the index that is built over the segments.

Segments also get a digest of all their symbols, from sums of ``symbol * root^place``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Symbols that are worked on at once, so that array memory is bounded; longer documents go in overlapping parts.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of ``gram`` symbols, by doubling."""
    out, size, have = None, 0, h
    step, base = 1, np.full(1, 0x9E3779B97F4A7C15, U)
    while gram:
        if gram & 1:
            if out is None:
                out, size = have, step
            else:
                n = len(have) - size
                out = out[:n] * base + have[size : size + n]
                size += step
        gram >>= 1
        if gram:
            n = len(have) - step
            have = have[:n] * base + have[step:]
            base = np.multiply(base, base)
            step *= 2
    return mix(out)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


_ROOTS = (0xD1342543DE82EF95, 0x9FB21C651E98DF25)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(root: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``root`` and of its inverse."""
    if root not in _powers or len(_powers[root][0]) < n:
        up, down = np.full(n, root, U), np.full(n, pow(root, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[root] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[root]


class Spans:
    """Hashes of spans of symbols, from sums of ``symbol * root^place``."""

    def __init__(self, h: np.ndarray, root: int = _ROOTS[0]):
        up, self.down = powers(root, 1 << max(16, len(h).bit_length()))
        self.sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


#: The low bits of a hash, which make room for a place; the same for all texts, so that equal windows pick the same substring.
_LOW = U(2 * CHUNK - 1)


def _minimizers(h: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For every window: its document, its start in ``h``, and the place and hash of its least substring."""
    n = len(h)
    doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    g = gram_hashes(h, gram)
    place = window_minima((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & _LOW
    at = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    return doc, at, place[at].astype(np.int64), g


def segments(h: np.ndarray, starts: np.ndarray, length: int, gram: int, heavy: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """``(document, start, end, anchor, digest)`` of all segments of documents that lie one after the other in ``h``.

    ``starts``: where each document begins, and where the last one ends; start and end count from there.
    Segments whose anchor is among ``heavy`` (sorted) come as their single windows, each with its own hash as the anchor.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    if len(h) < length:
        return none
    doc, at, place, g = _minimizers(h, starts, length, gram)
    if not len(at):
        return none
    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 0)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(at)]]) - 1
    # the least of many hashes lies near zero: hashed again, anchors are even
    anchor = mix(g[place[first]] + U(0x632BE59BD9B4E019))
    begin, end = at[first], at[last] + length
    if heavy is not None and len(heavy):
        hot = heavy[np.minimum(np.searchsorted(heavy, anchor), len(heavy) - 1)] == anchor
        if hot.any():
            single = at[np.repeat(hot, last - first + 1)]
            begin, end = np.concatenate([begin[~hot], single]), np.concatenate([end[~hot], single + length])
            anchor = np.concatenate([anchor[~hot], mix(Spans(h, _ROOTS[1]).hashes(single, single + length))])
    owner = doc[begin]
    base = starts[owner]
    digest = Spans(h).hashes(begin, end) + (end - begin).astype(U) * U(0x8EBC6AF09C88C6E3)
    return owner.astype(np.int64), begin - base, end - base, anchor, digest


#: In how many spans the place of a window around its anchor is bounded.
CONTEXTS = 8


def context_hashes(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each segment in ``h`` hashes of ``CONTEXTS`` parts around its anchor, a row each.

    Equal windows agree in the symbols before their anchor, as many as it lies behind their start, and in the
    rest after it. Where that lies between two bounds, they agree in the smaller number before and the smaller
    rest after it: one of the parts is equal. 0 stands for a part that is not within the segment.
    """
    rest = length - gram
    step = -(-(rest + 1) // CONTEXTS)
    ends = starts + sizes
    g = gram_hashes(h, gram) & ~_LOW
    anchor = starts + np.argmin(g[starts[:, None] + np.arange(rest + 1)], axis=1)
    spans, out = Spans(h), []
    for low in range(0, rest + 1, step):
        a, b = anchor - low, anchor + gram + rest - min(rest, low + step - 1)
        fits = (a >= starts) & (b <= ends)
        x = np.zeros(len(a), U)
        x[fits] = mix(spans.hashes(a[fits], b[fits]) + U(low)) | U(1)
        out.append(x)
    return np.stack(out)


def pieces(sizes: list[int], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Group documents of these sizes into lists of ``(document, from, to)`` of about ``CHUNK`` symbols.

    The windows of a long document are split over parts that overlap by ``length - 1``.
    """
    held, size = [], 0
    for i, n in enumerate(sizes):
        a = 0
        while True:
            b = min(n, a + CHUNK)
            if held and size + b - a > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, a, b))
            size += b - a
            if b == n:
                break
            a = b - (length - 1)
    if held:
        yield held
