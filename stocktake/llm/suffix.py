"""External induced suffix sorting with common-prefix values.

Suffixes that begin a rise (S*) are sorted first: their substrings are named, and
the names are sorted by the same procedure when they repeat (the recursion). Two
scans then induce all others: a priority queue, keyed by symbol and by the rank
of the suffix that induced an entry, hands out suffix tuples in order, in batches
whose successors cannot come before the batch's end, and takes their predecessors
in. Each tuple's common prefix with the one before it is carried along: one more
than the least value between the two inducing suffixes. Values are cut at ``cap``.

Everything with a value a symbol or a suffix is a ``scratch`` array: types, names,
orders, seeds, tables and results, in memory up to ``memory`` bytes each and in a
mapped file beyond. All steps work on them in blocks; names are sorted by dealing
them to parts that fit; the queue's waiting parts, and the rest of a part that is
all one symbol, lie in files. So what a process holds itself is a small multiple of
``memory``, whatever the length of the text (``test_sorts_beyond_memory``).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of one array, or of the waiting queue, beyond which files are used.
MEMORY = 64 << 20
_FAR = np.iinfo(np.int64).max


def scratch(shape: tuple[int, ...] | int, dtype: type, memory: int) -> np.ndarray:
    size = int(np.prod(shape)) * np.dtype(dtype).itemsize
    if size <= memory:
        return np.zeros(shape, dtype)
    with tempfile.TemporaryFile() as f:  # the mapping outlives the name
        f.truncate(max(size, 1))
        return np.memmap(f, dtype, "r+", shape=shape)


def blocks(n: int, memory: int, start: int = 0) -> Iterator[tuple[int, int]]:
    """``start`` to ``n`` in steps that a few arrays of 64-bit numbers fit ``memory`` for."""
    step = max(1024, memory // 32)
    for a in range(start, n, step):
        yield a, min(n, a + step)


class TupleQueue:
    """A priority queue of ``(key, rank, place)`` in parts by key; parts wait in files beyond ``memory``.

    Entries of a key must arrive in the order of their ranks. A part is a run of keys with few entries,
    or one key; that one is handed out piece by piece, as its entries are in order already.
    """

    def __init__(self, key_counts: np.ndarray, parts: int, memory: int):
        total = 0
        for a, b in blocks(len(key_counts), memory):
            total += int(key_counts[a:b].sum())
        size = max(1, -(-total // parts))
        first, held = [0], 0
        for a, b in blocks(len(key_counts), memory):
            counts = key_counts[a:b]
            edge = np.cumsum(counts)
            at = 0
            while at < len(counts):
                before = int(edge[at - 1]) if at else 0
                # the next key that would fill the part
                k = int(np.searchsorted(edge, before + size - held, "left"))
                if k >= len(counts):
                    held += int(edge[-1]) - before
                    break
                if a + k > first[-1] and int(counts[k]) > size:
                    first.append(a + k)  # a part of its own
                first.append(a + k + 1)
                at, held = k + 1, 0
        self.first = np.array(first, np.int64)
        self.parts = len(first)
        self.single = np.append(np.diff(self.first) == 1, False)
        self.waiting: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(self.parts)]
        self.files: list = [None] * self.parts
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.fresh_size = 0
        self.now = -1
        self.held, self.memory = 0, memory
        self.key = self.rank = self.place = np.zeros(0, np.int64)
        self.read = 0

    def push(self, key: np.ndarray, rank: np.ndarray, place: np.ndarray) -> None:
        if self.now >= 0 and not self.single[self.now]:
            end = self.first[self.now + 1] if self.now + 1 < self.parts else _FAR
            here = key < end
            if here.any():
                k = np.concatenate([self.key, key[here]])
                order = np.argsort(k, kind="stable")
                self.key = k[order]
                self.rank = np.concatenate([self.rank, rank[here]])[order]
                self.place = np.concatenate([self.place, place[here]])[order]
                key, rank, place = key[~here], rank[~here], place[~here]
        if len(key):
            self.fresh.append((key, rank, place))
            self.fresh_size += 24 * len(key)
            if self.fresh_size > self.memory:
                self._deal()

    def _deal(self) -> None:
        if not self.fresh:
            return
        key, rank, place = (np.concatenate(x) for x in zip(*self.fresh))
        self.fresh, self.fresh_size = [], 0
        part = (np.searchsorted(self.first, key, "right") - 1).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, key, rank, place = part[order], key[order], rank[order], place[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(part)]):
            self.waiting[part[a]].append((key[a:b], rank[a:b], place[a:b]))
        self.held += 24 * len(key)
        if self.held > self.memory:
            for i in range(max(self.now, 0), self.parts):
                if self.waiting[i]:
                    self.files[i] = self.files[i] or tempfile.TemporaryFile()
                    self.files[i].seek(0, 2)
                    for entry in self.waiting[i]:
                        np.stack(entry, axis=1).tofile(self.files[i])
                    self.waiting[i] = []
            self.held = 0

    def _load(self) -> bool:
        """The entries of the current part, or its next piece."""
        entries: list[tuple[np.ndarray, ...]] = []
        if f := self.files[self.now]:
            f.seek(self.read)
            most = max(1024, self.memory // 96) * 3 if self.single[self.now] else -1
            got = np.fromfile(f, np.int64, most).reshape(-1, 3)
            self.read += got.nbytes
            if len(got):
                entries = [tuple(got.T)]
            if not len(got) or not self.single[self.now]:
                f.close()
                self.files[self.now], self.read = None, 0
        if not self.files[self.now]:
            more, self.waiting[self.now] = self.waiting[self.now], []
            self.held -= min(self.held, 24 * sum(len(e[0]) for e in more))
            entries += more
        if not entries:
            return False
        self.key, self.rank, self.place = (np.concatenate(x) for x in zip(*entries))
        if not self.single[self.now]:
            order = np.argsort(self.key - self.key.min(), kind="stable")
            self.key, self.rank, self.place = self.key[order], self.rank[order], self.place[order]
        return True

    def advance(self) -> bool:
        """Go to the next entries: of this part, if it has more, or of the next one that has any."""
        self._deal()
        if self.now >= 0 and self.single[self.now] and self._load():
            return True
        while self.now + 1 < self.parts:
            self.now += 1
            self.read = 0
            if self._load():
                return True
        return False


class _Text:
    """Symbols and types of a text, and the runs up to the next symbol that differs."""

    def __init__(self, t: np.ndarray, cap: int, memory: int):
        n = len(t)
        self.t = t
        self.rising = scratch(n, np.bool_, memory)
        self.run = scratch(n, np.uint8, memory)
        after, up = n - 1, True  # of the position behind the block: where its run ends, and whether it rises
        for a, b in reversed(list(blocks(n, memory))):
            x = np.asarray(t[a : min(b + 1, n)])
            m = b - a
            differs = np.flatnonzero(x[1:] != x[:-1])
            at = np.searchsorted(differs, np.arange(m))
            inside = at < len(differs)
            step = np.full(m, after, np.int64)
            rises = np.full(m, up)
            if len(differs):
                hit = differs[np.minimum(at, len(differs) - 1)]
                step[inside] = a + hit[inside]
                rises[inside] = (x[1:] > x[:-1])[hit[inside]]
            self.rising[a:b] = rises
            self.run[a:b] = np.minimum(step - np.arange(a, b) + 1, cap)
            after, up = int(step[0]), bool(rises[0])

    def stars(self, memory: int) -> np.ndarray:
        """Where a rise begins behind a fall."""
        n = len(self.t)
        count = 0
        for fill in (False, True):
            if fill:
                out = scratch(count, np.int64, memory)
                count = 0
            for a, b in blocks(n, memory, 1):
                own = np.flatnonzero(self.rising[a:b] & ~self.rising[a - 1 : b - 1]) + a
                if fill:
                    out[count : count + len(own)] = own
                count += len(own)
        return out


def _induce(text: _Text, up: bool, alphabet: int, seeds: np.ndarray, seed_lcp: np.ndarray, cap: int, memory: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One scan: ``(places, lcp, is seed)`` of the seeds and of all suffixes that they induce, in order.

    ``up``: falling suffixes from rising seeds, in rising order of the symbol; else rising ones from
    falling seeds, in falling order. An induced suffix comes before the seeds of its symbol.
    """
    t, rising, run, n = text.t, text.rising, text.run, len(text.t)

    def key_of(place: np.ndarray) -> np.ndarray:
        s = t[place].astype(np.int64)
        return 2 * (s if up else alphabet - 1 - s)

    counts = scratch(2 * alphabet, np.int64, memory)

    def count(keys: np.ndarray) -> None:
        if alphabet <= 1 << 16:
            counts[:] += np.bincount(keys, minlength=2 * alphabet)
        else:
            k, c = np.unique(keys, return_counts=True)
            counts[k] += c

    n_wanted = 0
    for a, b in blocks(n - 1, memory):
        own = np.flatnonzero(rising[a:b] != up) + a
        n_wanted += len(own)
        count(key_of(own))
    for a, b in blocks(len(seeds), memory):
        count(key_of(seeds[a:b]) + 1)
    total = n_wanted + len(seeds)
    queue = TupleQueue(counts, 64 if alphabet > 1024 else 512, memory)
    for a, b in blocks(len(seeds), memory):
        queue.push(key_of(seeds[a:b]) + 1, -1 - seed_lcp[a:b].astype(np.int64), np.array(seeds[a:b], np.int64))
    levels = max(1, int(total).bit_length())
    least = [scratch(total, np.uint8, memory // 4) for _ in range(levels)]  # least[k][i]: least common prefix among the 2^k entries up to i
    places = scratch(total, np.int64, memory)
    seeded = scratch(total, np.bool_, memory)
    m, size, done = 0, 4096, 0
    most = max(256, min(1 << 16, memory // 256))
    last_key, last_rank, last_place = -1, 0, 0
    while queue.advance():
        while len(queue.key):
            key, rank, place = queue.key[:size], queue.rank[:size], queue.place[:size]
            before = place - 1
            ok = (before >= 0) & (rising[before] != up)
            made = np.where(ok, key_of(before), _FAR)
            # up to the first entry that must wait for a successor of an earlier one
            if len(key) > 1:
                late = key[1:] > np.minimum.accumulate(made[:-1])
                k = int(np.argmax(late)) + 1 if late.any() else len(key)
            else:
                k = len(key)
            size = max(256, min(most, 2 * k if k < len(key) else 2 * size))
            key, rank, place, ok, made, before = key[:k], rank[:k], place[:k], ok[:k], made[:k], before[:k]
            queue.key, queue.rank, queue.place = queue.key[k:], queue.rank[k:], queue.place[k:]
            # common prefixes with the entry before
            k0 = np.concatenate([[last_key], key[:-1]])
            r0 = np.concatenate([[last_rank], rank[:-1]])
            p0 = np.concatenate([[last_place], place[:-1]])
            lcp = np.zeros(k, np.int64)
            seed = rank < 0
            twin = seed & (k0 == key)
            lcp[twin] = -1 - rank[twin]
            seam = seed & (k0 == key - 1)
            lcp[seam] = np.minimum(run[p0[seam]], run[place[seam]])
            pair = ~seed & (k0 == key)
            if pair.any():
                a, b = r0[pair] + 1, rank[pair]
                if int(b.max()) >= done:  # tables follow the sequence when they are asked
                    for j in range(1, min(levels, m.bit_length())):
                        half = 1 << (j - 1)
                        lo = max(done, half)
                        np.minimum(least[j - 1][lo:m], least[j - 1][lo - half : m - half], out=least[j][lo:m])
                    done = m
                level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
                got = np.empty(len(a), np.int64)
                for j in np.flatnonzero(np.bincount(level)).tolist():
                    own = level == j
                    got[own] = np.minimum(least[j][b[own]], least[j][a[own] + (1 << j) - 1])
                lcp[pair] = 1 + got
            np.minimum(lcp, cap, out=lcp)
            least[0][m : m + k] = lcp
            places[m : m + k] = place
            seeded[m : m + k] = seed
            last_key, last_rank, last_place = int(key[-1]), int(rank[-1]), int(place[-1])
            if ok.any():
                at = np.flatnonzero(ok)
                queue.push(made[at], m + at, before[at])
            m += k
    return places[:m], least[0][:m], seeded[:m]


def stable_order(keys: list[np.ndarray], at: np.ndarray, memory: int) -> None:
    """Sort the numbers ``at`` in place by ``keys[0][at]``, then ``keys[1][at]`` and so on; equal ones stay in order."""
    m = len(at)
    if m * 8 * (len(keys) + 3) <= memory or m <= 1024:
        own = np.array(at)
        at[:] = own[np.lexsort([k[own] for k in reversed(keys)])]
        return
    # a sample's distinct keys cut the range: parts between them, and parts of a single key
    sample = np.array(keys[0][at[:: max(1, m // 4096)]])
    cuts = np.unique(sample[:: max(1, len(sample) // 64)])

    def part_of(a: int, b: int) -> np.ndarray:
        x = keys[0][at[a:b]]
        return np.searchsorted(cuts, x, "left") + np.searchsorted(cuts, x, "right")

    sizes = np.zeros(2 * len(cuts) + 1, np.int64)
    for a, b in blocks(m, memory):
        sizes += np.bincount(part_of(a, b), minlength=len(sizes))
    edge = np.append(0, np.cumsum(sizes))
    fill, out = edge[:-1].copy(), scratch(m, np.int64, memory)
    for a, b in blocks(m, memory):
        part = part_of(a, b)
        order = np.argsort(part, kind="stable")
        n = np.bincount(part, minlength=len(sizes))
        own = np.repeat(fill - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(b - a)
        out[own] = at[a:b][order]
        fill += n
    for a, b in blocks(m, memory):
        at[a:b] = out[a:b]
    del out
    for i, (a, b) in enumerate(zip(edge, edge[1:])):
        if b - a < 2:
            continue
        if i % 2 == 0:
            stable_order(keys, at[a:b], memory)
        elif len(keys) > 1:
            stable_order(keys[1:], at[a:b], memory)


def _name(text: _Text, star: np.ndarray, bits: int, memory: int) -> tuple[np.ndarray, int]:
    """Dense ranks of the substrings between neighbouring ``star``s, by chunks of packed symbols from the last to the first."""
    t, rising, n, m = text.t, text.rising, len(text.t), len(star)
    per = max(1, 62 // bits)
    names = scratch(m, np.int64, memory)
    packed = scratch(m, np.int64, memory)

    def sizes(a: int, b: int) -> np.ndarray:
        ends = np.append(star[a + 1 : min(b + 1, m)], [star[m - 1]] if b == m else [])
        return (ends - star[a:b] + 1).astype(np.int64)

    longest = max(int(sizes(a, b).max()) for a, b in blocks(m, memory))
    most = 0
    for c in range((longest - 1) // per, -1, -1):
        count = 0
        for fill in (False, True):
            if fill:
                at = scratch(count, np.int64, memory)
                count = 0
            for a, b in blocks(m, memory):
                size = sizes(a, b)
                own = np.flatnonzero(size > c * per)
                if fill:
                    at[count : count + len(own)] = own + a
                    x = np.zeros(len(own), np.int64)
                    first, size = np.asarray(star[a:b])[own], size[own]
                    for j in range(per):
                        i = c * per + j
                        where = np.minimum(first + i, n - 1)
                        x = (x << bits) | np.where(i < size, 2 * t[where].astype(np.int64) + rising[where], 0)
                    packed[own + a] = x
                count += len(own)
        stable_order([packed, names] if most else [packed], at, memory)
        most, p0, r0 = 0, -1, -1
        for a, b in blocks(count, memory):
            own = np.asarray(at[a:b])
            p, r = packed[own], names[own]
            new = (p != np.append(p0, p[:-1])) | (r != np.append(r0, r[:-1]))
            p0, r0 = int(p[-1]), int(r[-1])
            names[own] = most + np.cumsum(new)
            most += int(new.sum())
        del at
    for a, b in blocks(m, memory):
        names[a:b] -= 1
    return names, most


def _direct(t: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, at most ``cap``, of suffixes that are known to share the first ``known`` symbols."""
    out = np.minimum(known, cap)
    live = np.flatnonzero(out < cap)
    n = len(t)
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        same = (i < n) & (j < n)
        same &= t[np.minimum(i, n - 1)] == t[np.minimum(j, n - 1)]
        live = live[same]
        out[live] += 1
        live = live[out[live] < cap]
    return out


def _seeds(text: _Text, star: np.ndarray, alphabet: int, cap: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """The S* suffixes in order, and the common prefix of each with the one before it."""
    m = len(star)
    names, distinct = _name(text, star, int(2 * alphabet + 1).bit_length(), memory)
    seeds, lcp = scratch(m, np.int64, memory), scratch(m, np.uint8, memory)
    if distinct == m:
        order, upper = scratch(m, np.int64, memory), None
        for a, b in blocks(m, memory):
            order[names[a:b]] = np.arange(a, b)
    else:
        order, upper = induced_sort(names, distinct, cap, memory)
    for a, b in blocks(m, memory):
        seeds[a:b] = star[order[a:b]]
    for a, b in blocks(m, memory, 1):
        known = np.zeros(b - a, np.int64)
        if upper is not None:  # names in common, as symbols
            known = star[np.minimum(order[a:b] + upper[a:b].astype(np.int64), m - 1)] - seeds[a:b]
        lcp[a:b] = _direct(text.t, np.asarray(seeds[a - 1 : b - 1]), np.asarray(seeds[a:b]), known, cap)
    return seeds, lcp


def induced_sort(t: np.ndarray, alphabet: int, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """``(suffix array, lcp)`` of ``t``, whose last symbol is 0 and occurs only there.

    ``lcp[i]`` is the common prefix of the suffixes at ranks ``i`` and ``i - 1``, at most ``cap`` (up to 254).
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    text = _Text(t, cap, memory)
    seeds, lcp = _seeds(text, text.stars(memory), alphabet, cap, memory)
    places, lcp, seeded = _induce(text, True, alphabet, seeds, lcp, cap, memory)
    del seeds
    # downwards: the falling suffixes, last first, induce the rising ones
    m = len(places)
    falling = m - int(np.count_nonzero(seeded))
    down, down_lcp = scratch(falling, np.int64, memory), scratch(falling, np.uint8, memory)
    end, link = falling, 0
    for a, b in blocks(m, memory):
        own = np.flatnonzero(~seeded[a:b]) + a
        k = len(own)
        if not k:
            continue
        down[end - k : end] = places[own][::-1]
        # common prefix with the falling suffix before it in rank; it belongs to that one's place in falling order
        near = np.where((own > 0) & ~seeded[np.maximum(own - 1, 0)], lcp[own], 0)[::-1]
        lo, hi = end - k + 1, min(end + 1, falling)
        down_lcp[lo:hi] = near[: hi - lo]
        end -= k
    del places, lcp, seeded
    places, lcp, _ = _induce(text, False, alphabet, down, down_lcp, cap, memory)
    m = len(places)
    sa, out = scratch(n, np.int64, memory), scratch(n, np.uint8, memory)
    sa[0] = n - 1
    for a, b in blocks(m, memory):
        sa[n - b : n - a] = places[a:b][::-1]
        # the prefix of entry i is with entry i - 1, which is the next one in rank
        x = lcp[max(a, 1) : b][::-1]
        out[n - b + 1 : n - b + 1 + len(x)] = x
    return sa, out
