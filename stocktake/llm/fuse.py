"""Static binary-fuse filters over 64-bit keys, built and probed with array operations.

A filter holds one byte for each of about 1.13 slots a key and answers "maybe"
for 1/256 of the keys it has not seen; it never misses one that it has.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

U = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + U(seed)
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@dataclass
class FuseFilter:
    seed: int
    segment: int
    span: int
    slots: np.ndarray

    def _places(self, h: np.ndarray) -> np.ndarray:
        """Three slots a key, one in each of three neighbouring segments."""
        first = ((h >> U(32)) * U(self.span)) >> U(32)
        mask = U(self.segment - 1)
        second = (first + U(self.segment)) ^ ((h >> U(18)) & mask)
        third = (first + U(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> U(32))).astype(np.uint8)

    def __contains__(self, key: int) -> bool:
        return bool(self.maybe(np.array([key], U))[0])

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(len(keys), bool)
        h = mix(keys, self.seed)
        a, b, c = self._places(h)
        return (self.slots[a] ^ self.slots[b] ^ self.slots[c]) == self._print(h)

    @classmethod
    def build(cls, keys: np.ndarray, tries: int = 100) -> FuseFilter:
        keys = np.unique(np.asarray(keys, U))
        n = len(keys)
        if not n:
            return cls(0, 1, 0, np.zeros(0, np.uint8))
        segment = min(1 << 18, 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
        capacity = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        count = max(1, math.ceil(capacity / segment) - 2)
        for attempt in range(tries):
            f = cls(attempt * 0x9E3779B97F4A7C15 % (1 << 64), segment, count * segment, np.zeros((count + 2) * segment, np.uint8))
            if f._fill(mix(keys, f.seed)):
                return f
            count += attempt % 4 == 3
        raise RuntimeError("no filter could be built")

    def _fill(self, h: np.ndarray) -> bool:
        """Peel keys that are alone in a slot, wave by wave; then set slots in reverse order."""
        at = self._places(h)
        n, size = len(h), len(self.slots)
        degree = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        left, waves = n, []
        alone = np.flatnonzero(degree == 1)
        gone = np.zeros(n, bool)
        while len(alone):
            keys, first = np.unique(owner[alone], return_index=True)
            waves.append((keys, alone[first]))
            gone[keys] = True
            left -= len(keys)
            touched = at[:, keys].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(keys, 3))
            touched = np.unique(touched)
            alone = touched[degree[touched] == 1]
        if left:
            return False
        want = self._print(h)
        for keys, slot in reversed(waves):
            a, b, c = at[:, keys]
            self.slots[slot] = 0
            self.slots[slot] = want[keys] ^ self.slots[a] ^ self.slots[b] ^ self.slots[c]
        return True
