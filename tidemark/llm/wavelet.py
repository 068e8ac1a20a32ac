"""Wavelet matrix: a sequence of ids as bit planes that answer access, rank and select."""

from __future__ import annotations

import numpy as np

BLOCK = 512


class WaveletMatrix:
    """Bit planes from the highest bit down; each plane's zeros go before its ones in the next.

    A plane holds one bit per id, packed, and a running count of ones for every
    ``BLOCK`` bits. All questions are answered from the planes.
    """

    def __init__(self, n: int, planes: list[bytes], ranks: list[bytes], zeros: list[int]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << level)) != 0
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed.tobytes())
            padded = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(per_block)), dtype=np.uint32, casting="unsafe").tobytes())
            low = ids[~ones]
            zeros.append(len(low))
            ids = np.concatenate((low, ids[ones]))
        return cls(len(ids), planes, ranks, zeros)

    def _ones(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids: planes are undone from the last to the first."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(bits - 1, -1, -1):
            ones, before = self._ones(level), np.empty(self.n, kind)
            before[~ones] = ids[: self.zeros[level]]
            before[ones] = ids[self.zeros[level] :] | kind(1 << (bits - 1 - level))
            ids = before
        return ids

    def _rank1(self, level: int, at: int) -> int:
        """Ones before the place."""
        block = at // BLOCK
        start = block * BLOCK
        part = np.unpackbits(self.planes[level][start // 8 : (at + 7) // 8], bitorder="little")[: at - start]
        return int(self.ranks[level][block]) + int(part.sum())

    def access(self, at: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][at // 8] >> (at % 8) & 1)
            ones = self._rank1(level, at)
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before ``end`` lie below the last plane."""
        start, bits = 0, len(self.planes)
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (zeros + a, zeros + b) if token >> (bits - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of the token before ``end``."""
        a, b = self._range(token, self.n if end is None else end)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit: its block by the counts, then inside it."""
        counts = self.ranks[level].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * BLOCK, self.n) - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        start = block * BLOCK
        part = np.unpackbits(self.planes[level][start // 8 : start // 8 + BLOCK // 8], bitorder="little")[: self.n - start]
        return start + int(np.flatnonzero(part == bit)[k - counts[block]])

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        start, end = self._range(token, self.n)
        if not 0 <= k < end - start:
            raise IndexError(f"token {token} has {end - start} occurrences")
        at, bits = start + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at
