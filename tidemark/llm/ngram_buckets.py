"""Word n-grams of whole texts as crc32 buckets, column-wise: words by place, joined checksums by linearity.

The checksum of two joined strings follows from theirs and the second one's
length: crc(ab) = zeros(crc(a), len(b)) ^ crc(b), where ``zeros`` appends zero
bytes, a linear map. So words are read once and n-grams never built.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words up to this length are read byte by byte all at once, longer ones alone.
SHORT = 64
SPACE, NEWLINE = 0x20, 0x0A


def _byte_table() -> np.ndarray:
    """A-Z in lower case; a line feed as it is; every other ASCII byte outside of words as a space."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    for a, b in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
        table[a:b] = SPACE
    table[NEWLINE] = NEWLINE
    return table


def _checksum_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320, one byte at a time."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_BYTES, _CRC = _byte_table(), _checksum_table()


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 0xFF] ^ tables[1][c >> 8 & 0xFF] ^ tables[2][c >> 16 & 0xFF] ^ tables[3][c >> 24]


def _zero_tables() -> tuple[np.ndarray, np.ndarray]:
    """``zeros`` for 0 to SHORT + 1 bytes, and for 1, 2, 4, ... bytes, as four tables of 256 each."""
    every = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    by_length = [every]
    for _ in range(SHORT + 1):
        last = by_length[-1]
        by_length.append(_CRC[last & 0xFF] ^ (last >> 8))
    doubled = [by_length[1]]
    for _ in range(31):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.stack(by_length), np.stack(doubled)


_BY_LENGTH, _DOUBLED = _zero_tables()


def zeros(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each checksum with n zero bytes appended, before the second string is mixed in."""
    table, at = _BY_LENGTH.ravel(), np.minimum(n, SHORT + 1) * 1024
    wide = c.astype(np.int64)
    out = table.take(at + (wide & 0xFF))
    for k in range(1, 4):
        out ^= table.take(at + (wide >> 8 * k & 0xFF) + 256 * k)
    long = np.flatnonzero(n > SHORT + 1)
    if len(long):
        left, value = n[long], c[long]
        for k in range(int(left.max()).bit_length()):
            value = np.where(left >> k & 1, _apply(_DOUBLED[k], value), value)
        out[long] = value
    return out


def word_checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of data[start : start + length] for every word."""
    by_length = np.argsort(lengths, kind="stable")
    at, n = starts[by_length], lengths[by_length]
    c = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(min(SHORT, int(n[-1]) if len(n) else 0)):
        a = int(np.searchsorted(n, j, side="right"))
        c[a:] = _CRC[(c[a:] ^ data[at[a:] + j]) & 0xFF] ^ (c[a:] >> 8)
    out = np.empty(len(at), np.uint32)
    out[by_length] = ~c
    for i in by_length[np.searchsorted(n, SHORT, side="right") :]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    return out


class Words:
    """The words of some texts: lower-cased bytes, and each word's place, length, line and text."""

    def __init__(self, texts: pa.Array):
        # A line feed after each text keeps its last word from the next text.
        ended = pc.binary_join_element_wise(pc.fill_null(texts, ""), pa.scalar("", texts.type), pa.scalar("\n", texts.type))
        kind = np.int64 if pa.types.is_large_string(ended.type) else np.int32
        offsets = np.frombuffer(ended.buffers()[1], kind)[ended.offset : ended.offset + len(ended) + 1].astype(np.int64)
        raw = np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(ended) else np.empty(0, np.uint8)
        self.data = _BYTES[raw]
        inside = (self.data != SPACE) & (self.data != NEWLINE)
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        # The line feed at the end of each text closes its last word.
        self.starts, ends = edges[0::2], edges[1::2]
        self.lengths = ends - self.starts
        self.line = self._owners(np.flatnonzero(self.data == NEWLINE))
        self.text = self._owners(offsets[1:] - offsets[0])
        self._inside, self._ends = inside, ends

    def _owners(self, ends: np.ndarray) -> np.ndarray:
        """For each word, how many of the ends lie before it."""
        upto = np.searchsorted(self.starts, ends)
        return np.repeat(np.arange(len(ends)), np.diff(upto, prepend=0))

    def __len__(self) -> int:
        return len(self.starts)

    def lines(self) -> tuple[pa.Array, np.ndarray]:
        """Each line that has words as its words with one space after each but the last, which has a line feed; and each line's text."""
        last = np.append(self.line[1:] != self.line[:-1], True) if len(self) else np.empty(0, bool)
        data, keep = self.data.copy(), self._inside.copy()
        data[self._ends] = np.where(last, NEWLINE, SPACE)
        keep[self._ends] = True
        sizes = np.cumsum(self.lengths + 1)
        offsets = np.concatenate(([0], sizes[last])).astype(np.int64)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
        return packed.cast(pa.large_string()), self.text[last]

    def checksums(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """crc32 of the chosen words, or of all."""
        at, n = (self.starts, self.lengths) if chosen is None else (self.starts[chosen], self.lengths[chosen])
        return word_checksums(self.data, at, n)

    def grams(self, most: int, same: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """crc32 and first word of all runs of 1 to ``most`` words whose words agree in ``same``.

        With ``apart``, only runs whose first and last word differ in it.
        """
        n = len(self)
        first = [np.arange(n)] if apart is None else []
        runs = []
        for k in range(2, most + 1):
            ok = same[: n - k + 1] == same[k - 1 :] if n >= k else np.empty(0, bool)
            if apart is not None and n >= k:
                ok &= apart[: n - k + 1] != apart[k - 1 :]
            runs.append(np.flatnonzero(ok))
        if apart is None:
            crc = self.checksums()
        else:
            # Only words in runs that reach over a border are read.
            used = np.zeros(n, bool)
            for k, at in enumerate(runs, 2):
                for j in range(k):
                    used[at + j] = True
            crc = np.zeros(n, np.uint32)
            used = np.flatnonzero(used)
            crc[used] = self.checksums(used)
        # " word": the space's checksum, moved on by the word's length.
        spaced = zeros(np.full(n, zlib.crc32(b" "), np.uint32), self.lengths) ^ crc
        out = [crc] if apart is None else []
        for k, at in enumerate(runs, 2):
            value = crc[at]
            for j in range(1, k):
                value = zeros(value, self.lengths[at + j] + 1) ^ spaced[at + j]
            out.append(value)
            first.append(at)
        return np.concatenate(out) if out else np.empty(0, np.uint32), np.concatenate(first) if first else np.empty(0, np.int64)
