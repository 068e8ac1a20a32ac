"""Hashed word and character n-gram features of distinct words, for whole batches at once."""

from __future__ import annotations

import numpy as np

from tidemark.llm.words import hash_strings, mixed

_STEP = np.uint64(0x100000001B3)


def word_features(distinct: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of each word, and where each word's begin.

    A word's features are itself and its character n-grams, with marks for its
    begin and end. Every word has one feature at least.
    """
    n = len(distinct)
    if not n:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    text = "".join(f"<{w}>" for w in distinct)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in distinct), np.int32, n)
    owner = np.repeat(np.arange(n, dtype=np.int32), length)
    last = np.cumsum(length, dtype=np.int32)[owner]
    parts, owners = [(hash_strings(distinct, seed=1) % np.uint64(buckets)).astype(np.int32)], [np.arange(n, dtype=np.int32)]
    for size in sizes:
        if len(chars) < size:
            continue
        code = np.full(len(chars) - size + 1, size, np.uint64)
        for j in range(size):
            code = code * _STEP + chars[j : j + len(code)]
        inside = np.arange(size, size + len(code), dtype=np.int32) <= last[: len(code)]
        parts.append((mixed(code[inside]) % np.uint64(buckets)).astype(np.int32))
        owners.append(owner[: len(code)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=n))))
    return np.concatenate(parts)[order], starts


def pair_features(hashes: np.ndarray, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring words of a text, and the text's number for each."""
    if len(hashes) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = mixed(hashes[:-1] * _STEP + hashes[1:])
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    same = doc[:-1] == doc[1:]
    return (code[same] % np.uint64(buckets)).astype(np.int64), doc[:-1][same]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges, also of empty ones."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]
