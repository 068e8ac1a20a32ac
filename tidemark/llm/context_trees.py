"""Context-tree weighting over bytes.

A byte is eight binary decisions, one for each node of a binary tree over byte
values. Every node keeps a context tree of its own over the bytes before. A
context's decisions have the Krichevsky-Trofimov estimate of their counts; a
context's weighted probability is half that estimate and half the product of
what the longer contexts make of the same decisions. Given its counts, the tree
predicts a decision by mixing the estimates of all depths, each with the posterior weight
that the tree ends there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DEPTH = 5
START = b"\n" * DEPTH
_HALF = np.log(0.5)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``DEPTH`` bytes before it as one number, and where each text's begin.

    A text is followed by one end byte and preceded by end bytes, which are contexts only.
    """
    buffer, offsets = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    length = np.diff(offsets)
    begin = np.concatenate(([0], np.cumsum(length + DEPTH + 1)))
    stream = np.full(begin[-1], START[0], np.uint8)
    where = np.repeat(begin[:-1] + DEPTH - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    stream[where] = data[offsets[0] : offsets[-1]]
    if not len(stream):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    # Six bytes are three pairs; a text's own bytes begin after its contexts.
    pairs = stream[:-1].astype(np.int64) << 8 | stream[1:]
    code = pairs[:-4] << 32 | pairs[2:-2] << 16 | pairs[4:]
    scored = np.ones(len(code), bool)
    scored[(begin[1:-1, None] - np.arange(1, DEPTH + 1)).ravel()] = False
    return code[scored], np.concatenate(([0], np.cumsum(length + 1)))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up where it is exact enough."""
    down = np.zeros_like(x)
    for k in range(8):
        down += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - down


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with such counts."""
    half = _log_gamma(np.array([0.5]))[0]
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - 2 * half - _log_gamma(zeros + ones + 1.0)


def _nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, its eight decisions: node of the binary tree and bit."""
    level = np.arange(8)
    return (1 << level) | (byte[:, None] >> (8 - level)), byte[:, None] >> (7 - level) & 1


def context_key(code: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes before, of numbers as ``grams`` makes them."""
    return code >> 8 & ((1 << 8 * depth) - 1)


def tree_nodes(code: np.ndarray, count: np.ndarray, least_depth: int) -> dict[int, tuple]:
    """By depth: keys (context and node), counts of zeros and ones, log weighted probability, weight of ending here.

    ``code`` must hold all grams of the contexts of ``least_depth``.
    """
    out, below = {}, None
    node, bit = _nodes(code & 255)
    for depth in range(DEPTH, least_depth - 1, -1):
        key = (context_key(code, depth)[:, None] << 8 | node).ravel()
        keys, place = np.unique(key, return_inverse=True)
        many = np.repeat(count, 8)
        ones = np.bincount(place, weights=many * bit.ravel(), minlength=len(keys))
        zeros = np.bincount(place, weights=many, minlength=len(keys)) - ones
        estimate = log_estimate(zeros, ones)
        if below is None:
            weighted, ends = estimate, np.ones(len(keys))
        else:
            child_keys, child_weighted = below
            parent = (child_keys >> 8 & ((1 << 8 * depth) - 1)) << 8 | child_keys & 255
            product = np.bincount(np.searchsorted(keys, parent), weights=child_weighted, minlength=len(keys))
            weighted = _HALF + np.logaddexp(estimate, product)
            ends = np.exp(_HALF + estimate - weighted)
        below = keys, weighted
        out[depth] = keys, zeros, ones, weighted, ends
    return out


def shorter(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes one byte shorter than ``keys``: distinct keys, sums of counts and of log weighted probabilities ``below``.

    ``keys`` must have lost that byte already; what comes of parts of the table can be summed again.
    """
    node, place = np.unique(keys, return_inverse=True)
    return node, *(np.bincount(place, weights=x, minlength=len(node)) for x in (zeros, ones, below))


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimate of a one, weight of ending here, and log weighted probability, of nodes whose longer contexts make ``below``."""
    estimate = log_estimate(zeros, ones)
    weighted = _HALF + np.logaddexp(estimate, below)
    return (ones + 0.5) / (zeros + ones + 1), np.exp(_HALF + estimate - weighted), weighted


def mix(layers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], code: np.ndarray, odds: np.ndarray | None = None) -> np.ndarray:
    """Probability of each gram's eight decisions by the depths given, the longest first.

    ``odds`` is what contexts longer than those say. A context without counts
    says one half, by its own estimate and by those of all that is longer.
    """
    node, bit = _nodes(code & 255)
    p = np.full(node.shape, 0.5) if odds is None else odds
    for depth in sorted(layers, reverse=True):
        keys, one, ends = layers[depth]
        if not len(keys):
            continue
        key = context_key(code, depth)[:, None] << 8 | node
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        p = np.where(keys[at] == key, ends[at] * np.where(bit == 1, one[at], 1 - one[at]) + (1 - ends[at]) * p, p)
    return p


class Model:
    """Per depth, sorted keys with the estimate of a one and the weight of ending there."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.layers = dict(enumerate(layers))

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Log10 of the probability of each byte."""
        return np.log10(mix(self.layers, code)).sum(1)


def distinct_grams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    coded = pa.array(code).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and how often each comes."""
    distinct, place = distinct_grams(code)
    return distinct, np.bincount(place, minlength=len(distinct))
