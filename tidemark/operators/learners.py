"""The numpy step that one worker runs on its own few batches.

Everything distributed (who gets which rows, averaging, scoring) is in
``training``; here are only gradients of three small models and the updaters.
Parameters are one flat vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PREDICT_ROWS = 256

# Arrays of a learner by number of rows, which a caller keeps from one gradient to the next: fresh memory for each
# would take a third as long as the arithmetic.
Kept = dict[int, tuple[np.ndarray, ...]]


def _space(steps: int, width: int, units: int, n: int) -> tuple[np.ndarray, ...]:
    """Arrays for unrolling n sequences: what the cell sees, gates, c, tanh(c), and two for the way back."""
    seen, c = np.ones((steps + 1, width + units + 1, n)), np.zeros((steps + 1, units, n))
    seen[0, width:-1] = 0
    acts, t, through = (np.empty((steps, k * units, n)) for k in (4, 1, 1))
    return seen, acts, c, t, np.empty((steps, 4, units, n)), through


@dataclass(frozen=True)
class Learner:
    """``kind`` is linear, softmax or recurrent; the last reads ``x`` as steps."""

    kind: str
    inputs: int
    outputs: int
    steps: int = 1
    hidden: int = 8
    classes: bool = False
    dropout: float = 0.0

    @property
    def is_classifier(self) -> bool:
        return self.kind == "softmax" or self.classes

    @property
    def shapes(self) -> list[tuple[int, int]]:
        if self.kind == "recurrent":
            per_step = self.inputs // self.steps
            return [(per_step + self.hidden + 1, 4 * self.hidden), (self.hidden + 1, self.outputs)]
        return [(self.inputs + 1, self.outputs)]

    @property
    def size(self) -> int:
        return sum(a * b for a, b in self.shapes)

    def start(self, seed: int) -> np.ndarray:
        """Normal weights with variance 2 / (fan in + fan out), zero biases."""
        rng = np.random.default_rng(seed)
        parts = []
        for rows, cols in self.shapes:
            block = rng.normal(0.0, np.sqrt(2.0 / (rows - 1 + cols)), (rows, cols))
            block[-1] = 0.0
            parts.append(block.ravel())
        return np.concatenate(parts)

    def _unpack(self, w: np.ndarray) -> list[np.ndarray]:
        parts, at = [], 0
        for rows, cols in self.shapes:
            parts.append(w[at : at + rows * cols].reshape(rows, cols))
            at += rows * cols
        return parts

    def _head(self, hidden: np.ndarray, weights: np.ndarray) -> np.ndarray:
        z = hidden @ weights[:-1] + weights[-1]
        if not self.is_classifier:
            return z
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _by_gate(self, gates: np.ndarray) -> np.ndarray:
        """The cell's weights, a row per unit of a gate, as its exponentials need them: tanh(z) = 2 / (1 + exp(-2 z)) - 1."""
        rows = -gates.T
        rows[3 * self.hidden :] *= 2
        return rows

    def _cell(self, rows: np.ndarray, seen: np.ndarray, c: np.ndarray, acts: np.ndarray, after: np.ndarray, t: np.ndarray):
        """One step of the recurrent cell, one column per sequence.

        From what it sees and c before, fills in the four gates, c after and tanh(c).
        """
        units = self.hidden
        np.matmul(rows, seen, out=acts)
        np.exp(acts, out=acts)
        acts += 1
        np.divide(1, acts, out=acts)
        new = acts[3 * units :]
        new *= 2
        new -= 1
        np.multiply(acts[units : 2 * units], c, out=after)
        after += acts[:units] * new
        np.tanh(after, out=t)

    def _unroll(self, x: np.ndarray, gates: np.ndarray, kept: Kept):
        """Last h of each sequence, and for all steps what the cell saw, its gates, c (one more, from zero on) and tanh(c).

        All are valid until the next call with the same kept arrays.
        """
        n, units, width = len(x), self.hidden, self.inputs // self.steps
        if n not in kept:
            kept[n] = _space(self.steps, width, units, n)
        seen, acts, c, t, *_ = trace = kept[n]
        seen[:-1, :width] = x.reshape(n, self.steps, width).transpose(1, 2, 0)
        rows = self._by_gate(gates)
        for k in range(self.steps):
            self._cell(rows, seen[k], c[k], acts[k], c[k + 1], t[k])
            np.multiply(acts[k, 2 * units : 3 * units], t[k], out=seen[k + 1, width:-1])
        return seen[-1, width:-1].T, trace

    def _unroll_back(self, d_h: np.ndarray, gates: np.ndarray, trace: tuple[np.ndarray, ...]) -> np.ndarray:
        """Gradient of the gates from that of the last h."""
        seen, acts, c, t, d_z, through = trace
        by_gate = acts.reshape(d_z.shape)
        i, f, o, g = (by_gate[:, k] for k in range(4))
        # What does not depend on later steps, for all steps at once.
        np.subtract(1, by_gate[:, :3], out=d_z[:, :3])
        d_z[:, :3] *= by_gate[:, :3]
        for k, other in enumerate((g, c[:-1], t)):
            d_z[:, k] *= other
        for square, of, times in ((d_z[:, 3], g, i), (through, t, o)):
            np.multiply(of, of, out=square)
            np.subtract(1, square, out=square)
            square *= times
        back = gates[-1 - self.hidden : -1]
        d_h, d_c = d_h.T, np.zeros(t.shape[1:])
        for k in reversed(range(self.steps)):
            d_c += d_h * through[k]
            step = d_z[k]
            step[:2] *= d_c
            step[2] *= d_h
            step[3] *= d_c
            d_h = back @ step.reshape(acts.shape[1:])
            d_c *= f[k]
        return np.matmul(seen[:-1], d_z.reshape(acts.shape).transpose(0, 2, 1)).sum(axis=0)

    def continue_series(self, w: np.ndarray, x: np.ndarray, h: np.ndarray, c: np.ndarray):
        """Outputs for consecutive rows of one series, from state (h, c) on; and the new state."""
        gates, head = self._unpack(w)
        rows, units, outputs = self._by_gate(gates), self.hidden, []
        for row in x:
            seen = np.concatenate([row, h[0], [1.0]])[:, None]
            acts, after, t = np.empty((4 * units, 1)), np.empty((units, 1)), np.empty((units, 1))
            self._cell(rows, seen, c.T, acts, after, t)
            h, c = (acts[2 * units : 3 * units] * t).T, after.T
            outputs.append(self._head(h, head)[0])
        return np.array(outputs), h, c

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        parts = self._unpack(w)
        if self.kind != "recurrent":
            return self._head(x, parts[-1])
        # Few rows at a time, so that a step's arrays stay in the processor's cache.
        kept: Kept = {}
        blocks = [x[at : at + PREDICT_ROWS] for at in range(0, len(x), PREDICT_ROWS)] or [x]
        return np.concatenate([self._head(self._unroll(block, parts[0], kept)[0], parts[-1]) for block in blocks])

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, kept: Kept | None = None) -> np.ndarray:
        """Mean gradient of squared error or cross-entropy; both end in (p - y)."""
        parts, trace = self._unpack(w), None
        hidden = x
        if self.kind == "recurrent":
            hidden, trace = self._unroll(x, parts[0], {} if kept is None else kept)
        keep = (rng.random(hidden.shape) >= self.dropout) / (1 - self.dropout)
        shown = hidden * keep if trace is not None else hidden
        error = (self._head(shown, parts[-1]) - y) / len(x)
        head = np.vstack([shown.T @ error, error.sum(axis=0)])
        if trace is None:
            return head.ravel()
        d_gates = self._unroll_back((error @ parts[-1][:-1].T) * keep, parts[0], trace)
        return np.concatenate([d_gates.ravel(), head.ravel()])


@dataclass(frozen=True)
class Updater:
    """sgd, nesterov, rmsprop or adam, with L2 and element-wise clipping."""

    kind: str = "nesterov"
    rate: float = 0.01
    momentum: float = 0.9
    decay: float = 0.95
    l2: float = 0.0
    clip: float | None = 0.5

    def step(self, state: np.ndarray, grad: np.ndarray) -> None:
        """Update ``state`` in place: rows are weights, first and second moment, step count."""
        w, m, v, count = state
        grad = grad + self.l2 * w
        if self.clip is not None:
            grad = np.clip(grad, -self.clip, self.clip)
        if self.kind == "sgd":
            w -= self.rate * grad
        elif self.kind == "nesterov":
            before = m.copy()
            m[:] = self.momentum * m - self.rate * grad
            w += (1 + self.momentum) * m - self.momentum * before
        elif self.kind == "rmsprop":
            v[:] = self.decay * v + (1 - self.decay) * grad * grad
            w -= self.rate * grad / np.sqrt(v + 1e-8)
        elif self.kind == "adam":
            count += 1
            m[:] = 0.9 * m + 0.1 * grad
            v[:] = 0.999 * v + 0.001 * grad * grad
            w -= self.rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-8)
        else:
            raise ValueError(f"unknown updater {self.kind!r}")
