"""Softmax regression by Newton's method on distributed rows, until it has converged.

Each iteration is one pass: every task sums loss, gradient and Hessian of the
rows it holds, Spark adds the tasks' sums up in levels, and the driver solves one system of (classes - 1) * (inputs + 1) unknowns. Rows stay where they
are. The problem is convex, so full steps, halved where they overshoot, end at
the one best model, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks that add up the sums of all tasks, level by level; the driver adds up those of the last.
LEVELS = (64, 4)
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class SoftmaxModel:
    """``weights[class, input]``, the constant last; the last class has zeros. ``history`` has every step's weights."""

    weights: np.ndarray
    l2: float
    converged: bool
    history: list[np.ndarray] = field(default_factory=list, repr=False)


def probabilities(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One row of class probabilities per row of inputs with a constant."""
    score = x @ weights.T
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


def partial_sums(weights: np.ndarray, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Count, loss, gradient and Hessian of some rows, one after the other in one vector."""
    classes, width = weights.shape
    free = classes - 1
    p = probabilities(weights, x)
    rows = np.arange(len(x))
    loss = -np.log(np.maximum(p[rows, label], 1e-300)).sum()
    off = p.copy()
    off[rows, label] -= 1
    gradient = (off.T @ x)[:free]
    hessian = np.zeros((free, width, free, width))
    for a in range(free):
        for b in range(a, free):
            weight = p[:, a] * ((a == b) - p[:, b])
            part = x.T @ (weight[:, None] * x)
            hessian[a, :, b, :] = part
            hessian[b, :, a, :] = part.T
    return np.concatenate(([len(x), loss], gradient.ravel(), hessian.ravel()))


def with_constant(column: pa.Array) -> np.ndarray:
    if column.null_count or column.values.null_count:
        raise ValueError("a classifier needs complete rows: an input is null")
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.column_stack((x, np.ones(len(x))))


def _summed(rows: DataFrame, weights: np.ndarray, levels: list[int]) -> np.ndarray | None:
    """``partial_sums`` of all rows: per task, then level by level. One vector at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                label = part.column("label").to_numpy(zero_copy_only=False)
                if label.min() < 0 or label.max() >= len(weights):
                    raise ValueError(f"labels must be 0 to {len(weights) - 1}")
                sums = partial_sums(weights, with_constant(part.column("x")), label)
                total = sums if total is None else total + sums
        yield from _vector(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column("sums"):
                part = np.frombuffer(value.as_py(), np.float64)
                total = part.copy() if total is None else total + part
        yield from _vector(total)

    parts = rows.mapInArrow(run, "sums binary")
    for tasks in levels:
        parts = parts.repartition(tasks).mapInArrow(add, "sums binary")
    found = [np.frombuffer(r.sums, np.float64) for r in parts.collect()]
    return sum(found) if found else None


def _vector(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def fit_softmax(examples: DataFrame, classes: int, l2: float = 1e-3, most_steps: int = 50, tolerance: float = 1e-9) -> SoftmaxModel:
    """Fit ``x ARRAY<DOUBLE>`` to ``label`` (0 to classes - 1) with the penalty ``l2`` / 2 per row on all but the constants.

    Done when no mean gradient exceeds ``tolerance``. Rows without a label are
    left out; without any rows the classes are equally likely.
    """
    rows = examples.where("label is not null").select("x", F.col("label").cast("int").alias("label"))
    head = rows.select(F.size("x").alias("n")).first()
    if head is None:
        return SoftmaxModel(np.zeros((classes, 1)), l2, True)
    width, free = head.n + 1, classes - 1
    # A level pays where it adds up several sums per task.
    tasks = rows.rdd.getNumPartitions()
    levels = [n for n in LEVELS if tasks > 2 * n]
    penalty = np.tile(np.append(np.full(head.n, l2), 0.0), free)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = _summed(rows, w, levels)
        n, own = sums[0], w[:free].ravel()
        gradient = sums[2 : 2 + free * width] / n + penalty * own
        hessian = sums[2 + free * width :].reshape(free * width, -1) / n + np.diag(penalty)
        return sums[1] / n + 0.5 * (penalty * own * own).sum(), gradient, hessian

    weights = np.zeros((classes, width))
    value, gradient, hessian = objective(weights)
    history, converged = [weights], False
    for _ in range(most_steps):
        if np.abs(gradient).max() <= tolerance:
            converged = True
            break
        # A class that no row has pulls its constant away without end; the ridge keeps the system solvable.
        step = np.linalg.solve(hessian + 1e-12 * np.eye(len(hessian)), gradient).reshape(free, width)
        share = 1.0
        while True:
            tried = weights.copy()
            tried[:free] -= share * step
            new = objective(tried)
            if new[0] <= value + 1e-12 or share < 1e-3:
                break
            share /= 2
        weights, (value, gradient, hessian) = tried, new
        history.append(weights)
    return SoftmaxModel(weights, l2, converged, history)


def classify(examples: DataFrame, model: SoftmaxModel, keep: list[str], all_steps: bool = False) -> DataFrame:
    """The columns ``keep`` with ``step`` (of the fit) and ``output``, the class probabilities; all steps share one scan."""
    chosen = list(enumerate(model.history)) if all_steps else [(len(model.history) - 1, model.weights)]
    kept = examples.select(F.struct(*keep).alias("row"), "x")
    schema = T.StructType().add(kept.schema["row"]).add("step", T.IntegerType()).add("output", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = with_constant(batch.column("x"))
            for number, weights in chosen:
                p = probabilities(weights, x if weights.shape[1] > 1 else x[:, -1:])
                output = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(p), number, np.int32)), output], names=["row", "step", "output"])

    done = kept.mapInArrow(run, schema)
    return done.select(*[F.col("row").getField(c).alias(c) for c in keep], "step", "output")
