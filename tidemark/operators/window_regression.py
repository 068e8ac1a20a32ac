"""Least squares on whole windows, fitted from lag moments.

A window model sees the last L rows of all features and forecasts the row after
them. Its normal equations hold sums over windows of x[w + i] * x[w + j], which
is a sum over rows of x[p] * x[p + (j - i)] but for a few rows at both ends of a
series. So one pass over ordered rows adds up one small matrix per lag, corrects
the ends, and no window is ever written; scoring is a moving sum over the rows.
The system that is left, (L * features + 1) unknowns, is solved by Cholesky.

Rows of a series stay in the task that numbered them. Cut series go block by
block of positions, each with the first L rows after it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import CHUNK, EVERYTHING, Ordered, join_series
from tidemark.operators.windowing import LENGTH

BLOCK = 1 << 16


@dataclass(frozen=True)
class Shape:
    """Features in, targets (some of the features) out, rows in a window."""

    features: tuple[str, ...]
    targets: tuple[str, ...]
    length: int = LENGTH
    include_last: bool = False

    @property
    def inputs(self) -> int:
        return self.length * len(self.features) + 1

    def n_windows(self, n_rows: int) -> int:
        return max(0, n_rows - self.length - (0 if self.include_last else 1))

    @property
    def aims(self) -> list[int]:
        return [self.features.index(t) for t in self.targets]


@dataclass(frozen=True)
class WindowModel:
    """``weights[input, target]``: inputs step by step, feature by feature, the constant last."""

    shape: Shape
    weights: np.ndarray = field(repr=False)


def lag_moments(x: np.ndarray, first: int, own: int, n_rows: int, shape: Shape) -> np.ndarray:
    """Sums over windows of all products of two values of steps 0 to L, the row after the window included.

    ``x`` are rows of one series from position ``first`` on, the first ``own`` of
    which count here; those after them only as later factors. Each row ends in
    a constant 1. The blocks of a series add up to its moments.
    """
    steps, width = shape.length + 1, x.shape[1]
    out = np.zeros((steps, width, steps, width))
    windows = shape.n_windows(n_rows)
    if not windows:
        return out.reshape(steps * width, -1)
    end = first + own

    def edge(start: int, count: int, lag: int) -> np.ndarray:
        """0 and the running sums of the products at ``count`` positions."""
        at = np.arange(start, start + count)
        here = (at >= first) & (at < end)
        a, b = x[at[here] - first], x[at[here] - first + lag]
        products = np.zeros((count + 1, width, width))
        products[1:][here] = a[:, :, None] * b[:, None, :]
        return products.cumsum(0)

    for lag in range(steps):
        last = max(0, min(end, windows) - first)
        total = x[:last].T @ x[lag : lag + last]
        for i, (gone, more) in enumerate(zip(edge(0, steps - 1 - lag, lag), edge(windows, steps - 1 - lag, lag))):
            part = total + more - gone
            out[i, :, i + lag, :] = part
            out[i + lag, :, i, :] = part.T
    return out.reshape(steps * width, -1)


def solve(moments: np.ndarray, shape: Shape, l2: float) -> np.ndarray:
    """Weights of least squares with the penalty ``l2`` on all but the constant; zeros without windows."""
    width = len(shape.features) + 1
    inputs = [i * width + f for i in range(shape.length) for f in range(width - 1)] + [width - 1]
    aims = [shape.length * width + f for f in shape.aims]
    penalty = np.full(shape.inputs, l2)
    penalty[-1] = 0.0 if moments[width - 1, width - 1] > 0 else 1.0
    lower = np.linalg.cholesky(moments[np.ix_(inputs, inputs)] + np.diag(penalty))
    return np.linalg.solve(lower.T, np.linalg.solve(lower, moments[np.ix_(inputs, aims)]))


def moving_forecasts(x: np.ndarray, starts: int, weights: np.ndarray, shape: Shape) -> np.ndarray:
    """Forecasts of the windows that begin at the first ``starts`` rows: one moving sum per feature and target."""
    kernel = weights[:-1].reshape(shape.length, len(shape.features), -1)
    rows = x[: starts + shape.length - 1]
    out = np.empty((starts, weights.shape[1]))
    for t in range(weights.shape[1]):
        out[:, t] = weights[-1, t] + sum(np.convolve(rows[:, f], kernel[::-1, f, t], "valid") for f in range(len(shape.features)))
    return out


def _numbers(values: Sequence[Column]) -> Column:
    return F.array(*[v.cast("double") for v in values])


def _groups(ordered: Ordered, shape: Shape, extra: dict[str, Column]) -> list[tuple[DataFrame, list[str]]]:
    """Rows with ``x`` for whole series and for blocks of cut ones, sorted inside tasks, and what groups them.

    ``own`` tells a block's rows from those after it. The count per group is
    what keeps a group's rows in one task; where they are already, nothing moves.
    """
    columns = {"x": _numbers([F.col(f"{f}_scaled") for f in shape.features]), **extra}

    def prepare(rows: DataFrame, group: list[str], own: Column) -> DataFrame:
        rows = rows.select(*group, "pos", "n_rows", own.alias("own"), *[c.alias(n) for n, c in columns.items()])
        rows = rows.withColumn("together", F.count(F.lit(1)).over(Window.partitionBy(*group)))
        return rows.sortWithinPartitions(*group, "pos")

    parts = [(prepare(ordered.whole, ordered.keys, F.lit(True)), ordered.keys)]
    if ordered.cut is not None:
        own = F.floor(F.col("pos") / F.lit(BLOCK))
        near = (F.col("pos") % BLOCK < shape.length) & (own > 0)
        spread = ordered.cut.drop(CHUNK).withColumn("_block", F.explode(F.when(near, F.array(own - 1, own)).otherwise(F.array(own))))
        group = [*ordered.keys, "_block"]
        parts.append((prepare(spread, group, F.col("_block") == own), group))
    return parts


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if column.null_count or column.values.null_count:
        raise ValueError("window models need complete rows: a feature is null or has no train range")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per run of rows with the same group; ``together`` tells where it ends."""
    held, need = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            need = need or batch.column("together")[at].as_py()
            part = batch.slice(at, need)
            held.append(part)
            at, need = at + part.num_rows, need - part.num_rows
            if not need:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []


def _read(table: pa.Table, shape: Shape) -> tuple[np.ndarray, int, int, int]:
    """Features with a constant, first position, own rows and length of the series."""
    x = _matrix(table.column("x").combine_chunks(), len(shape.features))
    own = int(np.count_nonzero(table.column("own").to_numpy()))
    return np.column_stack((x, np.ones(len(x)))), table.column("pos")[0].as_py(), own, table.column("n_rows")[0].as_py()


_PLACES = "place int, value double"


def _places(moments: np.ndarray) -> list[pa.Array]:
    flat = moments.ravel()
    return [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)]


def pooled_moments(ordered: Ordered, shape: Shape) -> np.ndarray:
    """The moments of all series together: one matrix per task, summed by Spark; its size depends on the shape alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for table in _series(batches):
            part = lag_moments(*_read(table, shape), shape)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(_places(total), names=["place", "value"])

    parts = [rows.mapInArrow(run, _PLACES) for rows, _ in _groups(ordered, shape, {})]
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    size = (shape.length + 1) * (len(shape.features) + 1)
    out = np.zeros(size * size)
    for r in every.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out.reshape(size, size)


def fit_pooled(ordered: Ordered, shape: Shape, l2: float = 1.0) -> WindowModel:
    """One model for all series, from rows with ``pos``, ``n_rows`` and ``<f>_scaled``."""
    return WindowModel(shape, solve(pooled_moments(ordered, shape), shape, l2))


def fit_each(ordered: Ordered, shape: Shape, l2: float = 1.0) -> DataFrame:
    """One model per series: its keys and ``weights``, input by input. Series without windows are left out.

    A whole series is solved where it lies; of a cut one the blocks' moments are
    summed place by place first.
    """
    keys, kinds = ordered.keys, ordered.whole.select(*ordered.keys).schema.fields
    (whole, _), *cut = _groups(ordered, shape, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _series(batches):
            moments = lag_moments(*_read(table, shape), shape)
            if moments.any():
                yield from _one(table, moments)

    def _one(table: pa.Table, moments: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = table.select(keys).slice(0, 1).to_batches()[0]
        weights = pa.array([solve(moments, shape, l2).ravel()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*head.columns, weights], names=[*keys, "weights"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _series(batches):
            places = _places(lag_moments(*_read(table, shape), shape))
            head = table.select(keys).take(pa.array(np.zeros(len(places[0]), np.int64))).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*head.columns, *places], names=[*keys, "place", "value"])

    def finish(table: pa.Table) -> pa.Table:
        flat = np.zeros(len(table))
        flat[table.column("place").to_numpy()] = table.column("value").to_numpy()
        side = int(np.sqrt(len(flat)))
        return pa.Table.from_batches(list(_one(table, flat.reshape(side, side))))

    types = T.StructType([*kinds, T.StructField("weights", T.ArrayType(T.DoubleType()))])
    models = whole.mapInArrow(run, types)
    if cut:
        spread = T.StructType([*kinds, T.StructField("place", T.IntegerType()), T.StructField("value", T.DoubleType())])
        moments = cut[0][0].mapInArrow(blocks, spread).groupBy(*keys, "place").agg(F.sum("value").alias("value"))
        models = models.unionByName(moments.groupBy(*keys).applyInArrow(finish, types))
    return models


def forecast_windows(ordered: Ordered, shape: Shape, models: WindowModel | DataFrame) -> DataFrame:
    """``keys, idx, feature, predict, actual`` in original units for the row after each window.

    Needs ``<f>_min`` and ``<f>_max`` beside what fitting needs. ``models`` is one
    model for all series, or the table that ``fit_each`` gives; series without a
    model have no forecast.
    """
    shared = models.weights if isinstance(models, WindowModel) else None
    extra = {
        "actual": _numbers([F.col(t) for t in shape.targets]),
        "low": _numbers([F.col(f"{t}_min") for t in shape.targets]),
        "high": _numbers([F.col(f"{t}_max") for t in shape.targets]),
    }
    n_targets = len(shape.targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _series(batches):
            x, first, n_own, n_rows = _read(table, shape)
            starts = max(0, min(n_own, shape.n_windows(n_rows) - first))
            if not starts:
                continue
            weights = shared if shared is not None else np.array(table.column("weights")[0].as_py()).reshape(shape.inputs, -1)
            low, high = (np.array(table.column(c)[0].as_py()) for c in ("low", "high"))
            predict = moving_forecasts(x, starts, weights, shape) * (high - low) + low
            actual = np.array(table.column("actual").combine_chunks().flatten()).reshape(-1, n_targets)[shape.length : shape.length + starts]
            names = pa.array(list(shape.targets) * starts)
            head = table.select(keys).take(pa.array(np.zeros(starts * n_targets, np.int64))).combine_chunks().to_batches()[0]
            idx = pa.array(np.repeat(np.arange(first, first + starts), n_targets))
            yield pa.RecordBatch.from_arrays([*head.columns, idx, names, pa.array(predict.ravel()), pa.array(actual.ravel())], names=types.names)

    keys = ordered.keys
    types = T.StructType(ordered.whole.select(*keys).schema.fields).add("idx", T.LongType()).add("feature", T.StringType()).add("predict", T.DoubleType()).add("actual", T.DoubleType())
    if shared is None:
        extra["weights"] = F.col("weights")
        ordered = ordered.map(lambda rows: join_series(rows, models, keys))
    parts = [rows.mapInArrow(run, types) for rows, _ in _groups(ordered, shape, extra)]
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.drop(EVERYTHING)
