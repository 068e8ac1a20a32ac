"""States that change by an affine map per row, scanned in parallel.

A row's value x takes the state s to ``step @ s + gain * x``; the first row of a
series, and a row that restarts it, sets ``start * x`` whatever was before. Such
maps compose to maps of the same form, a restart to one that forgets everything.
So any run of rows is summed up by one small matrix and vector: blocks of rows
inside a batch are scanned side by side, and the chunks of a long series are
scanned all at once and joined by their maps afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import CHUNK, EVERYTHING, cut_long_series, join_series
from tidemark.session import write_through


@dataclass(frozen=True)
class Affine:
    """One state per name."""

    names: tuple[str, ...]
    step: tuple[tuple[float, ...], ...]
    gain: tuple[float, ...]
    start: tuple[float, ...]


def exponential(alpha: float) -> Affine:
    """The mean ``s = alpha * x + (1 - alpha) * s``, from the first value on."""
    return Affine(("state",), ((1 - alpha,),), (alpha,), (1.0,))


def trend(alpha: float, beta: float) -> Affine:
    """Level and slope: the level follows x and level + trend, the trend follows the level's changes.

    A series begins at its first value with trend 0.
    """
    return Affine(("level", "trend"), ((1 - alpha, 1 - alpha), (-alpha * beta, 1 - alpha * beta)), (alpha, alpha * beta), (1.0, 0.0))


def scan(rule: Affine, x: np.ndarray, restart: np.ndarray, before: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state after each row, and each row's map of a state further back.

    ``before`` is the state ahead of the first row, ``reach`` the map from
    further back to it; a restart makes the map zero. About sqrt(n) blocks go
    side by side, row by row; then each block's carry follows from the blocks
    before it.
    """
    step, gain, start = (np.array(a, np.float64) for a in (rule.step, rule.gain, rule.start))
    n, d = len(x), len(gain)
    width = max(1, isqrt(n))
    blocks = -(-n // width)
    xs = np.pad(x, (0, blocks * width - n)).reshape(blocks, width).T.copy()
    again = np.pad(restart, (0, blocks * width - n)).reshape(blocks, width).T.copy()
    states, maps = np.empty((width, d, blocks)), np.empty((width, d, d, blocks))
    s, m = np.zeros((d, blocks)), np.repeat(np.eye(d)[:, :, None], blocks, axis=2)
    for t in range(width):
        s = np.where(again[t], start[:, None] * xs[t], step @ s + gain[:, None] * xs[t])
        m = np.where(again[t], 0.0, np.tensordot(step, m, axes=1))
        states[t], maps[t] = s, m
    carry, far = np.empty((blocks, d)), np.empty((blocks, d, d))
    for b in range(blocks):
        carry[b], far[b] = before, reach
        before = maps[-1, :, :, b] @ before + states[-1, :, b]
        reach = maps[-1, :, :, b] @ reach
    states = np.einsum("tib->bti", states) + np.einsum("tijb,bj->bti", maps, carry)
    maps = np.einsum("tijb,bjk->btik", maps, far)
    return states.reshape(-1, d)[:n], maps.reshape(-1, d, d)[:n]


def _group_starts(batch: pa.RecordBatch, group: Sequence[str], last: tuple | None) -> np.ndarray:
    """True where a row's group differs from the one before; nulls are alike."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = last != _group(batch, group, 0)
    for name in group:
        a, b = batch.column(name).slice(0, batch.num_rows - 1), batch.column(name).slice(1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return new


def _group(batch: pa.RecordBatch, group: Sequence[str], at: int) -> tuple:
    return tuple(batch.column(name)[at].as_py() for name in group)


def _input(batch: pa.RecordBatch, value: str, restart: str | None) -> tuple[np.ndarray, np.ndarray]:
    if batch.column(value).null_count:
        raise ValueError(f"a state needs a value in every row; {value} is null")
    x = batch.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
    again = batch.column(restart).fill_null(False).to_numpy(zero_copy_only=False) if restart else np.zeros(len(x), bool)
    return x, again


def _columns(states: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c)) for c in states.reshape(len(states), -1).T]


def scan_whole(batches: Iterator[pa.RecordBatch], rule: Affine, group: Sequence[str], value: str, restart: str | None) -> Iterator[pa.RecordBatch]:
    """Whole series, sorted: a new series restarts the state, so a batch of many short ones is one scan."""
    d = len(rule.names)
    last, before = None, np.zeros(d)
    for batch in batches:
        if batch.num_rows:
            x, again = _input(batch, value, restart)
            states, _ = scan(rule, x, again | _group_starts(batch, group, last), before, np.eye(d))
            last, before = _group(batch, group, -1), states[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(states)], names=[*batch.schema.names, *rule.names])


def scan_chunks(batches: Iterator[pa.RecordBatch], rule: Affine, group: Sequence[str], value: str, restart: str | None, maps: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Chunks, sorted: each begins from nothing and keeps the map of what may have been before it."""
    d = len(rule.names)
    last, before, reach = None, np.zeros(d), np.eye(d)
    for batch in batches:
        if not batch.num_rows:
            continue
        x, again = _input(batch, value, restart)
        starts = _group_starts(batch, group, last)
        opens = batch.column("_opens").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(starts[1:]) + 1).tolist(), len(x)]
        done = []
        for a, b in zip(edges[:-1], edges[1:]):
            if starts[a]:
                before, reach = np.zeros(d), np.eye(d)
                again[a] |= opens[a]
            states, far = scan(rule, x[a:b], again[a:b], before, reach)
            before, reach = states[-1], far[-1]
            done.append(np.concatenate((states, far.reshape(len(states), -1)), axis=1))
        last = _group(batch, group, -1)
        kept = [i for i, name in enumerate(batch.schema.names) if name != "_opens"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *_columns(np.concatenate(done))], names=[*[batch.schema.names[i] for i in kept], *rule.names, *maps])


def _with_doubles(schema: T.StructType, names: Sequence[str]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])


def affine_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rule: Affine, restart: str | None = None) -> DataFrame:
    """The rows with the state up to and including each row, one column per name of the rule.

    A true value in the ``restart`` column (null counts as false) drops the
    state before that row. A null value raises. Series of any length: those too
    long for one task are scanned in chunks, each once.
    """
    ordered = cut_long_series(df, keys, order)

    def sort(rows: DataFrame, group: list[str]) -> DataFrame:
        return rows.repartition(*group).sortWithinPartitions(*group, *ordered.order)

    together = sort(ordered.whole, ordered.keys)
    group = list(ordered.keys)
    whole = together.mapInArrow(lambda b: scan_whole(b, rule, group, value, restart), _with_doubles(together.schema, rule.names)).drop(EVERYTHING)
    if ordered.cut is None:
        return whole

    chunked, d = [*group, CHUNK], len(rule.names)
    maps = [f"_map_{i}_{j}" for i in range(d) for j in range(d)]
    first = F.col(CHUNK) == F.min(CHUNK).over(Window.partitionBy(*group))
    openers = ordered.cut.groupBy(*chunked).agg(F.lit(1)).select(*chunked, first.alias("_opens"))
    alone = sort(join_series(ordered.cut, openers, chunked), chunked)
    kept = T.StructType([f for f in alone.schema if f.name != "_opens"])
    alone = alone.mapInArrow(lambda b: scan_chunks(b, rule, chunked, value, restart, maps), _with_doubles(kept, [*rule.names, *maps]))
    alone = write_through(alone, "states")

    # One row per chunk from here on: its own state at the end, and its map.
    ends = alone.groupBy(*chunked).agg(F.max_by(F.struct(*rule.names, *maps), F.struct(*ordered.order)).alias("last")).select(*chunked, "last.*")
    enter = [f"_enter_{i}" for i in range(d)]

    def pass_on(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values(CHUNK)
        own, far = chunks[list(rule.names)].to_numpy(np.float64), chunks[maps].to_numpy(np.float64).reshape(-1, d, d)
        into = np.zeros_like(own)
        for c in range(1, len(own)):
            into[c] = far[c - 1] @ into[c - 1] + own[c - 1]
        return chunks[chunked].assign(**{name: into[:, i] for i, name in enumerate(enter)})

    keyed = T.StructType([ends.schema[c] for c in chunked])
    carried = ends.groupBy(*group).applyInPandas(pass_on, _with_doubles(keyed, enter))
    joined = join_series(alone, carried, chunked)
    full = {name: F.col(name) + sum(F.col(maps[i * d + j]) * F.col(enter[j]) for j in range(d)) for i, name in enumerate(rule.names)}
    return whole.unionByName(joined.withColumns(full).drop(*maps, *enter, CHUNK, EVERYTHING))
