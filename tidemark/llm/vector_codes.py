"""Vectors as short codes: per-part codebooks by exact rounds over metric trees.

Vectors become integers and are cut into equal parts. Blocks of vectors are
packed once, each with a metric tree per part, and written to the shared folder;
every round reads them, goes down the trees with the current codebooks (a
bounded table, sent with the tasks) and returns one sum per entry and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.metric_trees import Tree, assign, build
from tidemark.llm.words import give_back
from tidemark.session import write_through

# Vectors of a block and bytes of its components, whichever is reached first.
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
SCALE = 4096

_SUMS = "part int, entry int, place int, total bigint"


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, place]``: whole numbers."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def largest_whole(dim: int) -> int:
    """The largest component with which all distances fit 64 bits."""
    return int(np.sqrt(2.0**62 / (4 * max(1, dim))))


def _whole(vectors: np.ndarray, dim: int) -> np.ndarray:
    """floor(4096 * x); what distances of 64 bits couldn't hold counts as the largest that they can."""
    bound = min(largest_whole(dim), 2**31 - 1)
    return np.clip(np.floor(SCALE * vectors), -bound, bound).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, parts: int) -> Iterator[pa.RecordBatch]:
    """One row per block: the input rows, their whole components and a tree for each part."""
    at, rows = 0, max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, dim))))
    held, n = [], 0

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = batch.column("vector").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        whole = _whole(flat.reshape(batch.num_rows, dim), dim)
        width = dim // parts
        trees = [build(whole[:, p * width : (p + 1) * width]).to_bytes() for p in range(parts)]
        inner = batch.column("row")
        listed = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), inner)
        return pa.RecordBatch.from_arrays(
            [listed, pa.array([whole.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.list_(pa.binary())))],
            names=["rows", "whole", "trees"],
        )

    def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            at, n = at + take, n + take
            if n == rows:
                yield pack(joined(held))
                held, n = [], 0
    if n:
        yield pack(joined(held))
    give_back()


def _points(whole: bytes, dim: int, parts: int) -> list[np.ndarray]:
    matrix = np.frombuffer(whole, np.int32).reshape(-1, dim).astype(np.int64)
    width = dim // parts
    return [matrix[:, p * width : (p + 1) * width] for p in range(parts)]


def _round(blocks: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """Every part to its nearest entry, every entry to the floored mean of its parts."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries, 1), np.int64)
        for batch in batches:
            for whole, trees in zip(batch.column("whole"), batch.column("trees")):
                for p, points in enumerate(_points(whole.as_py(), dim, parts)):
                    s, c, _, _ = assign(Tree.from_bytes(trees[p].as_py(), width), points, books.entries[p], members=False)
                    sums[p] += s
                    counts[p] += c[:, None]
        every = np.concatenate((counts, sums), axis=2)
        p, e, d = np.indices(every.shape)
        keep = np.broadcast_to(counts > 0, every.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p[keep], pa.int32()), pa.array(e[keep], pa.int32()), pa.array(d[keep] - 1, pa.int32()), pa.array(every[keep], pa.int64())],
            names=["part", "entry", "place", "total"],
        )

    totals = blocks.select("whole", "trees").mapInArrow(run, _SUMS)
    # One row per place of an entry: bounded by the codebooks' size, whatever the number of vectors.
    found = totals.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {(r.part, r.entry, r.place): int(r.total) for r in found}
    new = books.entries.copy()
    for (p, e, d), value in total.items():
        if d >= 0:
            new[p, e, d] = value // total[p, e, -1]
    return Codebooks(new)


def fit(blocks: DataFrame, first: Codebooks, dim: int, rounds: int) -> Codebooks:
    books = first
    for _ in range(rounds):
        books = _round(blocks, books, dim)
    return books


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, keep: list[str] | None = None) -> tuple[DataFrame, Codebooks | None]:
    """All usable rows (of them the columns ``keep``, or all) with ``code`` and ``error``, and the codebooks.

    ``code`` has two hex digits a part, ``error`` is the squared distance to the
    coded vector. The codebooks start as the parts of the smallest keys (null
    last, ties by components; of fewer than ``entries`` rows, all of them), so
    results don't depend on how rows are partitioned. Rows whose vector is null
    or holds null or non-finite components drop out. The first of those rows
    sets the number of components; a row with another number, or one that
    ``parts`` does not divide, stays with a null code and error. Components so
    large that distances would not fit 64 bits (from 32,768 on at 64
    components) count as that bound. Repeated rows are coded each. Input
    columns named like results are replaced, others are kept. A table without
    usable rows gives no rows and no codebooks.
    """
    kept = [c for c in keep or df.columns if c.lower() not in ("code", "error")]
    good = df.where(usable(F.col(vector)))
    components = F.transform(F.col(vector), lambda v: v.cast("double")).alias("vector")
    head = good.select(F.col(key), components).orderBy(F.col(key).asc_nulls_last(), "vector").limit(entries).collect()
    nothing = {"code": F.lit(None).cast("string"), "error": F.lit(None).cast("bigint")}
    if not head:
        return good.select(*kept).withColumns(nothing), None
    dim = len(head[0][1])
    odd = good.where(F.size(vector) != dim).select(*kept)
    if not dim or dim % parts:
        return good.select(*kept).withColumns(nothing), None
    start = _whole(np.array([r[1] for r in head if len(r[1]) == dim], np.float64).reshape(-1, dim), dim)
    first = Codebooks(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2).copy())

    packed = good.where(F.size(vector) == dim).select(F.struct(*kept).alias("row"), components)
    row = packed.schema["row"].dataType
    trees = T.ArrayType(T.ArrayType(T.BinaryType()))
    schema = T.StructType().add("rows", T.ArrayType(row)).add("whole", T.BinaryType()).add("trees", trees)
    blocks = write_through(packed.mapInArrow(lambda batches: _blocks(batches, dim, parts), schema), "vector-blocks")
    books = fit(blocks, first, dim, rounds)
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, whole, trees in zip(batch.column("rows"), batch.column("whole"), batch.column("trees")):
                codes, error = [], 0
                for p, points in enumerate(_points(whole.as_py(), dim, parts)):
                    _, _, nearest, off = assign(Tree.from_bytes(trees[p].as_py(), width), points, books.entries[p], members=True)
                    codes.append(nearest)
                    error = error + off
                text = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([rows.values, pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["row", "code", "error"])

    schema = T.StructType().add("row", row).add("code", T.StringType()).add("error", T.LongType())
    coded = blocks.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in kept], "code", "error")
    return coded.unionByName(odd.withColumns(nothing)), books
