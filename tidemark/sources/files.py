"""One file per entity: listed by path and size, dealt to tasks by bytes, read and written inside tasks.

Only paths and sizes are joined, filtered and shuffled. Files are packed in
order of their ids into tasks of about ``TASK_BYTES``, by a running sum of
sizes, and a task reads its files block by block, so neither many small files
nor one large file fills its memory. Tasks open files by their URI; local paths,
HDFS and object stores work as pyarrow knows them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import number_rows

# Fixed value: numbered files are named after their entity, and by nothing else.
STEM = r"([^/]+)\.csv$"
TASK_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20


def file_id(column: str, strict_names: bool) -> Column:
    """The number a file is named after; of other names an error, or null."""
    stem = F.regexp_extract(column, STEM, 1)
    return stem.cast("int") if strict_names else stem.try_cast("int")


def list_files(spark: SparkSession, path: str, ids: tuple[int, int] | None = None, strict_names: bool = True) -> DataFrame:
    """``seq_id, path, bytes`` of the ``<id>.csv`` files of a folder; no content is read.

    ``ids`` is an inclusive range. A name that is no number raises, or is left
    out with ``strict_names`` off.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    files = listed.select(file_id("path", strict_names).alias("seq_id"), "path", F.col("length").alias("bytes"))
    files = files.where(F.col("seq_id").isNotNull())
    return files if ids is None else files.where(F.col("seq_id").between(*ids))


def pair_files(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``seq_id, features_path, labels_path, bytes`` of files with one name on both sides."""
    left = features.select("seq_id", F.col("path").alias("features_path"), F.col("bytes").alias("features_bytes"))
    right = labels.select("seq_id", F.col("path").alias("labels_path"), F.col("bytes").alias("labels_bytes"))
    bytes_of = (F.col("features_bytes") + F.col("labels_bytes")).alias("bytes")
    return left.join(right, "seq_id").select("seq_id", "features_path", "labels_path", bytes_of)


def pack_files(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The same rows, dealt to as many tasks as their bytes fill, in order of ids.

    A task's files start in the same ``task_bytes`` of the running sum, so it
    reads no more than that and its last file.
    """
    paths = [c for c in files.columns if c.endswith("path")]
    # An empty file takes room too, or any number of them would come to one task.
    room = F.greatest(F.col("bytes"), F.lit(1024)).alias("room")
    numbered = number_rows(files.select("*", room), [], ["seq_id", *paths], running=["room"]).rows
    packed = numbered.withColumn("task", F.floor(F.col("room_before") / task_bytes).cast("int"))
    last = packed.agg(F.max("task")).first()[0]
    columns = [F.col(c) for c in files.columns]
    if last is None:
        return packed.select(*columns)
    return packed.repartitionById(last + 1, F.col("task")).sortWithinPartitions("seq_id").select(*columns)


def open_uri(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    local = re.match(r"(?:file:)?(?://(?=/))?(/.*)", path)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class LineFormat:
    """How the lines of a file are read: the first cells are the columns.

    Blank lines are no rows. Lines with fewer cells than columns raise; so do
    lines that don't have ``width`` cells, where it is given.
    """

    columns: tuple[str, ...]
    skip_lines: int = 0
    delimiter: str = ","
    width: int | None = None

    def blocks(self, path: str) -> Iterator[list[np.ndarray]]:
        """The file's values column by column, some thousand lines at a time."""
        system, inside = open_uri(path)
        skip, rest = self.skip_lines, b""
        with system.open_input_stream(inside) as stream:
            while True:
                read = stream.read(BLOCK_BYTES)
                whole, cut, left = (rest + read).rpartition(b"\n") if read else (rest, b"", b"")
                if read and not cut:
                    rest = left
                    continue
                rest = left
                while skip and whole:
                    whole = whole.partition(b"\n")[2]
                    skip -= 1
                values = self._values(whole, path)
                if values is not None:
                    yield values
                if not read:
                    return

    def _values(self, text: bytes, path: str) -> list[np.ndarray] | None:
        lines = pc.split_pattern(pa.array([text.decode()]), "\n").flatten()
        lines = pc.utf8_trim_whitespace(lines)
        lines = lines.filter(pc.greater(pc.binary_length(lines), 0))
        if not len(lines):
            return None
        cells = pc.split_pattern(lines, self.delimiter)
        counts = pc.list_value_length(cells).to_numpy()
        if counts.min() < len(self.columns) or (self.width is not None and (counts != self.width).any()):
            raise ValueError(f"{path}: lines of {counts.min()} to {counts.max()} cells, expected {self.width or len(self.columns)}")
        flat, starts = pc.utf8_trim_whitespace(cells.flatten()), np.concatenate(([0], np.cumsum(counts)[:-1]))
        return [flat.take(pa.array(starts + i)).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(len(self.columns))]


def _rows(files: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in files:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def _schema(columns: Sequence[str]) -> T.StructType:
    schema = T.StructType().add("seq_id", T.IntegerType()).add("step", T.IntegerType())
    for name in columns:
        schema = schema.add(name, T.DoubleType())
    return schema


def _numbered(seq_id: int, step: int, values: list[np.ndarray]) -> list[pa.Array]:
    n = len(values[0])
    return [pa.array(np.full(n, seq_id, np.int32)), pa.array(np.arange(step, step + n, dtype=np.int32)), *map(pa.array, values)]


def read_rows(files: DataFrame, lines: LineFormat) -> DataFrame:
    """``seq_id, step, columns`` of packed files; step counts a file's rows from 0."""
    names = ["seq_id", "step", *lines.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq_id, path in _rows(batches, "seq_id", "path"):
            step = 0
            for values in lines.blocks(path):
                yield pa.RecordBatch.from_arrays(_numbered(seq_id, step, values), names=names)
                step += len(values[0])

    return files.select("seq_id", "path").mapInArrow(run, _schema(lines.columns))


def read_aligned(pairs: DataFrame, lines: LineFormat, labels: LineFormat) -> DataFrame:
    """``seq_id, step, columns, label, label_mask`` of packed pairs of files.

    The label file's first value is the class of the sequence; it stands on the
    sequence's last row, which alone has mask 1. A sequence without rows gives
    none; an empty label file raises.
    """
    schema = _schema(lines.columns).add("label", T.IntegerType()).add("label_mask", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq_id, features_path, labels_path in _rows(batches, "seq_id", "features_path", "labels_path"):
            first = next(labels.blocks(labels_path), None)
            if first is None:
                raise ValueError(f"{labels_path} has no label")
            blocks = lines.blocks(features_path)
            step, values = 0, next(blocks, None)
            while values is not None:
                after, n = next(blocks, None), len(values[0])
                last = np.zeros(n, bool)
                last[-1] = after is None
                label = pa.array(np.full(n, int(first[0][0]), np.int32), mask=~last)
                yield pa.RecordBatch.from_arrays([*_numbered(seq_id, step, values), label, pa.array(last.astype(np.int32))], names=schema.names)
                step, values = step + n, after

    return pairs.select("seq_id", "features_path", "labels_path").mapInArrow(run, schema)


def read_contents(pairs: DataFrame) -> DataFrame:
    """``seq_id, features_path, features, labels_path, labels``: the bytes of packed pairs of files."""

    def content(path: str) -> bytes:
        system, inside = open_uri(path)
        with system.open_input_stream(inside) as stream:
            return stream.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq_id, features, labels in _rows(batches, "seq_id", "features_path", "labels_path"):
            row = {"seq_id": seq_id, "features_path": features, "features": content(features), "labels_path": labels, "labels": content(labels)}
            yield pa.RecordBatch.from_pylist([row], schema)

    kinds = {"seq_id": pa.int32(), "features_path": pa.string(), "features": pa.binary(), "labels_path": pa.string(), "labels": pa.binary()}
    schema = pa.schema(list(kinds.items()))
    types = "seq_id int, features_path string, features binary, labels_path string, labels binary"
    return pairs.select("seq_id", "features_path", "labels_path").mapInArrow(run, types)


def write_files(df: DataFrame, path: str, key: str, order: Sequence[str], columns: Sequence[str], delimiter: str = ",", header: bool = False) -> int:
    """Write each entity's rows, in order, as ``<key>.csv``, and return the number of files.

    A file is written under another name and then renamed, so a task that is
    run again replaces it as a whole. Rows without a key are left out. Numbers
    are written so that they read back the same.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"cell{i}") for i, c in enumerate(columns)])
    sort = ["key", *[f"order{i}" for i in range(len(order))]]
    head = (delimiter.join(columns) + "\n").encode() if header else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_uri(path)
        system.create_dir(folder, recursive=True)
        at, out, part, n = None, None, "", 0
        for batch in batches:
            keys = batch.column("key").to_pylist()
            cells = [batch.column(f"cell{i}").to_pylist() for i in range(len(columns))]
            for k, *values in zip(keys, *cells):
                if out is None or k != at:
                    if out is not None:
                        out.close()
                        system.move(part, f"{folder}/{at}.csv")
                    at, part, n = k, f"{folder}/.{uuid.uuid4().hex}", n + 1
                    out = system.open_output_stream(part)
                    out.write(head)
                out.write((delimiter.join("" if v is None else repr(v) if isinstance(v, float) else str(v) for v in values) + "\n").encode())
        if out is not None:
            out.close()
            system.move(part, f"{folder}/{at}.csv")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    together = rows.repartition("key").sortWithinPartitions(*sort)
    return together.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
