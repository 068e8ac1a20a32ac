"""Words and shingles of whole texts, column-wise inside tasks, and native word columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Text that a task holds in its working form at once; a longer text comes alone.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 2000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are.

    ``lower`` is far quicker and says the same where all characters are ASCII.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(name: str, columns: list[str]) -> str:
    """The name, longer if need be, so that none of the columns has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let text go to Python workers, and come back, a few megabytes at a time.

    A setting of the session, for operators whose rows carry whole texts: by
    default a batch holds up to 64 MB, several times over in both processes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of a few megabytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > size or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
    give_back()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and where each text's words begin (one more offset than texts)."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), before[starts]


def encode_words(flat: pa.Array) -> tuple[list[str], np.ndarray]:
    """Distinct words, and for each word its place among them."""
    coded = flat.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def hash_strings(values: list[str], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v.encode(), seed) for v in values), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all of its bits can be used."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


# Odd multipliers, one for each place in a shingle.
_PLACES = np.random.default_rng(20240229).integers(1 << 62, 1 << 63, 64).astype(np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted 64-bit hashes.

    A text with fewer words than ``width`` has its whole sequence as one
    shingle; one without words has none.
    """
    flat, starts = split_words(texts)
    distinct, code = encode_words(flat)
    words = hash_strings(distinct)[code] if len(distinct) else np.empty(0, np.uint64)
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        whole += words[j : j + len(whole)] * _PLACES[j]
    whole = mixed(whole)
    sets = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * _PLACES[: b - a]).sum(keepdims=True, dtype=np.uint64)
            sets.append(mixed(short + _PLACES[width + b - a : width + b - a + 1]))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
