"""Token ids of documents in files of wavelet matrices, and what can be read from them."""

from __future__ import annotations

import importlib
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.wavelet import WaveletMatrix
from tidemark.llm.words import slices
from tidemark.session import new_folder

# Ids in a shard, the row of a file; a shard closes after the document that fills it.
SHARD_IDS = 1 << 20
# Characters of text in a task's part, the file.
PART_CHARS = 16 << 20
END_ID = 0
# Text encoded at once; the more, the fewer pieces come twice.
SLICE_BYTES = 6 << 20
# Parts of text whose ids a task keeps before it begins anew, and parts that are encoded as one text.
KEPT_PARTS = 200_000
GROUP_PARTS = 256

SHARD = (
    "part int, seq int, first bigint, n bigint, bits int, zeros array<int>, planes array<binary>, ranks array<binary>, "
    "keys array<bigint>, ends array<int>"
)
_SHARD_ARROW = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("bits", pa.int32()), ("zeros", pa.list_(pa.int32())),
    ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("keys", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())),
])


# What a byte is to the places where a text may be cut.
_LETTER, _STOP, _SPACE, _NEWLINE, _OTHER, _FOREIGN, _UNSURE = range(1, 8)


def _byte_kinds() -> np.ndarray:
    """ASCII letters, full stops and their like, white space, other ASCII; first bytes of characters of which some are white space are unsure."""
    kinds = np.full(256, _FOREIGN, np.uint8)
    kinds[:0x80] = _OTHER
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
    kinds[list(b".,;:!?")] = _STOP
    kinds[[*range(0x09, 0x0E), *range(0x1C, 0x20), *range(0x80, 0xC0), 0xC2, 0xE1, 0xE2, 0xE3]] = _UNSURE
    kinds[0x0A], kinds[0x20] = _NEWLINE, _SPACE
    return kinds


_KINDS = _byte_kinds()


def cut_places(data: np.ndarray) -> np.ndarray:
    """True at each byte that a byte-level pattern always begins a new piece at, if no text begins or ends around there.

    That is a space that no white space follows, a stop or line feed after a
    letter, and a letter after a single line feed. What the pattern makes of the
    parts on both sides doesn't change by the cut, and no special token is cut.
    """
    kind = _KINDS[data]
    cut = np.zeros(len(data), bool)
    solid = (kind == _LETTER) | (kind == _STOP) | (kind == _OTHER)
    cut[:-1] = (kind[:-1] == _SPACE) & (solid[1:] | (kind[1:] == _FOREIGN))
    cut[1:] |= ((kind[1:] == _STOP) | (kind[1:] == _NEWLINE)) & (kind[:-1] == _LETTER)
    cut[2:] |= (kind[2:] == _LETTER) & (kind[1:-1] == _NEWLINE) & solid[:-2]
    return cut


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies on this machine."""
    return importlib.import_module("public_tokenizers").path(name)


class _Encoder:
    """Byte-level BPE ids of whole texts as the tokenizer gives them, each distinct part of text encoded once.

    Texts are cut where the tokenizer's pattern always begins a new piece.
    Parts that were met before are looked up: ``known`` texts, their ids one
    after the other in ``ids``, and where each one's begin in ``at``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(1, int(max(vocab.values())).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        # Ids that begin with a space, one of which every part but a text's first begins with.
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        self.forget()

    def forget(self) -> None:
        """Let go of all parts."""
        self.known, self.ids, self.at = pa.array([], pa.string()), np.empty(0, self.kind), np.zeros(1, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and where each text's begin."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        at = np.concatenate(([0], np.cumsum([len(x) for x in coded], dtype=np.int64)))
        return np.fromiter(chain.from_iterable(coded), self.kind, int(at[-1])), at

    def _spaced(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded``, for parts that begin with a space. Many are encoded as one text, whose ids show where each part begins."""
        groups = [parts[i : i + GROUP_PARTS] for i in range(0, len(parts), GROUP_PARTS)]
        ids, at = self._encoded(["".join(g) for g in groups])
        out, sizes = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for g, a, b in zip(groups, at[:-1], at[1:]):
            mine = ids[a:b]
            begins = np.flatnonzero(self.opens[mine])
            if len(begins) != len(g):
                # Some part holds another id that begins with a space.
                mine, each = self._encoded(g)
                begins = each[:-1]
            out.append(mine)
            sizes.append(np.diff(begins, append=len(mine)))
        return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))

    def _look_up(self, parts: pa.Array) -> np.ndarray:
        """Each part's place among the known ones; new ones are encoded and become known."""
        if len(self.known) > KEPT_PARTS:
            self.forget()
        found = pc.index_in(parts, value_set=self.known)
        if found.null_count:
            new = parts.filter(found.is_null()).unique()
            spaced = pc.starts_with(new, " ")
            for some, encode in ((new.filter(spaced), self._spaced), (new.filter(pc.invert(spaced)), self._encoded)):
                ids, at = encode(some.to_pylist())
                self.known = pa.concat_arrays([self.known, some])
                self.at = np.concatenate((self.at, at[1:] + len(self.ids)))
                self.ids = np.concatenate((self.ids, ids))
            found = pc.index_in(parts, value_set=self.known)
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and where each text's ids begin."""
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        cut = cut_places(data) if len(data) > 2 else np.zeros(len(data), bool)
        # What stands around a text's ends belongs to other texts: no cut is made there, but for the ends themselves.
        first = offsets[:-1][offsets[1:] > offsets[:-1]]
        for near in (first - 1, first + 1):
            cut[near[(near >= 0) & (near < len(data))]] = False
        cut[first] = True
        begins = np.flatnonzero(cut)
        parts = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(data))
        code = self._look_up(parts)
        starts = np.searchsorted(begins, offsets)
        ids = np.append(self.ids, self.kind(END_ID))
        code = np.insert(code, starts[1:], len(self.known))
        length = np.append(np.diff(self.at), 1)[code]
        out_at = np.concatenate(([0], np.cumsum(length)))
        take = np.repeat((self.at[code] - out_at[:-1]).astype(np.int32), length)
        take += np.arange(len(take), dtype=np.int32)
        return ids[take], out_at[starts + np.arange(len(starts))]


def _encoder(path: str) -> _Encoder:
    """One per worker process; from task to task it keeps the tokenizer, which takes long to load, but no parts."""
    kept = sys.modules.setdefault("tidemark_worker_state", types.ModuleType("tidemark_worker_state")).__dict__
    if ("encoder", path) not in kept:
        kept["encoder", path] = _Encoder(path)
    return kept["encoder", path]


def _shard(part: int, seq: int, first: int, ids: list[np.ndarray], bits: int, keys: list, ends: list[np.ndarray]) -> pa.RecordBatch:
    matrix = WaveletMatrix.build(np.concatenate(ids), bits)
    row = {
        "part": part, "seq": seq, "first": first, "n": matrix.n, "bits": bits, "zeros": matrix.zeros,
        "planes": [p.tobytes() for p in matrix.planes], "ranks": [r.tobytes() for r in matrix.ranks],
        "keys": keys, "ends": np.concatenate(ends).tolist(),
    }
    return pa.RecordBatch.from_pylist([row], _SHARD_ARROW)


def write(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Write the ids of all texts, in ascending order of keys, and return the folder.

    Each text's ids are followed by the end id 0. Null texts count as empty,
    null keys come last, repeated rows are written each; rows of one key are
    ordered by a hash of their text, so one frequent key is split too. A part is
    one file; each of its rows is a shard, a wavelet matrix of about
    ``SHARD_IDS`` ids with the keys and ends of its documents. Every task holds
    one shard at a time.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = rows.select(F.sum(F.length("text")).alias("n")).first().n or 0
    order = [F.col("key").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(max(1, -(-chars // PART_CHARS)), *order).sortWithinPartitions(*order)
    path = tokenizer_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        seq, first, held, ids, keys, ends = 0, 0, 0, [], [], []
        for batch in slices(batches, size=SLICE_BYTES, rows=10_000):
            flat, at = encoder.encode(batch.column("text"))
            names = batch.column("key").to_pylist()
            done = 0
            while done < len(names):
                # As many documents as fill the shard, the one that fills it included.
                stop = min(len(names), int(np.searchsorted(at, at[done] + SHARD_IDS - held)))
                stop = max(stop, done + 1)
                ids.append(flat[at[done] : at[stop]])
                ends.append(at[done + 1 : stop + 1] - at[done] + held)
                keys += names[done:stop]
                held += int(at[stop] - at[done])
                done = stop
                if held >= SHARD_IDS:
                    yield _shard(part, seq, first, ids, encoder.bits, keys, ends)
                    seq, first, held, ids, keys, ends = seq + 1, first + held, 0, [], [], []
        encoder.forget()
        if keys:
            yield _shard(part, seq, first, ids, encoder.bits, keys, ends)

    rows.mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(folder)
    return folder


def shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(folder)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n"], row["planes"], row["ranks"], row["zeros"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def offsets(spark: SparkSession, folder: str) -> DataFrame:
    """``part, before``: ids in all earlier parts. One row per part."""
    parts = shards(spark, folder).groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``key, start, n_tokens, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = _matrix(row).decode().astype("<u4")
            ends = np.array(row["ends"], np.int64)
            begin = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["keys"], pa.int64()), pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(begin + row["first"]), pa.array(ends - begin), pa.array(crc, pa.int64())],
                names=["key", "part", "start", "n_tokens", "ids_crc32"],
            )

    rows = shards(spark, folder).mapInArrow(run, "key bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint")
    joined = rows.join(offsets(spark, folder), "part")
    return joined.select("key", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def count(spark: SparkSession, folder: str, token: int) -> int:
    """Occurrences of a token in all files, by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_matrix(row).rank(token)], pa.int64())], names=["n"])

    return shards(spark, folder).mapInArrow(run, "n bigint").select(F.sum("n")).first()[0] or 0


def locate(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """``position`` of each occurrence of a token among all ids, by select."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            matrix = _matrix(row)
            at = np.array([matrix.select(token, k) for k in range(matrix.rank(token))], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["part"], np.int32)), pa.array(at + row["first"])], names=["part", "at"])

    rows = shards(spark, folder).mapInArrow(run, "part int, at bigint")
    return rows.join(offsets(spark, folder), "part").select((F.col("at") + F.col("before")).alias("position"))
