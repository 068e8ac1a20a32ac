"""Score texts by a byte model learnt from the corpus, beside a word count baseline.

Counts cover all training texts, and every context that comes in them is a node.
The distinct grams of all texts (a byte and the five before) are one distributed
table; nodes of three bytes and more are grown where the grams of their last
three bytes lie, which are 2^24 at most whatever the size of the corpus. Only the
contexts of up to two bytes, of which there are 65,536 at most, go to all tasks.
Each distinct gram is priced once; slices of documents exchange their distinct
grams and words with buckets of both, packed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import context_trees as trees
from tidemark.llm.words import encode_words, hash_strings, mixed, slices, split_words
from tidemark.session import write_through

# Bytes of context by which nodes are grown; shorter contexts are known to every task.
GROWN = 3
# Distinct grams that one task grows, and that it holds in eightfold form at once.
TASK_GRAMS, CHUNK_GRAMS = 1 << 19, 1 << 16
# Characters of text for each bucket of words and grams.
BUCKET_CHARS = 6 << 20
END = "\n"

_LONG = pa.int64()
_PACKED = (
    "batch bigint, bucket int, words binary, counts binary, grams binary, logs binary, n_train bigint, n_distinct bigint, "
    "keys array<bigint>, held array<boolean>, text binary, offsets binary"
)
_NAMES = [f.split()[0] for f in _PACKED.split(", ")]
_KINDS = [_LONG, pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), _LONG, _LONG, pa.list_(_LONG), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
_SCORED = "key bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, n_bytes bigint, n_train bigint, n_distinct bigint"


def _joined(flat: pa.Array, starts: np.ndarray) -> pa.Array:
    """Each text as its words with one space between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), flat), " ")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of a task's texts with their counts in training texts, merged as they come."""
    codes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def merged() -> tuple[np.ndarray, np.ndarray]:
        distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
        return distinct, np.bincount(place, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)

    for batch in slices(batches):
        flat, starts = split_words(batch.column("text"))
        code, at = trees.grams(_joined(flat, starts))
        learn = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False), np.diff(at))
        code, place = trees.distinct_grams(code)
        codes.append(code)
        counts.append(np.bincount(place, weights=learn, minlength=len(code)).astype(np.int64))
        if sum(map(len, codes)) > 2_000_000:
            code, count = merged()
            if len(code) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], names=["code", "n"])
                code, count = code[:0], count[:0]
            codes, counts = [code], [count]
    code, count = merged()
    for at in range(0, len(code), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(code[at : at + 100_000]), pa.array(count[at : at + 100_000])], names=["code", "n"])


_GROWN = "code bigint, odds binary, key bigint, zeros double, ones double, below double"


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of grams sorted by their last bytes of context: the odds of each by the long contexts, and those contexts' sums by shorter ones."""
    held, size, limit = [], 0, CHUNK_GRAMS
    for batch in batches:
        held.append((batch.column("code").to_numpy(), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size < limit:
            continue
        code, count = (np.concatenate(x) for x in zip(*held))
        group = trees.context_key(code, GROWN)
        edges = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
        # The last group may go on in the next batch.
        last = int(edges[-1])
        at = 0
        while at < last:
            end = int(edges[max(np.searchsorted(edges, at + CHUNK_GRAMS, "right") - 1, np.searchsorted(edges, at, "right"))]) if at + CHUNK_GRAMS < last else last
            yield from _grown(code[at:end], count[at:end])
            at = end
        held, size = [(code[last:], count[last:])], len(code) - last
        limit = max(CHUNK_GRAMS, 2 * size)
    if size:
        yield from _grown(*(np.concatenate(x) for x in zip(*held)))


def _grown(code: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    learnt = count > 0
    layers, sums = {}, [np.empty(0, np.int64), *[np.empty(0)] * 3]
    if learnt.any():
        nodes = trees.tree_nodes(code[learnt], count[learnt].astype(np.float64), GROWN)
        layers = {d: (keys, (ones + 0.5) / (zeros + ones + 1), ends) for d, (keys, zeros, ones, _, ends) in nodes.items()}
        keys, zeros, ones, weighted, _ = nodes[GROWN]
        sums = trees.shorter(_parent(keys, GROWN - 1), zeros, ones, weighted)
    for at in range(0, len(code), 10_000):
        part = code[at : at + 10_000]
        odds = trees.mix(layers, part).astype(np.float32)
        empty = pa.nulls(len(part), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array([row.tobytes() for row in odds], pa.binary()), pa.nulls(len(part), _LONG), empty, empty, empty], names=[f.split()[0] for f in _GROWN.split(", ")]
        )
    n = len(sums[0])
    yield pa.RecordBatch.from_arrays([pa.nulls(n, _LONG), pa.nulls(n, pa.binary()), *map(pa.array, sums)], names=[f.split()[0] for f in _GROWN.split(", ")])


def _parent(keys: np.ndarray, depth: int) -> np.ndarray:
    return (keys >> 8 & ((1 << 8 * depth) - 1)) << 8 | keys & 255


def train(rows: DataFrame) -> tuple[DataFrame, dict[int, tuple]]:
    """Each distinct gram of ``text`` with its odds by long contexts, and the nodes of the short ones; learnt from rows that ``learn``."""
    total = write_through(rows.select("text", "learn").mapInArrow(_count_grams, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "grams")
    tasks = max(16, -(-total.count() // TASK_GRAMS))
    last = F.shiftright("code", 8).bitwiseAND((1 << 8 * GROWN) - 1)
    grown = write_through(total.repartition(tasks, last).sortWithinPartitions(last).mapInArrow(_grow, _GROWN), "grown")
    sums = grown.where("key is not null").groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()
    keys, zeros, ones, below = (sums[c].to_numpy() for c in ("key", "zeros", "ones", "below"))
    layers = {}
    for depth in range(GROWN - 1, -1, -1):
        keys, zeros, ones, below = trees.shorter(keys, zeros, ones, below)
        one, ends, weighted = trees.weigh(zeros, ones, below)
        layers[depth] = keys, one, ends
        keys, below = _parent(keys, depth - 1) if depth else keys, weighted
    return grown.where("code is not null").select("code", "odds"), layers


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    """By a hash of a gram's four oldest bytes: at most 65,536 grams go together, and numbers in a bucket lie close."""
    return (mixed((code >> 16).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _squeezed(codes: np.ndarray) -> bytes:
    """Sorted grams as zstd of their differences, first bytes first."""
    return pa.compress(np.diff(codes, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(codes) else b""


def _unsqueezed(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    plain = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(plain.reshape(8, n).T).view(np.int64).ravel())


def _price(buckets: int, layers: Broadcast):
    """Log10 of the probability of each distinct gram, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, held, size = layers.value, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                part = batch.slice(at, 50_000)
                code = part.column("code").to_numpy()
                odds = np.frombuffer(b"".join(part.column("odds").to_pylist()), np.float32).reshape(len(code), 8)
                held.append((code, np.log10(trees.mix(short, code, odds.astype(np.float64))).sum(1).astype(np.float32)))
                size += len(code)
            if size >= TASK_GRAMS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        code, log = (np.concatenate(x) for x in zip(*held))
        bucket = _bucket(code, buckets)
        order = np.argsort(bucket, kind="stable")
        code, log, edges = code[order], log[order], np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        rows = [
            (None, b, None, None, code[edges[b] : edges[b + 1]].tobytes(), log[edges[b] : edges[b + 1]].tobytes(), *[None] * 6)
            for b in range(buckets) if edges[b + 1] > edges[b]
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)

    return run


def _dealt(value: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Distinct values by bucket, each one's place in that order, and where each bucket begins."""
    order = np.lexsort((value, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return value[order], rank, np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()


def _dealt_grams(joined: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct grams by bucket, the place of each gram of the texts, where texts begin, and where buckets begin."""
    code, at = trees.grams(joined)
    distinct, place = trees.distinct_grams(code)
    distinct, rank, edges = _dealt(distinct, _bucket(distinct, buckets), buckets)
    return distinct, rank[place], at, edges


def _dealt_words(flat: pa.Array, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The same of words, as hashes, with an end after each text."""
    distinct, word = encode_words(flat)
    word = np.insert(word, starts[1:], len(distinct))
    value = hash_strings([*distinct, END])
    value, rank, edges = _dealt(value, (value % np.uint64(buckets)).astype(np.int64), buckets)
    return value, rank[word], starts + np.arange(len(starts)), edges


def _pack(buckets: int):
    """Per slice of documents: its distinct words by bucket with training counts, its distinct grams, and one row with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for seq, batch in enumerate(slices(batches)):
            flat, starts = split_words(batch.column("text"))
            joined = _joined(flat, starts)
            grams, _, _, gram_edges = _dealt_grams(joined, buckets)
            value, word, starts, edges = _dealt_words(flat, starts, buckets)
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            count = np.bincount(word[np.repeat(learn, np.diff(starts))], minlength=len(value)).astype(np.uint32)
            rows = []
            for b in range(buckets):
                here = grams[gram_edges[b] : gram_edges[b + 1]]
                if edges[b + 1] > edges[b] or len(here):
                    named = value[edges[b] : edges[b + 1]].tobytes(), count[edges[b] : edges[b + 1]].tobytes()
                    rows.append((task | seq, b, *named, _squeezed(here), None, len(here), *[None] * 5))
            data = joined.buffers()[2]
            rows.append((
                task | seq, (task >> 32 ^ seq * 7919) % buckets, *[None] * 6, batch.column("key").to_pylist(), batch.column("held_out").to_pylist(),
                pa.compress(data, codec="zstd", asbytes=True) if data else b"", np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1].tobytes(),
            ))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)

    return run


def _count(table: pa.Table) -> pa.Table:
    """In a bucket: training counts of all its words and logs of all its grams, sent back to each slice in its own order."""
    about, priced, table = (table.filter(pc.is_valid(table[c])) for c in ("keys", "logs", "words"))
    if not table.num_rows:
        return about
    words = [np.frombuffer(v, np.uint64) for v in table["words"].to_pylist()]
    counts = np.concatenate([np.frombuffer(v, np.uint32) for v in table["counts"].to_pylist()])
    distinct, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
    back = [part.astype(np.uint64).tobytes() for part in np.split(total[place], np.cumsum([len(w) for w in words])[:-1])]
    code, log = (np.concatenate([np.empty(0, kind), *(np.frombuffer(v, kind) for v in priced[c].to_pylist())]) for c, kind in (("grams", np.int64), ("logs", np.float32)))
    order = np.argsort(code, kind="stable")
    code, log = code[order], log[order]
    # Up to here ``n_train`` of such a row is its number of grams.
    logs = [log[np.searchsorted(code, _unsqueezed(v, n))].tobytes() for v, n in zip(table["grams"].to_pylist(), table["n_train"].to_pylist())]
    first = [None] * (len(back) - 1)
    new = {"words": [b""] * len(back), "counts": back, "grams": [b""] * len(back), "logs": logs, "n_train": [int(total.sum()), *first], "n_distinct": [int((total > 0).sum()), *first]}
    for name, values in new.items():
        at = _NAMES.index(name)
        table = table.set_column(at, name, pa.array(values, _KINDS[at]))
    return pa.concat_tables([about, table])


def _finish(buckets: int):
    """In a slice: each document's tokens, known tokens, sum of log10(count + 1), and log10 probability."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["keys"] is not None, r["bucket"]))
        about, rows = rows[-1], rows[:-1]
        offsets = np.frombuffer(about["offsets"], np.int32)
        data = pa.decompress(about["text"], decompressed_size=int(offsets[-1]), codec="zstd", asbytes=True) if about["text"] else b""
        joined = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(about["offsets"]), pa.py_buffer(data))
        _, word, starts, _ = _dealt_words(*split_words(joined), buckets)
        count = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
        log = np.concatenate(([0.0], np.cumsum(np.log10(count + 1.0)[word])))
        known = np.concatenate(([0], np.cumsum((count > 0)[word])))
        _, gram, at, _ = _dealt_grams(joined, buckets)
        priced = np.frombuffer(b"".join(r["logs"] for r in rows), np.float32)
        byte = np.concatenate(([0.0], np.cumsum(priced[gram], dtype=np.float64)))
        n = len(about["keys"])
        more = [(r["n_train"], r["n_distinct"]) for r in rows if r["n_train"] is not None]
        none = [None] * len(more)
        return pa.table({
            "key": pa.array(about["keys"] + none, _LONG), "held_out": pa.array(about["held"] + none, pa.bool_()),
            "n_tokens": pa.array(np.diff(starts).tolist() + none, _LONG), "n_known": pa.array((known[starts[1:]] - known[starts[:-1]]).tolist() + none, _LONG),
            "logs": pa.array((log[starts[1:]] - log[starts[:-1]]).tolist() + none, pa.float64()),
            "score": pa.array((byte[at[1:]] - byte[at[:-1]]).tolist() + none, pa.float64()), "n_bytes": pa.array(np.diff(at).tolist() + none, _LONG),
            "n_train": pa.array([None] * n + [a for a, _ in more], _LONG), "n_distinct": pa.array([None] * n + [b for _, b in more], _LONG),
        })

    return run


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Rows where ``held_out`` is not true are learnt from. Tokens are words
    between ASCII white space, A-Z in lower case, and one end. ``score`` is the
    log10 probability of a text's words with one space between and an end byte,
    by the context trees; ``bits_per_byte`` is the code length that this gives
    each of these bytes. Null and empty texts have the end token only; repeated
    rows count and are scored each; a null key is kept; with nothing to learn
    from, every decision has probability one half.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = rows.withColumn("learn", ~F.col("held_out"))
    grams, short = train(rows)
    layers = docs.sparkSession.sparkContext.broadcast(short)
    chars = rows.select(F.sum(F.length("text")).alias("n")).first().n or 0
    buckets = max(16, -(-chars // BUCKET_CHARS))
    dealt = rows.mapInArrow(_pack(buckets), _PACKED).unionByName(grams.mapInArrow(_price(buckets, layers), _PACKED))
    counted = dealt.groupBy("bucket").applyInArrow(_count, _PACKED)
    scored = write_through(counted.groupBy("batch").applyInArrow(_finish(buckets), _SCORED), "scored")
    known = scored.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("v")).first()
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(known.n + known.v + 1)))
    return scored.where("n_tokens is not null").select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(known.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (F.col("score") * F.lit(-log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
