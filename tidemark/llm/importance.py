"""Documents drawn by how like a target they are: hashed n-grams, gains per bucket, seeded noise.

Texts are cut into lines. Of all documents together each distinct line's
features are counted once and multiplied by how often the line occurs; runs of
words that reach over a line's end are counted beside that. Weighing goes the
same way inside a task's slice: distinct lines once, then the runs over borders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.ngram_buckets import Words
from tidemark.llm.words import slices
from tidemark.operators.ordering import number_rows
from tidemark.session import write_through

BUCKETS = 10_000
LONGEST = 3
# Rows that one task puts in order; the number of tasks grows with the rows.
SORT_ROWS = 1 << 15


def _segments(batches: Iterator[pa.RecordBatch], text: str, buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Distinct lines of each slice with their number, and at the end the counts of runs over borders."""
    over = np.zeros(buckets, np.int64)
    for batch in slices(batches, column=text):
        words = Words(batch.column(text))
        lines, _ = words.lines()
        coded = lines.dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.cast(pa.string()), pa.nulls(len(n), pa.int32()), pa.array(n.astype(np.int64))], names=["line", "bucket", "n"]
        )
        crc, _ = words.grams(longest, words.text, words.line)
        over += np.bincount(crc % buckets, minlength=buckets)
    used = np.flatnonzero(over)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.string()), pa.array(used, pa.int32()), pa.array(over[used])], names=["line", "bucket", "n"])


def _count_segments(batches: Iterator[pa.RecordBatch], buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Features of distinct lines times their number, and the other counts as they are."""
    total = np.zeros(buckets, np.int64)
    for batch in slices(batches, column="line"):
        n = batch.column("n").to_numpy()
        words = Words(batch.column("line"))
        crc, first = words.grams(longest, words.text)
        # In doubles, exact up to 2**53; a slice stays far below that.
        total += np.bincount(crc % buckets, weights=n[words.text[first]], minlength=buckets).astype(np.int64)
        over = batch.column("line").is_null().to_numpy(zero_copy_only=False)
        total += np.bincount(batch.column("bucket").fill_null(0).to_numpy()[over], weights=n[over], minlength=buckets).astype(np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket. ``buckets`` numbers are collected, no more."""
    found = df.select(F.col(text).alias("text")).where("text is not null").mapInArrow(lambda b: _segments(b, "text", buckets, longest), "line string, bucket int, n bigint")
    distinct = found.groupBy("line", "bucket").agg(F.sum("n").alias("n"))
    counted = distinct.mapInArrow(lambda b: _count_segments(b, buckets, longest), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) per bucket."""
    s, t, b = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log(float((tk + 1) * (s + b)) / float((sk + 1) * (t + b)))) for sk, tk in zip(raw.tolist(), target.tolist())], np.int64)


def _weights(texts: pa.Array, gains: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed gains of each text."""
    words = Words(texts)
    n_words = np.bincount(words.text, minlength=len(texts))
    lines, owner = words.lines()
    coded = lines.dictionary_encode()
    distinct = Words(coded.dictionary)
    crc, first = distinct.grams(longest, distinct.text)
    of_line = np.bincount(distinct.text[first], weights=gains[crc % len(gains)], minlength=len(coded.dictionary))
    weight = np.bincount(owner, weights=of_line[coded.indices.to_numpy()], minlength=len(texts))
    crc, first = words.grams(longest, words.text, words.line)
    weight += np.bincount(words.text[first], weights=gains[crc % len(gains)], minlength=len(texts))
    return n_words, np.rint(weight).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", longest: int = LONGEST, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (or all) with ``n_words, n_features, weight``.

    Null texts and texts without words have no features and weight 0. Input
    columns named like results are replaced.
    """
    new = ["n_words", "n_features", "weight"]
    kept = [c for c in keep or docs.columns if c.lower() not in new]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, weight = _weights(batch.column("text"), gains, longest)
            features = sum(np.maximum(n - k, 0) for k in range(longest))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(x.astype(np.int64)) for x in (n, features, weight)]], names=["row", *new])

    schema = T.StructType().add(rows.schema["row"])
    for c in new:
        schema = schema.add(c, T.LongType())
    return rows.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in kept], *new)


def noise(key: Column, seed: int = 42) -> Column:
    """floor(1000 times a Gumbel number) that follows from seed and key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Each document's key with ``n_words, n_features, weight, score, rank``.

    Of the N documents of ``least_words`` words or more the floor(percent * N /
    100) best scores are drawn and ranked 1, 2, 3, ...; ties go to the smaller
    key, null keys come last; rows that agree in key and score are
    interchangeable. Others have a null rank. An empty target gives a bucket the
    gain of its rarity alone; an empty table gives no rows. Texts stay where
    they are: distinct lines are shuffled for the counts, and a few numbers per
    document for the ranks.
    """
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    weighed = weigh(docs.select(F.col(key), F.col(text)), gains, text, keep=[key])
    scored = weighed.withColumn("score", (F.col("weight") + noise(F.col(key), seed)).cast("long"))
    scored = write_through(scored, "scored")
    drawn = percent * scored.where(F.col("n_words") >= least_words).count() // 100
    ways = {"down_": -F.col("score"), "short_": F.col("n_words") < least_words, "lost_": F.col(key).isNull()}
    ranked = number_rows(scored.withColumns(ways), [], ["short_", "down_", "lost_", key, "n_features"], chunk_rows=SORT_ROWS).rows
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1).cast("long")
    return ranked.select(key, "n_words", "n_features", "weight", "score", rank.alias("rank"))
