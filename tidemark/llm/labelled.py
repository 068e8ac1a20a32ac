"""A bounded sample of labelled rows, to fit a classifier on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, mod ``folds``; null for a null key."""
    return F.crc32(key.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, key: str = "doc_id", text: str = "text") -> pa.Table:
    """At most ``rows`` rows of ``text, label``, chosen by a hash of their keys among those to ``learn`` from.

    Null keys and labels are no labels; of several labels of a key the largest
    counts. Two keyed tables of ``rows`` rows at most are all that is collected.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & learn)
    known = known.groupBy(F.col(key).alias("__k")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("__k", F.lit(11)), "__k").limit(rows)
    joined = docs.select(F.col(key).alias("__d"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("__d") == F.col("__k"))
    picked = joined.select("__k", "text", "label").orderBy(F.xxhash64("__k", F.lit(11)), F.xxhash64("text")).limit(rows)
    return picked.select("text", "label").toArrow()
