"""Sliding windows over numbered rows.

All functions expect ``pos`` and ``n_rows``. Windows start at every row from 0
while ``start < n_rows - (length + 1)``; ``include_last`` adds the one window
more that would still have a next row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators.ordering import CHUNK, EVERYTHING, Ordered

LENGTH = 22
BLOCK_BATCHES = 1 << 16


def window_total(n_rows: Column, length: int = LENGTH, include_last: bool = False) -> Column:
    return F.greatest(n_rows - (length if include_last else length + 1), F.lit(0))


def to_windows(df: DataFrame, length: int = LENGTH, include_last: bool = False) -> DataFrame:
    """One row per (window, step): row p is step p - w of each window w over it.

    No self-join and no shuffle; each row is copied at most ``length`` times.
    """
    first = F.greatest(F.col("pos") - (length - 1), F.lit(0))
    last = F.least(F.col("pos"), window_total(F.col("n_rows"), length, include_last) - 1)
    return (
        df.where(last >= first)
        .withColumn("window_id", F.explode(F.sequence(first, last)))
        .withColumn("step", F.col("pos") - F.col("window_id"))
    )


def label_last_step(windows: DataFrame, label: str, length: int = LENGTH) -> DataFrame:
    """``label_raw``: the row after the window, on the window's last step only."""
    return windows.withColumn("label_raw", F.when(F.col("step") == length - 1, F.col(label)))


def last_steps(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """Only the last step of each window, without building the windows."""
    start = F.col("pos") - (length - 1)
    inside = (start >= 0) & (start < window_total(F.col("n_rows"), length))
    return df.where(inside).withColumn("window_id", start)


def batch_of(window_id: Column, size: int) -> Column:
    return F.floor(window_id / F.lit(size))


def count_windows(df: DataFrame, keys: Sequence[str], length: int = LENGTH) -> DataFrame:
    """Rows and windows per series, from a grouped count alone."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_windows", window_total(F.col("n_rows"), length)
    )


def batch_sizes(counts: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Windows per mini-batch; the last batch of a series may be short."""
    batches = F.ceil(F.col("n_windows") / F.lit(size))
    # In two steps, so that no array grows with a series: first blocks of batches, then each one's batches.
    blocks = F.floor((batches - 1) / F.lit(BLOCK_BATCHES))
    upto = F.least((F.col("_block") + 1) * BLOCK_BATCHES, batches) - 1
    return (
        counts.where(F.col("n_windows") > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
        .withColumn("batch_id", F.explode(F.sequence(F.col("_block") * BLOCK_BATCHES, upto)))
        .select(*keys, "batch_id", F.least(F.col("n_windows") - F.col("batch_id") * size, F.lit(size)).alias("n_examples"))
    )


def window_arrays(ordered: Ordered, columns: Sequence[str], length: int = LENGTH, block: int = 4096) -> DataFrame:
    """One row per window with its steps as ``ARRAY<STRUCT<columns>>``.

    Whole series use their existing partitioning. Rows of cut series go to
    blocks of ``block`` positions, and the first rows of a block are also sent
    to the block before it, so every window finds all its steps.
    """
    steps = F.collect_list(F.struct(*columns))
    starts = F.col("pos") < window_total(F.col("n_rows"), length)

    def frame(*group: str):
        return Window.partitionBy(*group).orderBy("pos").rowsBetween(0, length - 1)

    windows = ordered.whole.drop(EVERYTHING).withColumn("steps", steps.over(frame(*ordered.keys))).where(starts)
    if ordered.cut is not None:
        own = F.floor(F.col("pos") / F.lit(block))
        halo = (F.col("pos") % block < length - 1) & (own > 0)
        blocks = F.explode(F.when(halo, F.array(own - 1, own)).otherwise(F.array(own)))
        cut = (
            ordered.cut.withColumn("_block", blocks)
            .withColumn("steps", steps.over(frame(*ordered.keys, "_block")))
            .where(starts & (F.col("_block") == own))
        )
        windows = windows.unionByName(cut.drop("_block", CHUNK, EVERYTHING))
    return windows.withColumnRenamed("pos", "window_id")
