"""Series laid over one another on a common index; the output is a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predict_and_actual(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forecast rows as two named series over their index."""
    return pairs.unpivot([*keys, "idx"], ["predict", "actual"], "series_name", "value")


def shared_range(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole-number value range of both series, 2% wider than the data."""
    low = F.min(F.least("predict", "actual")) * 0.98
    high = F.max(F.greatest("predict", "actual")) * 1.02
    return pairs.groupBy(*keys).agg(low.cast("bigint").alias("range_min"), high.cast("bigint").alias("range_max"))


def train_actual_predicted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Train, actual and predicted series on one axis, in a single pass.

    A test row stands at the end of train minus one; its forecast, which is for
    the row after it, stands one further.
    """
    test_idx = F.col("pos") - F.col("n_train")
    point = lambda name, idx, v: F.struct(
        F.lit(name).alias("series_name"), idx.cast("long").alias("idx"), v.alias("value")
    )
    points = F.when(
        F.col("split") == "train", F.array(point("train", F.col("pos"), F.col(value)))
    ).otherwise(
        F.array(
            point("actual", test_idx + F.col("n_train") - 1, F.col(value)),
            point("predicted", test_idx + F.col("n_train"), F.col(f"{value}_predict")),
        )
    )
    return df.select(*keys, F.inline(points))
