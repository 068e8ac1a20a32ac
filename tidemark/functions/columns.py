"""Column expressions shared by the operators. All run inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The column order of a bar file, the order in which bars are
# assembled into a vector, and the choices of forecast target.
BAR_FEATURES = ["open", "close", "low", "high", "volume"]
VECTOR_FEATURES = ["open", "low", "high", "volume", "close"]
TARGETS = ["OPEN", "CLOSE", "LOW", "HIGH", "VOLUME", "ALL"]


def target_columns(target: str) -> list[str]:
    """Columns to forecast: one feature, or all of them."""
    if target not in TARGETS:
        raise ValueError(f"target must be one of {TARGETS}, not {target!r}")
    return list(BAR_FEATURES) if target == "ALL" else [target.lower()]


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a constant column becomes 0.5, as in Spark ML."""
    return F.when(high == low, x * 0 + 0.5).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def undo_min_max(scaled: Column, low: Column, high: Column) -> Column:
    return scaled * (high - low) + low


def standard(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std; a constant column becomes 0, as in Spark ML."""
    return F.when(std == 0, x * 0).otherwise((x - mean) / F.nullif(std, F.lit(0.0)))


def undo_standard(scaled: Column, mean: Column, std: Column) -> Column:
    return scaled * std + mean


def ratio(top: Column, bottom: Column) -> Column:
    """Double division; null where the denominator is 0."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def train_length(n_rows: Column, share: float) -> Column:
    """Share of a row count, rounded half up."""
    return F.floor(n_rows * F.lit(share) + 0.5)


def hash_key(seed: int, *ids: str) -> Column:
    """A hash that depends on the seed and the id alone, not on partitions."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def block_label(line_no: Column, block: int = 100) -> Column:
    """Class of a line when classes come in blocks of equal length."""
    return F.floor(line_no / F.lit(block)).cast("int")


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == label).cast("int"))


def unpivot_features(columns: Sequence[str], name: str = "feature", value: str = "value") -> Column:
    """Explode expression: one (name, value) struct per column."""
    return F.explode(
        F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    )


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)
