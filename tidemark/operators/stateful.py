"""Scoring with a state that is carried along each series, in batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.affine_scan import affine_states, exponential, trend
from tidemark.operators.ordering import Ordered


def exponential_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float, restart: str | None = None) -> DataFrame:
    """The rows with ``state``, the exponential mean up to and including each row."""
    return affine_states(df, keys, order, value, exponential(alpha), restart)


def trend_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float, beta: float, restart: str | None = None) -> DataFrame:
    """The rows with ``level`` and ``trend`` up to and including each row; their sum is the forecast of the next."""
    return affine_states(df, keys, order, value, trend(alpha, beta), restart)


def forecast_from_state(ordered: Ordered, feature: str, alpha: float, beta: float) -> DataFrame:
    """Rows of scaled, time-split series with ``<feature>_predict``, the forecast of the row after each, in original units.

    The state is learnt on the train rows' scale and passes from the last train
    row into the test rows without a break.
    """
    scored = trend_state(ordered.rows, ordered.keys, ordered.order, f"{feature}_scaled", alpha, beta)
    ahead: Column = F.col("level") + F.col("trend")
    return scored.withColumn(f"{feature}_predict", C.undo_min_max(ahead, F.col(f"{feature}_min"), F.col(f"{feature}_max")))
