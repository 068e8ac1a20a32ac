"""One-step-ahead forecasts with a closed-form model per series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.ordering import Ordered, number_rows
from tidemark.operators.scaling import scale_series
from tidemark.operators.splitting import split_by_time
from tidemark.operators.windowing import LENGTH, last_steps


def fit_next_step(ordered: Ordered, features: Sequence[str]) -> Ordered:
    """Least squares of the next scaled value on the current one, on train pairs.

    Needs ``<f>_scaled`` and ``next_<f>``; adds ``<f>_slope`` and
    ``<f>_intercept`` to every row of the series.
    """
    pair = F.col("pos") + 1 < F.col("n_train")
    stats: dict[str, Column] = {}
    for f in features:
        x = F.when(pair, F.col(f"{f}_scaled"))
        y = F.when(pair, C.min_max(F.col(f"next_{f}"), F.col(f"{f}_min"), F.col(f"{f}_max")))
        stats[f"{f}_slope"] = F.regr_slope(y, x)
        stats[f"{f}_intercept"] = F.regr_intercept(y, x)
    return ordered.with_series_stats(stats)


def prepare(df: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str],
            share: float = 0.8, short: bool = False) -> Ordered:
    """Number, split by time, scale on the train range and fit. One shuffle."""
    numbered = number_rows(df, keys, order, next_of=features, short=short)
    split = split_by_time(numbered, share)
    train = F.col("split") == "train"
    return fit_next_step(scale_series(split, features, train), features)


def predict_next(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``<f>_predict``: the forecast of the next row, in original units."""
    return df.withColumns(
        {
            f"{f}_predict": C.undo_min_max(
                F.col(f"{f}_slope") * F.col(f"{f}_scaled") + F.col(f"{f}_intercept"),
                F.col(f"{f}_min"),
                F.col(f"{f}_max"),
            )
            for f in features
        }
    )


def unfitted_reason(feature: str) -> Column:
    """Why a series has no model of a feature; null where it has one."""
    return (
        F.when(F.col("n_train") < 3, "fewer than 3 train rows")
        .when(F.col(f"{feature}_max").isNull(), "no train values")
        .when(F.col(f"{feature}_max") <= F.col(f"{feature}_min"), "constant in train")
        .when(F.col(f"{feature}_slope").isNull(), "constant before the last train row")
    )


def fitted_series(features: Sequence[str]) -> Column:
    """True where any of the features has a model."""
    return reduce(or_, [unfitted_reason(f).isNull() for f in features])


def unfitted(ordered: Ordered, features: Sequence[str]) -> DataFrame:
    """(keys, feature, reason, n_rows): series and features without a model, once each."""
    reasons = F.array(*[F.struct(F.lit(f).alias("feature"), unfitted_reason(f).alias("reason")) for f in features])
    first = ordered.rows.where(F.col("pos") == 0).select(*ordered.keys, "n_rows", F.inline(reasons))
    return first.where(F.col("reason").isNotNull()).select(*ordered.keys, "feature", "reason", "n_rows")


def forecast_test_rows(ordered: Ordered, features: Sequence[str]) -> DataFrame:
    """Forecast and actual for every test row, the first one made from the last train row."""
    to_test = (F.col("pos") + 1 >= F.col("n_train")) & (F.col("pos") + 1 < F.col("n_rows"))
    scored = predict_next(ordered.rows.where(to_test & fitted_series(features)), features)
    return long_pairs(scored.withColumn("idx", F.col("pos") + 1 - F.col("n_train")), ordered.keys, features)


def forecast_test_windows(ordered: Ordered, features: Sequence[str], length: int = LENGTH) -> DataFrame:
    """Forecast and actual for the row after each test window."""
    test = ordered.rows.where((F.col("split") == "test") & fitted_series(features)).withColumns(
        {"pos": F.col("pos") - F.col("n_train"), "n_rows": F.col("n_rows") - F.col("n_train")}
    )
    scored = predict_next(last_steps(test, length), features)
    return long_pairs(scored.withColumnRenamed("window_id", "idx"), ordered.keys, features)


def long_pairs(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, idx, feature, predict, actual), one row per feature that has a model."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.col(f"{f}_predict").alias("predict"), F.col(f"next_{f}").alias("actual"),
                (unfitted_reason(f).isNull() if f"{f}_slope" in df.columns else F.lit(True)).alias("has_model"),
            )
            for f in features
        ]
    )
    return df.select(*keys, "idx", F.inline(pairs)).where("has_model").drop("has_model")
