"""Fitting and applying scalers, and undoing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.joins import join_on_key
from tidemark.operators.ordering import Ordered

# fit_scope: which rows the statistics come from.
SCOPES = ("all", "train", "per_split")


def min_max_stats(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``<f>_min`` and ``<f>_max`` per key."""
    aggs = [agg(f).alias(f"{f}_{name}") for f in features for name, agg in (("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*aggs)


def moments_long(df: DataFrame, keys: Sequence[str], value: str, sample_std: bool = False) -> DataFrame:
    """n, min, max, mean and std of a long table, per key."""
    std = F.stddev_samp if sample_std else F.stddev_pop
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        std(value).alias("std"),
    )


def scale_by_key(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    fit_rows: Column | None = None,
    fit_scope: str = "train",
    split: str = "split",
) -> DataFrame:
    """Min-max scale features with each key's own range.

    Adds ``<f>_scaled`` and keeps ``<f>_min`` / ``<f>_max`` for the way back.
    With ``per_split`` each split is scaled with its own range; with ``train``
    the range comes from ``fit_rows``.
    """
    if fit_scope not in SCOPES:
        raise ValueError(f"fit_scope must be one of {SCOPES}")
    by = [*keys, split] if fit_scope == "per_split" else list(keys)
    fitted = df.where(fit_rows) if fit_scope == "train" and fit_rows is not None else df
    joined = join_on_key(df, min_max_stats(fitted, by, features), by)
    return joined.withColumns(
        {f"{f}_scaled": C.min_max(F.col(f), F.col(f"{f}_min"), F.col(f"{f}_max")) for f in features}
    )


def scale_series(ordered: Ordered, features: Sequence[str], fit_rows: Column | None = None) -> Ordered:
    """As ``scale_by_key``, for rows that are numbered already: no new shuffle."""
    inside = fit_rows if fit_rows is not None else F.lit(True)
    stats = {}
    for f in features:
        stats[f"{f}_min"] = F.min(F.when(inside, F.col(f)))
        stats[f"{f}_max"] = F.max(F.when(inside, F.col(f)))
    scaled = {f"{f}_scaled": C.min_max(F.col(f), F.col(f"{f}_min"), F.col(f"{f}_max")) for f in features}
    return ordered.with_series_stats(stats).map(lambda rows: rows.withColumns(scaled))


def unscale(df: DataFrame, features: Sequence[str], suffix: str = "_scaled", into: str = "_back") -> DataFrame:
    """Undo a min-max scaling of several features at once."""
    return df.withColumns(
        {
            f"{f}{into}": C.undo_min_max(F.col(f"{f}{suffix}"), F.col(f"{f}_min"), F.col(f"{f}_max"))
            for f in features
        }
    )


def with_feature_stats(df: DataFrame, feature: str, value: str, fit_rows: Column | None = None) -> DataFrame:
    """Attach pooled statistics to a long table ``(…, feature, value)``.

    Features are data, so their number isn't bounded: Spark chooses the join.
    """
    fitted = df if fit_rows is None else df.where(fit_rows)
    return df.join(moments_long(fitted, [feature], value), [feature])


def scale_vector_min_max(
    df: DataFrame, features: Sequence[str] = tuple(C.VECTOR_FEATURES), output: str = "features"
) -> DataFrame:
    """Assemble columns to a vector and scale it to [0, 1] over all rows."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(df)
    model = MinMaxScaler(min=0.0, max=1.0, inputCol="_raw", outputCol=output).fit(assembled)
    return model.transform(assembled).drop("_raw", *features)
