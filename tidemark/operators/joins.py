"""Equi-joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import join_series
from tidemark.session import DEFAULT_HOT_ROWS, HOT_ROWS, int_setting, write_through

# Joins that may repeat rows of the right side without changing the result.
HOWS = {"inner", "left", "left_outer", "leftouter", "left_semi", "leftsemi", "semi", "left_anti", "leftanti", "anti"}


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame | None:
    """Keys with ``hot_rows`` rows or more, and into how many parts (``_salts``) their rows go; None if there is none.

    Counts are pre-aggregated; the table of hot keys stays distributed.
    """
    limit = hot_rows or int_setting(df.sparkSession, HOT_ROWS, DEFAULT_HOT_ROWS)
    counted = df.groupBy(*keys).count().where(F.col("count") >= limit)
    salts = F.ceil(2 * F.col("count") / F.lit(limit)).cast("int").alias("_salts")
    return None if counted.isEmpty() else write_through(counted.select(*keys, salts), "hot-keys")


def join_on_key(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Join ``many`` (any number of rows per key) with ``one`` (few per key).

    Rows of a hot key get a random-looking but repeatable salt, as many as its
    rows need, and the other side repeats its rows of that key once per salt.
    Right and full joins would return those copies, and are refused.
    """
    if how not in HOWS:
        raise ValueError(f"join_on_key offers no {how!r} join")
    keys = list(keys)
    hot = hot_keys(many, keys, hot_rows)
    if hot is None:
        return many.join(one, keys, how)
    rest = [c for c in many.columns if c not in keys]
    # Rows that are keys only are alike; their place tells them apart.
    drawn = F.xxhash64(*rest) if rest else F.monotonically_increasing_id()
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(drawn, F.col("_salts")).cast("int")).otherwise(0)
    # A null key may be hot too, though it joins with nothing.
    salted = join_series(many, hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    spread = join_series(one, hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
