"""Bar files: header ``date,symbol,open,close,low,high,volume``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import BAR_FEATURES

TEXT_SCHEMA = ", ".join(f"{c} STRING" for c in ["date", "symbol", *BAR_FEATURES])


def read_bars_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, as the header names them."""
    return spark.read.schema(TEXT_SCHEMA).csv(path, header=True, enforceSchema=False)


def typed_bars(text: DataFrame, strict: bool = True) -> DataFrame:
    """Prices and volume as doubles.

    ``strict`` raises on a value that is no number; otherwise it becomes null
    and ``bad_values`` says how many there were in the row.
    """
    if strict:
        return text.select("date", "symbol", *[F.col(c).cast("double").alias(c) for c in BAR_FEATURES])
    parsed = {c: F.col(c).try_cast("double") for c in BAR_FEATURES}
    bad = sum((F.col(c).isNotNull() & parsed[c].isNull()).cast("int") for c in BAR_FEATURES)
    return text.select("date", "symbol", *[parsed[c].alias(c) for c in BAR_FEATURES], bad.alias("bad_values"))


def read_bars(spark: SparkSession, path: str | list[str], symbol: str | None = None) -> DataFrame:
    """Typed bars of all symbols, or of one; the filter reaches the scan."""
    bars = typed_bars(read_bars_text(spark, path))
    return bars if symbol is None else bars.where(F.col("symbol") == symbol)
