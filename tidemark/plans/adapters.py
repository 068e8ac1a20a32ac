"""The test tables, shaped like the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.evaluation import argmax

# Fixed values of the events table.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def series(spark: SparkSession, folder: str) -> DataFrame:
    """One series of values per user; order is (ts, event_id)."""
    events = table(spark, folder, "events")
    return events.select(F.col("user_id").alias("series_id"), "ts", "event_id", "value")


def _day_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumns(
        {"symbol": F.col("l_returnflag"), "date": F.to_date("l_shipdate")}
    )


def trading_days(spark: SparkSession, folder: str) -> DataFrame:
    """The symbol and date of every bar, when prices are not asked for."""
    return _day_items(spark, folder).select("symbol", F.col("date").cast("string").alias("date")).distinct()


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars: return flags as symbols, ship dates as trading days.

    At most one row per symbol and calendar day, however many line items. Open
    and close are the prices of the first and last item of the day; hash
    aggregates find the first and last order, and only the items of those two
    orders are compared in full, so the line items are never sorted.
    """
    day = ["symbol", "date"]
    price = F.col("l_extendedprice")
    items = _day_items(spark, folder)
    days = items.groupBy(*day).agg(
        F.min("l_orderkey").alias("_first"),
        F.max("l_orderkey").alias("_last"),
        F.min(price).alias("low"),
        F.max(price).alias("high"),
        F.sum("l_quantity").alias("volume"),
    )
    # One row per flag (a single letter) and day: small enough to broadcast.
    outer = items.join(F.broadcast(days), day).where(F.col("l_orderkey").isin(F.col("_first"), F.col("_last")))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return outer.groupBy(*day).agg(
        F.min_by(price, order).alias("open"),
        F.max_by(price, order).alias("close"),
        *[F.max(c).alias(c) for c in ("low", "high", "volume")],
    ).withColumn("date", F.col("date").cast("string"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding as a sequence of steps."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("seq_id"), "label", F.posexplode("embedding").alias("step", "value")
    ).withColumn("value", F.col("value").cast("double"))


def text_series(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding as a line of whole numbers divided by runs of spaces."""
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10000).cast("string"))
    return table(spark, folder, "embeddings").select("vec_id", F.array_join(numbers, "  ").alias("line"))


def clinical(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of unequal length with one column per measurement."""
    events = table(spark, folder, "events")
    measured = [F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0).alias(t) for t in EVENT_TYPES]
    return events.select(F.col("user_id").alias("seq_id"), "ts", "event_id", *measured)


def clinical_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Class 1 if the last measurement of the sequence is above 50."""
    events = table(spark, folder, "events")
    last = F.max_by("value", F.struct("ts", "event_id"))
    return events.groupBy(F.col("user_id").alias("seq_id")).agg((last > 50).cast("int").alias("label"))


def clinical_labels_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The labels, without those of every seventh sequence."""
    return clinical_labels(spark, folder).where(F.col("seq_id") % 7 != 0)


def scored_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a quality label; the score is their length."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(docs, "doc_id").select(
        "doc_id", "label", F.col("n_chars").alias("score"), (F.col("n_chars") > 1500).cast("int").alias("pred")
    )


def scored_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings; the predicted class is the largest of the first ten values."""
    pred = argmax(F.slice("embedding", 1, 10))
    return table(spark, folder, "embeddings").select("vec_id", "label", pred.alias("pred"))
