"""Prepared train and test tables: features and labels by split, written once and as a whole.

Both tables go into a folder of their own, and last of all one row in the
manifest names that folder and what it was made from. Spark moves the single
file of that row into place when its job commits, so the manifest is there whole
or not at all. Readers follow it; a folder that a failed or lost run left behind
has no row and is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST = "folder string, fingerprint string"


def content_hash(df: DataFrame) -> str:
    """A hash of all rows, whatever their order and partitions; repeated rows count each."""
    row = F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(f"`{c}`"))), F.lit("")) for c in df.columns])
    parts = df.select(row.alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64(F.lit(1), "h")).alias("mixed"),
    ).first()
    return f"{parts.n}-{parts.total}-{parts.mixed}"


def fingerprint(features: DataFrame, labels: DataFrame, **parameters) -> str:
    """What a prepared pair was made from: the rows of both tables, their columns, and the parameters."""
    said = {"features": [features.dtypes, content_hash(features)], "labels": [labels.dtypes, content_hash(labels)], "parameters": parameters}
    return hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()


def committed(spark: SparkSession, path: str) -> Row | None:
    """The row of the manifest, or None where nothing was written to the end."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return min(rows, key=lambda row: row.folder, default=None)


def write_prepared(features: DataFrame, labels: DataFrame, path: str, made_from: str | None = None) -> bool:
    """Write both tables by ``split``, unless they are there already; tells whether it wrote.

    With ``made_from``, as ``fingerprint`` gives it, tables that were made from
    something else are written anew; without it any finished pair is left alone.
    """
    spark = features.sparkSession
    there = committed(spark, path)
    if there is not None and (made_from is None or there.fingerprint == made_from):
        return False
    folder = f"tables-{uuid.uuid4().hex}"
    features.write.partitionBy("split").parquet(f"{path}/{folder}/features")
    labels.write.partitionBy("split").parquet(f"{path}/{folder}/labels")
    row = spark.createDataFrame([(folder, made_from)], MANIFEST).coalesce(1)
    row.write.mode("overwrite").parquet(f"{path}/manifest")
    return True


def read_prepared(spark: SparkSession, path: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features and labels, of one split or of all; other splits are not read."""
    there = committed(spark, path)
    if there is None:
        raise FileNotFoundError(f"{path} holds no finished tables")
    both = tuple(spark.read.parquet(f"{path}/{there.folder}/{name}") for name in ("features", "labels"))
    return both if split is None else tuple(df.where(F.col("split") == split) for df in both)
