"""From raw documents to token files: filter, deduplicate, decontaminate, mix, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, mixing, quality, token_files
from tidemark.session import write_through


# Text that goes to a Python worker at once. By rows alone, batches of long documents take many times this.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set(BATCH_BYTES, "4m")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from all labels, accepts.

    Null texts count as empty, and an empty text has the score of the model's
    bias; rows without an id are judged by their text; repeated rows are judged
    alike; texts of any length are read whole. Without labels, all documents stay.
    """
    _small_batches(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.accepted(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Rows are told apart by id and text: of rows that repeat both one stays.
    Texts without words are near no other: rows that repeat such a text and its
    id give one, rows without an id all stay.
    """
    _small_batches(spark)
    return jaccard.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item.

    Null and empty texts, and an empty benchmark, hold none; rows without an id
    are judged by their text.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own. Documents without words have size 0
    and are taken at their source's rate like others; rows of one id are taken
    equally often.
    """
    return mixing.repeated(mixing.mix(docs), docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and from them each document's place, length and checksum.

    Documents come in order of their ids, null last, repeated rows each by
    itself. A null or empty text is its end id alone.
    """
    _small_batches(spark)
    return token_files.documents(spark, token_files.write(docs)).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

# A trained classifier's decisions and byte-pair merges have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), name)
    return docs
