"""Sequence files: one file per entity, or one series per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import block_label
from tidemark.operators.ordering import number_rows
from tidemark.sources.files import LineFormat, list_files, pack_files, pair_files, read_aligned, read_contents, read_rows


def explode_line(line: Column) -> Column:
    """The numbers of a line as (step, value) columns; runs of spaces divide them."""
    parts = F.split(F.trim(F.regexp_replace(line, " +", " ")), " ")
    numbers = F.transform(parts, lambda part: part.cast("double"))
    return F.posexplode(numbers).alias("step", "value")


def read_lines(
    spark: SparkSession, path: str | list[str], glob: str | None = None, across_files: bool = False
) -> DataFrame:
    """Lines with ``file`` and ``line_no`` (from 0), for files of any size.

    Spark reads a file in byte blocks. ``monotonically_increasing_id`` counts the
    rows of a block one by one, so a line's number is its distance from the
    block's first line, plus the lines of earlier blocks. These come from a table
    with one row per block, read in the same query, so that both see the same
    blocks; Spark sends it to the lines while it is small. ``across_files``
    counts on from file to file, in order of file names.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value"),
    )
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    order = ([], ["file", "block"]) if across_files else (["file"], ["block"])
    starts = number_rows(blocks, *order, running=["lines"], short=True).rows
    starts = starts.select("file", "block", (F.col("first") - F.col("lines_before")).alias("base"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("at") - F.col("base")).alias("line_no"), "value")


def read_series_text(
    spark: SparkSession, path: str | list[str], block: int = 100, across_files: bool = False
) -> DataFrame:
    """One series per line: (line_no, label, step, value); classes come in blocks of lines."""
    lines = read_lines(spark, path, across_files=across_files)
    return lines.select("line_no", block_label(F.col("line_no"), block).alias("label"), explode_line(F.col("value")))


def read_numbered_files(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    skip_lines: int = 0,
    delimiter: str = ",",
    ids: tuple[int, int] | None = None,
    large_files: bool = False,
    strict_names: bool = True,
    width: int | None = None,
) -> DataFrame:
    """``<id>.csv`` files of a folder as (seq_id, step, columns), step in file order.

    Only ``*.csv`` files are listed. A name that is no number raises unless
    ``strict_names`` is off, which leaves such files out. ``ids`` is an
    inclusive id range; files outside of it are not read. Files are dealt to
    tasks by their bytes and read block by block, so ``large_files`` changes
    nothing any more. Blank lines are no rows; a line with fewer cells than
    columns raises, and one with other than ``width`` cells, where given.
    """
    files = list_files(spark, path, ids, strict_names)
    return read_rows(pack_files(files), LineFormat(tuple(columns), skip_lines, delimiter, width))


def read_numbered_labels(spark: SparkSession, path: str, **options) -> DataFrame:
    """``<id>.csv`` files with one class each as (seq_id, label)."""
    rows = read_numbered_files(spark, path, ["label"], **options)
    return rows.where(F.col("step") == 0).select("seq_id", F.col("label").cast("int").alias("label"))


def read_file_pairs(spark: SparkSession, features: str, labels: str, strict_names: bool = True) -> DataFrame:
    """Raw bytes of feature and label files whose names are the same number; others drop out.

    A name that is no number raises unless ``strict_names`` is off. Listings
    are joined, and only paired files are read.
    """
    return read_contents(pack_files(pair_files(list_files(spark, features, None, strict_names), list_files(spark, labels, None, strict_names))))


def read_labelled_files(
    spark: SparkSession, features: str, labels: str, columns: Sequence[str], skip_lines: int = 0, delimiter: str = ",",
    ids: tuple[int, int] | None = None, strict_names: bool = True,
) -> DataFrame:
    """Paired files as examples: (seq_id, step, columns, label, label_mask), the class on the last step."""
    pairs = pair_files(list_files(spark, features, ids, strict_names), list_files(spark, labels, ids, strict_names))
    return read_aligned(pack_files(pairs), LineFormat(tuple(columns), skip_lines, delimiter), LineFormat(("label",), skip_lines, delimiter))
