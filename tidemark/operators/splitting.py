"""Splits that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import columns as C
from tidemark.operators.ordering import Ordered


def split_by_time(ordered: Ordered, share: float = 0.8) -> Ordered:
    """First share of each series is ``train``, the rest ``test``."""
    return ordered.map(
        lambda rows: rows.withColumn("n_train", C.train_length(F.col("n_rows"), share)).withColumn(
            "split", F.when(F.col("pos") < F.col("n_train"), "train").otherwise("test")
        )
    )


def only_split(ordered: Ordered, split: str) -> Ordered:
    """Rows of one time split, with ``pos`` and ``n_rows`` counted inside it."""
    start = F.lit(0) if split == "train" else F.col("n_train")
    length = F.col("n_train") if split == "train" else F.col("n_rows") - F.col("n_train")
    return ordered.map(
        lambda rows: rows.where(F.col("split") == split).withColumns(
            {"pos": F.col("pos") - start, "n_rows": length}
        )
    )


def inside_splits(ordered: Ordered) -> Ordered:
    """All rows, with ``pos`` and ``n_rows`` counted inside their time split, which becomes a further key."""
    train = F.col("split") == "train"
    counted = {
        "pos": F.when(train, F.col("pos")).otherwise(F.col("pos") - F.col("n_train")),
        "n_rows": F.when(train, F.col("n_train")).otherwise(F.col("n_rows") - F.col("n_train")),
    }
    return replace(ordered.map(lambda rows: rows.withColumns(counted)), keys=[*ordered.keys, "split"])


def split_by_ranges(df: DataFrame, id_column: str, sizes: Sequence[tuple[str, int]]) -> DataFrame:
    """Consecutive id ranges; ids outside all of them are not part of any split."""
    branches, start = [], 0
    for name, size in sizes:
        branches.append((F.col(id_column).between(start, start + size - 1), name))
        start += size
    split = reduce(lambda rest, b: F.when(b[0], b[1]).otherwise(rest), reversed(branches), F.lit(None))
    return df.where(F.col(id_column).between(0, start - 1)).withColumn("split", split)


def split_by_hash(
    df: DataFrame, ids: Sequence[str], shares: Sequence[tuple[str, float]], seed: int = 1
) -> DataFrame:
    """Weighted random split; a row's split follows from its id and the seed."""
    total = sum(share for _, share in shares)
    draw = F.substring(C.hash_key(seed, *ids), 1, 8)
    bounds = [int(reached / total * 2**32) for reached in accumulate(share for _, share in shares)]
    split = F.lit(shares[-1][0])
    for (name, _), bound in reversed(list(zip(shares[:-1], bounds))):
        split = F.when(draw < f"{bound:08x}", name).otherwise(split)
    return df.withColumn("split", split)


# Rows among which the n-th is looked for by sorting, and digits by which the search is narrowed at a time.
BORDER_ROWS = 100_000
DIGITS = 4


def nth_hash(hashed: DataFrame, n: int, border_rows: int = BORDER_ROWS) -> tuple | None:
    """The n-th row (from 1) of ``hash, id`` in that order; None if there are fewer.

    Rows are counted by the hash's next digits, and only those that share the
    digits which the n-th row falls under are looked at further, until few are
    left. Whatever the size of the table, at most 65,536 counts and
    ``border_rows`` rows are put in order (more only if they share one hash).
    """
    prefix, left = "", n
    while True:
        inside = hashed.where(F.col("hash").startswith(prefix)) if prefix else hashed
        sizes = inside.groupBy(F.substring("hash", len(prefix) + 1, DIGITS).alias("digits")).agg(F.count(F.lit(1)).alias("size"))
        upto = sizes.withColumn("upto", F.sum("size").over(Window.orderBy("digits")))
        border = upto.where(F.col("upto") >= left).orderBy("digits").first()
        if border is None:
            return None
        left -= border.upto - border.size
        prefix += border.digits
        if border.size <= border_rows or len(border.digits) < DIGITS:
            rows = hashed.where(F.col("hash").startswith(prefix))
            return tuple(rows.orderBy("hash", "id").offset(left - 1).first())


def split_exact(df: DataFrame, id_column: str, n_train: int, seed: int) -> DataFrame:
    """Exactly ``n_train`` rows, chosen by shuffled order, are ``train``.

    The order is that of the hashed ids. Only the n-th smallest hash is looked
    for; no row is shuffled.
    """
    if n_train <= 0:
        return df.withColumn("split", F.lit("test"))
    ranked = df.select(C.hash_key(seed, id_column).alias("hash"), F.col(id_column).alias("id"))
    last = nth_hash(ranked, n_train)
    if last is None:
        # The table is smaller than n_train: all is train.
        return df.withColumn("split", F.lit("train"))
    kind = df.schema[id_column].dataType
    here = F.struct(C.hash_key(seed, id_column).alias("hash"), F.col(id_column).alias("id"))
    border = F.struct(F.lit(last[0]).alias("hash"), F.lit(last[1]).cast(kind).alias("id"))
    return df.withColumn("split", F.when(here <= border, "train").otherwise("test"))


def union_files(train: DataFrame, test: DataFrame) -> DataFrame:
    """Separate train and test inputs as one table with a ``split`` column."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
