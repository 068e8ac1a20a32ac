"""Mix sources to target weights by repeating whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import fresh
from tidemark.session import write_through

# A table of so many sources is sent to every executor; a longer one is joined by key.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: ``source_size`` and its ``target``.

    Sources in code point order, null last, take the weights in turn. The
    targets share ``total`` times all sizes by weight; none exceeds ``cap`` times
    its source's size, and what it can't take goes to the others by weight. That
    is a level L with target = min(cap * size, weight * L): with the sources in
    order of the level at which they fill up, L follows from running sums. Sums
    are of integers, so they don't depend on the order of rows. If even all caps
    together are less than the total, every target is its cap.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight.cast("long"))
    # One row per source from here on, not per document.
    fills = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    per = (
        per.withColumn("fills_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
        .withColumn("held", F.sum("source_size").over(fills.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("all_sizes", F.sum("source_size").over(every))
    )
    level = (F.lit(total) * F.col("all_sizes") - F.lit(cap) * F.coalesce("held", F.lit(0))) / F.col("open")
    # The first source in that order which doesn't fill up sets the level.
    level = F.min(F.when(level < F.col("fills_at"), F.struct(F.col("fills_at"), level.alias("level")))).over(every)["level"]
    target = F.least(F.lit(cap) * F.col("source_size"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return per.select("source", "source_size", target.alias("target"))


def seeded_uniform(*keys: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that follows from the keys alone: the first 32 bits of a digest."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``copies``.

    A source's rate is target / size; each of its documents is taken floor(rate)
    times and once more with a probability of the rest, decided by a hash of its
    key, so reruns and recomputed tasks agree. Repeated rows of one key agree
    too. Texts without words have size 0; a null source is a source of its own;
    columns that the operator adds replace input columns of the same name. Only
    one row per source and task is shuffled; the documents stay where they are
    unless there are more than ``BROADCAST_SOURCES`` sources.
    """
    sized = docs.withColumn("size", n_words(F.col(text)))
    names = {c: fresh(f"__{c}", sized.columns) for c in ("source", "source_size", "target")}
    s, z, t = names.values()
    targets = source_targets(sized.select(F.col(source), F.col("size")), source, "size", weights, total, cap)
    targets = write_through(targets.withColumnsRenamed(names), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    plain = sized.drop("source_size", "target", "copies")
    joined = plain.join(targets, plain[source].eqNullSafe(targets[s]), "left")
    rate = F.when(F.col(z) > 0, F.col(t) / F.col(z)).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (seeded_uniform(F.col(key), seed=seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumns({"source_size": F.col(z), "target": F.col(t), "copies": copies}).drop(s, z, t)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    extra = fresh("__copy", columns)
    return mixed.where(F.col("copies") > 0).select(*columns, copies.alias(extra)).drop(extra)
