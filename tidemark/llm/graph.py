"""Connected components of distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import write_through


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang a node's larger (or other) neighbours under the smallest.

    Minima are pre-aggregated; the join back is one that a skewed node's rows
    can be split in.
    """
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        return seen.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    hung = edges.join(low, "a")
    return hung.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest reachable node) of all nodes in edges ``a, b``, which are bigints.

    Large-star and small-star steps by turns until nothing changes; each round's
    edges are written to the shared folder, so lineage stays short. Edges are
    taken both ways; loops and repeated edges change nothing.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = write_through(ordered, "edges")
    state = None
    while True:
        stepped = _star(_star(current, True), False).where("a <> b").distinct()
        current = write_through(stepped, "edges")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
