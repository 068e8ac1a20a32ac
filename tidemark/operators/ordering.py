"""Ordered work over many series, safe when one series holds most of the rows.

A plain ``Window.partitionBy(series)`` puts a whole series into one task. So
series that are too long go a way of their own: their rows are sorted into
ranges of bounded size across tasks and written once, each with the number of
its range, its *chunk*. Everything later reads the chunk from the written rows,
so a lost and recomputed task can't change it. The number of chunks grows with
the rows; a chunk doesn't.

Windows then run per (series, chunk), and what crosses a chunk border (row
offset, running sums, first row of the next chunk, totals) comes from a table
with one row per chunk. All other series take the plain window; when no series
is long, that is all there is in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.session import CHUNK_ROWS, DEFAULT_CHUNK_ROWS, int_setting, write_through

CHUNK = "_chunk"
EVERYTHING = "_everything"


def join_series(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on series keys; a null key is a key like any other. Keeps the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.expr(f"`{k}` <=> `_right_{k}`") for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


@dataclass(frozen=True)
class Ordered:
    """Rows of many series: ``whole`` series, and those ``cut`` into chunks."""

    whole: DataFrame
    keys: list[str]
    order: list[str]
    cut: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """All rows together."""
        whole = self.whole.drop(EVERYTHING)
        return whole if self.cut is None else whole.unionByName(self.cut.drop(CHUNK, EVERYTHING))

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Apply a row-wise change that keeps the key columns."""
        return replace(self, whole=change(self.whole), cut=None if self.cut is None else change(self.cut))

    def with_series_stats(self, stats: dict[str, Column]) -> Ordered:
        """Add per-series aggregates to every row, and shuffle none of them.

        Whole series are window groups already; cut ones get their values from
        a grouped table with one row per series.
        """
        over = Window.partitionBy(*self.keys)
        whole = self.whole.withColumns({name: agg.over(over) for name, agg in stats.items()})
        if self.cut is None:
            return replace(self, whole=whole)
        totals = self.cut.groupBy(*self.keys).agg(*[agg.alias(name) for name, agg in stats.items()])
        return replace(self, whole=whole, cut=join_series(self.cut, totals, self.keys))

    def attach(self, right: DataFrame, how: str = "inner") -> Ordered:
        """Join a table with one row per series; the rows stay where they are."""
        whole = self.whole.join(right, self.keys, how)
        if self.cut is None:
            return replace(self, whole=whole)
        # One row per series on the right: a small table, or a join whose skewed side Spark can split.
        return replace(self, whole=whole, cut=self.cut.join(right, self.keys, how))


def cut_long_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk_rows: int | None = None,
    short: bool = False,
) -> Ordered:
    """Set series apart that are too long for one task, and give their rows a chunk.

    ``order`` must make the rows of a series distinct. ``short=True`` states
    that the length of a series is bounded by what it means (one row per
    calendar day, one per vector position), so no long one is looked for.
    """
    keys, order = list(keys), list(order)
    if not keys:
        keys = [EVERYTHING]
        df = df.withColumn(EVERYTHING, F.lit(1))
    if short:
        return Ordered(df, keys, order)
    size = chunk_rows or int_setting(df.sparkSession, CHUNK_ROWS, DEFAULT_CHUNK_ROWS)
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    total = long.agg(F.sum("_n")).first()[0]
    if total is None:
        return Ordered(df, keys, order)
    # Only now is there anything to keep.
    long = write_through(long.drop("_n"), "long-series")
    ranges = join_series(df, long, keys, "left_semi").repartitionByRange(-(-total // size), *keys, *order)
    return Ordered(
        whole=join_series(df, long, keys, "left_anti"),
        keys=keys,
        order=order,
        cut=write_through(ranges.withColumn(CHUNK, F.spark_partition_id()), "chunks"),
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    next_of: Sequence[str] = (),
    running: Sequence[str] = (),
    chunk_rows: int | None = None,
    short: bool = False,
) -> Ordered:
    """Add ``pos`` (from 0) and ``n_rows`` per series.

    ``next_of`` columns come back as ``next_<name>``, the value in the
    following row (null at the end); ``running`` columns as ``<name>_before``,
    the sum over all earlier rows. Cut series are written once, numbered.
    """
    ordered = cut_long_series(df, keys, order, chunk_rows, short)
    zero = {c: F.lit(0).cast(df.schema[c].dataType) for c in running}

    def numbered(rows: DataFrame, group: list[str]) -> DataFrame:
        all_rows = Window.partitionBy(*group)
        in_order = all_rows.orderBy(*ordered.order)
        earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
        columns = {
            "pos": F.row_number().over(in_order).cast("long") - 1,
            "n_rows": F.count(F.lit(1)).over(all_rows),
        }
        columns |= {f"next_{c}": F.lead(c).over(in_order) for c in next_of}
        columns |= {f"{c}_before": F.coalesce(F.sum(c).over(earlier), zero[c]) for c in running}
        return rows.withColumns(columns)

    whole = numbered(ordered.whole, ordered.keys)
    if ordered.cut is None:
        return replace(ordered, whole=whole)

    group = [*ordered.keys, CHUNK]
    head = F.min_by(F.struct(*next_of), F.struct(*ordered.order)) if next_of else F.lit(None)
    by_series = Window.partitionBy(*ordered.keys)
    by_chunk = by_series.orderBy(CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        ordered.cut.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("_size"),
            head.alias("_head"),
            *[F.sum(c).alias(f"_sum_{c}") for c in running],
        )
        .select(
            *group,
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
            F.sum("_size").over(by_series).alias("_total"),
            F.lead("_head").over(by_chunk).alias("_next_head"),
            *[F.coalesce(F.sum(f"_sum_{c}").over(before), zero[c]).alias(f"_sum_{c}") for c in running],
        )
    )
    last_of_chunk = F.col("pos") == F.col("n_rows") - 1
    moved = {
        f"next_{c}": F.when(last_of_chunk, F.col(f"_next_head.{c}")).otherwise(F.col(f"next_{c}")) for c in next_of
    }
    moved |= {f"{c}_before": F.col(f"{c}_before") + F.col(f"_sum_{c}") for c in running}
    cut = (
        join_series(numbered(ordered.cut, group), borders, group)
        .withColumns(moved)
        .withColumns({"pos": F.col("pos") + F.col("_offset"), "n_rows": F.col("_total")})
        .drop("_offset", "_total", "_next_head", *[f"_sum_{c}" for c in running])
    )
    return replace(ordered, whole=whole, cut=write_through(cut, "numbered"))
