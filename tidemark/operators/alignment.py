"""Pairing sequences with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import Ordered


def align_end(ordered: Ordered, labels: DataFrame, label: str = "label") -> Ordered:
    """Put each sequence's label on its last step and mask the other steps.

    ``labels`` has one row per sequence; sequences without a label drop out.
    """
    last = F.col("pos") == F.col("n_rows") - 1
    return ordered.attach(labels).map(
        lambda rows: rows.withColumns(
            {"label_mask": last.cast("int"), label: F.when(last, F.col(label))}
        )
    )


def pad_to(ordered: Ordered, length: int, values: list[str]) -> Ordered:
    """Fill sequences up to a common length with unmasked rows of zeros.

    Each last step brings the padding rows of its sequence along.
    """
    missing = F.greatest(F.lit(length) - F.col("n_rows"), F.lit(0))
    copies = F.when(F.col("pos") == F.col("n_rows") - 1, missing).otherwise(F.lit(0))

    def fill(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_extra", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
        real = F.col("_extra") == 0
        masks = [c for c in ("label_mask",) if c in rows.columns]
        filled = {v: F.when(real, F.col(v)).otherwise(F.lit(0).cast(rows.schema[v].dataType)) for v in values}
        filled |= {m: F.when(real, F.col(m)).otherwise(F.lit(0)) for m in masks}
        filled |= {"pos": F.col("pos") + F.col("_extra"), "step_mask": real.cast("int")}
        return rows.withColumns(filled).drop("_extra")

    return ordered.map(fill)


def last_steps_vector(ordered: Ordered, steps: int, values: list[str], scale: float = 1.0) -> DataFrame:
    """One row per sequence: ``x``, its last ``steps`` steps aligned at the end, oldest first.

    Each step has its values, times ``scale``, and a mask; steps before a
    sequence's first are zeros with mask 0. A group holds ``steps`` rows at most.
    """
    back = F.col("n_rows") - 1 - F.col("pos")
    cells = F.array(*[F.col(v).cast("double") * scale for v in values], F.lit(1.0))
    recent = ordered.rows.where(back < steps).groupBy(*ordered.keys).agg(F.map_from_entries(F.collect_list(F.struct(back.cast("int"), cells))).alias("_steps"))
    empty = F.array(*[F.lit(0.0)] * (len(values) + 1))
    wanted = F.transform(F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)), lambda k: F.coalesce(F.element_at("_steps", k), empty))
    return recent.select(*ordered.keys, F.flatten(wanted).alias("x"))


def missing_sides(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Ids found on one side only, with the side that lacks them."""
    left = features.select(key).distinct().withColumn("_left", F.lit(True))
    right = labels.select(key).distinct().withColumn("_right", F.lit(True))
    missing = F.when(F.col("_right").isNull(), "label").when(F.col("_left").isNull(), "features")
    return left.join(right, key, "full").select(key, missing.alias("missing")).where(F.col("missing").isNotNull())
