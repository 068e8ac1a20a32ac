"""Metrics. Each takes one pass with a map-side aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio
from tidemark.operators.ordering import number_rows
from tidemark.session import write_through


def confusion(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Row count per (label, pred)."""
    return df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class: support, tp, fp, fn, precision, recall, f1 (0 where undefined)."""
    cells = confusion(df, by, label, pred)
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col(label).alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said")),
                F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said")),
            )
        ).alias("s"),
        F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("hit"),
    )
    per_class = sides.groupBy(*by, "s.class").agg(
        F.sum("s.actual").alias("support"), F.sum("s.said").alias("said"), (F.sum("hit") / 2).cast("long").alias("tp")
    )
    return per_class.select(
        *by,
        "class",
        "support",
        "tp",
        (F.col("said") - F.col("tp")).alias("fp"),
        (F.col("support") - F.col("tp")).alias("fn"),
        F.coalesce(ratio(F.col("tp"), F.col("said")), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(F.col("tp"), F.col("support")), F.lit(0.0)).alias("recall"),
        F.coalesce(ratio(2 * F.col("tp"), F.col("said") + F.col("support")), F.lit(0.0)).alias("f1"),
    )


def accuracy_f1(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """n, accuracy and macro F1, from the class report."""
    return (
        class_report(df, by, label, pred)
        .groupBy(*by)
        .agg(
            F.sum("support").alias("n"),
            ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
            F.avg("f1").alias("f1_macro"),
        )
    )


def regression_report(df: DataFrame, by: Sequence[str] = (), actual: str = "actual", predict: str = "predict") -> DataFrame:
    """n, mse, mae, rmse, rse, r2 and pearson_r per group.

    ``rse`` is squared error relative to the mean forecast; r2 is 1 - rse.
    """
    y, p = F.col(actual), F.col(predict)
    spread = F.stddev_pop(y) * F.stddev_pop(p)
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("_var"),
        F.covar_pop(y, p).alias("_cov"),
        spread.alias("_spread"),
    )
    rse = F.when(F.col("_var") > 0, F.col("mse") / F.nullif(F.col("_var"), F.lit(0.0)))
    r = F.when(F.col("_spread") > 0, F.col("_cov") / F.nullif(F.col("_spread"), F.lit(0.0)))
    return sums.select(
        *by, "n", "mse", "mae", F.sqrt("mse").alias("rmse"), rse.alias("rse"), (1 - rse).alias("r2"), r.alias("pearson_r")
    )


def roc_auc(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve per group; ties count half.

    Rows are first counted per distinct score, and the counts written once. The
    negatives below each score are a running sum over them, which is cut into
    chunks when a group is long.
    """
    positive = (F.col(label) == 1).cast("long")
    counts = df.groupBy(*by, score).agg(
        F.sum(positive).alias("n_pos"), F.sum(1 - positive).alias("n_neg")
    )
    ranked = number_rows(write_through(counts, "scores"), by, [score], running=["n_neg"]).rows
    below = F.col("n_neg_before").cast("double") + F.col("n_neg").cast("double") / 2
    return ranked.groupBy(*by).agg(
        F.sum("n_pos").alias("n_pos"),
        F.sum("n_neg").alias("n_neg"),
        ratio(
            F.sum(F.col("n_pos").cast("double") * below),
            F.sum("n_pos").cast("double") * F.sum("n_neg").cast("double"),
        ).alias("auc"),
    )


def roc_counts(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score", bins: int = 200) -> DataFrame:
    """``n_pos, n_neg`` per group and bin of equal width over scores from 0 to 1.

    Counts of several tables, days or epochs add up. Scores outside count in
    the first or last bin; rows without a score or label count nowhere.
    """
    positive = (F.col(label) == 1).cast("long")
    place = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).cast("int")
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(*by, place.alias("bin")).agg(F.sum(positive).alias("n_pos"), F.sum(1 - positive).alias("n_neg"))


def merge_roc_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of several tables as those of all their rows."""
    return counts.groupBy(*by, "bin").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def roc_points(counts: DataFrame, by: Sequence[str], bins: int = 200) -> DataFrame:
    """Rows at or above each threshold that some row reaches: ``threshold, tp, fp, tpr, fpr``.

    Puts ``bins`` rows per group in order, whatever the number of scores.
    """
    down = Window.partitionBy(*by).orderBy(F.desc("bin"))
    every = Window.partitionBy(*by)
    sums = counts.select(
        *by, (F.col("bin") / F.lit(bins)).alias("threshold"),
        F.sum("n_pos").over(down).alias("tp"), F.sum("n_neg").over(down).alias("fp"),
        F.sum("n_pos").over(every).alias("_p"), F.sum("n_neg").over(every).alias("_n"),
    )
    return sums.select(*by, "threshold", "tp", "fp", ratio(F.col("tp"), F.col("_p")).alias("tpr"), ratio(F.col("fp"), F.col("_n")).alias("fpr"))


def roc_area(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``n_pos, n_neg, auc`` per group; pairs that share a bin count half, so it is off by at most half of those."""
    below = F.sum("n_neg").over(Window.partitionBy(*by).orderBy("bin")) - F.col("n_neg") / 2
    won = counts.withColumn("_won", F.col("n_pos") * below)
    pairs = F.sum("n_pos").cast("double") * F.sum("n_neg").cast("double")
    return won.groupBy(*by).agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), ratio(F.sum("_won"), pairs).alias("auc"))


def argmax(values: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def metric_rows(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metrics as ``(…, metric, value)`` rows."""
    return wide.unpivot(list(ids), list(metrics), "metric", "value")
