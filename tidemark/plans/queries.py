"""Registered queries: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.columns import BAR_FEATURES, VECTOR_FEATURES, rounded
from tidemark.operators import (
    affine_scan,
    alignment,
    evaluation,
    forecasting,
    models,
    overlay,
    scaling,
    softmax,
    splitting,
    stateful,
    training,
    window_regression,
    windowing,
)
from tidemark.operators.joins import join_on_key
from tidemark.operators.learners import Learner, Updater
from tidemark.operators.ordering import Ordered, cut_long_series, number_rows
from tidemark.operators.training import Averaging
from tidemark.plans import adapters as A
from tidemark.session import new_folder, write_through
from tidemark.sources.bars import read_bars, typed_bars
from tidemark.sources.models import load_model, model_rows, save_model
from tidemark.sources.files import list_files, write_files
from tidemark.sources.prepared import fingerprint, read_prepared, write_prepared
from tidemark.sources.sequences import explode_line, read_labelled_files, read_numbered_files, read_series_text
from tidemark.streaming.affine import affine_states_stream, last_states, typed_state
from tidemark.streaming.stateful import exponential_state_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SERIES_ORDER = ["ts", "event_id"]
SHARE = 0.8
# Class count, train count, seed and id-range sizes of the workloads.
CLASSES = 10
N_TRAIN = 450
SHUFFLE_SEED = 12345
ID_RANGES = [("train", 300), ("valid", 80), ("test", 100)]
HASH_SHARES = [("train", 0.8), ("valid", 0.1), ("test", 0.1)]
FILE_IDS = (7, 40)
SHORT_WINDOW = 5
# Rows of a stream's file.
STREAM_ROWS = 1_000_000
ROC_BINS = 64
# Length of a document that scores 1.
MOST_CHARS = 16_384
LAST_STEPS = 20
RESTART_EVENT = "signup"
BATCH = 64
FILE_BORDER = "1999-01-01"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def numbered_series(spark: SparkSession, folder: str) -> Ordered:
    ordered = number_rows(A.series(spark, folder), ["series_id"], SERIES_ORDER, next_of=["value"])
    return splitting.split_by_time(ordered, SHARE)


def numbered_bars(spark: SparkSession, folder: str, keep: bool = False) -> Ordered:
    """Bars in order; ``keep`` writes the few bars once, for work that reads them repeatedly."""
    bars = A.bars(spark, folder)
    bars = write_through(bars, "bars") if keep else bars
    ordered = number_rows(bars, ["symbol"], ["date"], next_of=BAR_FEATURES, short=True)
    return splitting.split_by_time(ordered, SHARE)


# --- tables and statistics -------------------------------------------------


@query
def symbol_counts(spark, folder):
    return A.trading_days(spark, folder).groupBy("symbol").agg(F.count("date").alias("n_rows"))


@query
def symbol_total(spark, folder):
    return A.trading_days(spark, folder).agg(F.countDistinct("symbol").alias("n_symbols"))


@query
def typed_projection(spark, folder):
    text = A.bars(spark, folder).select("date", "symbol", *[F.col(c).cast("string") for c in BAR_FEATURES])
    return typed_bars(text).where(F.col("symbol") == "R").select("date", "symbol", *VECTOR_FEATURES)


@query
def target_values(spark, folder):
    values = C.unpivot_features(C.target_columns("ALL"), "target")
    return A.bars(spark, folder).select("symbol", "date", values.alias("t")).select("symbol", "date", "t.*")


@query
def feature_minmax_by_symbol(spark, folder):
    long = A.bars(spark, folder).select("symbol", C.unpivot_features(BAR_FEATURES).alias("f")).select("symbol", "f.*")
    stats = scaling.moments_long(long, ["symbol", "feature"], "value")
    return stats.select("symbol", "feature", "min", "max")


@query
def feature_stats_pooled(spark, folder):
    stats = scaling.moments_long(A.vectors(spark, folder), ["step"], "value")
    return stats.select("step", "n", *[rounded(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")])


# --- scaling ---------------------------------------------------------------


def scaled_bars(bars: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Scaled in one pass: a symbol has at most one bar per day, so its window is small."""
    return scaling.scale_series(cut_long_series(bars, keys, ["date"], short=True), features).rows


@query
def scale_minmax_by_symbol(spark, folder):
    scaled = scaled_bars(A.bars(spark, folder), BAR_FEATURES, ["symbol"])
    return scaled.select("symbol", "date", *[rounded(F.col(f"{f}_scaled")).alias(f) for f in BAR_FEATURES])


@query
def scale_minmax_pooled(spark, folder):
    bars = A.bars(spark, folder).select("symbol", "date", C.unpivot_features(VECTOR_FEATURES).alias("f"))
    bars = bars.select("symbol", "date", "f.*")
    scaled = C.min_max(F.col("value"), F.col("min"), F.col("max"))
    position = F.array_position(F.array(*map(F.lit, VECTOR_FEATURES)), F.col("feature")) - 1
    return scaling.with_feature_stats(bars, "feature", "value").select(
        "symbol", "date", position.cast("int").alias("position"), rounded(scaled).alias("scaled")
    )


@query
def scale_minmax_vector(spark, folder):
    # The fit and the rows each read the few bars, not the line items again.
    scaled = scaling.scale_vector_min_max(write_through(A.bars(spark, folder), "bars"))
    long = scaled.select("symbol", "date", F.posexplode(vector_to_array("features")).alias("position", "scaled"))
    return long.withColumn("scaled", rounded(F.col("scaled")))


@query
def scale_minmax_pooled_steps(spark, folder):
    stats = scaling.with_feature_stats(A.vectors(spark, folder), "step", "value")
    scaled = C.min_max(F.col("value"), F.col("min"), F.col("max"))
    return stats.select("seq_id", "step", rounded(scaled).alias("scaled"))


@query
def scale_standard_train_fit(spark, folder):
    embeddings = splitting.split_exact(A.table(spark, folder, "embeddings"), "vec_id", N_TRAIN, SHUFFLE_SEED)
    steps = embeddings.select("vec_id", "split", F.posexplode("embedding").alias("step", "value"))
    steps = steps.withColumn("value", F.col("value").cast("double"))
    stats = scaling.with_feature_stats(steps, "step", "value", F.col("split") == "train")
    scaled = C.standard(F.col("value"), F.col("mean"), F.col("std"))
    return stats.select(F.col("vec_id").alias("seq_id"), "step", "split", rounded(scaled).alias("scaled"))


@query
def scale_minmax_train_with_label(spark, folder):
    rows = numbered_series(spark, folder).map(
        lambda df: df.withColumnsRenamed({"value": "x", "next_value": "y"})
    )
    pairs = (F.col("split") == "train") & F.col("y").isNotNull()
    scaled = scaling.scale_series(rows, ["x", "y"], pairs).rows.where(F.col("y").isNotNull())
    return scaled.select(
        "series_id", "pos", "split", rounded(F.col("x_scaled")).alias("x"), rounded(F.col("y_scaled")).alias("y")
    )


@query
def inverse_scale_one(spark, folder):
    scaled = scaled_bars(A.bars(spark, folder), ["close"], ["symbol"])
    back = scaling.unscale(scaled, ["close"])
    return back.select("symbol", "date", rounded(F.col("close_scaled")).alias("scaled"), rounded(F.col("close_back"), 4).alias("close"))


@query
def inverse_scale_all(spark, folder):
    scaled = scaled_bars(A.bars(spark, folder), BAR_FEATURES, ["symbol"])
    back = scaling.unscale(scaled, BAR_FEATURES)
    return back.select("symbol", "date", *[rounded(F.col(f"{f}_back"), 4).alias(f) for f in BAR_FEATURES])


@query
def inverse_standard(spark, folder):
    stats = scaling.with_feature_stats(A.vectors(spark, folder), "step", "value")
    scaled = C.standard(F.col("value"), F.col("mean"), F.col("std"))
    back = C.undo_standard(scaled, F.col("mean"), F.col("std"))
    return stats.select("seq_id", "step", rounded(back).alias("value"))


# --- splits ----------------------------------------------------------------


@query
def split_chrono(spark, folder):
    return numbered_series(spark, folder).rows.select("series_id", "event_id", "pos", "split")


@query
def split_ranges(spark, folder):
    ids = A.table(spark, folder, "embeddings").select("vec_id")
    return splitting.split_by_ranges(ids, "vec_id", ID_RANGES)


@query
def split_hash(spark, folder):
    ids = A.table(spark, folder, "embeddings").select("vec_id")
    return splitting.split_by_hash(ids, ["vec_id"], HASH_SHARES, seed=1)


@query
def split_shuffle_exact(spark, folder):
    ids = A.table(spark, folder, "embeddings").select("vec_id")
    return splitting.split_exact(ids, "vec_id", N_TRAIN, SHUFFLE_SEED)


@query
def split_per_file_scale(spark, folder):
    file = F.when(F.col("date") < FILE_BORDER, "train").otherwise("test")
    both = A.bars(spark, folder).withColumn("split", file)
    scaled = scaled_bars(both, ["close"], ["split", "symbol"])
    return scaled.select("split", "symbol", "date", rounded(F.col("close_scaled")).alias("close"))


@query
def split_sizes(spark, folder):
    ids = A.table(spark, folder, "embeddings").select("vec_id")
    parts = {
        "time": numbered_series(spark, folder).rows,
        "ranges": splitting.split_by_ranges(ids, "vec_id", ID_RANGES),
        "hash": splitting.split_by_hash(ids, ["vec_id"], HASH_SHARES, seed=1),
        "exact": splitting.split_exact(ids, "vec_id", N_TRAIN, SHUFFLE_SEED),
    }
    counted = [
        df.groupBy(F.lit(name).alias("method"), "split").agg(F.count(F.lit(1)).alias("n"))
        for name, df in parts.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


# --- windows ---------------------------------------------------------------


@query
def next_row_label(spark, folder):
    rows = numbered_series(spark, folder).rows
    return rows.where(F.col("next_value").isNotNull()).select("series_id", "pos", "value", "next_value")


@query
def train_windows(spark, folder):
    scaled = scaling.scale_series(numbered_series(spark, folder), ["value"], F.col("split") == "train")
    windows = windowing.to_windows(splitting.only_split(scaled, "train").rows)
    label = C.min_max(F.col("next_value"), F.col("value_min"), F.col("value_max"))
    return windows.select(
        "series_id", "window_id", "step", rounded(F.col("value_scaled")).alias("x"), rounded(label).alias("label_next")
    )


@query
def test_windows(spark, folder):
    scaled = scaling.scale_series(numbered_bars(spark, folder), BAR_FEATURES, F.col("split") == "train")
    windows = windowing.to_windows(splitting.only_split(scaled, "test").rows)
    labelled = windowing.label_last_step(windows, "next_close")
    return labelled.select(
        "symbol", "window_id", "step", *[rounded(F.col(f"{f}_scaled")).alias(f) for f in BAR_FEATURES], "label_raw"
    )


@query
def window_counts(spark, folder):
    return windowing.count_windows(A.series(spark, folder), ["series_id"])


@query
def window_batches(spark, folder):
    counts = windowing.count_windows(A.trading_days(spark, folder), ["symbol"])
    return windowing.batch_sizes(counts, ["symbol"], BATCH)


@query
def window_step_totals(spark, folder):
    """Sum per batch and step over all windows, folded without keeping the windows."""
    windows = windowing.to_windows(numbered_series(spark, folder).rows)
    batch = windowing.batch_of(F.col("window_id"), BATCH)
    return windows.groupBy("series_id", batch.alias("batch_id"), "step").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 4).alias("total")
    )


# --- sequences and labels --------------------------------------------------


@query
def text_series_explode(spark, folder):
    return A.text_series(spark, folder).select(F.col("vec_id").alias("line_no"), explode_line(F.col("line")))


@query
def block_label(spark, folder):
    lines = number_rows(A.table(spark, folder, "embeddings").select("vec_id"), [], ["vec_id"]).rows
    return lines.select("vec_id", F.col("pos").alias("line_no"), C.block_label(F.col("pos")).alias("label"))


@query
def one_hot(spark, folder):
    hot = F.posexplode(C.one_hot(F.col("label"), CLASSES)).alias("class", "y")
    return A.table(spark, folder, "embeddings").select(F.col("vec_id").alias("seq_id"), hot)


@query
def label_join(spark, folder):
    features, labels = A.clinical(spark, folder), A.clinical_labels_with_gaps(spark, folder)
    return join_on_key(features, labels, ["seq_id"]).select("seq_id", "event_id", *A.EVENT_TYPES, "label")


@query
def label_join_missing(spark, folder):
    return alignment.missing_sides(
        A.clinical(spark, folder), A.clinical_labels_with_gaps(spark, folder), "seq_id"
    )


@query
def document_labels_missing(spark, folder):
    return alignment.missing_sides(
        A.table(spark, folder, "documents"), A.table(spark, folder, "labels"), "doc_id"
    )


@query
def align_end(spark, folder):
    ordered = number_rows(A.clinical(spark, folder), ["seq_id"], SERIES_ORDER)
    aligned = alignment.align_end(ordered, A.clinical_labels_with_gaps(spark, folder))
    return aligned.rows.select("seq_id", F.col("pos").alias("step"), *A.EVENT_TYPES, "label", "label_mask")


@query
def align_end_padded(spark, folder):
    ordered = number_rows(A.clinical(spark, folder), ["seq_id"], SERIES_ORDER)
    aligned = alignment.align_end(ordered, A.clinical_labels_with_gaps(spark, folder))
    padded = alignment.pad_to(aligned, 100, A.EVENT_TYPES)
    return padded.rows.select("seq_id", F.col("pos").alias("step"), "click", "error", "label_mask", "step_mask")


@query
def masked_label_counts(spark, folder):
    """Labelled steps only: how many sequences end in each class, and how long they are."""
    ordered = number_rows(A.clinical(spark, folder), ["seq_id"], SERIES_ORDER)
    aligned = alignment.align_end(ordered, A.clinical_labels(spark, folder)).rows
    return aligned.where(F.col("label_mask") == 1).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_steps")
    )


# --- evaluation ------------------------------------------------------------


def _both_tasks(spark, folder):
    docs = A.scored_docs(spark, folder).select(F.lit("documents").alias("task"), "label", "pred")
    vecs = A.scored_classes(spark, folder).select(F.lit("vectors").alias("task"), "label", "pred")
    return docs.unionByName(vecs)


@query
def eval_accuracy_f1(spark, folder):
    report = evaluation.accuracy_f1(_both_tasks(spark, folder), ["task"])
    return report.select("task", "n", *[rounded(F.col(c)).alias(c) for c in ("accuracy", "f1_macro")])


@query
def eval_class_report(spark, folder):
    report = evaluation.class_report(_both_tasks(spark, folder), ["task"])
    metrics = [rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
    return report.select("task", F.col("class").alias("class_id"), "support", "tp", "fp", "fn", *metrics)


@query
def eval_confusion(spark, folder):
    return evaluation.confusion(_both_tasks(spark, folder), ["task"])


@query
def eval_regression(spark, folder):
    rows = numbered_series(spark, folder).rows.where(F.col("next_value").isNotNull())
    report = evaluation.regression_report(rows, ["split"], actual="next_value", predict="value")
    return report.select("split", "n", *[rounded(F.col(c)).alias(c) for c in report.columns[2:]])


@query
def eval_auc_splits(spark, folder):
    docs = splitting.split_by_hash(A.scored_docs(spark, folder), ["doc_id"], HASH_SHARES, seed=1)
    auc = evaluation.roc_auc(docs, ["split"])
    return auc.withColumn("auc", rounded(F.col("auc")))


@query
def eval_roc_thresholds(spark, folder):
    """True and false positives at fixed thresholds, per split, from one pass without sorting."""
    docs = splitting.split_by_hash(A.scored_docs(spark, folder), ["doc_id"], HASH_SHARES, seed=1)
    counts = evaluation.roc_counts(docs.withColumn("score", F.col("score") / MOST_CHARS), ["split"], bins=ROC_BINS)
    points = evaluation.roc_points(counts, ["split"], bins=ROC_BINS)
    return points.select("split", "threshold", "tp", "fp", *[rounded(F.col(c)).alias(c) for c in ("tpr", "fpr")])


@query
def eval_roc_area(spark, folder):
    docs = splitting.split_by_hash(A.scored_docs(spark, folder), ["doc_id"], HASH_SHARES, seed=1)
    counts = evaluation.roc_counts(docs.withColumn("score", F.col("score") / MOST_CHARS), ["split"], bins=ROC_BINS)
    area = evaluation.roc_area(counts, ["split"])
    return area.withColumn("auc", rounded(F.col("auc")))


# --- forecasts -------------------------------------------------------------


def _series_forecast(spark, folder):
    return forecasting.prepare(A.series(spark, folder), ["series_id"], SERIES_ORDER, ["value"], SHARE)


def _bars_forecast(spark, folder, target):
    return forecasting.prepare(
        A.bars(spark, folder), ["symbol"], ["date"], C.target_columns(target), SHARE, short=True
    )


@query
def forecast_quality(spark, folder):
    """Flagship: how good one-step-ahead forecasts are, per series."""
    pairs = forecasting.forecast_test_rows(_series_forecast(spark, folder), ["value"])
    report = evaluation.regression_report(pairs, ["series_id"])
    return report.select("series_id", "n", *[rounded(F.col(c)).alias(c) for c in ("mae", "mse", "rmse")])


@query
def forecast_one(spark, folder):
    pairs = forecasting.forecast_test_windows(_bars_forecast(spark, folder, "CLOSE"), ["close"])
    return pairs.select("symbol", "idx", "feature", rounded(F.col("predict"), 4).alias("predict"), "actual")


@query
def forecast_all(spark, folder):
    pairs = forecasting.forecast_test_windows(_bars_forecast(spark, folder, "ALL"), BAR_FEATURES)
    return pairs.select("symbol", "idx", "feature", rounded(F.col("predict"), 4).alias("predict"), "actual")


# Penalty of the window models: a constant feature must not make them singular.
WINDOW_L2 = 1.0


def _window_parts(rows: Ordered, features: list[str]) -> tuple[Ordered, Ordered]:
    """Train and test rows, scaled with the train range."""
    scaled = scaling.scale_series(rows, features, F.col("split") == "train")
    return splitting.only_split(scaled, "train"), splitting.only_split(scaled, "test")


def _window_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """All features of the day after each test window, by one model on windows of all symbols."""
    shape = window_regression.Shape(tuple(BAR_FEATURES), tuple(BAR_FEATURES))
    train, test = _window_parts(numbered_bars(spark, folder, keep=True), BAR_FEATURES)
    return window_regression.forecast_windows(test, shape, window_regression.fit_pooled(train, shape, WINDOW_L2))


@query
def forecast_window_all(spark, folder):
    pairs = _window_forecasts(spark, folder)
    return pairs.select("symbol", "idx", "feature", rounded(F.col("predict"), 2).alias("predict"), "actual")


@query
def forecast_window_report(spark, folder):
    report = evaluation.regression_report(_window_forecasts(spark, folder), ["symbol", "feature"])
    return report.select("symbol", "feature", "n", *[rounded(F.col(c), 3).alias(c) for c in ("mae", "rmse", "r2")])


@query
def forecast_window_one(spark, folder):
    """The close after each test window, by one model per symbol."""
    shape = window_regression.Shape(tuple(BAR_FEATURES), ("close",))
    train, test = _window_parts(numbered_bars(spark, folder, keep=True), BAR_FEATURES)
    pairs = window_regression.forecast_windows(test, shape, window_regression.fit_each(train, shape, WINDOW_L2))
    return pairs.select("symbol", "idx", rounded(F.col("predict"), 2).alias("predict"), "actual")


@query
def window_model_series(spark, folder):
    """Weights of one window model for all series."""
    shape = window_regression.Shape(("value",), ("value",))
    train, _ = _window_parts(numbered_series(spark, folder), ["value"])
    weights = window_regression.fit_pooled(train, shape, WINDOW_L2).weights[:, 0]
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "pos int, value double")
    return rows.select("pos", rounded(F.col("value")).alias("value"))


@query
def forecast_window_series(spark, folder):
    """Every series' test windows of five values, by a model of its own."""
    shape = window_regression.Shape(("value",), ("value",), SHORT_WINDOW)
    train, test = _window_parts(numbered_series(spark, folder), ["value"])
    pairs = window_regression.forecast_windows(test, shape, window_regression.fit_each(train, shape, WINDOW_L2))
    return pairs.select("series_id", "idx", rounded(F.col("predict"), 4).alias("predict"), "actual")


@query
def forecast_report(spark, folder):
    pairs = forecasting.forecast_test_windows(_bars_forecast(spark, folder, "ALL"), BAR_FEATURES)
    report = evaluation.regression_report(pairs, ["symbol", "feature"])
    return report.select(
        "symbol", "feature", "n", *[rounded(F.col(c), 4).alias(c) for c in ("mae", "rmse", "rse", "r2", "pearson_r")]
    )


@query
def predict_actual_series(spark, folder):
    pairs = forecasting.forecast_test_windows(_bars_forecast(spark, folder, "CLOSE"), ["close"])
    lines = overlay.predict_and_actual(pairs.drop("feature"), ["symbol"])
    return lines.withColumn("value", rounded(F.col("value"), 4))


@query
def predict_actual_range(spark, folder):
    pairs = forecasting.forecast_test_windows(_bars_forecast(spark, folder, "ALL"), BAR_FEATURES)
    return overlay.shared_range(pairs, ["symbol", "feature"])


@query
def overlay_series(spark, folder):
    fitted = _series_forecast(spark, folder)
    rows = forecasting.predict_next(fitted.rows.where(forecasting.fitted_series(["value"])), ["value"])
    lines = overlay.train_actual_predicted(rows, ["series_id"], "value")
    return lines.withColumn("value", rounded(F.col("value")))


# --- written and read back -------------------------------------------------


@query
def bars_from_csv(spark, folder):
    path = new_folder(spark, "bars")
    A.bars(spark, folder).select("date", "symbol", *BAR_FEATURES).write.csv(path, header=True)
    return read_bars(spark, path, symbol="A")


@query
def series_from_text(spark, folder):
    path = new_folder(spark, "lines")
    A.text_series(spark, folder).orderBy("vec_id").select("line").write.text(path)
    return read_series_text(spark, path, across_files=True)


def _clinical_files(spark: SparkSession, folder: str) -> tuple[str, str]:
    """One feature file and, for most sequences, one label file per sequence."""
    path = new_folder(spark, "sequences")
    write_files(A.clinical(spark, folder), f"{path}/sequence", "seq_id", SERIES_ORDER, A.EVENT_TYPES, header=True)
    write_files(A.clinical_labels_with_gaps(spark, folder), f"{path}/label", "seq_id", [], ["label"], header=True)
    return f"{path}/sequence", f"{path}/label"


@query
def files_numbered(spark, folder):
    """Every sequence's file, written and read back."""
    return read_numbered_files(spark, _clinical_files(spark, folder)[0], A.EVENT_TYPES, skip_lines=1, width=len(A.EVENT_TYPES))


@query
def files_range(spark, folder):
    """The files of an id range; the others are listed, not read."""
    return read_numbered_files(spark, _clinical_files(spark, folder)[0], A.EVENT_TYPES[:2], skip_lines=1, ids=FILE_IDS)


@query
def files_paired_aligned(spark, folder):
    """Pairs of files as examples, the class on the last step."""
    return read_labelled_files(spark, *_clinical_files(spark, folder), A.EVENT_TYPES, skip_lines=1)


@query
def files_unpaired(spark, folder):
    """Ids with a file on one side only, from the listings."""
    features, labels = (list_files(spark, path) for path in _clinical_files(spark, folder))
    return alignment.missing_sides(features, labels, "seq_id")


def _prepared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    embeddings = splitting.split_exact(A.table(spark, folder, "embeddings"), "vec_id", N_TRAIN, SHUFFLE_SEED)
    features = embeddings.select(F.col("vec_id").alias("seq_id"), "split", F.posexplode("embedding").alias("step", "value"))
    labels = embeddings.select(F.col("vec_id").alias("seq_id"), "split", "label")
    return features.withColumn("value", F.col("value").cast("double")), labels


@query
def prepared_test_split(spark, folder):
    path = new_folder(spark, "prepared")
    write_prepared(*_prepared(spark, folder), path)
    features, labels = read_prepared(spark, path, "test")
    joined = features.drop("split").join(labels.drop("split"), "seq_id")
    return joined.select("seq_id", "step", rounded(F.col("value")).alias("value"), "label")


@query
def prepared_written_once(spark, folder):
    """Rows per split after a run that failed half-way, a whole one, one more of the same and one of another making."""
    path = new_folder(spark, "prepared")
    features, labels = _prepared(spark, folder)
    features.write.partitionBy("split").parquet(f"{path}/tables-lost/features")
    made_from = fingerprint(features, labels, seed=SHUFFLE_SEED)
    wrote = [write_prepared(features, labels, path, made_from) for _ in range(2)]
    before = read_prepared(spark, path)
    wrote.append(write_prepared(features.where("step < 10"), labels, path, fingerprint(features, labels, seed=SHUFFLE_SEED, steps=10)))
    counted = [df.groupBy("split").agg(F.count(F.lit(1)).alias(name)) for df, name in zip((*before, *read_prepared(spark, path)), ("features", "labels", "features_anew", "labels_anew"))]
    both = counted[0].join(counted[1], "split").join(counted[2], "split").join(counted[3], "split")
    return both.withColumn("writes", F.lit(sum(wrote)))


# --- state and training ----------------------------------------------------

# No state of two-decimal values lies on a rounding border.
ALPHA = 1 / 3
DESCENT_STEPS = 5
DESCENT_RATE = 0.2


@query
def stateful_score_batch(spark, folder):
    scored = stateful.exponential_state(A.series(spark, folder), ["series_id"], SERIES_ORDER, "value", ALPHA)
    return scored.select("series_id", "event_id", rounded(F.col("state"), 4).alias("state"))


@query
def stateful_score_stream(spark, folder):
    """The same scores from a stream that is run until its input is used up."""
    schema = A.table(spark, folder, "events").schema
    # One file per micro-batch bounds what a series can hold of one batch.
    options = {"pathGlobFilter": "events.parquet", "maxFilesPerTrigger": "1"}
    stream = spark.readStream.schema(schema).options(**options).parquet(folder)
    scored = exponential_state_stream(stream, ["user_id"], SERIES_ORDER, "value", ALPHA)
    path = new_folder(spark, "scores")
    run = (
        scored.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return rows.select(F.col("user_id").alias("series_id"), "event_id", rounded(F.col("state"), 4).alias("state"))


# Thirds and sevenths: no state of two-decimal values lies on a rounding border.
TREND = (1 / 3, 1 / 7)


@query
def state_train_to_test_overlay(spark, folder):
    """Train, actual and predicted values of every series, by level and trend that pass from train into test."""
    rows = scaling.scale_series(numbered_series(spark, folder), ["value"], F.col("split") == "train")
    lines = overlay.train_actual_predicted(stateful.forecast_from_state(rows, "value", *TREND), ["series_id"], "value")
    return lines.withColumn("value", rounded(F.col("value"), 4))


@query
def state_with_restarts(spark, folder):
    """Level and trend of every series, cleared at each sign-up."""
    events = A.table(spark, folder, "events").select(
        F.col("user_id").alias("series_id"), "ts", "event_id", "value", (F.col("event_type") == RESTART_EVENT).alias("restart")
    )
    scored = stateful.trend_state(events, ["series_id"], SERIES_ORDER, "value", *TREND, restart="restart")
    return scored.select("series_id", "event_id", *[rounded(F.col(c), 4).alias(c) for c in ("level", "trend")])


def _as_slices(rows: DataFrame, keys: list[str], order: list[str], path: str) -> None:
    """Files of a stream: later slices of time after earlier ones, each series in one file of a slice, in order."""
    border = rows.agg(F.percentile_approx(order[0], 0.5).alias("at")).first().at
    early = F.col(order[0]) <= F.lit(border)
    files = max(1, -(-rows.count() // STREAM_ROWS))
    for part in (rows.where(early), rows.where(~early)):
        part.repartition(files, *keys).sortWithinPartitions(*keys, *order).write.mode("append").parquet(path)


@query
def state_stream_from_batch(spark, folder):
    """Level and trend of test rows on a stream that goes on from the batch-scored train rows."""
    rule = affine_scan.trend(*TREND)
    scaled = scaling.scale_series(numbered_series(spark, folder), ["value"], F.col("split") == "train").rows
    rows = write_through(scaled.select("series_id", *SERIES_ORDER, "split", F.col("value_scaled").alias("x")), "scaled")
    train = affine_scan.affine_states(rows.where("split = 'train'"), ["series_id"], SERIES_ORDER, "x", rule)
    initial = write_through(last_states(train, ["series_id"], SERIES_ORDER, rule), "initial")
    path = new_folder(spark, "stream")
    test = rows.where("split = 'test'").drop("split")
    _as_slices(test, ["series_id"], SERIES_ORDER, f"{path}/in")
    stream = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", "1").parquet(f"{path}/in")
    scored = affine_states_stream(stream, ["series_id"], SERIES_ORDER, "x", rule, initial)
    with typed_state(spark):
        run = scored.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress")
        run.trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{path}/rows")
    return done.select("series_id", "event_id", *[rounded(F.col(c)).alias(c) for c in ("level", "trend")])


def window_examples(spark: SparkSession, folder: str, length: int) -> DataFrame:
    """Windows of scaled values (x) with the scaled next value (y, label), inside each split."""
    rows = scaling.scale_series(numbered_series(spark, folder), ["value"], F.col("split") == "train")
    scaled_next = C.min_max(F.col("next_value"), F.col("value_min"), F.col("value_max"))
    rows = rows.map(lambda df: df.withColumn("scaled_next", scaled_next))
    windows = windowing.window_arrays(splitting.inside_splits(rows), ["value_scaled", "scaled_next"], length)
    label = F.element_at("steps", -1)["scaled_next"]
    return windows.select(
        "series_id",
        "window_id",
        F.transform("steps", lambda s: s["value_scaled"]).alias("x"),
        F.array(label).alias("y"),
        label.alias("label"),
        "split",
    )


def bar_examples(spark: SparkSession, folder: str, length: int) -> DataFrame:
    """Windows of all scaled features (x) with all scaled next values (y), inside each split."""
    bars = numbered_bars(spark, folder, keep=True)
    rows = scaling.scale_series(bars, BAR_FEATURES, F.col("split") == "train")
    ranges = {f: (F.col(f"{f}_min"), F.col(f"{f}_max")) for f in BAR_FEATURES}
    aimed = {f"{f}_aim": C.min_max(F.col(f"next_{f}"), *ranges[f]) for f in BAR_FEATURES}
    rows = rows.map(lambda df: df.withColumns(aimed))
    inputs, aims = [f"{f}_scaled" for f in BAR_FEATURES], [f"{f}_aim" for f in BAR_FEATURES]
    after = [f"next_{f}" for f in BAR_FEATURES]
    parts = [
        windowing.window_arrays(splitting.only_split(rows, split), [*inputs, *aims, *after], length)
        for split in ("train", "test")
    ]
    last = F.element_at("steps", -1)
    return parts[0].unionByName(parts[1]).select(
        "symbol",
        "window_id",
        "split",
        F.flatten(F.transform("steps", lambda s: F.array(*[s[c] for c in inputs]))).alias("x"),
        F.array(*[last[c] for c in aims]).alias("y"),
        *[last[c].alias(c) for c in after],
        *[F.col(f"{f}_{end}") for f in BAR_FEATURES for end in ("min", "max")],
    )


def vector_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings (x) with their class (label, one-hot y), by exact split."""
    rows = splitting.split_exact(A.table(spark, folder, "embeddings"), "vec_id", N_TRAIN, SHUFFLE_SEED)
    return rows.select(
        F.col("vec_id").alias("seq_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.transform(C.one_hot(F.col("label"), CLASSES), lambda c: c.cast("double")).alias("y"),
        "label",
        "split",
    )


def clinical_examples(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sequence: mean of each measurement (x), class (label, one-hot y)."""
    means = A.clinical(spark, folder).groupBy("seq_id").agg(
        F.array(*[F.avg(t) / 50 for t in A.EVENT_TYPES]).alias("x")
    )
    rows = means.join(A.clinical_labels(spark, folder), "seq_id")
    rows = rows.withColumn("y", F.transform(C.one_hot(F.col("label"), 2), lambda c: c.cast("double")))
    return splitting.split_by_hash(rows, ["seq_id"], HASH_SHARES, seed=1)


def _train_rows(examples: DataFrame) -> DataFrame:
    return examples.where(F.col("split") == "train")


def _descent_model(spark: SparkSession, folder: str, barrier: bool = False) -> training.Model:
    """A linear window regressor after steps of averaged full-batch descent from zero."""
    examples = _train_rows(window_examples(spark, folder, 5))
    learner = Learner("linear", inputs=5, outputs=1)
    # Workers that run together need a core each; full batches give the same weights with any number.
    workers = min(4, spark.sparkContext.defaultParallelism) if barrier else 4
    return training.train(
        examples, ["series_id", "window_id"], learner,
        Averaging(workers=workers, batch=None, epochs=DESCENT_STEPS, barrier=barrier), Updater("sgd", rate=DESCENT_RATE, clip=None),
        resume=training.Model(learner, np.zeros((len(training.STATE_PARTS), learner.size))),
    )


def _weight_rows(spark: SparkSession, model: training.Model) -> DataFrame:
    fitted = model_rows(spark, model, "linear", with_updater=False).where(F.col("epoch").isNull())
    return fitted.select("pos", rounded(F.col("value"), 6).alias("value"))


@query
def train_avg_linear(spark, folder):
    """Weights of the window regressor."""
    return _weight_rows(spark, _descent_model(spark, folder))


@query
def train_avg_barrier(spark, folder):
    """The same weights from workers that run together and average among themselves, one job per epoch."""
    return _weight_rows(spark, _descent_model(spark, folder, barrier=True))


@query
def model_round_trip(spark, folder):
    """The same weights, saved to a model table beside another model and loaded again."""
    model, path = _descent_model(spark, folder), new_folder(spark, "models")
    save_model(spark, training.Model(model.learner, model.state + 1), path, "other")
    save_model(spark, model, path, "linear")
    return _weight_rows(spark, load_model(spark, path, "linear"))


@query
def forecast_unfitted(spark, folder):
    """Series and features without a forecast model, and why."""
    return forecasting.unfitted(_bars_forecast(spark, folder, "ALL"), BAR_FEATURES)


@query
def train_avg_softmax(spark, folder):
    """Predicted class of every embedding, train and test."""
    examples = vector_examples(spark, folder)
    model = training.train(
        _train_rows(examples), ["seq_id"], Learner("softmax", inputs=64, outputs=CLASSES),
        Averaging(workers=4, batch=10, rounds=4, epochs=3), Updater("adam", rate=0.02, l2=1e-4),
    )
    scored = training.score(examples, model, ["seq_id", "split", "label"])
    return scored.select("seq_id", "split", "label", evaluation.argmax(F.col("output")).alias("pred"))


@query
def train_history(spark, folder):
    """Accuracy, F1 and AUC of the sequence classifier per epoch and split."""
    examples = clinical_examples(spark, folder)
    model = training.train(
        _train_rows(examples), ["seq_id"], Learner("softmax", inputs=len(A.EVENT_TYPES), outputs=2),
        Averaging(workers=4, batch=40, rounds=4, epochs=3, seed=1234), Updater("adam", rate=0.036),
    )
    return training.history(examples, model, "clinical")


@query
def train_avg_recurrent(spark, folder):
    """Error of the recurrent window regressor per epoch and split."""
    examples = window_examples(spark, folder, windowing.LENGTH)
    model = training.train(
        _train_rows(examples), ["series_id", "window_id"],
        Learner("recurrent", inputs=windowing.LENGTH, outputs=1, steps=windowing.LENGTH, hidden=8, dropout=0.2),
        Averaging(workers=4, batch=64, rounds=4, epochs=2), Updater("rmsprop", rate=0.005, l2=1e-4),
    )
    return training.history(examples, model, "recurrent")


@query
def forecast_trained(spark, folder):
    """Forecasts of all features by an averaged window model, in original units."""
    length = windowing.LENGTH
    examples = bar_examples(spark, folder, length)
    model = training.train(
        _train_rows(examples), ["symbol", "window_id"],
        Learner("linear", inputs=length * len(BAR_FEATURES), outputs=len(BAR_FEATURES)),
        Averaging(workers=4, batch=64, rounds=4, epochs=3), Updater("rmsprop", rate=0.005, l2=1e-4),
    )
    keep = [c for c in examples.columns if c not in ("x", "y", "split")]
    scored = training.score(examples.where(F.col("split") == "test"), model, keep)
    scored = scored.withColumns(
        {
            f"{f}_predict": C.undo_min_max(F.col("output")[i], F.col(f"{f}_min"), F.col(f"{f}_max"))
            for i, f in enumerate(BAR_FEATURES)
        }
    )
    return forecasting.long_pairs(scored.withColumnRenamed("window_id", "idx"), ["symbol"], BAR_FEATURES)


def step_examples(spark: SparkSession, folder: str) -> DataFrame:
    """One row per labelled sequence: its last steps with their mask (x), class and split."""
    ordered = number_rows(A.clinical(spark, folder), ["seq_id"], SERIES_ORDER)
    rows = alignment.last_steps_vector(ordered, LAST_STEPS, A.EVENT_TYPES, scale=0.01)
    return splitting.split_by_hash(rows.join(A.clinical_labels(spark, folder), "seq_id"), ["seq_id"], HASH_SHARES, seed=1)


def _train_balance(examples: DataFrame, classes: int, l2: float) -> DataFrame:
    """Train rows and summed probability per class: equal where the classifier has converged."""
    train = write_through(_train_rows(examples), "train-rows")
    model = softmax.fit_softmax(train, classes, l2)
    scored = softmax.classify(train, model, ["label"]).select("label", F.posexplode("output").alias("class", "p"))
    return scored.groupBy("class").agg(
        F.sum((F.col("label") == F.col("class")).cast("long")).alias("n"), rounded(F.sum("p"), 4).alias("probability")
    )


@query
def classify_aligned_steps(spark, folder):
    """Classes of sequences from their last steps, aligned at the end, by softmax regression."""
    return _train_balance(step_examples(spark, folder), 2, 1e-3)


@query
def classify_vector_steps(spark, folder):
    """Ten classes of sequences of 64 steps, by softmax regression."""
    return _train_balance(vector_examples(spark, folder).select("x", "label", "split"), CLASSES, 1e-3)


@query
def fit_pooled_ml(spark, folder):
    """One least-squares model of the next scaled value for all series together."""
    train = _train_rows(window_examples(spark, folder, 1))
    fitted = models.coefficients(train, models.fit_linear(train))
    return fitted.select("pos", rounded(F.col("value"), 5).alias("value"))


@query
def fit_windows_ml(spark, folder):
    """Errors of a least-squares model on whole windows, by split."""
    examples = window_examples(spark, folder, windowing.LENGTH)
    scored = models.apply_model(models.fit_linear(_train_rows(examples), l2=1e-4), examples)
    report = evaluation.regression_report(scored, ["split"], actual="label")
    return report.select("split", "n", *[rounded(F.col(c), 4).alias(c) for c in ("mse", "mae", "rmse")])


@query
def classify_vectors_ml(spark, folder):
    """Accuracy and F1 of softmax regression on the embeddings, by split."""
    examples = vector_examples(spark, folder)
    model = models.fit_classifier(_train_rows(examples), l2=1e-3)
    scored = models.apply_model(model, examples).withColumn("pred", F.col("predict").cast("int"))
    return evaluation.accuracy_f1(scored, ["split"])
