import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import alignment, evaluation, forecasting, overlay, scaling, splitting, windowing
from tidemark.operators.ordering import number_rows
from tidemark.plans.queries import window_examples

BAR = "date string, symbol string, open double, close double, low double, high double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    rows = []
    for d in range(30):
        # constant volume, all-negative low; "S" is too short for any window
        rows.append((f"2020-01-{d + 1:02d}", "LONG", 10.0 + d, 20.0 - d, -5.0 - d, 30.0 + d * d, 7.0))
    for d in range(23):
        rows.append((f"2020-01-{d + 1:02d}", "S", 1.0 + d, 2.0, -9.0, 3.0 + d, 5.0))
    return spark.createDataFrame(rows[::-1], BAR)


@pytest.mark.parametrize("n,expect", [(199, 176), (52, 29), (23, 0), (24, 1), (1, 0)])
def test_window_totals_for_known_lengths(spark, n, expect):
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    assert windowing.count_windows(df, ["k"]).first().n_windows == expect
    numbered = number_rows(df, ["k"], ["t"]).rows
    windows = windowing.to_windows(numbered)
    assert windows.count() == expect * 22
    assert windows.select("window_id").distinct().count() == expect
    assert windowing.last_steps(numbered).count() == expect
    assert windowing.to_windows(numbered, include_last=True).select("window_id").distinct().count() == max(n - 22, 0)


def test_windows_hold_consecutive_rows(bars):
    rows = windowing.to_windows(number_rows(bars, ["symbol"], ["date"], next_of=["open"]).rows).collect()
    assert {r.symbol for r in rows} == {"LONG"} and len(rows) == 7 * 22
    for r in rows:
        assert r.open == 10.0 + r.window_id + r.step
        assert r.next_open == r.open + 1
    labelled = windowing.label_last_step(
        windowing.to_windows(number_rows(bars, ["symbol"], ["date"], next_of=["open"]).rows), "next_open"
    )
    labels = {r.window_id: r.label_raw for r in labelled.collect() if r.label_raw is not None}
    assert labels == {w: 10.0 + w + 22 for w in range(7)}


@pytest.mark.parametrize("chunk_rows", [None, 3])
@pytest.mark.parametrize("block", [4, 64])
def test_window_arrays_agree_with_long_windows(bars, chunk_rows, block):
    numbered = number_rows(bars, ["symbol"], ["date"], chunk_rows=chunk_rows)
    long = {(r.symbol, r.window_id, r.step): r.open for r in windowing.to_windows(numbered.rows, 5).collect()}
    arrays = windowing.window_arrays(numbered, ["open"], 5, block=max(block, 5)).collect()
    assert {(a.symbol, a.window_id, i): s.open for a in arrays for i, s in enumerate(a.steps)} == long


def test_batches_end_short(bars):
    sizes = windowing.batch_sizes(windowing.count_windows(bars, ["symbol"]), ["symbol"], 3).collect()
    assert sorted((r.symbol, r.batch_id, r.n_examples) for r in sizes) == [("LONG", 0, 3), ("LONG", 1, 3), ("LONG", 2, 1)]


def test_min_max_true_range_and_constant_column(bars):
    rows = scaling.scale_by_key(bars, ["symbol"], C.BAR_FEATURES, fit_scope="all").collect()
    for r in rows:
        assert r.volume_scaled == 0.5
        assert r.low_max < 0
        assert all(0 <= r[f"{f}_scaled"] <= 1 for f in C.BAR_FEATURES)
    back = scaling.unscale(scaling.scale_by_key(bars, ["symbol"], C.BAR_FEATURES, fit_scope="all"), C.BAR_FEATURES)
    for r in back.collect():
        assert all(r[f"{f}_back"] == pytest.approx(r[f], abs=1e-9) for f in C.BAR_FEATURES)


def test_fit_scopes(bars):
    split = bars.withColumn("split", F.when(F.col("date") < "2020-01-11", "train").otherwise("test"))
    fit = lambda scope: {
        (r.symbol, r.date): r.open_scaled
        for r in scaling.scale_by_key(split, ["symbol"], ["open"], F.col("split") == "train", scope).collect()
    }
    assert fit("train")["LONG", "2020-01-30"] == pytest.approx(29 / 9)
    assert fit("all")["LONG", "2020-01-30"] == 1.0
    assert fit("per_split")["LONG", "2020-01-11"] == 0.0
    with pytest.raises(ValueError):
        fit("other")


@pytest.mark.parametrize("hot_rows", ["25", "100000"])
def test_two_files_each_scaled_by_itself(spark, bars, hot_rows):
    spark.conf.set("spark.tidemark.hotRows", hot_rows)
    try:
        both = splitting.union_files(bars.where("date < '2020-01-11'"), bars.where("date >= '2020-01-11'"))
        rows = scaling.scale_by_key(both, ["symbol"], ["open", "high"], fit_scope="per_split").collect()
    finally:
        spark.conf.unset("spark.tidemark.hotRows")
    assert len(rows) == 53
    ends = {(r.symbol, r.split): [] for r in rows}
    for r in rows:
        ends[r.symbol, r.split].append(r.open_scaled)
    assert len(ends) == 4 and all((min(v), max(v)) == (0.0, 1.0) for v in ends.values())


def test_vector_scaling_pools_all_symbols(bars):
    rows = scaling.scale_vector_min_max(bars).collect()
    assert set(rows[0].asDict()) == {"date", "symbol", "features"}
    assert max(r.features[0] for r in rows) == 1.0 and len(rows[0].features) == 5
    # position 3 is volume, 7 for one symbol and 5 for the other
    assert {r.features[3] for r in rows} == {0.0, 1.0}


def test_standard_constant_is_zero(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 1.0), ("b", 3.0)], "f string, v double")
    stats = scaling.with_feature_stats(df, "f", "v")
    got = sorted((r.f, r.z) for r in stats.select("f", C.standard(F.col("v"), F.col("mean"), F.col("std")).alias("z")).collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", -1.0), ("b", 1.0)]
    assert scaling.moments_long(df, ["f"], "v", sample_std=True).where("f = 'b'").first().std == pytest.approx(math.sqrt(2))


@pytest.mark.parametrize("n,train", [(5, 4), (7, 6), (8, 6), (1, 1), (3, 2), (12, 10)])
def test_time_split_rounds_half_up(spark, n, train):
    df = spark.range(n).select(F.lit(1).alias("k"), (F.lit(n) - F.col("id")).alias("t"))
    rows = splitting.split_by_time(number_rows(df, ["k"], ["t"])).rows.collect()
    assert sorted(r.t for r in rows if r.split == "train") == list(range(1, train + 1))


def test_splits_do_not_depend_on_partitioning(spark):
    ids = spark.range(600).withColumnRenamed("id", "i")
    for split in (
        lambda df: splitting.split_exact(df, "i", 450, 12345),
        lambda df: splitting.split_by_hash(df, ["i"], [("a", 0.8), ("b", 0.1), ("c", 0.1)]),
    ):
        one, other = split(ids.coalesce(1)).collect(), split(ids.repartition(13)).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and len(one) == 600


@pytest.mark.parametrize("n_train", [0, 1, 450, 599, 600, 1000])
def test_exact_split_size(spark, n_train):
    rows = splitting.split_exact(spark.range(600), "id", n_train, 1).where("split = 'train'")
    assert rows.count() == min(n_train, 600)


def test_exact_split_changes_with_the_seed(spark):
    picked = lambda seed: {r.id for r in splitting.split_exact(spark.range(100), "id", 50, seed).where("split = 'train'").collect()}
    assert picked(1) == picked(1) != picked(2)


def test_range_split_leaves_out_other_ids(spark):
    rows = splitting.split_by_ranges(spark.range(800), "id", [("train", 500), ("valid", 100), ("test", 150)])
    sizes = {r.split: (r["count"]) for r in rows.groupBy("split").count().collect()}
    assert sizes == {"train": 500, "valid": 100, "test": 150}


def test_align_end_masks_and_drops_unlabelled(spark):
    steps = spark.createDataFrame([(1, t, float(t)) for t in range(3)] + [(2, 0, 5.0), (3, 0, 1.0)], "s int, t int, x double")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "s int, label int")
    aligned = alignment.align_end(number_rows(steps, ["s"], ["t"]), labels)
    got = sorted((r.s, r.pos, r.label_mask, r.label) for r in aligned.rows.collect())
    assert got == [(1, 0, 0, None), (1, 1, 0, None), (1, 2, 1, 1), (2, 0, 1, 0)]
    padded = sorted((r.s, r.pos, r.x, r.step_mask, r.label_mask) for r in alignment.pad_to(aligned, 3, ["x"]).rows.collect())
    assert [p[1] for p in padded] == [0, 1, 2, 0, 1, 2]
    assert padded[4] == (2, 1, 0.0, 0, 0)
    missing = alignment.missing_sides(steps, labels.union(spark.createDataFrame([(9, 1)], labels.schema)), "s")
    assert sorted(map(tuple, missing.collect())) == [(3, "label"), (9, "features")]


def test_auc_with_ties(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.5), ("a", 1, 0.5), ("a", 0, 0.1), ("b", 1, 1.0), ("c", 1, 0.2), ("c", 0, 0.2)]
    df = spark.createDataFrame(rows, "split string, label int, score double")
    got = {r.split: r.auc for r in evaluation.roc_auc(df, ["split"]).collect()}
    assert got == {"a": 0.875, "b": None, "c": 0.5}


def test_auc_equals_spark_ml(spark, cut_small):
    df = spark.range(500).select(
        F.lit("x").alias("split"),
        (F.xxhash64("id") % 2 == 0).cast("int").alias("label"),
        F.pmod(F.xxhash64("id", F.lit(5)), F.lit(40)).cast("double").alias("score"),
    )
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert evaluation.roc_auc(df, ["split"]).first().auc == pytest.approx(ml, abs=1e-9)


def test_class_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "label int, pred int")
    report = {r["class"]: r for r in evaluation.class_report(df).collect()}
    assert (report[0].tp, report[0].fp, report[0].fn) == (1, 1, 1)
    assert (report[2].precision, report[2].recall, report[2].f1) == (0.0, 0.0, 0.0)
    total = evaluation.accuracy_f1(df).first()
    assert total.n == 4 and total.accuracy == 0.5
    assert total.f1_macro == pytest.approx((0.5 + 2 / 3 + 0) / 3)


def test_regression_report(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)], "actual double, predict double")
    r = evaluation.regression_report(df).first()
    assert (r.mse, r.mae) == (0.5, 0.5)
    assert r.rse == pytest.approx(0.4) and r.r2 == pytest.approx(0.6) and r.pearson_r == pytest.approx(0.8)
    flat = evaluation.regression_report(spark.createDataFrame([(1.0, 2.0)], df.schema)).first()
    assert flat.rse is None and flat.pearson_r is None


def test_forecast_of_a_line_is_exact(bars):
    rising = bars.where("symbol = 'LONG'")
    fitted = forecasting.prepare(rising, ["symbol"], ["date"], ["open", "volume"], short=True)
    pairs = forecasting.forecast_test_rows(fitted, ["open", "volume"]).collect()
    assert pairs and {p.feature for p in pairs} == {"open"}  # a constant volume has no model
    lacking = forecasting.unfitted(fitted, ["open", "volume"]).collect()
    assert [(r.feature, r.reason) for r in lacking] == [("volume", "constant in train")]
    pairs = forecasting.forecast_test_rows(fitted, ["open"]).collect()
    assert len(pairs) == 6
    assert all(p.predict == pytest.approx(p.actual) for p in pairs)


def test_overlay_offsets(bars):
    fitted = forecasting.prepare(bars.where("symbol = 'LONG'"), ["symbol"], ["date"], ["open"], short=True)
    lines = overlay.train_actual_predicted(forecasting.predict_next(fitted.rows, ["open"]), ["symbol"], "open")
    span = {r.series_name: (r.lo, r.hi) for r in lines.groupBy("series_name").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).collect()}
    assert span == {"train": (0, 23), "actual": (23, 28), "predicted": (24, 29)}


def test_shared_range_truncates(spark):
    df = spark.createDataFrame([("a", 100.0, 103.0), ("a", -50.0, 40.0)], "k string, predict double, actual double")
    r = overlay.shared_range(df, ["k"]).first()
    assert (r.range_min, r.range_max) == (-49, 105)


def test_targets():
    assert C.target_columns("ALL") == C.BAR_FEATURES
    assert C.target_columns("CLOSE") == ["close"]
    with pytest.raises(ValueError):
        C.target_columns("MIDDLE")


@pytest.mark.parametrize("border_rows", [1, 5, 100_000])
def test_nth_hash(spark, border_rows):
    from tidemark.operators.splitting import nth_hash

    rows = sorted([(f"{i * 2654435761 % 2**32:08x}" + "0" * 24, i) for i in range(300)] + [("abcd" + "e" * 28, i) for i in range(20)])
    df = spark.createDataFrame(rows, "hash string, id int").repartition(5)
    for n in (1, 2, 150, 211, len(rows) - 1, len(rows)):
        assert nth_hash(df, n, border_rows) == rows[n - 1]
    assert nth_hash(df, len(rows) + 1, border_rows) is None
    assert nth_hash(df.limit(0), 1, border_rows) is None


@pytest.mark.parametrize("chunk_rows", [None, 9])
def test_windows_inside_splits_in_one_pass(spark, chunk_rows):
    series = F.when(F.col("id") >= 100, 9).when(F.col("id") % 3 > 0, F.col("id") % 3)
    rows = spark.range(106).select(series.alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 11).alias("v"))
    split = splitting.split_by_time(number_rows(rows, ["k"], ["t"], chunk_rows=chunk_rows), 0.7)
    once = windowing.window_arrays(splitting.inside_splits(split), ["v"], 3)
    apart = [windowing.window_arrays(splitting.only_split(split, part), ["v"], 3) for part in ("train", "test")]
    columns = ["k", "split", "window_id", "n_rows", F.col("steps.v").alias("v")]
    expected = apart[0].unionByName(apart[1]).select(*columns).collect()
    assert len(expected) == 76 and sorted(map(str, once.select(*columns).collect())) == sorted(map(str, expected))


def test_both_splits_share_one_scan_of_the_series(spark, tmp_path):
    rows = spark.range(60).select("id", F.timestamp_seconds("id").alias("ts"), (F.col("id") * 1.5).alias("value"))
    events = rows.select(F.col("id").alias("event_id"), "ts", (F.col("id") % 2).alias("user_id"), "value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    examples = window_examples(spark, str(tmp_path), 3)
    assert examples.groupBy("split").count().count() == 2
    assert examples._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
