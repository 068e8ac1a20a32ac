"""Lag moments against windows written out, also for cut series and blocks."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import splitting, window_regression
from tidemark.operators.ordering import number_rows
from tidemark.operators.scaling import scale_series
from tidemark.operators.window_regression import Shape, fit_each, fit_pooled, forecast_windows, lag_moments, moving_forecasts, solve


@pytest.mark.parametrize("n", [3, 5, 6, 9, 30, 200])
@pytest.mark.parametrize("length,include_last", [(1, False), (3, True), (4, False)])
def test_moments_are_sums_over_windows(n, length, include_last):
    shape = Shape(("a", "b"), ("b", "a"), length, include_last)
    x = np.column_stack((np.random.default_rng(n).normal(size=(n, 2)), np.ones(n)))
    count = shape.n_windows(n)
    windows = np.array([x[w : w + length + 1].ravel() for w in range(count)]).reshape(count, (length + 1) * 3)
    want = windows.T @ windows
    assert np.allclose(lag_moments(x, 0, n, n, shape), want)
    for block in (1, 4, 7):
        parts = [lag_moments(x[a : a + block + length], a, min(block, n - a), n, shape) for a in range(0, n, block)]
        assert np.allclose(sum(parts), want)
    if count > 2 * shape.inputs:
        inputs = np.column_stack((np.delete(windows[:, : length * 3], np.s_[2::3], 1), np.ones(count)))
        weights = solve(want, shape, 1e-9)
        assert np.allclose(weights, np.linalg.lstsq(inputs, windows[:, length * 3 :][:, [1, 0]], rcond=None)[0], atol=1e-5)
        assert np.allclose(moving_forecasts(x, count, weights, shape), inputs @ weights)


def series(spark, nulls=False):
    rng = np.random.default_rng(7)
    rows = []
    for key, n in ((1, 300), (2, 90), (None, 60), (4, 8), (5, 2)):
        a = rng.normal(size=n).cumsum()
        rows += [(key, t, float(a[t]), float(rng.normal())) for t in range(n)]
    if nulls:
        rows.append((6, 0, None, 1.0))
    df = spark.createDataFrame(rows, "k bigint, t bigint, a double, b double").repartition(4)
    rows = splitting.split_by_time(number_rows(df, ["k"], ["t"], chunk_rows=50), 0.8)
    scaled = scale_series(rows, ["a", "b"], F.col("split") == "train")
    return splitting.only_split(scaled, "train"), splitting.only_split(scaled, "test"), df.collect()


def by_hand(rows, shape, pooled, l2):
    """Plain least squares on windows of arrays: key -> {(idx, feature): forecast}."""
    train, test, ranges = {}, {}, {}
    for key in {r.k for r in rows}:
        x = np.array([[r.a, r.b] for r in sorted((r for r in rows if r.k == key), key=lambda r: r.t)])
        cut = int(np.floor(len(x) * 0.8 + 0.5))
        low, high = x[:cut].min(0), x[:cut].max(0)
        scaled = (x - low) / np.where(high > low, high - low, 1.0)
        scaled[:, high == low] = 0.5
        train[key], test[key], ranges[key] = scaled[:cut], scaled[cut:], (low, high)
    aims = shape.aims

    def windows(x):
        count = shape.n_windows(len(x))
        inputs = np.array([np.append(x[w : w + shape.length].ravel(), 1.0) for w in range(count)]).reshape(count, shape.inputs)
        return inputs, np.array([x[w + shape.length][aims] for w in range(count)]).reshape(count, len(aims))

    def fit(parts):
        inputs, labels = (np.concatenate(p) for p in zip(*[windows(x) for x in parts]))
        penalty = np.diag([l2] * (shape.inputs - 1) + [0.0])
        return np.linalg.solve(inputs.T @ inputs + penalty, inputs.T @ labels) if len(inputs) else None

    every = fit(train.values())
    out = {}
    for key, x in test.items():
        weights = every if pooled else fit([train[key]])
        low, high = ranges[key]
        if weights is not None:
            said = windows(x)[0] @ weights * (high - low)[aims] + low[aims]
            out |= {(key, w, f): said[w, i] for w in range(len(said)) for i, f in enumerate(shape.targets)}
    return out


@pytest.mark.parametrize("pooled", [True, False])
@pytest.mark.parametrize("block", [1 << 16, 16])
@pytest.mark.parametrize("targets", [("b",), ("a", "b")])
def test_forecasts_equal_plain_least_squares(spark, monkeypatch, pooled, block, targets):
    monkeypatch.setattr(window_regression, "BLOCK", block)
    shape = Shape(("a", "b"), targets, 4)
    train, test, rows = series(spark)
    assert train.cut is not None
    models = (fit_pooled if pooled else fit_each)(train, shape, 0.1)
    got = {(r.k, r.idx, r.feature): r.predict for r in forecast_windows(test, shape, models).collect()}
    want = by_hand(rows, shape, pooled, 0.1)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_incomplete_rows_raise_and_no_rows_give_zeros(spark):
    shape = Shape(("a", "b"), ("a",), 4)
    train, _, _ = series(spark, nulls=True)
    with pytest.raises(PySparkException, match="complete rows"):
        fit_pooled(train, shape)
    none = train.map(lambda rows: rows.where("false"))
    assert not fit_pooled(none, shape).weights.any()
    assert fit_each(none, shape).count() == 0


def test_no_window_is_written(spark):
    train, _, _ = series(spark)
    parts = window_regression._groups(train, Shape(("a", "b"), ("a",), 4), {})
    plan = spark._jvm.PythonSQLUtils.explainString(parts[0][0]._jdf.queryExecution(), "simple")
    assert "Generate" not in plan and "collect_list" not in plan
