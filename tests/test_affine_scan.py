"""Affine scans against row-by-row updates, for any batches, chunks and restarts."""

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from conftest import TINY
from pyspark.errors import PySparkException

from tidemark.operators.affine_scan import affine_states, exponential, scan, scan_whole, trend
from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES
from tidemark.session import CHUNK_ROWS


def row_by_row(rule, x, restart, before):
    step, gain, start = map(np.array, (rule.step, rule.gain, rule.start))
    out = []
    for value, again in zip(x, restart):
        before = start * value if again else step @ before + gain * value
        out.append(before)
    return np.array(out)


@pytest.mark.parametrize("rule", [exponential(0.3), trend(0.4, 0.25), trend(1.0, 0.0)])
@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 1000])
@pytest.mark.parametrize("share", [0.0, 0.02, 1.0])
def test_scan(rule, n, share):
    rng = np.random.default_rng(n)
    x, restart = rng.normal(size=n), rng.random(n) < share
    d = len(rule.names)
    before = rng.normal(size=d)
    states, maps = scan(rule, x, restart, before, np.eye(d))
    assert np.allclose(states, row_by_row(rule, x, restart, before))
    alone, _ = scan(rule, x, restart, np.zeros(d), np.eye(d))
    assert np.allclose(states, alone + maps @ before)
    half = n // 2
    if half:
        first, far = scan(rule, x[:half], restart[:half], before, np.eye(d))
        rest, farther = scan(rule, x[half:], restart[half:], first[-1], far[-1])
        assert np.allclose(np.concatenate((first, rest)), states) and np.allclose(np.concatenate((far, farther)), maps)


def test_holt_by_its_two_equations():
    x = np.array([3.0, 5.0, 4.0, 8.0])
    states, _ = scan(trend(0.5, 0.2), x, np.array([True, False, False, False]), np.zeros(2), np.eye(2))
    level, slope = 3.0, 0.0
    for value, (l, b) in zip(x[1:], states[1:]):
        new = 0.5 * value + 0.5 * (level + slope)
        level, slope = new, 0.2 * (new - level) + 0.8 * slope
        assert (l, b) == pytest.approx((level, slope))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_batch_borders_do_not_matter(size):
    keys = ["a"] * 7 + [None] * 5 + ["b"] + ["c"] * 20
    x = np.arange(len(keys), dtype=float) ** 1.3
    table = pa.table({"k": pa.array(keys, pa.string()), "x": x})
    batches = [b for i in range(0, len(keys), size) for b in table.slice(i, size).to_batches()]
    out = pa.Table.from_batches(list(scan_whole(iter(batches), trend(0.4, 0.3), ["k"], "x", None)))
    restart = [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]
    want = row_by_row(trend(0.4, 0.3), x, restart, np.zeros(2))
    assert np.allclose(np.column_stack((out["level"], out["trend"])), want)


def rows_of_three_series():
    rng = np.random.default_rng(11)
    return [(k, t, float(rng.normal()), bool(rng.random() < 0.15) if t % 3 else None) for k, n in (("a", 90), (None, 40), ("c", 3)) for t in range(n)]


@pytest.mark.parametrize("chunk_rows", ["1000000", "1", "7"])
@pytest.mark.parametrize("restart", [None, "again"])
def test_states_of_cut_series(spark, chunk_rows, restart):
    rows = rows_of_three_series()
    df = spark.createDataFrame(rows, "k string, t int, x double, again boolean").repartition(5)
    spark.conf.set(CHUNK_ROWS, chunk_rows)
    try:
        got = {(r.k, r.t): (r.level, r.trend) for r in affine_states(df, ["k"], ["t"], "x", trend(0.3, 0.6), restart).collect()}
    finally:
        spark.conf.unset(CHUNK_ROWS)
    assert len(got) == len(rows)
    for key in ("a", None, "c"):
        mine = [r for r in rows if r[0] == key]
        again = [r[1] == 0 or bool(restart and r[3]) for r in mine]
        want = row_by_row(trend(0.3, 0.6), [r[2] for r in mine], again, np.zeros(2))
        assert np.allclose([got[key, t] for t in range(len(mine))], want)


def test_nulls_raise_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0)], "k string, t int, x double")
    with pytest.raises(PySparkException, match="x is null"):
        affine_states(df, ["k"], ["t"], "x", exponential(0.5)).collect()
    none = affine_states(df.where("false"), ["k"], ["t"], "x", exponential(0.5))
    assert none.columns == ["k", "t", "x", "state"] and none.count() == 0


@pytest.mark.parametrize("name", ["state_train_to_test_overlay", "state_with_restarts"])
def test_queries_equal_sql_when_series_are_cut(spark, cut_small, name):
    assert differences(QUERIES[name](spark, TINY), connect(TINY), ORACLE[name]) is None
