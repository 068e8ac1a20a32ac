import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.joins import hot_keys, join_on_key
from tidemark.operators.ordering import number_rows
from tidemark.operators.stateful import exponential_state


def rows_with_one_long_series(seed=3):
    rng = random.Random(seed)
    rows = [("long", t // 3, t % 3, float(rng.randrange(1000)) - 500) for t in range(300)]
    rows += [(f"s{i}", t, 0, float(rng.randrange(1000))) for i in range(40) for t in range(i % 7)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(rows_with_one_long_series(), "k string, t int, u int, x double").repartition(7).cache()


def by_hand(rows):
    out = {}
    for key in {r[0] for r in rows}:
        part = sorted(r for r in rows if r[0] == key)
        total = 0.0
        for pos, row in enumerate(part):
            nxt = part[pos + 1][3] if pos + 1 < len(part) else None
            out[row[:3]] = (pos, len(part), nxt, total)
            total += row[3]
    return out


@pytest.mark.parametrize("chunk_rows", [None, 1, 2, 5, 50])
def test_number_rows(series, chunk_rows):
    done = number_rows(series, ["k"], ["t", "u"], next_of=["x"], running=["x"], chunk_rows=chunk_rows)
    got = {(r.k, r.t, r.u): (r.pos, r.n_rows, r.next_x, r.x_before) for r in done.rows.collect()}
    assert got == by_hand(rows_with_one_long_series())
    assert (done.cut is None) == (chunk_rows is None)


def test_null_values_are_not_taken_for_a_missing_next_row(spark):
    rows = [("a", t, None if t % 2 else float(t)) for t in range(40)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    done = number_rows(df, ["k"], ["t"], next_of=["x"], chunk_rows=3)
    got = {r.t: r.next_x for r in done.rows.collect()}
    assert got == {t: (rows[t + 1][2] if t < 39 else None) for t in range(40)}


def test_missing_order_values_come_first(spark):
    rows = [("a", None, i) for i in range(20)] + [("a", t, i if i else None) for t in range(10) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, t int, u int")
    expect = [(r.t, r.u) for r in df.orderBy("t", "u").collect()]
    for chunk_rows in (None, 1, 3):
        done = number_rows(df, ["k"], ["t", "u"], chunk_rows=chunk_rows).rows.collect()
        assert [(r.t, r.u) for r in sorted(done, key=lambda r: r.pos)] == expect


@pytest.mark.parametrize("chunk_rows", [None, 4])
def test_whole_table_is_one_series(series, chunk_rows):
    done = number_rows(series, [], ["k", "t", "u"], chunk_rows=chunk_rows).rows
    got = [(r.k, r.t, r.u) for r in sorted(done.collect(), key=lambda r: r.pos)]
    assert got == sorted(r[:3] for r in rows_with_one_long_series())


@pytest.mark.parametrize("chunk_rows", [None, 4])
def test_series_stats_and_attach(spark, series, chunk_rows):
    names = spark.createDataFrame([("long", "L"), ("s3", "three")], "k string, name string")
    done = (
        number_rows(series, ["k"], ["t", "u"], chunk_rows=chunk_rows)
        .with_series_stats({"top": F.max("x"), "odd": F.count(F.when(F.col("pos") % 2 == 1, 1))})
        .attach(names)
        .with_series_stats({"again": F.min("top")})
    )
    got = {(r.k, r.top, r.odd, r.name, r.again) for r in done.rows.collect()}
    rows = rows_with_one_long_series()
    expect = set()
    for key, name in (("long", "L"), ("s3", "three")):
        values = [r[3] for r in rows if r[0] == key]
        expect.add((key, max(values), len(values) // 2, name, max(values)))
    assert got == expect
    assert done.rows.count() == 303


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_on_hot_key_keeps_every_row(spark, series, how):
    right = spark.createDataFrame([("long", 1), ("long", 2), ("s5", 3)], "k string, y int")
    key = lambda df: sorted((r.k, r.t, r.u, r.y or 0) for r in df.collect())
    assert key(join_on_key(series, right, ["k"], how, hot_rows=100)) == key(series.join(right, ["k"], how))
    assert [r.k for r in hot_keys(series, ["k"], 100).collect()] == ["long"]
    assert hot_keys(series, ["k"], 10_000) is None


def test_hot_keys_without_other_columns_and_refused_joins(spark, series):
    keys, right = series.select("k"), spark.createDataFrame([("long", 1), ("s5", 3)], "k string, y int")
    assert join_on_key(keys, right, ["k"], hot_rows=100).count() == 305
    for how in ("right", "full"):
        with pytest.raises(ValueError):
            join_on_key(series, right, ["k"], how, hot_rows=100)


def test_a_null_key_is_cut_like_any_other(spark):
    rows = [(None, t, float(t)) for t in range(100)] + [("a", t, 1.0) for t in range(4)]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(3)
    done = number_rows(df, ["k"], ["t"], next_of=["x"], running=["x"], chunk_rows=10)
    assert done.whole.count() == 4 and done.cut.groupBy("_chunk").count().agg(F.max("count")).first()[0] < 40
    done = done.with_series_stats({"top": F.max("x")})
    got = {r.t: (r.pos, r.n_rows, r.next_x, r.x_before, r.top) for r in done.rows.where("k is null").collect()}
    assert got == {t: (t, 100, t + 1.0 if t < 99 else None, t * (t - 1) / 2, 99.0) for t in range(100)}
    states = exponential_state(df, ["k"], ["t"], "x", 0.5).where("k is null").orderBy("t").collect()
    assert len(states) == 100 and states[2].state == pytest.approx(1.25)


@pytest.mark.parametrize("chunk_rows", ["1000000", "1", "6"])
@pytest.mark.parametrize("alpha", [0.02, 0.3, 1.0])
def test_exponential_state(spark, series, chunk_rows, alpha):
    spark.conf.set("spark.tidemark.chunkRows", chunk_rows)
    try:
        got = {(r.k, r.t, r.u): r.state for r in exponential_state(series, ["k"], ["t", "u"], "x", alpha).collect()}
    finally:
        spark.conf.unset("spark.tidemark.chunkRows")
    rows, expect = rows_with_one_long_series(), {}
    for name in {r[0] for r in rows}:
        state = None
        for row in sorted(r for r in rows if r[0] == name):
            state = row[3] if state is None else alpha * row[3] + (1 - alpha) * state
            expect[row[:3]] = state
    assert got.keys() == expect.keys()
    assert all(got[k] == pytest.approx(expect[k], abs=1e-9) for k in expect)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_hot_null_key_is_dealt_out(spark, how):
    rows = [(None, i) for i in range(2000)] + [("a", i) for i in range(500)] + [("b", 1)]
    many = spark.createDataFrame(rows, "k string, x int").repartition(4)
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, y int")
    joined = join_on_key(many, one, ["k"], how, hot_rows=100)
    assert sorted(joined.fillna("none").fillna(-1).collect()) == sorted(many.join(one, "k", how).fillna("none").fillna(-1).collect())
    hot = {r.k: r._salts for r in hot_keys(many, ["k"], 100).collect()}
    assert hot == {None: 40, "a": 10}
