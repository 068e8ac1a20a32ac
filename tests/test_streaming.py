import numpy as np
import pandas as pd
import pytest
from conftest import TINY
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators.affine_scan import affine_states, exponential, trend
from tidemark.operators.learners import Learner
from tidemark.operators.stateful import exponential_state
from tidemark.operators.training import Model
from tidemark.plans.adapters import series
from tidemark.streaming.affine import PROVIDER, affine_states_stream, last_states, typed_state
from tidemark.streaming.stateful import exponential_state_stream, recurrent_state_stream


def run(spark, stream, path):
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_stream_in_three_batches_equals_batch(spark, tmp_path):
    rows = series(spark, TINY)
    ordered = rows.orderBy("ts", "event_id").toPandas()
    for i in range(3):
        part = ordered.iloc[i * len(ordered) // 3 : (i + 1) * len(ordered) // 3]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    out = run(spark, exponential_state_stream(stream, ["series_id"], ["ts", "event_id"], "value", 0.3), tmp_path)
    got = {r.event_id: round(r.state, 8) for r in out.collect()}
    batch = exponential_state(rows, ["series_id"], ["ts", "event_id"], "value", 0.3)
    assert got == {r.event_id: round(r.state, 8) for r in batch.collect()}


def test_restart_clears_the_state(spark, tmp_path):
    df = spark.createDataFrame(
        pd.DataFrame({"k": [1] * 6, "t": range(6), "x": [1.0, 2, 3, 10, 20, 30], "r": [False] * 3 + [True] + [False] * 2})
    )
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = run(spark, exponential_state_stream(stream, ["k"], ["t"], "x", 0.5, restart="r"), tmp_path)
    assert [r.state for r in out.orderBy("t").collect()] == [1.0, 1.5, 2.25, 10.0, 15.0, 22.5]
    assert out.where(F.col("r")).count() == 1


def test_recurrent_state_is_carried_across_batches(spark, tmp_path):
    learner = Learner("recurrent", inputs=2 * 12, outputs=2, steps=12, hidden=3)
    weights = np.random.default_rng(4).normal(size=learner.size)
    rng = np.random.default_rng(5)
    values = {k: rng.normal(size=(12, 2)) for k in (1, 2)}
    for part in (range(0, 5), range(5, 12)):  # the first rows, later the rest
        rows = [(k, t, *map(float, values[k][t])) for t in part for k in values]
        spark.createDataFrame(rows, "k int, t int, a double, b double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, t int, a double, b double").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    model = Model(learner, np.vstack([weights] + [np.zeros(learner.size)] * 3))
    out = run(spark, recurrent_state_stream(stream, ["k"], ["t"], ["a", "b"], model), tmp_path)
    ends = {r.k: r.output for r in out.where("t = 11").collect()}
    for k in values:
        assert np.allclose(ends[k], learner.predict(weights, values[k].reshape(1, -1))[0])
    assert out.count() == 24


def write_parts(spark, path, *parts):
    for rows in parts:
        spark.createDataFrame(rows, "k string, t int, x double, r boolean").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema("k string, t int, x double, r boolean").option("maxFilesPerTrigger", "1").parquet(f"{path}/in")


def test_stream_goes_on_from_a_batch_scored_past(spark, tmp_path):
    rule = trend(0.4, 0.3)
    rows = [(k, t, float((7 * t + len(k)) % 5), t == 8 and k == "aa") for k in ("a", "aa", "aaa") for t in range(12)]
    df = spark.createDataFrame(rows, "k string, t int, x double, r boolean")
    want = {(r.k, r.t): (r.level, r.trend) for r in affine_states(df, ["k"], ["t"], "x", rule, restart="r").collect()}
    past = affine_states(df.where("t < 5 and k <> 'aaa'"), ["k"], ["t"], "x", rule, restart="r")
    later = [r for r in rows if r[1] >= 5 or r[0] == "aaa"]
    stream = write_parts(spark, tmp_path, [r for r in later if r[1] < 9], [r for r in later if r[1] >= 9])
    with typed_state(spark):
        out = run(spark, affine_states_stream(stream, ["k"], ["t"], "x", rule, last_states(past, ["k"], ["t"], rule), "r"), tmp_path)
    got = {(r.k, r.t): (r.level, r.trend) for r in out.collect()}
    assert set(got) == {r[:2] for r in later}
    assert all(np.allclose(got[k], want[k]) for k in got)
    assert "HDFSBacked" in spark.conf.get(PROVIDER)


def test_rows_out_of_order_raise(spark, tmp_path):
    stream = write_parts(spark, tmp_path, [("a", 5, 1.0, False)], [("a", 4, 1.0, False)])
    with typed_state(spark), pytest.raises(StreamingQueryException, match="after one at"):
        run(spark, affine_states_stream(stream, ["k"], ["t"], "x", exponential(0.5)), tmp_path)
