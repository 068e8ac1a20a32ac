import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tidemark.operators import training
from tidemark.operators.learners import PREDICT_ROWS, Learner, Updater
from tidemark.operators.training import Averaging

SMALL = [
    Learner("linear", inputs=3, outputs=2),
    Learner("softmax", inputs=3, outputs=4),
    Learner("recurrent", inputs=6, outputs=2, steps=3, hidden=3),
    Learner("recurrent", inputs=6, outputs=3, steps=3, hidden=3, classes=True),
]


def loss(learner, w, x, y):
    p = learner.predict(w, x)
    if learner.is_classifier:
        return -(y * np.log(p)).sum() / len(x)
    return 0.5 * ((p - y) ** 2).sum() / len(x)


@pytest.mark.parametrize("learner", SMALL, ids=lambda m: f"{m.kind}-{m.is_classifier}")
def test_gradient_equals_finite_differences(learner):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(5, learner.inputs)), learner.start(2) + 0.1
    y = np.eye(learner.outputs)[rng.integers(0, learner.outputs, 5)] if learner.is_classifier else rng.normal(size=(5, learner.outputs))
    numeric = np.empty(learner.size)
    for i in range(learner.size):
        e = np.zeros(learner.size)
        e[i] = 1e-6
        numeric[i] = (loss(learner, w + e, x, y) - loss(learner, w - e, x, y)) / 2e-6
    assert np.allclose(learner.gradient(w, x, y, rng), numeric, atol=1e-6)


@pytest.mark.parametrize("kind", ["sgd", "nesterov", "rmsprop", "adam"])
def test_updaters_go_downhill(kind):
    state = np.zeros((4, 2))
    state[0] = [3.0, -2.0]
    updater = Updater(kind, rate=0.05, clip=None)
    for _ in range(400):
        updater.step(state, state[0].copy())
    assert np.abs(state[0]).max() < 0.2
    with pytest.raises(ValueError):
        Updater("other").step(state, state[0])


@pytest.fixture(scope="module")
def line(spark):
    """y = 2 a - b + 0.5 over 600 rows."""
    a, b = F.pmod(F.xxhash64("id"), F.lit(100)) / 100, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100
    y = 2 * a - b + 0.5
    return spark.range(600).select(
        "id", F.array(a, b).alias("x"), F.array(y).alias("y"), y.alias("label"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
    )


def test_averaging_reaches_the_closed_form(line):
    model = training.train(
        line, ["id"], Learner("linear", inputs=2, outputs=1),
        Averaging(workers=3, batch=20, frequency=5, epochs=12), Updater("nesterov", rate=0.1, clip=None),
    )
    assert model.weights == pytest.approx([2.0, -1.0, 0.5], abs=0.05)
    assert len(model.history) == 12
    history = training.history(line, model, "run")
    mse = {(r.epoch, r.split): r.value for r in history.where("metric = 'mse'").collect()}
    assert len(mse) == 24 and mse[11, "test"] < mse[0, "test"]


def test_every_row_is_dealt_once(line):
    plan = Averaging(workers=3, batch=8, frequency=2)
    dealt = training.deal_rounds(line, ["id"], plan)
    assert dealt.count() == 600
    assert dealt.select("round_id").distinct().count() == -(-600 // (3 * plan.batch * plan.frequency))
    assert dealt.select("worker").distinct().count() == 3


def test_asking_for_rounds(line):
    dealt = training.deal_rounds(line, ["id"], Averaging(workers=3, batch=8, rounds=4))
    assert dealt.count() == 600
    assert sorted(r.round_id for r in dealt.select("round_id").distinct().collect()) == [0, 1, 2, 3]


def test_one_worker_equals_plain_descent(line):
    learner, updater = Learner("linear", inputs=2, outputs=1), Updater("nesterov", rate=0.05)
    plan = Averaging(workers=1, batch=50, frequency=3, epochs=2)
    model = training.train(line, ["id"], learner, plan, updater)
    dealt = training.deal_rounds(line, ["id"], plan)
    state = np.zeros((4, learner.size))
    state[0] = learner.start(plan.seed)
    for _ in range(2):
        for number in range(4):
            rows = dealt.where(F.col("round_id") == number).orderBy("key").collect()
            for at in range(0, len(rows), 50):
                part = rows[at : at + 50]
                x, y = np.array([r.x for r in part]), np.array([r.y for r in part])
                updater.step(state, learner.gradient(state[0], x, y, np.random.default_rng(0)))
    assert model.weights == pytest.approx(state[0], abs=1e-9)


def test_result_does_not_depend_on_partitioning(line):
    learner, plan = Learner("linear", inputs=2, outputs=1), Averaging(workers=4, batch=10)
    one = training.train(line.coalesce(1), ["id"], learner, plan)
    other = training.train(line.repartition(9), ["id"], learner, plan)
    assert one.weights == pytest.approx(other.weights, abs=1e-9)


def test_result_depends_on_neither_cores_nor_file_splits(spark, line):
    learner, plan = Learner("linear", inputs=2, outputs=1), Averaging(workers=2, batch=10)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    one = training.train(line, ["id"], learner, plan)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        other = training.train(line, ["id"], learner, plan)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert one.weights == pytest.approx(other.weights, abs=1e-12)


def test_full_batch_descent_is_the_same_for_any_number_of_workers(line):
    learner, updater = Learner("linear", inputs=2, outputs=1), Updater("sgd", rate=0.3, clip=None)
    two, eight = (training.train(line, ["id"], learner, Averaging(workers=n, batch=None, epochs=3), updater) for n in (2, 8))
    assert two.weights == pytest.approx(eight.weights, abs=1e-12)


def test_empty_rounds_change_nothing(line):
    learner = Learner("linear", inputs=2, outputs=1)
    model = training.train(line.limit(4), ["id"], learner, Averaging(workers=2, batch=2, rounds=30))
    assert np.isfinite(model.weights).all() and np.abs(model.weights).max() < 10


def test_history_of_several_outputs(line):
    rows = line.withColumn("y", F.array(F.col("label"), -F.col("label")))
    model = training.train(rows, ["id"], Learner("linear", inputs=2, outputs=2), Averaging(workers=2, batch=50))
    assert {r.metric for r in training.history(rows, model, "r").collect()} == {"mse_0", "mse_1", "mae_0", "mae_1"}


def test_resuming_goes_on_where_training_stopped(line):
    learner = Learner("linear", inputs=2, outputs=1)
    updater = Updater("adam", rate=0.05)
    whole = training.train(line, ["id"], learner, Averaging(workers=2, batch=30, epochs=2), updater)
    half = training.train(line, ["id"], learner, Averaging(workers=2, batch=30), updater)
    both = training.train(line, ["id"], learner, Averaging(workers=2, batch=30), updater, resume=half)
    assert both.weights == pytest.approx(whole.weights, abs=1e-9)


def test_more_workers_than_rows(line):
    model = training.train(line.limit(3), ["id"], Learner("linear", inputs=2, outputs=1), Averaging(workers=50))
    assert np.isfinite(model.weights).all()
    with pytest.raises(ValueError):
        training.train(line.limit(0), ["id"], Learner("linear", inputs=2, outputs=1))


def test_classifier_history_has_auc(line):
    rows = line.withColumn("label", (F.col("x")[0] > F.col("x")[1]).cast("int"))
    rows = rows.withColumn("y", F.when(F.col("label") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))
    model = training.train(
        rows.where("split = 'train'"), ["id"], Learner("softmax", inputs=2, outputs=2),
        Averaging(workers=2, batch=20, epochs=3), Updater("adam", rate=0.1),
    )
    metrics = {(r.epoch, r.split, r.metric): r.value for r in training.history(rows, model, "c").collect()}
    assert len(metrics) == 3 * 2 * 3
    assert metrics[2, "test", "auc"] > 0.95 and metrics[2, "test", "accuracy"] > 0.85


@pytest.mark.parametrize("batch,rounds", [(None, None), (8, 3), (16, None)])
@pytest.mark.parametrize("workers", [1, 3])
def test_workers_that_run_together_give_the_same_weights(spark, line, batch, rounds, workers):
    learner, updater = Learner("linear", inputs=2, outputs=1), Updater("adam", rate=0.05)
    plans = [Averaging(workers=workers, batch=batch, rounds=rounds, frequency=2, epochs=2, barrier=barrier) for barrier in (False, True)]
    one, other = (training.train(line, ["id"], learner, plan, updater) for plan in plans)
    assert np.allclose(one.state, other.state, rtol=0, atol=1e-12) and len(one.history) == len(other.history) == 2
    assert all(np.allclose(a, b, rtol=0, atol=1e-12) for a, b in zip(one.history, other.history))


def test_an_epoch_is_one_job_and_no_rounds_table_is_written(spark, line, tmp_path):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    learner = Learner("linear", inputs=2, outputs=1)
    jobs = []
    for epochs in (2, 5):
        context.setJobGroup(f"epochs-{epochs}", "")
        training.train(line, ["id"], learner, Averaging(workers=2, batch=4, rounds=20, epochs=epochs, barrier=True), Updater())
        jobs.append(len(tracker.getJobIdsForGroup(f"epochs-{epochs}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] == 3


def test_empty_rounds_and_no_rows(spark, line):
    learner = Learner("linear", inputs=2, outputs=1)
    few = line.limit(3)
    plan = Averaging(workers=2, batch=2, rounds=9, epochs=1)
    one = training.train(few, ["id"], learner, plan, Updater())
    other = training.train(few, ["id"], learner, Averaging(workers=2, batch=2, rounds=9, epochs=1, barrier=True), Updater())
    assert np.allclose(one.state, other.state, rtol=0, atol=1e-12)
    with pytest.raises(ValueError, match="no rows"):
        training.train(line.where("false"), ["id"], learner, Averaging(barrier=True), Updater())


def test_plain_descent_is_the_average_of_workers(spark, line, monkeypatch):
    learner, updater = Learner("linear", inputs=2, outputs=1), Updater("sgd", rate=0.3, l2=0.01, clip=None)
    fast = training.train(line, ["id"], learner, Averaging(workers=3, batch=None, epochs=4), updater)
    monkeypatch.setattr(training, "_is_descent", lambda *_: False)
    dealt = training.train(line, ["id"], learner, Averaging(workers=3, batch=None, epochs=4), updater)
    assert np.allclose(fast.state[0], dealt.state[0], rtol=0, atol=1e-12) and len(fast.history) == 4


def test_each_worker_of_a_round_has_a_task_of_its_own(line, monkeypatch):
    def mark_task(mine, learner, updater, size, state, rng):
        rows = sum(part.num_rows for part in mine)
        return min(rows, 1), np.eye(state.size)[TaskContext.get().partitionId()].reshape(state.shape)

    monkeypatch.setattr(training, "_fit_worker", mark_task)
    model = training.train(line, ["id"], Learner("linear", inputs=2, outputs=1), Averaging(workers=4, batch=20, rounds=1))
    assert model.state.ravel()[:4] == pytest.approx([0.25] * 4)


@pytest.mark.parametrize("learner", SMALL, ids=lambda m: f"{m.kind}-{m.is_classifier}")
def test_kept_arrays_change_no_gradient(learner):
    rng, kept = np.random.default_rng(1), {}
    for n in (7, 3, 7, 7):
        x, y, w = rng.normal(size=(n, learner.inputs)), rng.normal(size=(n, learner.outputs)), rng.normal(size=learner.size)
        assert np.array_equal(learner.gradient(w, x, y, rng, kept), learner.gradient(w, x, y, rng))


def test_blocks_of_rows_are_scored_like_single_rows():
    learner, rng = SMALL[2], np.random.default_rng(1)
    x, w = rng.normal(size=(2 * PREDICT_ROWS + 5, learner.inputs)), learner.start(2) + 0.1
    assert np.allclose(learner.predict(w, x), np.vstack([learner.predict(w, row[None]) for row in x]), rtol=0, atol=1e-12)
    assert learner.predict(w, x[:0]).shape == (0, learner.outputs)


def test_recurrent_scores_are_those_of_the_cell_by_hand():
    learner, rng = SMALL[2], np.random.default_rng(3)
    x, w = rng.normal(size=(4, learner.inputs)), learner.start(2) + 0.1
    gates, head = w[: 6 * 12].reshape(6, 12), w[6 * 12 :].reshape(4, 2)
    h, c = np.zeros((2, 4, 3))
    for t in range(3):
        z = np.hstack([x[:, 2 * t : 2 * t + 2], h, np.ones((4, 1))]) @ gates
        i, f, o = (1 / (1 + np.exp(-z[:, k : k + 3])) for k in (0, 3, 6))
        c = f * c + i * np.tanh(z[:, 9:])
        h = o * np.tanh(c)
    assert np.allclose(learner.predict(w, x), h @ head[:-1] + head[-1], rtol=0, atol=1e-12)
    seen, h_after, c_after = learner.continue_series(w, x[0].reshape(3, 2), *np.zeros((2, 1, 3)))
    assert np.allclose(seen[-1], learner.predict(w, x[:1])[0], rtol=0, atol=1e-12)
    assert np.allclose(np.vstack([h_after, c_after]), np.vstack([h[:1], c[:1]]), rtol=0, atol=1e-12)


def test_scores_keep_columns_as_they_are(spark, line):
    rows = line.select("x", F.lit(None).cast("string").alias("nothing"), F.struct("id").alias("pair"), F.array(F.lit(1)).alias("list"), "id")
    learner = Learner("linear", inputs=2, outputs=2)
    model = training.Model(learner, np.zeros((4, learner.size)), [np.zeros(learner.size), np.ones(learner.size)])
    scored = training.score(rows, model, ["id", "nothing", "pair", "list"], all_epochs=True)
    found = scored.join(line.select("id", F.col("x").alias("from_x")), "id").collect()
    assert scored.columns == ["id", "nothing", "pair", "list", "epoch", "output"] and len(found) == 1200
    for r in found:
        assert r.nothing is None and r.pair.id == r.id and r.list == [1]
        assert r.output == pytest.approx([r.epoch * (sum(r.from_x) + 1)] * 2)


def test_scores_that_are_no_numbers_are_null(spark):
    x = F.when(F.col("id") == 1, F.array(F.lit(None).cast("double"), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0)))
    label = F.when(F.col("id") == 2, F.lit(float("nan"))).otherwise(1.0)
    learner = Learner("linear", inputs=2, outputs=1)
    scored = training.score(spark.range(3).select("id", x.alias("x"), label.alias("label")), training.Model(learner, np.ones((4, 3)), []), ["id", "label"])
    found = {r.id: (r.label, r.output) for r in scored.collect()}
    assert found == {0: (1.0, [3.0]), 1: (1.0, [None]), 2: (None, [3.0])}
