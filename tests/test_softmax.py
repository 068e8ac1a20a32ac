"""The Newton classifier against its conditions of optimality and Spark ML, and threshold counts of ROC curves."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import alignment, evaluation, softmax
from tidemark.operators.models import fit_classifier
from tidemark.operators.ordering import number_rows


def rows(n=400, width=3, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    score = x @ rng.normal(size=(width, classes)) + rng.gumbel(size=(n, classes))
    return x, score.argmax(1)


def frame(spark, x, label, partitions=5):
    return spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, label)], "x array<double>, label int").repartition(partitions)


@pytest.mark.parametrize("classes", [2, 4])
@pytest.mark.parametrize("partitions", [1, 9])
def test_converged_model_has_no_gradient(spark, monkeypatch, classes, partitions):
    monkeypatch.setattr(softmax, "LEVELS", (3, 1))
    monkeypatch.setattr(softmax, "BLOCK_ROWS", 37)
    x, label = rows(classes=classes)
    model = softmax.fit_softmax(frame(spark, x, label, partitions), classes, l2=0.01)
    assert model.converged and len(model.history) < 15
    with_one = np.column_stack((x, np.ones(len(x))))
    p = softmax.probabilities(model.weights, with_one)
    off = p - np.eye(classes)[label]
    gradient = (off.T @ with_one)[:-1] / len(x)
    gradient[:, :-1] += 0.01 * model.weights[:-1, :-1]
    assert np.abs(gradient).max() < 1e-8
    assert np.allclose(p.sum(0), np.bincount(label, minlength=classes))


def test_hessian_is_the_gradient_s_slope():
    x, label = rows(50)
    x = np.column_stack((x, np.ones(50)))
    rng = np.random.default_rng(1)
    w = np.vstack((rng.normal(size=(2, 4)), np.zeros(4)))
    sums = softmax.partial_sums(w, x, label)
    size, step = 8, 1e-6
    for i in range(size):
        moved = w.copy()
        moved[i // 4, i % 4] += step
        other = softmax.partial_sums(moved, x, label)
        assert (other[1] - sums[1]) / step == pytest.approx(sums[2 + i], abs=1e-3)
        assert np.allclose((other[2 : 2 + size] - sums[2 : 2 + size]) / step, sums[2 + size :].reshape(size, size)[i], atol=1e-3)


def test_same_classes_as_spark_ml(spark):
    x, label = rows(300, classes=3)
    df = frame(spark, x, label)
    ours = softmax.classify(df, softmax.fit_softmax(df, 3, l2=0.001), ["x", "label"]).select("x", evaluation.argmax(F.col("output")).alias("ours"))
    model = fit_classifier(df, l2=0.0)
    from tidemark.operators.models import apply_model

    theirs = apply_model(model, df).select("x", F.col("predict").cast("int").alias("theirs"))
    assert ours.join(theirs, "x").where("ours = theirs").count() >= 285


def test_separable_rows_missing_classes_and_no_rows(spark):
    x = np.array([[-2.0], [-1.0], [1.0], [2.0]])
    model = softmax.fit_softmax(frame(spark, x, [0, 0, 1, 1]), 3, l2=0.01, most_steps=60)
    p = softmax.probabilities(model.weights, np.column_stack((x, np.ones(4))))
    assert (p.argmax(1) == [0, 0, 1, 1]).all() and p[:, 2].max() < 1e-3
    none = frame(spark, x, [0, 0, 1, 1]).where("false")
    empty = softmax.fit_softmax(none, 3)
    assert empty.converged and not empty.weights.any()
    assert softmax.classify(none, model, ["label"]).count() == 0
    assert [r.output for r in softmax.classify(frame(spark, x, [0, 0, 1, 1]), empty, ["label"]).collect()] == [pytest.approx([1 / 3] * 3)] * 4
    with pytest.raises(PySparkException, match="labels must be"):
        softmax.fit_softmax(frame(spark, x, [0, 0, 1, 7]), 3)


def test_all_steps_share_one_scan(spark):
    x, label = rows(60)
    df = frame(spark, x, label)
    model = softmax.fit_softmax(df, 3, l2=0.1)
    scored = softmax.classify(df, model, ["label"], all_steps=True)
    assert scored.groupBy("step").count().count() == len(model.history)
    first = scored.where("step = 0").first().output
    assert first == pytest.approx([1 / 3] * 3)


def test_last_steps_are_aligned_at_the_end(spark):
    made = [(k, t, float(10 * k + t)) for k, n in ((1, 5), (2, 2), (3, 1)) for t in range(n)]
    ordered = number_rows(spark.createDataFrame(made, "k int, t int, a double"), ["k"], ["t"])
    got = {r.k: r.x for r in alignment.last_steps_vector(ordered, 3, ["a"], scale=0.5).collect()}
    assert got == {1: [6.0, 1.0, 6.5, 1.0, 7.0, 1.0], 2: [0.0, 0.0, 10.0, 1.0, 10.5, 1.0], 3: [0.0, 0.0, 0.0, 0.0, 15.0, 1.0]}


@pytest.mark.parametrize("bins", [1, 7, 500])
def test_threshold_counts_are_near_the_exact_area_and_add_up(spark, bins):
    rng = np.random.default_rng(bins)
    made = [(f"g{i % 3}", int(i % 5 == 0 or rng.random() < 0.3), float(np.clip(rng.normal(0.5 + 0.1 * (i % 5 == 0), 0.3), -0.2, 1.3))) for i in range(900)]
    made += [("g0", None, 0.5), ("g1", 1, None), ("one", 1, 0.4)]
    df = spark.createDataFrame(made, "g string, label int, score double")
    counts = evaluation.roc_counts(df, ["g"], bins=bins)
    halves = [evaluation.roc_counts(part, ["g"], bins=bins) for part in df.randomSplit([0.5, 0.5], 3)]
    merged = evaluation.merge_roc_counts(halves[0].unionByName(halves[1]), ["g"])
    assert sorted(merged.collect()) == sorted(counts.collect())
    area = {r.g: r for r in evaluation.roc_area(counts, ["g"]).collect()}
    exact = {r.g: r.auc for r in evaluation.roc_auc(df.na.drop(), ["g"]).collect()}
    shared = {r.g: r.s for r in counts.groupBy("g").agg(F.sum(F.col("n_pos") * F.col("n_neg")).alias("s")).collect()}
    assert area["one"].auc is None
    for g in ("g0", "g1", "g2"):
        assert abs(area[g].auc - exact[g]) <= shared[g] / 2 / (area[g].n_pos * area[g].n_neg) + 1e-12
    for r in evaluation.roc_points(counts, ["g"], bins).where("g = 'g1'").collect():
        above = [m for m in made if m[0] == "g1" and m[1] is not None and m[2] is not None and min(max(m[2], 0), 1) >= r.threshold - (r.threshold == 1)]
        assert (r.tp, r.fp) == (sum(m[1] for m in above), sum(1 - m[1] for m in above))
