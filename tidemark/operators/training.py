"""Data-parallel training with parameter averaging, scoring, and metric history.

Rows never reach the driver: it holds one parameter vector between rounds.
In a round, each worker fits its next few batches from the averaged vector, and
Spark averages the results, weighted by rows. Which rows a worker sees in which
round and order follows from a hash of their ids and the number of workers that
is asked for, not from cores, files or partitions.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evaluation
from tidemark.operators.learners import Learner, Updater
from tidemark.session import new_folder, write_through

ROUND_SCHEMA = "worker INT, key LONG, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>, round_id INT"

# Rows of the state matrix, as stored with a model.
STATE_PARTS = ["weights", "first_moment", "second_moment", "step_count"]


@dataclass(frozen=True)
class Averaging:
    """How rows are dealt out: ``workers`` local models, ``batch`` rows per step,
    about ``frequency`` steps between two averagings.

    ``rounds`` asks for that many averagings per epoch instead of a frequency.
    Without a ``batch``, each worker takes one step per round along the mean
    gradient of all its rows; with plain descent, averaging then gives the step
    of the whole round, whatever the number of workers, and in one round an
    epoch sums gradients where the rows lie.

    With ``barrier``, an epoch is one job, in which ``workers`` tasks that run
    at the same time average among themselves; the cluster must have as many
    free cores. Results are those of a job per round.
    """

    workers: int = 4
    batch: int | None = 16
    frequency: int = 5
    rounds: int | None = None
    epochs: int = 1
    seed: int = 12345
    barrier: bool = False


@dataclass
class Model:
    learner: Learner
    state: np.ndarray
    history: list[np.ndarray] = field(default_factory=list)

    @property
    def weights(self) -> np.ndarray:
        return self.state[0]


def count_rounds(examples: DataFrame, averaging: Averaging) -> int:
    """Averagings per epoch."""
    if averaging.rounds is not None:
        return averaging.rounds
    if averaging.batch is None:
        return 1
    return max(1, -(-examples.count() // (averaging.workers * averaging.batch * averaging.frequency)))


def dealt_rows(examples: DataFrame, ids: Sequence[str], averaging: Averaging, rounds: int) -> DataFrame:
    """Each row with the worker and the round that hashes of its id give it. Shares are about equal, whatever the ids."""
    key = F.xxhash64(F.lit(averaging.seed), *ids)
    return examples.select(
        F.pmod(F.xxhash64(F.lit(1), key), F.lit(averaging.workers)).cast("int").alias("worker"), key.alias("key"), "x", "y",
        F.pmod(F.xxhash64(F.lit(2), key), F.lit(rounds)).cast("int").alias("round_id"),
    )


def deal_rounds(examples: DataFrame, ids: Sequence[str], averaging: Averaging) -> DataFrame:
    """The dealt rows as a table in the shared folder, partitioned by round.

    A round reads only its own rows, and a lost executor loses nothing.
    """
    spark = examples.sparkSession
    path = new_folder(spark, "rounds")
    dealt = dealt_rows(examples, ids, averaging, count_rounds(examples, averaging))
    dealt.repartition("round_id", "worker").write.partitionBy("round_id").parquet(path)
    return spark.read.schema(ROUND_SCHEMA).parquet(path)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _nan_as_null(column: pa.Array) -> pa.Array:
    """Metrics leave out what is null; a number that is none is left out too."""
    if not pa.types.is_floating(column.type):
        return column
    return pa.array(column.to_numpy(zero_copy_only=False), column.type, from_pandas=True)


def _runs(parts: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with one number in a column; batches arrive sorted by it."""
    for part in parts:
        number = part.column(column).to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True]))) if len(number) else []
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(number[a]), part.slice(int(a), int(b - a))


def _examples(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in parts:
        yield tuple(_matrix(part.column(c), part.num_rows) for c in ("x", "y"))


def _steps(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A worker's rows, ``size`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in _examples(parts):
        held.append(part)
        if sum(len(x) for x, _ in held) >= size:
            x, y = (np.concatenate(c) for c in zip(*held))
            whole = len(x) // size * size
            yield from ((x[at : at + size], y[at : at + size]) for at in range(0, whole, size))
            held = [(x[whole:], y[whole:])] if whole < len(x) else []
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _fit_worker(mine: Iterator[pa.RecordBatch], learner: Learner, updater: Updater, size: int | None, state: np.ndarray, rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """Rows, and what a worker makes of the state from its rows of one round."""
    local, n, whole, kept = state.copy(), 0, 0.0, {}
    for x, y in _examples(mine) if size is None else _steps(mine, size):
        gradient = learner.gradient(local[0], x, y, rng, None if size is None else kept)
        if size is None:
            whole = whole + gradient * len(x)
        else:
            updater.step(local, gradient)
        n += len(x)
    if size is None and n:
        updater.step(local, whole / n)
    return n, local


def _average_epoch(sorted_rows: DataFrame, learner: Learner, updater: Updater, averaging: Averaging, state: np.ndarray, seed: int, rounds: int) -> np.ndarray:
    """All rounds of an epoch in one job: each worker is a task, and they tell one another their states."""
    shared, size = sorted_rows.sparkSession.sparkContext.broadcast(state), averaging.batch

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, current = BarrierTaskContext.get(), shared.value
        runs = groupby(_runs(parts, "round_id"), key=lambda run: run[0])
        number, mine = next(runs, (rounds, iter(())))
        for k in range(rounds):
            rng = np.random.default_rng([seed + k, context.partitionId()])
            n, local = _fit_worker((run for _, run in mine) if number == k else iter(()), learner, updater, size, current, rng)
            if number == k:
                number, mine = next(runs, (rounds, iter(())))
            said = context.allGather(f"{n} {base64.b64encode(local.tobytes()).decode()}")
            total, summed = 0, np.zeros_like(current)
            for told in said:
                count, other = told.split(" ")
                total += int(count)
                summed += int(count) * np.frombuffer(base64.b64decode(other)).reshape(current.shape)
            current = summed / total if total else current
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"state": [current.ravel()]})

    found = sorted_rows.select("round_id", "x", "y").mapInArrow(fit, "state array<double>", barrier=True).collect()
    shared.destroy()
    return np.array(found[0].state).reshape(state.shape)


def _average_round(rows: DataFrame, learner: Learner, updater: Updater, averaging: Averaging, state: np.ndarray, seed: int) -> np.ndarray:
    shared, size = rows.sparkSession.sparkContext.broadcast(state), averaging.batch

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for worker, mine in groupby(_runs(parts, "worker"), key=lambda run: run[0]):
            rng = np.random.default_rng([seed, worker])
            n, local = _fit_worker((run for _, run in mine), learner, updater, size, shared.value, rng)
            yield pa.RecordBatch.from_pydict({"n": [n], "state": [local.ravel()]})

    # One small shuffle per round brings a worker's rows together in order, each worker's to a task of its own.
    dealt = rows.repartitionById(averaging.workers, F.col("worker")).sortWithinPartitions("worker", "key", "x", "y")
    fitted = dealt.select("worker", "x", "y").mapInArrow(fit, "n long, state array<double>")
    mean = (
        fitted.select("n", F.posexplode("state").alias("pos", "value"))
        .groupBy("pos")
        .agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
    )
    found = {row.pos: row.value for row in mean.collect()}  # one row per parameter
    shared.destroy()
    if not found:
        return state  # no row was dealt to this round
    if len(found) != state.size:
        raise ValueError(f"{len(found)} of {state.size} parameters came back")
    return np.array([found[i] for i in range(state.size)]).reshape(state.shape)


def _is_descent(learner: Learner, updater: Updater, averaging: Averaging) -> bool:
    """Whether averaged workers take just the step along the mean gradient of all rows."""
    alone = averaging.batch is None and averaging.rounds in (None, 1) and not averaging.barrier
    return alone and updater.kind == "sgd" and updater.clip is None and not learner.dropout


def _mean_gradient(rows: DataFrame, learner: Learner, weights: np.ndarray) -> np.ndarray:
    """One sum per task and parameter, of rows where they lie."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rng = np.zeros(learner.size + 1), np.random.default_rng(0)
        for part in parts:
            if part.num_rows:
                x, y = (_matrix(part.column(c), part.num_rows) for c in ("x", "y"))
                total += np.append(learner.gradient(shared.value, x, y, rng), 1.0) * part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["pos", "value"])

    summed = rows.mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
    found = {r.pos: r.value for r in summed.collect()}
    shared.destroy()
    if not found.get(learner.size):
        raise ValueError("no rows to train on")
    return np.array([found[i] for i in range(learner.size)]) / found[learner.size]


def _descend(examples: DataFrame, learner: Learner, averaging: Averaging, updater: Updater, state: np.ndarray, history: list[np.ndarray]) -> Model:
    """Full-batch descent: no row is dealt to a worker or shuffled."""
    rows = write_through(examples.select("x", "y"), "examples")
    for _ in range(averaging.epochs):
        updater.step(state, _mean_gradient(rows, learner, state[0]))
        history.append(state[0].copy())
    return Model(learner, state, history)


def train(
    examples: DataFrame,
    ids: Sequence[str],
    learner: Learner,
    averaging: Averaging = Averaging(),
    updater: Updater = Updater(),
    resume: Model | None = None,
) -> Model:
    """Fit ``x ARRAY<DOUBLE>`` to ``y ARRAY<DOUBLE>``; keeps the weights of each epoch."""
    if resume is not None:
        state, history = resume.state.copy(), list(resume.history)
    else:
        state, history = np.zeros((len(STATE_PARTS), learner.size)), []
        state[0] = learner.start(averaging.seed)
    if _is_descent(learner, updater, averaging):
        return _descend(examples, learner, averaging, updater, state, history)
    if averaging.barrier:
        return _train_with_barriers(examples, ids, learner, averaging, updater, state, history)
    dealt = deal_rounds(examples, ids, averaging)
    last = dealt.agg(F.max("round_id")).first()[0]
    if last is None:
        raise ValueError("no rows to train on")
    for epoch in range(averaging.epochs):
        for number in range(last + 1):
            rows = dealt.where(F.col("round_id") == number)
            state = _average_round(rows, learner, updater, averaging, state, averaging.seed + epoch * (last + 1) + number)
        history.append(state[0].copy())
    return Model(learner, state, history)


def _train_with_barriers(
    examples: DataFrame, ids: Sequence[str], learner: Learner, averaging: Averaging, updater: Updater, state: np.ndarray, history: list[np.ndarray]
) -> Model:
    """One shuffle in all: a worker's rows lie in one partition, sorted by round, and stay on the executors' disks."""
    rounds = count_rounds(examples, averaging)
    dealt = dealt_rows(examples, ids, averaging, rounds).repartitionById(averaging.workers, F.col("worker"))
    kept = dealt.sortWithinPartitions("round_id", "key", "x", "y").persist(StorageLevel.DISK_ONLY)
    try:
        if kept.isEmpty():
            raise ValueError("no rows to train on")
        for epoch in range(averaging.epochs):
            state = _average_epoch(kept, learner, updater, averaging, state, averaging.seed + epoch * rounds, rounds)
            history.append(state[0].copy())
    finally:
        kept.unpersist()
    return Model(learner, state, history)


def score(examples: DataFrame, model: Model, keep: Sequence[str], all_epochs: bool = False) -> DataFrame:
    """Outputs per row, for the final weights or for those of every epoch.

    Adds ``epoch`` and ``output ARRAY<DOUBLE>``, null where it is no number; all
    epochs share one scan.
    """
    if all_epochs:
        weights = list(enumerate(model.history))
    else:
        weights = [(len(model.history) - 1, model.weights)]
    shared, learner = examples.sparkSession.sparkContext.broadcast(weights), model.learner
    kept = examples.select(*keep, "x")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            if n:
                x, others = _matrix(part.column("x"), n), [_nan_as_null(part.column(c)) for c in keep]
                for epoch, w in shared.value:
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * learner.outputs)
                    output = pa.ListArray.from_arrays(ends, pa.array(learner.predict(w, x).ravel(), from_pandas=True))
                    columns = [*others, pa.array(np.full(n, epoch, dtype=np.int32)), output]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "epoch", "output"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "x")
    return kept.mapInArrow(run, f"{schema}, epoch int, output array<double>")


def history(
    examples: DataFrame, model: Model, run_id: str, split: str = "split", label: str = "label"
) -> DataFrame:
    """(run_id, epoch, split, metric, value) for all epochs and splits in one pass.

    Classifiers report accuracy, macro F1 and, with two classes, AUC;
    regressors mse and mae, of several outputs as ``mse_0``, ``mse_1`` and so on,
    against the targets in ``y``.
    """
    keep = [split, label] if model.learner.is_classifier or model.learner.outputs == 1 else [split, "y"]
    scored = score(examples, model, keep, all_epochs=True)
    by = ["epoch", split]
    if model.learner.is_classifier:
        scored = write_through(scored, "scored").withColumn("pred", evaluation.argmax(F.col("output")))
        report = evaluation.metric_rows(
            evaluation.accuracy_f1(scored, by, label).drop("n"), by, ["accuracy", "f1_macro"]
        )
        if model.learner.outputs == 2:
            auc = evaluation.roc_auc(scored.withColumn("score", F.col("output")[1]), by, label)
            report = report.unionByName(evaluation.metric_rows(auc.select(*by, "auc"), by, ["auc"]))
    elif model.learner.outputs == 1:
        errors = evaluation.regression_report(scored.withColumn("predict", F.col("output")[0]), by, label)
        report = evaluation.metric_rows(errors.select(*by, "mse", "mae"), by, ["mse", "mae"])
    else:
        each = scored.select(*by, F.posexplode(F.arrays_zip("y", "output")).alias("at", "pair")).select(*by, "at", "pair.*")
        errors = evaluation.regression_report(each, [*by, "at"], "y", "output")
        report = evaluation.metric_rows(errors.select(*by, "at", "mse", "mae"), [*by, "at"], ["mse", "mae"])
        report = report.withColumn("metric", F.concat_ws("_", "metric", "at"))
    return report.select(F.lit(run_id).alias("run_id"), *by, "metric", "value")
