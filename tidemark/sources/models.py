"""Models as rows: parameters, updater state, and the weights of past epochs."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.learners import Learner
from tidemark.operators.training import STATE_PARTS, Model

SCHEMA = "model_id STRING, learner STRING, part STRING, epoch INT, pos INT, value DOUBLE"


def model_rows(spark: SparkSession, model: Model, model_id: str, with_updater: bool = True) -> DataFrame:
    """One row per parameter and state value."""
    learner = json.dumps(asdict(model.learner), sort_keys=True)
    parts = STATE_PARTS if with_updater else STATE_PARTS[:1]
    vectors = [(part, None, row) for part, row in zip(parts, model.state)]
    vectors += [("epoch_weights", epoch, row) for epoch, row in enumerate(model.history)]
    rows = [
        (model_id, learner, part, epoch, pos, float(value))
        for part, epoch, row in vectors
        for pos, value in enumerate(row)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def save_model(spark: SparkSession, model: Model, path: str, model_id: str, with_updater: bool = True) -> None:
    """Add to a model table; each model is its own partition. An id that is there is refused."""
    try:
        held = not spark.read.schema(SCHEMA).parquet(path).where(F.col("model_id") == model_id).isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        held = False
    if held:
        raise ValueError(f"model {model_id!r} is in {path} already")
    rows = model_rows(spark, model, model_id, with_updater)
    rows.coalesce(1).write.mode("append").partitionBy("model_id").parquet(path)


def load_model(spark: SparkSession, path: str, model_id: str) -> Model:
    rows = spark.read.schema(SCHEMA).parquet(path).where(F.col("model_id") == model_id).collect()
    if not rows:
        raise ValueError(f"no model {model_id!r} in {path}")
    learner = Learner(**json.loads(rows[0].learner))
    state = np.zeros((len(STATE_PARTS), learner.size))
    epochs: dict[int, np.ndarray] = {}
    for row in rows:
        if row.part == "epoch_weights":
            epochs.setdefault(row.epoch, np.zeros(learner.size))[row.pos] = row.value
        else:
            state[STATE_PARTS.index(row.part), row.pos] = row.value
    return Model(learner, state, [epochs[e] for e in sorted(epochs)])
