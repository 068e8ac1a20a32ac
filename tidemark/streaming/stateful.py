"""Stateful scoring on a stream: one small state per series.

The rows of a micro-batch are put in order; micro-batches must follow one
another in that order. What a series brings in one micro-batch is handled at
once, so bound it with the source's options (``maxFilesPerTrigger`` and alike).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.affine_scan import exponential, scan
from tidemark.operators.training import Model


def exponential_state_stream(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    alpha: float,
    restart: str | None = None,
) -> DataFrame:
    """Streaming twin of ``operators.stateful.exponential_state``.

    A true value in the ``restart`` column drops the state of the series before
    that row.
    """
    columns = [*keys, *order, value] + ([restart] if restart else [])
    rows = stream.select(*columns)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)

    rule = exponential(alpha)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(batches)).sort_values(list(order))
        x = batch[value].to_numpy(np.float64)
        starts = np.zeros(len(x), dtype=bool)
        if restart:
            starts |= batch[restart].fillna(False).to_numpy(bool)
        starts[0] = starts[0] or not state.exists
        states, _ = scan(rule, x, starts, np.array(state.get if state.exists else [0.0], np.float64), np.eye(1))
        states = states[:, 0]
        state.update((float(states[-1]),))
        yield batch[columns].assign(state=states)

    return rows.groupBy(*keys).applyInPandasWithState(
        update, f"{schema}, state double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def recurrent_state_stream(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], features: Sequence[str], model: Model
) -> DataFrame:
    """Outputs of a trained recurrent model, whose state goes on from row to row.

    A series starts from a zero state and keeps it across micro-batches, so
    rows of a test period continue from the train period before it.
    """
    columns = [*keys, *order, *features]
    rows = stream.select(*keys, *order, *[F.col(f).cast("double") for f in features])
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)
    shared, learner = stream.sparkSession.sparkContext.broadcast(model.weights), model.learner

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(batches)).sort_values(list(order))
        if state.exists:
            h, c = (np.array(part, dtype=np.float64)[None, :] for part in state.get)
        else:
            h, c = np.zeros((2, 1, learner.hidden))
        outputs, h, c = learner.continue_series(shared.value, batch[list(features)].to_numpy(np.float64), h, c)
        state.update((h[0].tolist(), c[0].tolist()))
        yield batch[columns].assign(output=list(outputs))

    return rows.groupBy(*keys).applyInPandasWithState(
        update,
        f"{schema}, output array<double>",
        "h array<double>, c array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
