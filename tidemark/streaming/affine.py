"""Affine states on streams, with typed state that a batch-scored past can begin.

The state of a series is its values and the place of its last row. Rows are
scanned as they come, one Arrow batch after the other, so a series' rows of a
micro-batch are never held together. Input must be in order within a series; a
row at or before the last one raises instead of giving a wrong state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.affine_scan import Affine, scan

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which typed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class AffineProcessor(StatefulProcessor):
    def __init__(self, rule: Affine, columns: list[str], order: list[str], value: str, restart: str | None, state: T.StructType):
        self.rule, self.columns, self.order, self.value, self.restart, self.schema = rule, columns, order, value, restart, state

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The last scored row of a series: its state, and where it stood."""
        row = initialState.iloc[0]
        self.state.update(tuple(float(row[n]) for n in self.rule.names) + tuple(row[c] for c in self.order))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = len(self.rule.names)
        known = self.state.get() if self.state.exists() else None
        before = np.array(known[:d], np.float64) if known else np.zeros(d)
        last = tuple(known[d:]) if known else None
        for batch in rows:
            if not len(batch):
                continue
            batch = batch.sort_values(self.order)
            first = tuple(batch[c].iloc[0] for c in self.order)
            if last is not None and first <= tuple(type(a)(b) if isinstance(a, pd.Timestamp) else b for a, b in zip(first, last)):
                raise ValueError(f"series {key}: a row at {first} after one at {last}")
            if batch[self.value].isna().any():
                raise ValueError(f"a state needs a value in every row; {self.value} is null")
            again = batch[self.restart].eq(True).to_numpy(bool) if self.restart else np.zeros(len(batch), bool)
            again[0] |= last is None
            states, _ = scan(self.rule, batch[self.value].to_numpy(np.float64), again, before, np.eye(d))
            before, last = states[-1], tuple(batch[c].iloc[-1] for c in self.order)
            yield batch[self.columns].assign(**{n: states[:, i] for i, n in enumerate(self.rule.names)})
        if last is not None:
            self.state.update(tuple(before.tolist()) + tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if isinstance(v, np.generic) else v for v in last))

    def close(self) -> None:
        pass


def affine_states_stream(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rule: Affine,
    initial: DataFrame | None = None, restart: str | None = None,
) -> DataFrame:
    """Streaming twin of ``affine_scan.affine_states``; start the stream inside ``typed_state``.

    ``initial`` has one row per series that was scored before: keys, order
    columns and the rule's names. The stream goes on from there, and so does a
    series that only the stream has, from nothing.
    """
    columns = [*keys, *order, value] + ([restart] if restart else [])
    rows = stream.select(*columns)
    doubles = [T.StructField(n, T.DoubleType()) for n in rule.names]
    state = T.StructType([*doubles, *[T.StructField(c, rows.schema[c].dataType) for c in order]])
    given = initial.select(*keys, *order, *rule.names).groupBy(*keys) if initial is not None else None
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=AffineProcessor(rule, columns, list(order), value, restart, state),
        outputStructType=T.StructType([*rows.schema.fields, *doubles]), outputMode="append", timeMode="None", initialState=given,
    )


def last_states(scored: DataFrame, keys: Sequence[str], order: Sequence[str], rule: Affine) -> DataFrame:
    """The last scored row of each series, as ``affine_states_stream`` takes it."""
    last = F.max_by(F.struct(*order, *rule.names), F.struct(*order)).alias("last")
    return scored.groupBy(*keys).agg(last).select(*keys, "last.*")
