"""Near-duplicate vectors by a small-world graph per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.hnsw import BEAM, Graph
from tidemark.session import write_through

# Shards there are at least, and vectors that a shard's task holds at most (a few hundred megabytes with its graph).
SHARDS = 6
SHARD_VECTORS = 200_000
# Vectors with links that an audit takes of the shard and of other shards each, and vectors of each kind that it looks through for them.
AUDITED = 200
LOOKED_THROUGH = 4096
RECALL = 0.99
_FOUND = "rep bigint, weight bigint, a bigint, b bigint"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Each row divided by its length; first, exactly, by a power of two, so that no square over- or underflows."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class _Shard:
    """A shard's vectors, their graph, a beam that passes the audit, and components inside the shard."""

    def __init__(self, keys: np.ndarray, copies: np.ndarray, vectors: np.ndarray, least: float, asked_keys: np.ndarray, asked: np.ndarray):
        self.keys, self.copies, self.least = keys, copies, least
        self.unit = unit_rows(vectors)
        self.graph = Graph(self.unit, keys)
        self.beam = self._audited(BEAM, asked_keys, unit_rows(asked))
        self.label = np.arange(len(keys))
        for i, near in enumerate(self.links(self.unit)):
            for j in near.tolist():
                a, b = self._root(i), self._root(j)
                self.label[max(a, b)] = min(a, b)
        self.label = np.array([self._root(i) for i in range(len(keys))], np.int64)

    def _root(self, i: int) -> int:
        while self.label[i] != i:
            self.label[i] = i = self.label[self.label[i]]
        return i

    def _linked(self, keys: np.ndarray, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The first vectors that have links to others in the shard, with those, by brute force in blocks."""
        out = []
        for at in range(0, min(len(keys), LOOKED_THROUGH), 64):
            for key, q, row in zip(keys[at : at + 64], unit[at : at + 64], unit[at : at + 64] @ self.unit.T >= self.least - 1e-9):
                near = np.flatnonzero(row & (self.keys != key))
                near = near[self.unit[near] @ q >= self.least]
                if len(near):
                    out.append((q, near))
            if len(out) >= AUDITED:
                break
        return out[:AUDITED]

    def _audited(self, beam: int, asked_keys: np.ndarray, asked: np.ndarray) -> int:
        """Widen the beam until vectors of the shard and of others find their links, on the mean over vectors.

        Matches with itself don't count, and each vector counts the same, whatever the size of its group.
        """
        own = np.argsort(self.keys * 2654435761 % 4294967296, kind="stable")
        other = ~np.isin(asked_keys, self.keys)
        for links in (self._linked(self.keys[own], self.unit[own]), self._linked(asked_keys[other], asked[other])):
            if not links:
                continue
            unit = np.array([q for q, _ in links])
            while beam < len(self.keys):
                if np.mean([np.isin(near, found).mean() for (_, near), found in zip(links, self.links(unit, beam))]) >= RECALL:
                    break
                beam *= 2
        return beam

    def links(self, unit: np.ndarray, beam: int | None = None) -> list[np.ndarray]:
        """Per query, the nodes found whose cosine in double precision reaches the bound."""
        found = self.graph.within(unit, beam or self.beam, self.least)
        return [near[self.unit[near] @ q >= self.least] if len(near) else near for near, q in zip(found, unit)]


def _search(least: float):
    """Build the graph from a shard's own rows, which come first, then stream all queries through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, built, held, waiting = None, None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal built
            if held and waiting:
                built = _Shard(*(np.concatenate(x) for x in zip(*held)), least, *(np.concatenate(x) for x in zip(*waiting)))
                held.clear()
            for keys, vectors in waiting if built else ():
                yield from _answer(built, keys, vectors)
            waiting.clear()

        for batch in batches:
            name = batch.column("shard").to_numpy()
            query = batch.column("query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (query[1:] != query[:-1]), [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = batch.slice(a, b - a)
                keys = part.column("rep").to_numpy()
                vectors = part.column("vector").flatten().to_numpy().astype(np.float64).reshape(len(keys), -1)
                if name[a] != shard:
                    yield from answers()
                    shard, built = name[a], None
                    held.clear()
                if not query[a]:
                    held.append((keys, part.column("copies").to_numpy(), vectors))
                    continue
                waiting.append((keys, vectors))
                # The audit of a new shard takes its queries from the first ones, which come in random order.
                if built or sum(len(k) for k, _ in waiting) >= 2 * LOOKED_THROUGH:
                    yield from answers()
        yield from answers()

    return run


def _answer(shard: _Shard, keys: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    unit = unit_rows(vectors)
    for at in range(0, len(keys), 2048):
        rep, weight, a, b = [], [], [], []
        for key, near in zip(keys[at : at + 2048].tolist(), shard.links(unit[at : at + 2048])):
            near = near[shard.keys[near] != key]
            if len(near):
                rep.append(key)
                weight.append(int(shard.copies[near].sum()))
                # Inside the shard a component is connected already: one edge to each is enough.
                for root in np.unique(shard.label[near]).tolist():
                    a.append(key)
                    b.append(int(shard.keys[root]))
        empty = [None] * len(a)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep + empty, pa.int64()), pa.array(weight + empty, pa.int64()), pa.array([None] * len(rep) + a, pa.int64()), pa.array([None] * len(rep) + b, pa.int64())],
            names=["rep", "weight", "a", "b"],
        )


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, shards: int = SHARDS) -> DataFrame:
    """One row per vector: ``key, n_links, component_id, kept``.

    Vectors are dealt to shards by a hash of their key; each shard builds its
    graph, widens its beam until an audit against brute force passes, and is
    asked for every vector's links. A link is a cosine of at least ``least`` in
    double precision. Equal vectors are one node that counts as many times as it
    comes; a node's links in a shard are counted there, and only one edge per
    component of the shard leaves it. Vectors that are null, zero, or hold null or
    non-finite parts link with nothing; only vectors of one length are compared;
    rows that repeat a key are one node of the graph; a row with a null key links
    with nothing and has a null component.
    """
    rows = table.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col("key").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    usable = rows.where(good)
    nodes = write_through(usable.groupBy("vector").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "vectors")
    n_shards = max(shards, -(-nodes.count() // SHARD_VECTORS))
    # Vectors of another length never meet.
    base = F.size("vector").cast("bigint") * n_shards
    own = nodes.select((base + F.pmod(F.xxhash64("rep"), F.lit(n_shards))).alias("shard"), F.lit(False).alias("query"), "rep", "copies", "vector")
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda i: base + i))
    asked = nodes.select(every.alias("shard"), F.lit(True).alias("query"), "rep", "copies", "vector")
    dealt = own.unionByName(asked).repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "query", F.when(F.col("query"), F.xxhash64("rep")), "rep")
    found = write_through(dealt.mapInArrow(_search(least), _FOUND), "vector-links")
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("weight").alias("__n"))
    label = components(found.where("a is not null").select("a", "b"))
    named = nodes.join(counts, "rep", "left").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select(F.col("vector").alias("__v"), (F.coalesce("__n", F.lit(0)) + F.col("copies") - 1).alias("__links"), F.coalesce("component", "rep").alias("__c"))
    linked = usable.join(named, F.col("vector") == F.col("__v"), "left").select("key", "__links", "__c")
    alone = rows.where(~good).select("key", F.lit(0).cast("bigint").alias("__links"), F.col("key").alias("__c"))
    out = linked.unionByName(alone)
    return out.select(
        F.col("key").alias(key), F.col("__links").alias("n_links"), F.col("__c").alias("component_id"), F.coalesce(F.col("key") == F.col("__c"), F.lit(False)).alias("kept")
    )
