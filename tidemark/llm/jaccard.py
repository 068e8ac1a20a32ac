"""Jaccard join of documents over word shingles: all links at 0.8 or more, exactly.

Jaccard distance is a metric, so pivots and the triangle inequality say which
documents can be near each other. Two kinds of pivots are used.

First, single shingles. Take any part p of a document x with more than a fifth
of its shingles: d(x, p) < 0.8, so any y within 0.2 of x has d(y, p) < 1, that
is, shares a shingle with p. So x belongs to the region of its rarest shingle
and is replicated to the regions of its floor(n / 5) + 1 rarest ones, the window
that the inequality asks for. Rarity is counted over all documents. Shingles
that no other document has make no region. Regions that share a document are
one region from then on.

Then, documents. Inside a region, pivots take the documents within 0.2 of them
as cells (these are linked); a document within 0.4 of a pivot but outside its
cell may be linked to some document of the cell, and is a guest there; none
beyond 0.4 can be. What no pivot covers is joined again, recursively. Regions
that are small enough are joined so inside one task; larger ones are first
split by the same step across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.words import shingle_sets, slices
from tidemark.session import write_through

WIDTH = 5
# Characters of text for each bucket of shingles; a bucket is counted in one task.
BUCKET_CHARS = 6 << 20
# Shingles of the documents of a region that one task joins.
REGION_SHINGLES = 4 << 20
# Pivots of one round in a region that is split across tasks.
PIVOTS = 64
# Rows of a table of ids that is sent to every executor; a longer one is joined by key.
BROADCAST_ROWS = 400_000
# A shingle of so many documents of a slice is sent with its count, not with each document.
FREQUENT = 8

_LONG = pa.int64()


def _linked(shared: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    return 100 * shared >= 80 * (n + m - shared)


def _near(shared: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    return 100 * shared >= 60 * (n + m - shared)


class SetIndex:
    """Sets of sorted 64-bit values; how many values each shares with a given one."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]

    def shared(self, one: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.values, one, "left"), np.searchsorted(self.values, one, "right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def local_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all sets which links connect, exactly."""
    index, forest, links = SetIndex(sets), _Forest(len(sets)), []
    home, guests = np.full(len(sets), -1), []
    for p in range(len(sets)):
        if home[p] >= 0:
            continue
        shared = index.shared(sets[p])
        cell = _linked(shared, len(sets[p]), index.sizes) & (shared > 0)
        home[cell & (home < 0)] = p
        links += [(p, int(x)) for x in np.flatnonzero(cell) if forest.join(p, int(x))]
        # A document within the window may be linked to one of the cell, if that isn't the pivot alone.
        guests.append((p, np.flatnonzero(_near(shared, len(sets[p]), index.sizes) & ~cell)))
    asked = set()
    for p, near in guests:
        for g in near.tolist():
            if g not in asked and forest.root(g) != forest.root(p):
                asked.add(g)
                shared = index.shared(sets[g])
                links += [(g, int(x)) for x in np.flatnonzero(_linked(shared, len(sets[g]), index.sizes) & (shared > 0)) if forest.join(g, int(x))]
    return links


def _unpack(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) for v in column.to_pylist()]


# --- regions of single shingles ---------------------------------------------------------------------------------------

_PACKED = "batch bigint, bucket int, tok binary, ref binary, htok binary, hcount binary, keys array<bigint>, prints binary, sizes binary, hot binary"
_PREFIX = "key bigint, print binary, n bigint, tok bigint"


def _pack(buckets: int):
    """Per slice of documents: its shingles by bucket, and one row that describes its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for seq, batch in enumerate(slices(batches)):
            sets = shingle_sets(batch.column("text"), WIDTH)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            bucket, tok = (values & np.uint64(0xFFFFFFFF)) % np.uint64(buckets), values >> np.uint64(32)
            place = bucket << np.uint64(32) | tok
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
            count = np.diff(np.append(start, len(place)))
            often = np.repeat(count > FREQUENT, count)
            cold, cold_owner = place[~often], owner[~often].astype(np.uint16)
            hot, hot_count = place[start][count > FREQUENT], count[count > FREQUENT].astype(np.uint32)
            edges = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)
            a, h = np.searchsorted(cold, edges).tolist(), np.searchsorted(hot, edges).tolist()
            rows = [
                (task | seq, b, cold[a[b] : a[b + 1]].astype(np.uint32).tobytes(), cold_owner[a[b] : a[b + 1]].tobytes(),
                 hot[h[b] : h[b + 1]].astype(np.uint32).tobytes(), hot_count[h[b] : h[b + 1]].tobytes(), None, None, None, None)
                for b in range(buckets) if a[b + 1] > a[b] or h[b + 1] > h[b]
            ]
            postings = np.concatenate([place[often], owner[often].astype(np.uint64)]).tobytes()
            prints = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            rows.append((task | seq, (task >> 32 ^ seq * 7919) % buckets, None, None, None, None, batch.column("key").to_pylist(), prints, sizes.tobytes(), postings))
            columns = list(zip(*rows))
            kinds = [_LONG, pa.int32(), *[pa.binary()] * 4, pa.list_(_LONG), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _PACKED.split(", ")])

    return run


def _count(table: pa.Table) -> pa.Table:
    """In a bucket: keep each slice's shingles that are in two documents or more, with the number of documents."""
    described = table.filter(pc.is_valid(table["keys"]))
    table = table.filter(pc.is_valid(table["tok"]))
    tok = [np.frombuffer(v, np.uint32) for v in table["tok"].to_pylist()]
    hot = [np.frombuffer(v, np.uint32) for v in table["htok"].to_pylist()]
    weight = [np.frombuffer(v, np.uint32) for v in table["hcount"].to_pylist()]
    values = np.concatenate(tok + hot) if tok else np.empty(0, np.uint32)
    n = sum(map(len, tok))
    distinct, code = np.unique(values, return_inverse=True)
    total = np.bincount(code, weights=np.concatenate([np.ones(n), *weight]), minlength=len(distinct)).astype(np.uint32)[code] if n + len(values) else np.empty(0, np.uint32)
    out = {"tok": [], "ref": [], "htok": [], "hcount": [], "hot": []}
    at, hat = 0, n
    for i, ref in enumerate(table["ref"].to_pylist()):
        many = total[at : at + len(tok[i])]
        keep = many > 1
        out["tok"].append(tok[i][keep].tobytes())
        out["ref"].append(np.frombuffer(ref, np.uint16)[keep].tobytes())
        out["hot"].append(many[keep].tobytes())
        out["htok"].append(hot[i].tobytes())
        out["hcount"].append(total[hat : hat + len(hot[i])].tobytes())
        at, hat = at + len(tok[i]), hat + len(hot[i])
    counted = table
    for name, column in out.items():
        counted = counted.set_column(counted.schema.get_field_index(name), name, pa.array(column, pa.binary()))
    return pa.concat_tables([described, counted])


def _prefix(table: pa.Table) -> pa.Table:
    """In a slice: each document, and those of its rarest shingles that other documents have too."""
    rows = table.to_pylist()
    about = next(r for r in rows if r["keys"] is not None)
    parts, hot_places, hot_counts = [], [], []
    for r in rows:
        if r["tok"] is not None:
            high = np.uint64(r["bucket"]) << np.uint64(32)
            parts.append((np.frombuffer(r["tok"], np.uint32) | high, np.frombuffer(r["ref"], np.uint16).astype(np.int64), np.frombuffer(r["hot"], np.uint32)))
            hot_places.append(np.frombuffer(r["htok"], np.uint32) | high)
            hot_counts.append(np.frombuffer(r["hcount"], np.uint32))
    postings = np.frombuffer(about["hot"], np.uint64)
    if len(postings):
        place, owner = np.split(postings, 2)
        known, counts = np.concatenate(hot_places), np.concatenate(hot_counts)
        order = np.argsort(known)
        parts.append((place, owner.astype(np.int64), counts[order][np.searchsorted(known[order], place)]))
    keys, sizes = about["keys"], np.frombuffer(about["sizes"], np.int64)
    prints = [about["prints"][16 * i : 16 * i + 16] for i in range(len(keys))]
    place, owner, count = (np.concatenate(p) for p in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint32))
    order = np.lexsort((place, count, owner))
    place, owner = place[order], owner[order]
    shared = np.bincount(owner, minlength=len(keys))
    rank = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
    # Shingles that the document has alone come first in its window.
    window = sizes - -(-4 * sizes // 5) + 1 - (sizes - shared)
    place, owner = place[rank < window[owner]], owner[rank < window[owner]]
    return pa.table({
        "key": pa.array(keys + [keys[d] for d in owner], _LONG),
        "print": pa.array(prints + [prints[d] for d in owner], pa.binary()),
        "n": pa.array(np.concatenate((sizes, sizes[owner]))),
        "tok": pa.concat_arrays([pa.nulls(len(keys), _LONG), pa.array(place.astype(np.int64))]),
    })


def shingle_regions(docs: DataFrame) -> DataFrame:
    """``key, print, n, tok`` of ``key, text``: a row per document (null tok) and one per region that it is in."""
    chars = docs.select(F.sum(F.length("text")).alias("n")).first().n or 0
    buckets = max(16, -(-chars // BUCKET_CHARS))
    packed = docs.mapInArrow(_pack(buckets), _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(_count, _PACKED)
    return write_through(counted.groupBy("batch").applyInArrow(_prefix, _PREFIX), "regions")


# --- cells of documents -----------------------------------------------------------------------------------------------

_EDGES = "a bigint, b bigint"


def _solve(table: pa.Table) -> pa.Table:
    reps = table["rep"].to_pylist()
    links = local_links(_unpack(table["shingles"]))
    return pa.table({"a": pa.array([reps[i] for i, _ in links], _LONG), "b": pa.array([reps[j] for _, j in links], _LONG)})


def _to_pivots(members: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each member of a block with the nearest pivot that covers it, if any, and the pivots that it may visit."""
    sets, reps = _unpack(members["shingles"]), members["rep"].to_pylist()
    index = SetIndex(sets)
    home, best, visits = [None] * len(sets), np.full(len(sets), -1.0), [[] for _ in sets]
    for one, p in zip(_unpack(pivots["other_shingles"]), pivots["other_rep"].to_pylist()):
        shared = index.shared(one)
        likeness = shared / (len(one) + index.sizes - shared)
        cell = _linked(shared, len(one), index.sizes)
        for i in np.flatnonzero(cell & (likeness > best)):
            home[i], best[i] = p, likeness[i]
        for i in np.flatnonzero(_near(shared, len(one), index.sizes)):
            visits[i].append(p)
    n = len(sets)
    region = members["region"].to_pylist()[0] if n else None
    return pa.table({
        "region": pa.array([region] * n, _LONG), "rep": pa.array(reps, _LONG), "home": pa.array(home, _LONG), "visits": pa.array(visits, pa.list_(_LONG)),
    })


def _across(guests: pa.Table, cell: pa.Table) -> pa.Table:
    """Links between guests and the documents of a cell."""
    index, inside = SetIndex(_unpack(cell["other_shingles"])), cell["other_rep"].to_pylist()
    a, b = [], []
    for one, g in zip(_unpack(guests["shingles"]), guests["rep"].to_pylist()):
        shared = index.shared(one)
        # One link is enough: the documents of a cell are linked to each other by its pivot.
        hit = np.flatnonzero(_linked(shared, len(one), index.sizes) & (shared > 0))[:1]
        a += [g] * len(hit)
        b += [inside[i] for i in hit]
    return pa.table({"a": pa.array(a, _LONG), "b": pa.array(b, _LONG)})


def _pairs_of_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
    """All links between two blocks of documents that no pivot tells apart."""
    index, other = SetIndex(_unpack(right["other_shingles"])), right["other_rep"].to_pylist()
    a, b = [], []
    for one, g in zip(_unpack(left["shingles"]), left["rep"].to_pylist()):
        shared = index.shared(one)
        hit = np.flatnonzero(_linked(shared, len(one), index.sizes) & (shared > 0))
        a += [g] * len(hit)
        b += [other[i] for i in hit]
    return pa.table({"a": pa.array(a, _LONG), "b": pa.array(b, _LONG)})


def _blocks(shingles, limit: int):
    return F.greatest(F.lit(1), F.ceil(shingles / limit)).cast("int")


def _other(df: DataFrame) -> DataFrame:
    """Columns renamed, to stand beside a table of the same origin."""
    return df.toDF(*[f"other_{c}" for c in df.columns])


def _split_regions(members: DataFrame, limit: int) -> list[DataFrame]:
    """Links inside regions that are too large for one task, round by round."""
    links, homes = [], []
    rest = members
    while True:
        sizes = rest.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.min(F.xxhash64("rep")).alias("first"))
        sizes = write_through(sizes, "region-sizes")
        fits = F.col("shingles") <= limit
        small = rest.join(sizes.where(fits).select("region"), "region").withColumnRenamed("set", "shingles")
        links.append(write_through(small.groupBy("region").applyInArrow(_solve, _EDGES), "links"))
        large = sizes.where(~fits)
        if large.isEmpty():
            break
        held = rest.join(large, "region").withColumns({"blocks": _blocks(F.col("shingles"), limit), "hash": F.xxhash64("rep")})
        each = F.greatest(F.lit(1), F.floor(F.col("docs") / PIVOTS))
        pivots = held.where((F.pmod("hash", each) == 0) | (F.col("hash") == F.col("first")))
        spread = pivots.select("region", "rep", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        cut = held.select("region", "rep", "set", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int").alias("block"))
        cut, spread = cut.withColumnRenamed("set", "shingles"), _other(spread.withColumnRenamed("set", "shingles"))
        seen = cut.groupBy("region", "block").cogroup(spread.groupBy("other_region", "other_block"))
        seen = write_through(seen.applyInArrow(_to_pivots, "region bigint, rep bigint, home bigint, visits array<bigint>"), "homes")
        links.append(seen.where("home is not null and home <> rep").select(F.col("rep").alias("a"), F.col("home").alias("b")))
        homes.append(seen)
        left = rest.join(seen.where("home is null").select("rep"), "rep")
        left = write_through(left.select(*rest.columns), "uncovered")
        if 2 * left.count() > rest.join(large.select("region"), "region").count():
            # Pivots don't tell these apart: join them block by block, still exactly.
            links.append(_block_by_block(left, limit))
            break
        rest = left
    return links + _visits(members, homes, links, limit)


def _block_by_block(rest: DataFrame, limit: int) -> DataFrame:
    sizes = rest.groupBy("region").agg(F.sum("n").alias("shingles"))
    held = rest.join(sizes, "region").withColumn("blocks", _blocks(F.col("shingles"), limit))
    held = held.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int")).withColumnRenamed("set", "shingles_")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = held.select("region", "rep", F.col("shingles_").alias("shingles"), F.col("block").alias("i"), every.alias("j")).where("i <= j")
    right = held.select("region", "rep", F.col("shingles_").alias("shingles"), F.col("block").alias("j"), every.alias("i")).where("i <= j")
    found = left.groupBy("region", "i", "j").cogroup(_other(right).groupBy("other_region", "other_i", "other_j")).applyInArrow(_pairs_of_blocks, _EDGES)
    return write_through(found, "links")


def _visits(members: DataFrame, homes: list[DataFrame], links: list[DataFrame], limit: int) -> list[DataFrame]:
    """Links of guests: only of those that aren't connected with the cell that they may visit already."""
    if not homes:
        return []
    known = links[0]
    for more in links[1:]:
        known = known.unionByName(more)
    label = components(known)
    seen = homes[0]
    for more in homes[1:]:
        seen = seen.unionByName(more)
    named = seen.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    cell_label = label.select(F.col("node").alias("cell"), F.col("component").alias("cell_component"))
    guests = named.select("rep", "component", F.explode("visits").alias("cell")).join(cell_label, "cell", "left")
    guests = write_through(guests.where(F.coalesce("cell_component", "cell") != F.col("component")).select("rep", "cell"), "guests")
    cells = guests.select("cell").distinct()
    sets = members.select("rep", "n", F.col("set").alias("shingles"))
    inside = seen.where("home is not null").select("rep", F.col("home").alias("cell")).join(cells, "cell").join(sets, "rep")
    sizes = inside.groupBy("cell").agg(_blocks(F.sum("n"), limit).alias("blocks"))
    visiting = guests.join(sets, "rep").join(sizes, "cell")
    guest_blocks = visiting.groupBy("cell").agg(_blocks(F.sum("n"), limit).alias("guest_blocks"))
    inside = inside.join(sizes, "cell").join(guest_blocks, "cell")
    inside = inside.withColumns({"i": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("guest_blocks") - 1))})
    visiting = visiting.join(guest_blocks, "cell")
    visiting = visiting.withColumns({"j": F.pmod(F.xxhash64("rep"), F.col("guest_blocks")).cast("int"), "i": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    by = ["cell", "i", "j"]
    columns = [*by, "rep", "shingles"]
    inside = _other(inside.select(*columns))
    return [visiting.select(*columns).groupBy(*by).cogroup(inside.groupBy(*[f"other_{c}" for c in by])).applyInArrow(_across, _EDGES)]


def _region_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``region, rep, n, set`` of the documents that stand for their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), WIDTH)
            # Of several texts under one id, the one that was meant.
            same = [xxhash.xxh3_128_digest(s.tobytes()) == p for s, p in zip(sets, batch.column("print").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("region").filter(pa.array(same)), batch.column("key").filter(pa.array(same)),
                 batch.column("print").filter(pa.array(same)),
                 pa.array([len(s) for s, k in zip(sets, same) if k], _LONG), pa.array([s.tobytes() for s, k in zip(sets, same) if k], pa.binary())],
                names=["region", "rep", "print", "n", "set"],
            )

    ids = members.select("region", F.col("rep").alias("__rep"), "print")
    if members.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    joined = docs.join(ids, docs["key"] == F.col("__rep")).select("region", "key", "print", "text")
    return joined.mapInArrow(run, "region bigint, rep bigint, print binary, n bigint, set binary").dropDuplicates(["rep", "print"]).drop("print")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = REGION_SHINGLES) -> DataFrame:
    """One row per document: ``key, n_shingles, component_id``.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a document's set
    is its distinct runs of five words, or with fewer words the whole sequence.
    Documents link when their sets' intersection is at least 0.8 of the union;
    the component is the smallest key reachable by links, itself included. Null
    and empty texts have an empty set and link with nothing. Texts with equal
    sets are one node. Rows that repeat a key are one node, with the links
    of all their texts; a row with a null key is returned with its count, a null component, and links
    nothing. Input columns beside key and text are not used.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = shingle_regions(rows)
    each = found.where("tok is null").drop("tok")
    reps = write_through(each.where("n > 0 and key is not null").groupBy("print").agg(F.min("key").alias("rep")), "nodes")
    wide = found.where("tok is not null and key is not null").select("tok", "print").distinct().join(reps, "print")
    pivot = wide.groupBy("tok").agg(F.min("rep").alias("pivot"))
    star = wide.join(pivot, "tok").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    region = components(star).select(F.col("node").alias("rep"), F.col("component").alias("region"))
    members = write_through(region.join(reps, "rep"), "members")
    sets = write_through(_region_sets(rows, members), "sets")
    links = _split_regions(sets, limit)
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    final = components(edges)
    named = reps.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("__c"))
    out = each.join(named, "print", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("__c", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of texts, that with the smallest key, a null key after all others.

    Rows are told apart by key and text, so different texts under one key stay,
    and copies under null keys go. Texts without words link with nothing: of rows
    that repeat such a text and its key one stays, and those with a null key stay all.
    """
    ids = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    hashed = docs.withColumn("__h", ids)
    found = near_duplicates(hashed.select("__h", text), "__h", text)
    named = write_through(found.select("__h", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("__c")).distinct(), "texts")
    pairs = write_through(hashed.groupBy(F.col(key).alias("__k"), "__h").agg(F.count("*").alias("n")), "pairs")
    # One pair of each text first, so that a text of many rows isn't one hot key of a join.
    first = pairs.groupBy("__h").agg(F.min(F.struct(F.col("__k").isNull().alias("nameless"), F.col("__k").alias("k"), F.col("__h").alias("h"))).alias("row"))
    first = first.join(named.where("__c is not null"), "__h").groupBy("__c").agg(F.min("row").alias("row")).select(F.col("row.k").alias("__k"), F.col("row.h").alias("__h"))
    wordless = named.where("__c is null").select("__h")
    stay = first.unionByName(pairs.join(wordless, "__h", "left_semi").select("__k", "__h")).distinct()
    stay = write_through(stay.withColumnsRenamed({"__k": "__sk", "__h": "__sh"}), "stay")
    if stay.count() <= BROADCAST_ROWS:
        stay = F.broadcast(stay)
    kept = hashed.join(stay, hashed[key].eqNullSafe(stay["__sk"]) & (hashed["__h"] == stay["__sh"]), "left_semi")
    if pairs.where("n > 1").isEmpty():
        return kept.select(*docs.columns)
    kept = kept.withColumn("__nameless", F.col(key).isNull() & ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]"))
    single = kept.where("not __nameless")
    single = single.groupBy(F.col(key).alias("__k"), F.col("__h").alias("__t")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(kept.where("__nameless").select(*docs.columns))
