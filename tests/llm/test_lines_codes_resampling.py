"""Line deduplication, vector codes and importance resampling against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, alnum_words, docs, lowered, no_docs, prose, rows  # noqa: F401
from pyspark.sql import functions as F

from tidemark.llm import importance, lines, vector_codes
from tidemark.llm.metric_trees import Tree, assign, build
from tidemark.llm.ngram_buckets import Words, word_checksums, zeros

# --- lines ---

SHARED = ["this line is in many of them", "  THIS line is in many of them\t", "a second line, also quite long", "short one", "é" * 20, "é" * 19]


def line_rows():
    made = []
    for i in range(60):
        own = [f"only document {i} has this line {j}" for j in range(i % 4)]
        made.append((i, "\n".join([SHARED[i % 2], *own, SHARED[2 + i % 4], ""][: 1 + i % 5])))
    made += [(100, "\n".join([SHARED[0]] * 4 + ["x"])), (101, "twice only, but long enough"), (102, "twice only, but long enough")]
    made += [(103, "twice only, but long enough"), (103, "twice only, but long enough"), (104, None), (105, ""), (106, "\n\n"), (107, "\n".join(["a long line to be dropped"] * 3))]
    made += [(None, "a long line to be dropped\nand one that nobody else has at all"), (None, SHARED[0]), (108, "a long line to be dropped\r\nrest"), (109, "A LONG line to be dropped\x0b")]
    made += [(110, "\n".join(f"line number {j} of a long text" for j in range(5000)) + "\n" + SHARED[0]), (1, made[1][1]), (1, "this id comes twice\n" + SHARED[0])]
    return made


def deduplicated(rows):
    """By the definition: row -> (lines, dropped, kept text)."""
    def key(line):
        return lowered(line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-math.inf if i is None else i)
    out = []
    for i, text in rows:
        split = (text or "").split("\n")
        keep = [x for x in split if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == (-math.inf if i is None else i)]
        out.append((i, len(split), len(split) - len(keep), "\n".join(keep)))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_lines_equal_the_definition(spark, partitions):
    made = line_rows()
    df = spark.createDataFrame(made, "doc_id bigint, text string")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lines.kept_text(df).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert by_id(map(tuple, got)) == by_id(deduplicated(made))


def test_a_line_of_many_partitions_is_decided_by_its_borders():
    """The same rows cut anywhere into partitions give the same lines to drop."""
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 6, 300))
    doc = rng.integers(0, 30, 300)
    order = np.lexsort((-doc, h))
    h, doc = h[order], doc[order]
    th, place, ones = np.zeros(300, np.int64), np.arange(300, dtype=np.int32), np.ones(300, np.int64)
    want = {int(p) for p in place if len(set(doc[h == h[p]].tolist())) >= 3 and doc[p] != doc[h == h[p]].max()}
    for cuts in ([0, 300], [0, 1, 2, 300], [0, 50, 51, 100, 180, 299, 300], list(range(301))):
        dropped, opened, borders = set(), [], defaultdict(set)
        for a, b in zip(cuts, cuts[1:]):
            pieces = [(i, min(i + 37, b)) for i in range(a, b, 37)]
            batches = [pa.RecordBatch.from_arrays([pa.array(x[i:j]) for x in (h, ones, doc, th, place)], names=["h1", "h2", "doc", "th", "place"]) for i, j in pieces]
            for r in (r for batch in lines._stream(iter(batches), 3) for r in batch.to_pylist()):
                if r["kind"] == "drop":
                    dropped.add(r["place"])
                elif r["kind"] == "open":
                    opened.append(r)
                else:
                    borders[r["h1"]].add(r["doc"])
        dropped |= {r["place"] for r in opened if len(borders[r["h1"]]) >= 3 and r["doc"] != max(borders[r["h1"]])}
        assert dropped == want


def test_line_bitmaps(spark, no_docs):
    made = line_rows()
    df = spark.createDataFrame(made, "doc_id bigint, text string").withColumns({"keep": F.lit(1), "N_LINES": F.lit("x"), "doc": F.lit(2), "map_doc": F.lit(3), "h1": F.lit(4)})
    maps = lines.keep_bitmaps(df)
    texts = defaultdict(list)
    for i, n, dropped, _ in deduplicated(made):
        texts[i].append((n, dropped))
    for r in maps.collect():
        mask = lines.kept_mask(r.keep, r.n_lines)
        assert (len(mask), len(mask) - mask.sum()) in texts[r.doc_id] and r.n_dropped == len(mask) - mask.sum()
    assert maps.count() == len(made)
    kept = lines.kept_text(df)
    assert set(kept.columns) == {"doc_id", "text", "keep", "doc", "map_doc", "h1", "n_lines", "n_dropped"}
    assert lines.kept_text(no_docs).count() == 0 and lines.keep_bitmaps(no_docs).count() == 0


def test_lines_of_awkward_rows(docs, rows):
    got = lines.kept_text(docs).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))).collect()
    assert by_id(map(tuple, got)) == by_id(deduplicated([(r[0], r[1]) for r in rows]))


# --- vector codes ---


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """By comparing every part with every entry: codes, errors and the codebooks."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in v] for _, v in kept]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[nearest(p, v[p])[1]].append(v[p])
            for k, points in own.items():
                books[p][k] = [sum(c) // len(points) for c in zip(*points)]
    coded = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    out = [(i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c)) for (i, _), c in zip(kept, coded)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vector_rows():
    rng = np.random.default_rng(3)
    made = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 16)]) for i in rng.permutation(150)]
    same = made[0][1]
    made += [(1000 + i, same) for i in range(60)] + [(2000, None), (2001, [1.0] * 15 + [None]), (2002, [math.nan] * 16), (2003, [math.inf] + [0.0] * 15)]
    return made + [(2004, [0.0] * 16), (2005, [-1e-9] * 16), (2006, [900.0, -900.0] * 8), (None, same), made[5], made[5]]


@pytest.mark.parametrize("partitions", [1, 5])
def test_codes_equal_plain_rounds(spark, partitions):
    made = vector_rows()
    want, digest = plain_codes(made)
    df = spark.createDataFrame(made, "vec_id bigint, embedding array<float>").repartition(partitions)
    clash = df.withColumns({"code": F.lit(1), "Error": F.lit("x"), "row": F.lit(2), "vector": F.lit(3), "a b": F.lit(4)})
    coded, books = vector_codes.compress(clash)
    assert set(coded.columns) == {"vec_id", "embedding", "row", "vector", "a b", "code", "error"}
    got = [(r.vec_id, r.code, r.error) for r in coded.collect()]
    assert by_id(got) == by_id(want) and books.sha256 == digest


def test_codes_of_few_or_no_vectors(spark):
    kind = "vec_id bigint, embedding array<double>"
    none, books = vector_codes.compress(spark.createDataFrame([], kind))
    assert none.count() == 0 and books is None
    nothing, books = vector_codes.compress(spark.createDataFrame([(1, None), (2, [None] * 8)], kind))
    assert nothing.count() == 0 and books is None
    few = [(5, [0.5] * 8), (3, [0.25] * 8), (9, [1.0] * 16), (10, [])]
    coded, books = vector_codes.compress(spark.createDataFrame(few, kind))
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {3: ("00" * 8, 0), 5: ("01" * 8, 0), 9: (None, None), 10: (None, None)}
    odd, books = vector_codes.compress(spark.createDataFrame([(1, [1.0] * 9)], kind))
    assert [(r.code, r.error) for r in odd.collect()] == [(None, None)] and books is None
    huge, _ = vector_codes.compress(spark.createDataFrame([(1, [1e300] * 8), (2, [-1e300] * 8)], kind))
    assert {r.vec_id: r.error for r in huge.collect()} == {1: 0, 2: 0}


@pytest.mark.parametrize("n,scale", [(1, 9), (40, 3), (3000, 300), (3000, 2), (500, 1 << 26)])
def test_trees_give_what_all_distances_give(n, scale):
    rng = np.random.default_rng(n + scale)
    points = rng.integers(-scale, scale, (n, 4))
    points[n // 3 : n // 2] = points[0]
    entries = np.concatenate((points[rng.integers(0, n, 9)], points[:1], rng.integers(-scale, scale, (3, 4))))
    tree = build(points)
    for b in range(len(tree.lo)):
        inside = points[tree.order[tree.lo[b] : tree.hi[b]]]
        assert (inside.sum(0) == tree.sums[b]).all()
        assert np.sqrt(((inside - inside.mean(0)) ** 2).sum(1)).max() <= tree.radius[b]
    distance = ((points[:, None] - entries[None]) ** 2).sum(-1)
    sums, counts, nearest, off = assign(Tree.from_bytes(tree.to_bytes(), 4), points, entries, members=True)
    assert (nearest == distance.argmin(1)).all() and (off == distance.min(1)).all()
    assert (counts == np.bincount(nearest, minlength=len(entries))).all()
    assert all((sums[k] == points[nearest == k].sum(0)).all() for k in range(len(entries)))
    again = assign(tree, points, entries, members=False)
    assert (again[0] == sums).all() and (again[1] == counts).all()


# --- importance resampling ---


def grams(text):
    w = alnum_words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain_scores(rows, target):
    raw, aim = Counter(bucket(f) for _, t in rows for f in grams(t)), Counter(bucket(f) for t in target for f in grams(t))
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log(float((aim[b] + 1) * (s + 10_000)) / float((raw[b] + 1) * (t + 10_000)))) for b in {*raw, *aim}}
    out = []
    for i, text in rows:
        u = (int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[bucket(f)] for f in grams(text))
        out.append([i, len(grams(text)), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(alnum_words(text))])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(long[: 5 * len(long) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def resampled(df, target):
    got = importance.resample(df, target)
    return [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("sort_rows", [1 << 15, 16])
def test_resampling_equals_plain_counts(spark, docs, rows, monkeypatch, sort_rows):
    monkeypatch.setattr(importance, "SORT_ROWS", sort_rows)
    more = [(500 + i, f"{prose(random.Random(i), 15, 30)}\nsame line here\n\nw1\n-\nw2 w3\nÉa é!straße{i % 3} x_y") for i in range(80)]
    every = [(r[0], r[1]) for r in rows] + more
    target = ["w1 w2 w3", None, "", "same line here w1\nw2", "Straße"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    clash = df.withColumns({c: F.lit("x") for c in ("rank", "score", "down_", "row", "line", "pos")})
    got = resampled(clash, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string"))
    assert in_order(got) == in_order(plain_scores(every, target))
    assert sum(r[4] is not None for r in got) >= 5


def test_resampling_of_empty_tables(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "text string")
    assert resampled(no_docs, none) == []
    assert in_order(resampled(docs, none)) == in_order(plain_scores([(r[0], r[1]) for r in rows], []))


def test_checksums_join():
    words = [b"a", b"abc", b"x" * 64, b"y" * 65, b"z" * 5000, "é".encode()]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    crc = word_checksums(data, starts, lengths)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    joined = zeros(np.full(len(words), zlib.crc32(b"head"), np.uint32), lengths) ^ crc
    assert joined.tolist() == [zlib.crc32(b"head" + w) for w in words]


def test_words_by_line():
    words = Words(pa.array(["One two\n\n three-FOUR\n", None, "é", " \n"]))
    found, owner = words.lines()
    assert found.to_pylist() == ["one two\n", "three four\n", "é\n"] and owner.tolist() == [0, 0, 2]
    crc, first = words.grams(3, words.text, words.line)
    assert sorted(crc.tolist()) == sorted(zlib.crc32(g) for g in (b"two three", b"one two three", b"two three four"))
