"""Small tables with every awkward row, and plain Python versions of operators."""

from __future__ import annotations

import random
import re

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed=1):
    """Copies, near copies, a shared passage, short, empty, null, very long and repeated texts; null ids and sources."""
    rng = random.Random(seed)
    passage, base = prose(rng, 60), prose(rng, 120).split()
    rows = [(i, prose(rng, rng.randrange(1, 80)), "en", f"s{i % 4}", 0) for i in range(40)]
    rows += [(100 + i, passage + " " + prose(rng, 40 + i), "en", "s0", 0) for i in range(12)]
    for i in range(25):
        near = list(base)
        for _ in range(i % 5):
            near[rng.randrange(len(near))] = f"x{i}"
        rows.append((200 + i, " ".join(near), "en", "s0", 0))
    rows += [(300 + i, "Same Text  for\tall\nof them here", "de", None, None) for i in range(20)]
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, " \t\n", "en", "s1", 3), (403, "one two", "en", "s2", 7), (404, "ONE two", "en", "s2", 7)]
    rows += [(405, prose(rng, 30_000), "en", "s3", 0), (406, "Éa éA straße İ   x" * 3, "fr", "s3", 0)]
    rows += [rows[5], rows[5], (None, "no id at all but some words here", "en", "s1", 0), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def jaccard_components(rows):
    """By comparing all pairs: doc_id -> (set size, smallest reachable id)."""
    sets = {}
    for i, text, *_ in rows:
        if i is not None:
            w = words(text)
            sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
