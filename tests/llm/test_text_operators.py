import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from conftest import TINY
from helpers import SCHEMA, alnum_words, docs, jaccard_components, lowered, no_docs, rows, words  # noqa: F401
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, language_model, licences, mixing
from tidemark.llm import context_trees as trees
from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES
from tidemark.llm.words import shingle_sets


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, TINY), connect(TINY), ORACLE[name]) is None


# --- licences ---


def licence_matches(text, templates=licences.TEMPLATES):
    """By comparing every window: (template, licence, start, dice) of the best window of each template."""
    import re

    def pairs(t):
        w = re.findall("[a-z0-9]+", lowered(t))
        return [f"{a} {b}" for a, b in zip(w, w[1:])] if len(w) > 1 else w

    out, p = [], pairs(text)
    for i, (licence, notice) in enumerate(templates):
        b = pairs(notice)
        best = (0, 0)
        for start in range(len(p)):
            if p[start] in b:
                window = p[start : start + len(b)]
                window = set(window[: max(j for j, x in enumerate(window) if x in b) + 1])
                best = max(best, (2.0 * len(window & set(b)) / (len(window) + len(set(b))), -start))
        if best[0] >= 0.8:
            out.append((i, licence, -best[1], best[0]))
    return out


def scanned(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {i: [] for i in range(len(texts))}
    for r in licences.scan(df, **options).collect():
        out[r.doc_id].append((r.template, r.licence, r.start, r.dice))
    return [sorted(v) for v in out.values()]


def test_licences_wrapped_indented_embedded_and_commented(spark):
    def full(licence):
        return max((n for k, n in licences.TEMPLATES if k == licence), key=len)

    def wrapped(text, lead, width=9):
        words = text.split()
        return "\n".join(lead + " ".join(words[i : i + width]) for i in range(0, len(words), width))

    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "ISC", "Unlicense"]
    texts = [wrapped(full(k), lead) for k in names for lead in ("", "    ", " * ", "# ", "// ")]
    texts += ["Some text before it. " + full(k) + " And more of it after. " * 3 for k in names]
    texts += ["Copyright 2020 A. B.\n\n" + wrapped(full("MIT").replace("sublicense", "sub-license").replace("persons", "people"), "")]
    texts += ["Some text. Released under the MIT License. More text", "Released under MIT License", "RELEASED UNDER THE\nmit licence"]
    got = scanned(spark, texts)
    assert got == [licence_matches(t) for t in texts]
    for k, found in zip([k for k in names for _ in range(5)] + names + ["MIT"] * 2, got):
        assert k in {licence for _, licence, *_ in found}, k
    assert [f[1:] for f in got[-3]] == [("MIT", 2, 1.0)] and got[-1][0][1] == "MIT"


def test_licence_windows_equal_brute_force(spark, rows):
    rng = random.Random(4)
    words = [w for _, n in licences.TEMPLATES for w in n.split()] + ["some", "other", "words"] * 20
    texts = []
    for _ in range(60):
        licence, notice = rng.choice(licences.TEMPLATES)
        cut = [rng.choice(words) if rng.random() < rng.choice([0.02, 0.1, 0.3]) else w for w in notice.split() if rng.random() > 0.03]
        texts.append(" ".join(rng.choices(words, k=rng.randrange(30)) + cut + rng.choices(words, k=rng.randrange(30)) + cut[: len(cut) // 2]))
    texts += [None, "", " \n", "of the", "word " * 20_000 + "\nAll rights reserved!", "All rights reserved. " * 50] + [r[1] for r in rows]
    got = scanned(spark, texts)
    assert got == [licence_matches(t or "") for t in texts]
    assert sum(map(bool, got)) > 25
    assert scanned(spark, texts[:30], templates=[("one", "reserved"), ("none", "- -")]) == [licence_matches(t, [("one", "reserved")]) for t in texts[:30]]


def test_licences_of_no_rows_and_no_templates(docs, no_docs):
    assert licences.scan(no_docs).count() == 0
    assert licences.scan(docs, templates=[]).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("start", "template", "licence", "dice", "key", "pairs", "b", "n")})
    assert licences.scan(clash).count() == licences.scan(docs).count()


# --- mixing ---


def test_targets_fill_up_one_after_the_other(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "d": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(df, "source", "size").collect()}
    names = sorted((k for k in sizes if k), key=str) + [None]
    weight = {k: [3, 1, 2][i % 3] for i, k in enumerate(names)}
    want, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[k] for k in full)
        share = {k: left * weight[k] / sum(weight[j] for j in names if j not in full) for k in names if k not in full}
        over = {k for k in share if share[k] > 2 * sizes[k]}
        if not over:
            break
        full |= over
    want = {k: 2.0 * sizes[k] if k in full else share[k] for k in names}
    assert got == pytest.approx(want)


def test_mix(docs, rows, no_docs):
    got = mixing.mix(docs.withColumns({"size": F.lit("x"), "target": F.lit(0), "copies": F.lit(9)})).collect()
    assert len(got) == len(rows)
    assert all(r.size == len(words(r.text)) and 0 <= r.copies <= 2 for r in got)
    again = mixing.mix(docs.repartition(5))
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r.doc_id, r.copies) for r in again.collect())
    assert mixing.repeated(again, docs.columns).count() == sum(r.copies for r in got)
    assert mixing.mix(no_docs).count() == 0


def test_many_documents_come_near_the_target(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    taken = {r.source: (r.taken, r.target) for r in mixing.mix(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()}
    assert all(abs(taken - target) < 0.05 * target for taken, target in taken.values())


# --- decontamination ---


def brute_contamination(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, text, *_ in rows:
        w, hit, found = alnum_words(text), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [50_000, 7])
def test_contamination_equals_brute_force(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    texts = {r[0]: r[1] for r in rows}
    items = [(1, " ".join(texts[100].split()[5:40])), (2, "one two"), (30, "TWO"), (4, None), (5, ""), (6, "never seen words " * 5), (2, "same text for ALL of")]
    items += [(7, " ".join(texts[405].split()[-12:])), (8, " ".join(texts[405].split()[-12:])), (9, "a b " * 9)]
    extra = rows + [(900, "a b " * 12, "en", "s", 0)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(extra, SCHEMA).withColumns({"items": F.lit(1), "n_hit": F.lit(2), "w": F.lit(3), "pos": F.lit(4), "token": F.lit(5)})
    got = decontamination.contaminated(df, table).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got), key=str) == brute_contamination(extra, items)
    clean = decontamination.clean(df, table)
    assert clean.columns == df.columns
    assert clean.count() == sum(r.n_hit == 0 for r in got)


def test_contamination_of_empty_tables(spark, docs, no_docs, rows):
    none = spark.createDataFrame([(1, None)], "item_id bigint, text string")
    assert decontamination.contaminated(docs, none).where("n_hit = 0 and size(items) = 0").count() == len(rows)
    assert decontamination.clean(docs, none).count() == len(rows)
    assert decontamination.contaminated(no_docs, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0


def test_digest_of_no_items(spark):
    first = QUERIES["op10_decontamination"](spark, TINY).where("not contaminated").first()
    assert first.items_sha256 == hashlib.sha256(b"").hexdigest()


# --- Jaccard join ---


@pytest.mark.parametrize("limit,pivots", [(jaccard.REGION_SHINGLES, 64), (300, 2), (150, 1)])
def test_components_equal_brute_force(docs, rows, monkeypatch, limit, pivots):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    got = jaccard.near_duplicates(docs.withColumns({"key": F.lit(1), "print": F.lit(2), "tok": F.lit(3)}), limit=limit).collect()
    want = jaccard_components(rows)
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]


def test_block_by_block_is_exact(docs, rows, monkeypatch):
    # Pivots that cover nothing force the join of all blocks.
    monkeypatch.setattr(jaccard, "_to_pivots", lambda members, pivots: pa.table({
        "region": members["region"], "rep": members["rep"], "home": pa.nulls(members.num_rows, pa.int64()),
        "visits": pa.array([[]] * members.num_rows, pa.list_(pa.int64())),
    }))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, limit=400).where("doc_id is not null").collect()}
    assert got == {i: c for i, (_, c) in jaccard_components(rows).items()}


def test_one_of_each_component_stays(docs, rows, no_docs):
    kept = jaccard.representatives(docs)
    want = jaccard_components(rows)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert jaccard.near_duplicates(no_docs).count() == 0 and jaccard.representatives(no_docs).count() == 0


def test_rows_are_told_apart_by_key_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (3, a + " more"), (None, c), (None, c), (None, b), (None, None), (None, ""), (7, ""), (9, "")]
    got = jaccard.representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(7, b), (3, a + " more"), (None, c), (None, None), (None, ""), (7, ""), (9, "")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_local_links_equal_all_pairs():
    rng = np.random.default_rng(4)
    sets = []
    for c in range(12):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        for _ in range(8):
            own = base.copy()
            own[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(0, 1 << 60, 1)[0]
            sets.append(np.unique(own))

    def closed(links):
        up = list(range(len(sets)))
        for a, b in links:
            x, y = sorted({min(up[a], up[b]), max(up[a], up[b])}) if up[a] != up[b] else (up[a], up[a])
            up = [x if u == y else u for u in up]
        return up

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    assert closed(jaccard.local_links(sets)) == closed(every)


def test_shingles():
    texts = pa.array(["a b c d e f", "A  B\tC d\ne F ", "a b", "b a", "", None, "a", "a b c d e a b c d e a"])
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 1, 5]
    assert (sets[0] == sets[1]).all() and sets[2][0] != sets[3][0]


# --- language model ---


def test_counts_equal_plain_python(docs, rows):
    out = F.col("doc_id") % 3 == 0
    got = language_model.score(docs.withColumns({"score": F.lit(1), "learn": F.lit(2), "key": F.lit(3)}), out).collect()
    assert len(got) == len(rows)
    counts = Counter(w for i, t, *_ in rows if i is None or i % 3 for w in [*words(t), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        ((i or -1), bool(i is not None and i % 3 == 0), len(w), sum(counts[x] > 0 for x in w), round(sum(np.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), 4))
        for i, t, *_ in rows for w in [[*words(t), "\n"]]
    )
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 for r in got)


def test_model_of_nothing(no_docs, docs):
    assert language_model.score(no_docs, F.lit(False)).count() == 0
    row = language_model.score(docs.where("doc_id = 403"), F.lit(True)).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.score == pytest.approx(8 * 8 * np.log10(0.5), abs=1e-4)
    # With nothing learnt every bit costs one bit, so eight a byte: seven of the text and the end.
    assert row.bits_per_byte == pytest.approx(8.0, abs=1e-4)


def test_code_length_falls_with_learning(spark):
    df = spark.createDataFrame([(i, "the same few words again and again") for i in range(30)] + [(100, "zq xj kv wy")], "doc_id bigint, text string")
    got = {r.doc_id: (r.bits_per_byte, r.score) for r in language_model.score(df, F.col("doc_id") == 100).collect()}
    assert 0 < got[0][0] < 2 < got[100][0]
    n = len("the same few words again and again") + 1
    assert got[0][0] == pytest.approx(-got[0][1] / np.log10(2) / n)


def test_context_trees_by_hand():
    """The weighted probability of the definition, and predictions that sum to one."""
    code, at = trees.grams(pa.array(["abab", "", "abb"]))
    assert len(code) == 5 + 1 + 4 and at.tolist() == [0, 5, 6, 10]
    assert [chr(c & 255) for c in code] == list("abab\n\nabb\n")
    distinct, count = trees.counted(code)
    nodes = trees.tree_nodes(distinct, count.astype(float), 0)

    def weighted(depth, context, node):
        bits = [(c & 255) >> (7 - (node.bit_length() - 1)) & 1 for c in code.tolist()
                if trees.context_key(np.array([c]), depth)[0] == context and (1 << 8 | c & 255) >> (9 - node.bit_length()) == node]
        estimate, n = 1.0, [0, 0]
        for b in bits:
            estimate *= (n[b] + 0.5) / (sum(n) + 1)
            n[b] += 1
        if depth == trees.DEPTH:
            return estimate
        longer = {int(trees.context_key(np.array([c]), depth + 1)[0]) for c in code.tolist() if trees.context_key(np.array([c]), depth)[0] == context}
        product = 1.0
        for child in longer:
            product *= weighted(depth + 1, child, node)
        return 0.5 * estimate + 0.5 * product

    for depth in (0, 1, 3):
        keys, *_, logs, _ = nodes[depth]
        for key, log in list(zip(keys.tolist(), logs.tolist()))[:12]:
            assert np.exp(log) == pytest.approx(weighted(depth, key >> 8, key & 255))
    model = trees.Model([(k, ((o + 0.5) / (z + o + 1)).astype(np.float32), e.astype(np.float32)) for k, z, o, _, e in (nodes[d] for d in range(trees.DEPTH + 1))])
    for context in (code[2] >> 8 << 8, 123 << 8):
        assert (10.0 ** model.log10(np.array([context | b for b in range(256)]))).sum() == pytest.approx(1, abs=1e-4)


def test_scores_are_ratios_of_weighted_probabilities(spark, monkeypatch):
    """Every context counts, and one never seen says one half; whatever a task holds at once."""
    rng = np.random.default_rng(7)
    texts = [" ".join("abcdefghij"[k : k + 3] for k in rng.integers(0, 8, 30)) for _ in range(12)] + ["xyz abc zq", "bcd é cde"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    code, count = trees.counted(trees.grams(pa.array(texts[:12]))[0])

    def root(more):
        seen = dict(zip(code.tolist(), count.tolist()))
        seen[more] = seen.get(more, 0) + (more >= 0)
        seen.pop(-1, None)
        keys, *_, weighted, _ = trees.tree_nodes(np.array(sorted(seen)), np.array([float(seen[c]) for c in sorted(seen)]), 0)[0]
        return dict(zip(keys.tolist(), weighted.tolist()))

    plain = root(-1)
    want = []
    for text in texts:
        ratio = 0.0
        for c in trees.grams(pa.array([text]))[0].tolist():
            ratio += sum(w - plain.get(k, 0.0) for k, w in root(c).items())
        want.append(ratio / np.log(10))
    for size in (language_model.CHUNK_GRAMS, 5):
        monkeypatch.setattr(language_model, "CHUNK_GRAMS", size)
        got = [r.score for r in language_model.score(df, F.col("doc_id") >= 12).orderBy("doc_id").collect()]
        assert got == pytest.approx(want, rel=1e-5)


def test_clashing_names_of_mixing_and_decontamination(spark, docs, rows):
    names = ("__s", "__z", "__t", "__source", "__copy", "__id", "__h", "__hit", "__items", "__i", "__k", "items_", "w", "window")
    clash = docs.withColumns({c: F.lit(c) for c in names})
    mixed = mixing.mix(clash)
    assert mixed.count() == len(rows) and mixed.where("__z = '__z' and __source = '__source'").count() == len(rows)
    assert mixing.repeated(mixed, clash.columns).columns == clash.columns
    items = spark.createDataFrame([(1, rows[0][1])], "item_id bigint, text string")
    marked = decontamination.contaminated(clash, items)
    assert marked.count() == len(rows) and marked.where("__hit = '__hit' and __items = '__items'").count() == len(rows)
    plain = {(r.doc_id, r.text): r.n_hit for r in decontamination.contaminated(docs, items).collect()}
    assert {(r.doc_id, r.text): r.n_hit for r in marked.collect()} == plain
    assert decontamination.clean(clash, items).columns == clash.columns
