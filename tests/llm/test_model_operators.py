import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import TINY
from helpers import docs, no_docs, rows  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination, embeddings, jaccard, mixing, quality, site_trees, token_files, toxicity
from tidemark.llm.hnsw import Graph
from tidemark.llm.labelled import fold
from tidemark.llm.queries import QUERIES
from tidemark.llm.wavelet import WaveletMatrix

FOLDER = TINY.replace("sf0.001", "sf0.01")


def held_out_accuracy(spark, name, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    told = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    return np.mean(told)


def test_quality_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op4_quality", "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op2_toxicity", "toxic") > 0.92


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**15)], "k bigint")
    assert [r[0] for r in df.select(fold(F.col("k"), 5)).collect()] == [zlib.crc32(str(i).encode()) % 5 for i in (0, 7, -3, 10**15)]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_take_awkward_rows(spark, docs, no_docs, rows, module, label):
    apply = quality.score if module is quality else toxicity.tag
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)] + [(None, 1), (3, None), (5, 1), (400, 0)], f"doc_id bigint, {label} int")
    model = module.train(docs, labels, F.lit(True))
    got = apply(docs.withColumns({"score": F.lit("x"), "spans": F.lit(1)}), model)
    assert got.count() == len(rows) and got.where("score between 0 and 1").count() == len(rows)
    same = [r.score for r in got.where("doc_id between 300 and 319").collect()]
    assert len(set(same)) == 1
    assert apply(no_docs, model).count() == 0
    unseen = module.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in apply(docs, unseen).collect()} == {0.5}
    one_sided = module.train(docs, labels.where(f"{label} = 1"), F.lit(True))
    assert apply(docs, one_sided).where("score > 0.5").count() == len(rows)


def test_spans_are_offsets_of_toxic_words():
    rng = np.random.default_rng(0)
    plain = lambda: [f"word{rng.integers(50)}" for _ in range(20)]
    texts = [" ".join(plain()) for _ in range(60)]
    for i in range(0, 60, 3):
        w = plain()
        w[4:6] = ["grumbl!", "Grumbl"]
        texts[i] = "  ".join(w)
    model = toxicity.fit(pa.table({"text": texts, "label": [int(i % 3 == 0) for i in range(60)]}))
    score, spans = toxicity._scored(pa.array(["word1 grumbl  GRUMBL. word2", "word1 word2", None, ""]), model)
    assert score[0] > 0.5 > score[1] and spans == [[{"start": 6, "end": 21}], [], [], []]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    evidence, trans, starts = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 9])
    p = toxicity._chain(evidence, starts, trans)[0]
    for a, b in zip(starts[:-1], starts[1:]):
        n = b - a
        weight, total = np.zeros(n), 0.0
        for state in range(2**n):
            y = [state >> t & 1 for t in range(n)]
            w = np.exp(sum(evidence[a + t] * y[t] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1)))
            total += w
            weight += w * np.array(y)
        assert p[a:b] == pytest.approx(weight / total if n else [])


# --- pages ---

HEAD = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav>"


def page(spark, htmls, url="http://h.example/x"):
    df = spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")
    return [r.main_text for r in site_trees.extract(df.withColumn("main_text", F.lit(1))).orderBy("page_id").collect()]


def test_main_text_of_marked_pages(spark):
    body = "<header>top</header><article><h1>Head</h1><p>One &amp; <b>two\n  three<br>four<p>five&nbsp;six</p><div class='ad x'>buy</div><form>go</form><ul><li>a<li>b</ul><script>if(a</p>b)</script><section id=comments><p>nice</p></section></article><footer>&copy; me</footer>"
    assert page(spark, [HEAD + body, None, "", "<p>", "no markup"]) == ["Head One & two three four five six a b", "", "", "", "no markup"]


def test_repeated_branches_go_where_nothing_marks_the_article(spark):
    pages = [HEAD + f"<div class=top><p>Always the same</p></div><div class=body><p>Text {i} {'own ' * i}</p><p>More of {i}</p></div>" for i in range(8)]
    got = page(spark, pages)
    assert got[3] == "Text 3 own own own More of 3"
    assert page(spark, pages[:1])[0].startswith("Always the same Text 0")


def test_copies_of_one_article_stay(spark):
    same = HEAD + "<div class=body><p>The same story</p></div>"
    assert page(spark, [same] * 6) == ["The same story"] * 6
    marked = HEAD + "<article><p>Told again</p></article>"
    assert page(spark, [marked] * 6) == ["Told again"] * 6


def test_words_of_classes_never_take_the_article(spark):
    nav = "<nav><a>x</a></nav>"
    pages = {
        "<main class='with-sidebar'><p>One</p></main>": "One",
        "<div class='content has-sidebar'><article><p>Two</p></article></div>": "Two",
        "<article class='post comments-open'><p>Three</p></article>": "Three",
        "<div id='page-share-enabled'><p>Four</p></div>": "Four",
        "<div class='sidebar'><main><p>Five</p></main><p>side</p></div>": "Five",
        "<article><header><h1>Head</h1></header><p>a<span hidden>z</span>b <span class=ad>buy</span>c</p></article>": "Head ab c",
        "<article><p>x<p class='ad'>y<p class='newsletter'>z<div class='discussion'><p>d</div><h2 class='page-header'>h</h2></article>": "x h",
        "<header><h1>Site</h1></header><div class='comments'><article><p>Kept</p><div class='comment-list'><p>no</p></div></article></div>": "Kept",
        "<div class='left-sidebar'><p>no</p></div><div class='story'><p>yes</p></div>": "yes",
    }
    assert page(spark, [HEAD + nav + p for p in pages], None) == list(pages.values())


def test_repeated_texts_go_inside_articles_too_but_copies_stay(spark):
    sign = "<p>Sign up for our daily letter today</p>"
    pages = [HEAD + f"<article><h1>Title {i}</h1><p>Own {i} text</p>{sign}<p>more {i}</p></article>" for i in range(12)]
    assert page(spark, pages) == [f"Title {i} Own {i} text more {i}" for i in range(12)]
    assert page(spark, [pages[0]] * 12) == ["Title 0 Own 0 text Sign up for our daily letter today more 0"] * 12
    few = [HEAD + f"<article><p>Own {i}</p>{'<p>In three of twelve</p>' if i < 3 else ''}</article>" for i in range(12)]
    assert page(spark, few)[0] == "Own 0 In three of twelve"
    twice = pages + pages[:4] * 3
    assert page(spark, twice)[12] == "Title 0 Own 0 text more 0"


def plain_tree(htmls):
    """Importance of every path, by the definition, for pages of one host."""
    from collections import defaultdict
    from math import log

    seen = set()
    for h in htmls:
        article, features = site_trees.page_features(h)
        seen |= {(article, *f) for f in features}
    counts = defaultdict(lambda: defaultdict(int))
    for _, path, content, feature in seen:
        counts[path, content][feature] += 1
    site = sum(counts["", False].values())
    nodes = []
    for (path, content), k in counts.items():
        m = max(site, max(k.values()))
        if m <= 1:
            own = 1.0
        elif content:
            own = round(1 - sum(log(v) for v in k.values()) / len(k) / log(m), 9)
        else:
            mass = sum(k.values())
            own = round(-sum(v / mass * log(v / mass) for v in k.values()) / log(m), 9)
        nodes.append((path, min(m, sum(k.values())), own))
    out = {}
    for path in {p for p, *_ in nodes} | {">".join(p.split(">")[:i]) for p, *_ in nodes for i in range(1, p.count(">") + 2)}:
        below = [(n * site_trees.GAMMA ** (p.count(">") - path.count(">")), own) for p, n, own in nodes if p == path or p.startswith(path + ">")]
        out[path] = sum(w * own for w, own in below) / sum(w for w, _ in below)
    return out


def test_importance_equals_its_definition(spark):
    rng = np.random.default_rng(8)
    htmls = [
        HEAD + f"<div class=top><p>Same</p><p>{'A' if i % 2 else 'B'}</p></div><div class=body>" + "".join(f"<p>t {rng.integers(0, 40)}</p>" for _ in range(rng.integers(1, 5))) + "</div>"
        for i in range(15)
    ]
    htmls += htmls[:4]
    df = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(htmls)], "page_id int, url string, html string")
    counted = site_trees.feature_counts(df)
    got = {r.path: r.importance for r in site_trees.style_tree(counted).collect()}
    assert got == pytest.approx(plain_tree(htmls))


def test_very_long_and_nested_pages_and_clashing_names(spark):
    long = HEAD + "<article>" + "".join(f"<p>paragraph {i}" for i in range(30_000)) + "</article>"
    deep = HEAD + "<div>" * 500 + "<p>down here" + "</div>" * 500
    df = spark.createDataFrame([(1, None, long), (2, "http://a.b", deep), (3, None, None)], "page_id int, url string, html string")
    names = ("__low", "__host", "host", "path", "row", "paths", "texts", "low_host", "feature", "main_text")
    got = site_trees.extract(df.withColumns({c: F.lit(c) for c in names})).orderBy("page_id").collect()
    assert got[0].main_text == " ".join(f"paragraph {i}" for i in range(30_000)) and got[1].main_text == "down here" and got[2].main_text == ""
    assert all(r[c] == c for r in got for c in names if c != "main_text")


def test_pages_of_no_host(spark):
    assert page(spark, [HEAD + "<article>x"] * 2, None) == ["x", "x"] and page(spark, [HEAD + "<article>x"], "::bad") == ["x"]
    assert site_trees.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- vectors ---


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    vectors = [(i, (base[i % 30] + rng.normal(size=16) * 0.12).tolist()) for i in range(300)]
    vectors += [(1000 + i, base[0].tolist()) for i in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] * 16), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumns({"rep": F.lit(1), "key": F.lit(2)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, shards=3).collect()}
    good = [(i, np.array(v)) for i, v in vectors if i < 2000]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = unit @ unit.T >= 0.9
    component = np.array([i for i, _ in good])
    for _ in range(20):
        component = np.array([component[row].min() for row in linked])
    want = {i: (int(linked[k].sum()) - 1, int(component[k]), int(component[k]) == i) for k, (i, _) in enumerate(good)}
    assert {i: got[i] for i in want} == want
    assert all(got[i] == (0, i, True) for i in range(2000, 2005))
    assert got[2005] == (1, 2005, True) and got[2006] == (1, 2005, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_graph_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(150, 24))
    x = np.concatenate([centres + rng.normal(size=centres.shape) * 0.1 for _ in range(12)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x, np.arange(len(x)))
    truth = x[:300] @ x.T >= 0.9
    found = graph.within(x[:300], 32, 0.9)
    hits = sum(truth[i, near].sum() for i, near in enumerate(found))
    assert hits >= 0.97 * truth.sum()


@pytest.mark.parametrize("missed", ["own pairs", "queries of others"])
def test_audit_sees_lost_links_of_small_groups(monkeypatch, missed):
    rng = np.random.default_rng(2)
    group, pairs = rng.normal(size=(1, 32)), rng.normal(size=(60, 32))
    x = np.concatenate([np.repeat(group, 400, 0), pairs, pairs]) + rng.normal(size=(520, 32)) * 0.01

    class Lossy:
        def __init__(self, unit, keys):
            self.unit = unit

        def within(self, unit, beam, least):
            near = [np.flatnonzero(self.unit @ q >= least) for q in unit]
            lost = [(len(n) < 400 and missed == "own pairs") or (missed != "own pairs" and not (self.unit == q).all(1).any()) for n, q in zip(near, unit)]
            return [n[(self.unit[n] == q).all(1)] if beam < 4 * embeddings.BEAM and gone else n for n, q, gone in zip(near, unit, lost)]

    monkeypatch.setattr(embeddings, "Graph", Lossy)
    others = pairs + rng.normal(size=pairs.shape) * 0.01
    shard = embeddings._Shard(np.arange(520), np.ones(520, np.int64), x, 0.9, np.arange(1000, 1060), others)
    assert shard.beam >= 4 * embeddings.BEAM


# --- token files ---


def test_wavelet_matrix():
    ids = np.random.default_rng(3).integers(0, 50, 3000).astype(np.uint16)
    ids[::7] = 4
    m = WaveletMatrix.build(ids, 6)
    m = WaveletMatrix(m.n, [p.tobytes() for p in m.planes], [r.tobytes() for r in m.ranks], m.zeros)
    assert (m.decode() == ids).all()
    assert [m.access(i) for i in (0, 7, 511, 512, 2999)] == ids[[0, 7, 511, 512, 2999]].tolist()
    for token in (0, 4, 49, 60):
        at = np.flatnonzero(ids == token)
        assert m.rank(token) == len(at) and m.rank(token, 1000) == (at < 1000).sum()
        assert [m.select(token, k) for k in range(0, len(at), 9)] == at[::9].tolist()
    with pytest.raises(IndexError):
        m.select(60, 0)
    assert WaveletMatrix.build(ids[:0], 6).decode().tolist() == []


def test_token_files_round_trip(spark, rows, docs, no_docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "SHARD_IDS", 2000)
    tokenizer = Tokenizer.from_file(token_files.tokenizer_path("byte_bpe_50k.json"))
    odd = [(500, "a  b   c \n\n d\t\te ", "", "", 0), (501, "  lead and  hard space  x", "", "", 0), (502, "it's<|endoftext|>they'll\n\nx \n y", "", "", 0), (503, " ", "", "", 0)]
    table = spark.createDataFrame(rows + odd, docs.schema).withColumns({"key": F.lit(1), "part": F.lit(2)})
    folder = token_files.write(table)
    got = sorted(((r.key if r.key is not None else 1 << 60), r.n_tokens, r.ids_crc32) for r in token_files.documents(spark, folder).collect())
    ids = [((i if i is not None else 1 << 60), np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t, *_ in rows + odd]
    assert got == sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
    placed = sorted((r.start, r.n_tokens) for r in token_files.documents(spark, folder).collect())
    assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:]))
    by_start = token_files.documents(spark, folder).orderBy("start").collect()
    keys = [r.key for r in by_start]
    assert [k for k in keys if k is not None] == sorted(k for k in keys if k is not None) and keys[-1] is None
    assert token_files.count(spark, folder, 0) >= len(rows) + 4
    ends = {r.position for r in token_files.locate(spark, folder, 0).collect()}
    assert {r.start + r.n_tokens - 1 for r in by_start} <= ends and len(ends) == token_files.count(spark, folder, 0)
    assert token_files.documents(spark, token_files.write(no_docs)).count() == 0


def test_ids_of_all_short_strings():
    """All strings of up to four pieces, white space of every kind and the special token among them."""
    from itertools import product

    from tokenizers import Tokenizer

    path = token_files.tokenizer_path("byte_bpe_50k.json")
    plain, encoder = Tokenizer.from_file(path), token_files._Encoder(path)
    kinds = [" ", "\n", "\t", "\x0b", "\r", "\x1c", "\x00", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "a", "B", "7", ".", ",", "'s", "\u00e9", "\u4e2d", "<|endoftext|>"]
    texts = ["".join(x) for k in range(4) for x in product(kinds, repeat=k)]
    texts += ["".join(x) for x in product([" ", "\n", "\u2003", "a", ".", "\u00e9", "<|endoftext|>"], repeat=5)] + [None]
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    wanted = [e.ids + [0] for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert at.tolist() == [0, *np.cumsum([len(x) for x in wanted]).tolist()]
    assert ids.tolist() == [i for x in wanted for i in x]


# --- pipeline ---


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        before, got = got, corpus_pipeline.write_through(stage(spark, got, TINY), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
        ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
        if name == "near_duplicates":
            assert ids(got) == ids(jaccard.near_duplicates(before).where("doc_id = component_id"))
        if name == "decontamination":
            marked = decontamination.contaminated(before, spark.read.parquet(f"{TINY}/benchmark.parquet"))
            assert ids(got) == ids(marked.where("n_hit = 0"))
        if name == "mixing":
            assert got.count() == mixing.mix(before).agg(F.sum("copies")).first()[0]
        if name == "token_files":
            assert ids(got) == ids(before)
    con = duckdb.connect()
    junk = con.execute(f"select doc_id from '{TINY}/labels.parquet' where quality = 0").fetchall()
    assert not {i for (i,) in junk} & {r.doc_id for r in got.collect()}


def test_vectors_of_any_length_have_their_cosine(spark):
    vectors = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 3e-310]), (6, [0.0, 1e300])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5)}
