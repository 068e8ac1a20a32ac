"""Toxic spans by a linear-chain conditional random field.

Each word of a text is in state 0 or 1 (toxic). A word's evidence is the sum of
weights of its hashed features (itself and its character n-grams); transition
weights let neighbours support each other. Forward-backward gives each word's
marginal; marginals aggregate to a document's score and offending offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tidemark.llm.labelled import labelled_sample
from tidemark.llm.subwords import sums, word_features
from tidemark.llm.words import encode_words, slices, split_words

NGRAMS = (4, 5, 6)
BUCKETS = 1 << 20
SAMPLE = 3000
WORD = re.compile("[^\x20\x09-\x0d]+")


def _chain(evidence: np.ndarray, starts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal probability of state 1 for each word, with both messages; chains run side by side.

    With two states, a forward message is one ratio r(t) = alpha1 / alpha0 and a
    backward message one ratio s(t) = beta1 / beta0; the marginal's odds are r * s.
    """
    length = np.diff(starts)
    order = np.argsort(-length, kind="stable")
    first, length = starts[:-1][order], length[order]
    live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    odds = np.exp(np.clip(evidence, -30, 30))
    m = np.exp(trans)
    forward, backward = np.empty_like(odds), np.empty_like(odds)
    r = np.zeros(0)
    for t, n in enumerate(live):
        at = first[:n] + t
        r = odds[at] if t == 0 else odds[at] * (m[0, 1] + r[:n] * m[1, 1]) / (m[0, 0] + r[:n] * m[1, 0])
        r = np.clip(r, 1e-30, 1e30)
        forward[at] = r
    s = np.ones(len(length))
    for t in range(len(live) - 1, -1, -1):
        n, longer = live[t], live[t + 1] if t + 1 < len(live) else 0
        s[longer:n] = 1.0
        if longer:
            after = odds[first[:longer] + t + 1] * s[:longer]
            s[:longer] = np.clip((m[1, 0] + after * m[1, 1]) / (m[0, 0] + after * m[0, 1]), 1e-30, 1e30)
        backward[first[:n] + t] = s[:n]
    both = forward * backward
    return both / (1 + both), forward, odds * backward


def _clean(distinct: list[str]) -> list[str]:
    """Words without marks around them; a word of marks only stays."""
    return [w.strip(".,;:!?|*#$%&\"'()[]{}<>-_/\\~`^+=@") or w for w in distinct]


def _indicators(code: np.ndarray, starts: np.ndarray, label: np.ndarray, feats: np.ndarray, at: np.ndarray, buckets: int) -> np.ndarray:
    """Features that tell toxic documents, as flags.

    One after the other, the feature with the surest odds between toxic
    documents not yet explained and all others is taken, and the documents that
    have it are explained. So what copies of one toxic document share by chance
    isn't taken for a sign, once a real sign explains them.
    """
    neg, pos, own = np.zeros(buckets), np.zeros(buckets), {}
    for d in range(len(label)):
        words = np.unique(code[starts[d] : starts[d + 1]])
        if len(words):
            ids = np.unique(np.concatenate([feats[at[w] : at[w + 1]] for w in words]))
            if label[d]:
                pos[ids] += 1
                own[d] = ids
            else:
                neg[ids] += 1
    n_pos, n_neg = max(label.sum(), 1), max((1 - label).sum(), 1)
    told = np.zeros(buckets, bool)
    while own:
        live = np.flatnonzero((pos >= 3) & ~told)
        if not len(live):
            break
        a, b = pos[live], neg[live]
        sure = np.log((a + 0.1) / (n_pos + 0.2)) - np.log((b + 0.5) / (n_neg + 1.0)) - 2 * np.sqrt(1 / (a + 0.1) + 1 / (b + 0.5))
        best = int(np.argmax(sure))
        if sure[best] <= 0:
            break
        told[live[best]] = True
        for d in [d for d, ids in own.items() if ids[min(np.searchsorted(ids, live[best]), len(ids) - 1)] == live[best]]:
            pos[own.pop(d)] -= 1
    return told


def fit(sample: pa.Table, buckets: int = BUCKETS, epochs: int = 40, rate: float = 4.0, seed: int = 3) -> dict:
    """Fit the field on words labelled from documents, then the document score on its marginals.

    A word is labelled toxic where it stands in a toxic document and has one of
    the features that tell toxic documents. Gradients are expectations by
    forward-backward minus what the labels say. Without both classes the model
    gives the only class seen, or 0.5.
    """
    label = sample.column("label").to_numpy().astype(np.int64)
    if len(set(label.tolist())) < 2:
        return {"weights": np.zeros(buckets, np.float32), "trans": np.zeros((2, 2)), "start": 0.0, "doc": np.array([0.0 if not len(label) else (8.0 if label[0] else -8.0), 0.0, 0.0])}
    texts = sample.column("text").combine_chunks()
    flat, starts = split_words(texts)
    distinct, code = encode_words(flat)
    cleaned, place = np.unique(np.array(_clean(distinct), dtype=object), return_inverse=True)
    code = place[code]
    feats, at = word_features(cleaned.tolist(), NGRAMS, buckets)
    signs = _indicators(code, starts, label, feats, at, buckets)
    told = sums(signs[feats], at) > 0
    gold = (told[code] & np.repeat(label == 1, np.diff(starts))).astype(np.float64)
    # Words that tell nothing need no place in the chain's training but as neighbours: a few negatives for each positive.
    rng = np.random.default_rng(seed)
    docs = np.flatnonzero((label == 1) | (rng.random(len(label)) < 0.25))
    keep = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs]) if len(docs) else np.empty(0, np.int64)
    begin = np.concatenate(([0], np.cumsum(np.diff(starts)[docs])))
    code_k, gold_k = code[keep], gold[keep]
    n_feats = np.diff(at)
    weights, trans, start = np.zeros(buckets), np.zeros((2, 2)), -4.0
    inner = np.ones(len(keep), bool)
    inner[begin[:-1][begin[:-1] < len(keep)]] = False
    inner = np.flatnonzero(inner)
    seen = np.bincount(feats, weights=np.bincount(code_k, minlength=len(cleaned)).repeat(n_feats), minlength=buckets)
    damp = 1 / np.sqrt(seen + 1.0)
    grown = np.full(buckets, 1e-8)
    for _ in range(epochs):
        word_score = sums(weights[feats], at) + start
        p, forward, after = _chain(word_score[code_k], begin, trans)
        gap = np.bincount(code_k, weights=gold_k - p, minlength=len(cleaned))
        gradient = np.bincount(feats, weights=gap.repeat(n_feats), minlength=buckets) * damp - 1e-3 * weights
        grown += gradient**2
        weights += rate / 4 * gradient / np.sqrt(grown)
        start += 0.5 * np.clip((gold_k - p).sum() / max(gold_k.sum(), 1.0), -1, 1)
        # Labelled less expected steps from state to state.
        m, r, o = np.exp(trans), forward[inner - 1], after[inner]
        joint = np.stack([np.full(len(r), m[0, 0]), m[0, 1] * o, r * m[1, 0], r * m[1, 1] * o])
        joint /= joint.sum(0)
        c, d = gold_k[inner - 1], gold_k[inner]
        move = np.array([[0.0, ((1 - c) * d - joint[1]).sum()], [(c * (1 - d) - joint[2]).sum(), (c * d - joint[3]).sum()]])
        trans += 0.1 * np.clip(move / max(gold_k.sum(), 1.0), -1, 1)
    model = {"weights": weights.astype(np.float32), "trans": trans, "start": start, "doc": np.zeros(3)}
    total, most = _document_features(_chain((sums(weights[feats], at) + start)[code], starts, trans)[0], starts)
    x = np.stack([np.ones(len(label)), total, most], 1)
    theta = np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-2, 1e-2, 1e-2])
        theta += np.linalg.solve(hessian, x.T @ (label - q) - 1e-2 * theta)
    model["doc"] = theta
    return model


def _document_features(p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of one more than the expected number of toxic words, and the largest marginal."""
    most = np.zeros(len(starts) - 1)
    full = np.diff(starts) > 0
    if full.any():
        most[full] = np.maximum.reduceat(p, starts[:-1][full])
    return np.log1p(np.maximum(sums(p, starts), 0)), most


def marginals(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probability of being toxic, and where each text's words begin."""
    flat, starts = split_words(texts)
    distinct, code = encode_words(flat)
    feats, at = word_features(_clean(distinct), NGRAMS, len(model["weights"]))
    return _chain((sums(model["weights"][feats], at) + model["start"])[code], starts, model["trans"])[0], starts


def _scored(texts: pa.Array, model: dict) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    p, starts = marginals(texts, model)
    total, most = _document_features(p, starts)
    a, b, c = model["doc"]
    # Sums depend on a text's place in its batch in the last bits; equal texts have equal scores.
    score = np.round(1 / (1 + np.exp(-np.clip(a + b * total + c * most, -30, 30))), 9)
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    hot = np.flatnonzero(p > 0.5)
    owner = np.searchsorted(starts, hot, side="right") - 1
    for d in np.unique(owner):
        wanted = set((hot[owner == d] - starts[d]).tolist())
        last = -2
        for i, m in enumerate(WORD.finditer(texts[int(d)].as_py())):
            if i in wanted:
                if last == i - 1:
                    spans[d][-1]["end"] = m.end()
                else:
                    spans[d].append({"start": m.start(), "end": m.end()})
                last = i
    return score, spans


def tag(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans``: character offsets of runs of toxic words.

    Null and empty texts have no spans and the score of no evidence; repeated
    rows score alike; columns named like results are replaced. Row by row over
    whole texts, no shuffle.
    """
    plain = docs.drop("score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            score, spans = _scored(batch.column(text), shared.value)
            batch = batch.append_column("score", pa.array(score, pa.float64()))
            yield batch.append_column("spans", pa.array(spans, kind))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{fields}, score double, spans array<struct<start:int,end:int>>")


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", rows: int = SAMPLE, key: str = "doc_id", text: str = "text") -> dict:
    """Fit on at most ``rows`` labelled documents; labels, languages, sources and ids are no inputs."""
    return fit(labelled_sample(docs, labels, label, learn, rows, key, text))
