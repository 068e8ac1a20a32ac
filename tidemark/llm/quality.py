"""Text quality by supervised subword embeddings.

Words, their character n-grams and neighbouring pairs have hashed vectors; a
document is the mean of its vectors, and a softmax over that mean gives the
class. Fitted by stochastic gradient descent in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import labelled_sample
from tidemark.llm.subwords import pair_features, sums, word_features
from tidemark.llm.words import encode_words, give_back, hash_strings, slices, split_words

NGRAMS = (3, 4)
BUCKETS = 1 << 18
SAMPLE = 4000
# Text that is scored at once: its features take many times its size.
SLICE_BYTES = 1 << 20


def _bags(texts: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct buckets and their shares."""
    flat, starts = split_words(texts, lower=False)
    distinct, code = encode_words(flat)
    feats, at = word_features(distinct, NGRAMS, buckets)
    hashes = hash_strings(distinct, seed=1)[code] if len(distinct) else np.empty(0, np.uint64)
    pairs, owner = pair_features(hashes, starts, buckets)
    pair_at = np.searchsorted(owner, np.arange(len(starts)))
    bags = []
    for d in range(len(starts) - 1):
        own, n = np.unique(code[starts[d] : starts[d + 1]], return_counts=True)
        ids = [feats[at[w] : at[w + 1]] for w in own] + [pairs[pair_at[d] : pair_at[d + 1]]]
        weight = np.concatenate([np.repeat(n, at[own + 1] - at[own]), np.ones(len(ids[-1]), np.int64)]) if len(own) else np.ones(0)
        ids, where = np.unique(np.concatenate(ids).astype(np.int64), return_inverse=True)
        share = np.bincount(where, weights=weight, minlength=len(ids))
        bags.append((ids.astype(np.int32), (share / max(share.sum(), 1.0)).astype(np.float32)))
    return bags


def fit(sample: pa.Table, dim: int = 16, buckets: int = BUCKETS, epochs: int = 10, rate: float = 0.5, seed: int = 5) -> dict:
    """The model as one number per bucket, the difference of the two classes' scores, and the bias.

    The softmax over a mean of vectors is linear in the vectors, so each
    bucket's vector can be multiplied out once training is over. Without both
    classes the model says what it has seen, or 0.5 for all texts if nothing.
    """
    label = sample.column("label").to_numpy()
    if len(set(label.tolist())) < 2:
        return {"scores": np.zeros(buckets, np.float32), "bias": 0.0 if not len(label) else (8.0 if label[0] else -8.0)}
    bags = []
    for batch in slices(iter(sample.combine_chunks().to_batches()), size=SLICE_BYTES):
        bags += _bags(batch.column("text"), buckets)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for d in rng.permutation(len(bags)):
            ids, share = bags[d]
            pace = np.float32(rate * (1 - step / steps))
            step += 1
            mean = share @ vectors[ids]
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label[d]] -= 1
            back = out.T @ p
            out -= pace * np.outer(p, mean)
            bias -= pace * np.float32(0.1) * p
            vectors[ids] -= np.outer(share * pace * np.float32(min(len(ids), 200)), back)
    del bags
    give_back()
    return {"scores": vectors @ (out[1] - out[0]), "bias": float(bias[1] - bias[0])}


def score_texts(texts: pa.Array, model: dict) -> np.ndarray:
    """Probability of label 1 for each text; for one without words that of the bias alone."""
    table, buckets = model["scores"], len(model["scores"])
    flat, starts = split_words(texts, lower=False)
    distinct, code = encode_words(flat)
    feats, at = word_features(distinct, NGRAMS, buckets)
    word_sum, word_n = sums(table[feats], at), np.diff(at)
    total, n = sums(word_sum[code], starts), sums(word_n[code], starts)
    if len(distinct):
        pairs, owner = pair_features(hash_strings(distinct, seed=1)[code], starts, buckets)
        total += np.bincount(owner, weights=table[pairs], minlength=len(total))
        n += np.bincount(owner, minlength=len(total))
    logit = total / np.maximum(n, 1) + model["bias"]
    # Sums depend on a text's place in its batch in the last bits; equal texts have equal scores.
    return np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 9)


def score(docs: DataFrame, model: dict, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a ``score`` from 0 to 1; replaces a column of that name. Row by row, no shuffle."""
    plain = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            yield batch.append_column(into, pa.array(score_texts(batch.column(text), shared.value), pa.float64()))

    return plain.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + f", `{into}` double")


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", rows: int = SAMPLE, key: str = "doc_id", text: str = "text") -> dict:
    """Fit on at most ``rows`` labelled documents. Labels, languages, sources and ids are no inputs.

    Empty tables give a model without opinion (0.5). Null texts count as empty.
    """
    return fit(labelled_sample(docs, labels, label, learn, rows, key, text))


def accepted(docs: DataFrame, model: dict, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that score at least ``least``, with their own columns."""
    return score(docs, model, text, "__quality").where(F.col("__quality") >= least).drop("__quality")
