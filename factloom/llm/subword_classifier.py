"""Quality classifier by supervised subword embeddings.

A text is the average of learned vectors: one for each word, each run of three and four bytes inside a word, and each word that
repeats the one before, all hashed into BUCKETS rows. A softmax over the average gives the label. The vectors and the output
layer are trained by stochastic gradient descent (steps scaled per row) in numpy on a bounded, balanced sample of labelled
texts: PER_LABEL documents a label and SAMPLE_BYTES bytes. The share of labels among all labelled rows corrects the balance.

Averaging and the output layer are linear, so scoring needs one number a bucket: 256 kB are broadcast, and every text is read
whole in one pass without a shuffle. Only the text is an input; letters keep their case.

Defined cases: a null, empty or blank text has no vectors and gets the score of the bias; without labels of both kinds the score
is the share of label 1 (0.5 without any); rows that repeat are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BLOCK_BYTES, _BYTE_VALUE, _PLACES, chunks, crc_mod, keyed, mix, text_buffer, word_hashes, words
from factloom.llm.samples import label_counts, labelled_texts

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4)
PER_LABEL = 1500
EPOCHS = 6
BATCH = 32
RATE = 0.3
HELD_OUT = (4, 2)
CUTOFF = 0.7
_REPEATED = 0


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text number of every feature of the texts, in blocks cut between words."""
    body, offsets = text_buffer(column)
    start, end, text = words(body, offsets)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK_BYTES, side="right")))
        s, e, t = start[at:to], end[at:to], text[at:to]
        hashed = word_hashes(body, s, e, lower=False)
        again = np.flatnonzero((hashed[1:] == hashed[:-1]) & (t[1:] == t[:-1])) + 1
        found, of = [hashed, np.full(len(again), _REPEATED, np.uint64)], [t, t[again]]
        value = _BYTE_VALUE[body[s[0]:e[-1]]]
        length, begin = e - s, s - s[0]
        for n in GRAMS:
            runs = np.maximum(length - n + 1, 0)
            first = np.repeat(begin - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(runs.sum())
            h = np.zeros(len(first), np.uint64)
            for k in range(n):
                h += value[first + k] * _PLACES[8 * n + k]
            found.append(mix(h))
            of.append(np.repeat(t, runs))
        yield (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(of)
        at = to


def _bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their share in its average."""
    n, parts = len(column), list(features(column))
    keys = np.concatenate([of * BUCKETS + b for b, of in parts]) if parts else np.zeros(0, np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(n + 1) * BUCKETS)
    return [(keys[a:b] % BUCKETS, (counts[a:b] / max(1, counts[a:b].sum())).astype(np.float32)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def train(column: pa.Array, labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Logit of label 1 that each bucket adds per unit of its share, and the bias."""
    rng = np.random.default_rng(seed)
    bags = _bags(column)
    vectors = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    scale = np.full(BUCKETS, 1e-8, np.float32)
    out, bias = rng.uniform(-0.5, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    y = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            ids = np.concatenate([bags[i][0] for i in chosen])
            share = np.concatenate([bags[i][1] for i in chosen])
            of = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])
            mean = np.stack([np.bincount(of, vectors[ids, d] * share, len(chosen)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = p / p.sum(1, keepdims=True) - y[chosen]
            down = error @ out.T
            out -= rate * mean.T @ error / len(chosen) * 4
            bias -= rate * error.mean(0)
            step = down[of] * share[:, None]
            rows, back = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(back, step[:, d], len(rows)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            scale[rows] += (grad ** 2).mean(1)
            vectors[rows] -= rate * grad / np.sqrt(scale[rows])[:, None]
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each text."""
    n = len(column)
    total, size = np.zeros(n), np.zeros(n)
    for buckets, of in features(column):
        total += np.bincount(of, weights[buckets], n)
        size += np.bincount(of, minlength=n)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(size, 1) + bias, -60, 60)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", column: str = "quality",
                   per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    zeros, ones = label_counts(labels, column, *HELD_OUT)
    texts, known = labelled_texts(docs, labels, column, *HELD_OUT, per_label)
    prior = float(np.log((ones + 0.5) / (zeros + 0.5)))
    if 0 < sum(known) < len(known):
        weights, bias = train(texts, known)
        bias += prior - float(np.log(sum(known) / (len(known) - sum(known))))
    else:
        weights, bias = np.zeros(BUCKETS, np.float32), prior
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            score = score_texts(batch.column(1), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= CUTOFF).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", "predicted")
