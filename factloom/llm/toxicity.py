"""Toxicity by compression distance.

Two zstandard dictionaries of the same length are built from labelled text: each holds the segments that the texts of its label
have often and those of the other label lack, most frequent first, before a part trained on ordinary windows that both share.
Texts are cut into windows of a few words; each is compressed with either dictionary, and the bytes that the toxic one saves
are its distance. The shares of a text's windows above a row of distances go through a logistic calibration whose
threshold is set on labelled rows that the dictionaries were not built from, so that score CUTOFF is the cut of best balance (F1).

Both fits use bounded samples of labelled rows (DICTIONARY_ROWS and CALIBRATION_ROWS documents a label, and SAMPLE_BYTES
bytes). Scoring reads every text whole, in one pass without a shuffle; only the dictionaries and weights are broadcast.

Defined cases: a null, empty or blank text has no windows and gets the score of none; without labels of both kinds the
score is the share of label 1 among the labels (0 without any); rows that repeat are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import _LOWER, _SEPARATOR, chunks, crc_mod, keyed, text_buffer, words
from factloom.llm.samples import label_counts, labelled_texts

WINDOW_WORDS = 6
SEGMENT = 5
SHARED_BYTES = 8192
OWN_BYTES = 1024
DICTIONARY_ROWS = 700
CALIBRATION_ROWS = 1400
DISTANCES = np.arange(1, 10)
HELD_OUT = (3, 1)
CUTOFF = 0.7
_PLAIN = np.where(_SEPARATOR, 32, _LOWER).astype(np.uint8)


def windows(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Lowered windows of a few words, and the number of the text of each."""
    body, offsets = text_buffer(column)
    start, end, text = words(body, offsets)
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    begins = np.flatnonzero((np.arange(len(text)) - first[text]) % WINDOW_WORDS == 0) if len(text) else np.zeros(0, np.int64)
    last = np.r_[begins[1:], len(text)] - 1 if len(begins) else begins
    plain = _PLAIN[body].tobytes()
    return [plain[s:e] for s, e in zip(start[begins].tolist(), end[last].tolist(), strict=True)], text[begins]


def _spaced(text: bytes) -> list[bytes]:
    return [b" " + w + b" " for w in bytes(_PLAIN[np.frombuffer(text, np.uint8)]).split()]


def _cut(word: bytes) -> list[bytes]:
    return [word[i:i + SEGMENT] for i in range(len(word) - SEGMENT + 1)]


def _own_segments(own: list[bytes], other: list[bytes], ratio: float) -> list[bytes]:
    """Parts of words that the own texts have far more often than the other ones, most frequent first."""
    texts = [[_spaced(t) for t in side] for side in (own, other)]
    count, against = (Counter(g for t in side for g in {g for w in t for g in _cut(w)}) for side in texts)
    least = max(3, 0.02 * len(own))
    chosen = {g for g, c in count.items() if c >= least and c / len(own) >= ratio * (against[g] + 0.5) / max(1, len(other))}
    segments: Counter = Counter()
    for text in texts[0]:
        for word in text:
            hits = [i for i in range(len(word) - SEGMENT + 1) if word[i:i + SEGMENT] in chosen]
            if hits:
                segments[word[hits[0]:hits[-1] + SEGMENT]] += 1
    return [s for s, _ in sorted(segments.items(), key=lambda x: (-x[1], x[0]))]


def build_dictionaries(texts: list[bytes], labels: list[int]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    toxic, plain = ([t for t, y in zip(texts, labels, strict=True) if y == v] for v in (1, 0))
    held = b"".join(_own_segments(toxic, plain, 12))[:OWN_BYTES]
    against = b"".join(_own_segments(plain, toxic, 1.5))[:len(held)].ljust(len(held))
    samples = [w for w in windows(pa.array([t.decode() for t in plain], pa.string()))[0] if len(w) > 8]
    try:
        shared = zstandard.train_dictionary(SHARED_BYTES, samples, k=48, d=6).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on
        shared = b" ".join(samples)[-SHARED_BYTES:]
    return against + shared, held + shared


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(window_log=15, hash_log=14, chain_log=14, search_log=3, min_match=4, target_length=16,
                                              strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


class Distances:
    """Compares windows under both dictionaries; one object a task."""

    def __init__(self, contents: tuple[bytes, bytes]):
        self.plain, self.toxic = (_compressor(c).compress for c in contents)

    def features(self, column: pa.Array) -> np.ndarray:
        """Of each text: log of the number of windows beyond each distance, the shares, and the largest distance."""
        n = len(column)
        cut, of = windows(column)
        plain, toxic = self.plain, self.toxic
        far = np.fromiter((len(plain(w)) - len(toxic(w)) for w in cut), np.int64, len(cut))
        size = np.bincount(of, minlength=n)
        beyond = np.stack([np.bincount(of[far >= d], minlength=n) for d in DISTANCES], 1)
        most = np.zeros(n)
        np.maximum.at(most, of, far)
        return np.column_stack([np.log1p(beyond), 10 * np.sqrt(beyond / np.maximum(size, 1)[:, None]), np.minimum(most, 12), np.log1p(size)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> np.ndarray:
    """Weights and bias by Newton's method, with a ridge on standardised inputs."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()]


def _cut_of_best_balance(logits: np.ndarray, y: np.ndarray, share: float) -> float:
    """The logit whose cut has the best F1 if label 1 has this share of the rows."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    order = np.argsort(-logits)
    hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hit / (all_ + share)))
    ahead = logits[order][min(best + 1, len(order) - 1)]
    return float((logits[order][best] + ahead) / 2)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", column: str = "toxic",
                    dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    zeros, ones = label_counts(labels, column, *HELD_OUT)
    drawn, known = labelled_texts(docs, labels, column, *HELD_OUT, dictionary_rows + calibration_rows)
    y = np.array(known, np.int64)
    contents, weights = (b"", b""), np.zeros(2 * len(DISTANCES) + 2)
    bias = float(np.log(max(ones, 1e-9) / max(zeros, 1e-9))) if ones + zeros else -60.0
    if 0 < y.sum() < len(y):
        # the dictionaries' share of the sample; the rest calibrates
        turn = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) * (dictionary_rows + calibration_rows)
        build = turn <= np.where(y == 1, (y == 1).sum(), (y == 0).sum()) * dictionary_rows
        texts = [t.encode() for t in drawn.to_pylist()]
        contents = build_dictionaries([t for t, b in zip(texts, build, strict=True) if b], y[build].tolist())
        rest = ~build if 0 < y[~build].sum() < (~build).sum() else np.ones(len(y), bool)
        x = np.concatenate([Distances(contents).features(part) for part in _parts(drawn.filter(pa.array(rest)))])
        fitted = _logistic(x, y[rest])
        weights, bias = fitted[:-1], fitted[-1]
        cut = _cut_of_best_balance(x @ weights + bias, y[rest], ones / (ones + zeros))
        bias += float(np.log(CUTOFF / (1 - CUTOFF))) - cut
    shared = docs.sparkSession.sparkContext.broadcast((contents, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, weights, bias = shared.value
        distances = Distances(contents)
        for batch in chunks(batches):
            score = 1 / (1 + np.exp(-np.clip(distances.features(batch.column(1)) @ weights + bias, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= CUTOFF).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", "predicted")


def _parts(column: pa.Array, rows: int = 200) -> Iterator[pa.Array]:
    bounds = [*range(0, len(column), rows), len(column)]
    return (column.slice(a, b - a) for a, b in pairwise(bounds))
