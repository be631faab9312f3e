"""Importance resampling towards a target distribution by hashed word runs.

A table of 256 bytes lower-cases A-Z and blanks every separator; what bytes.split gives are the words. A run of words is hashed
by crc32 chained from word to word, and its bucket is that modulo BUCKETS. Counters take the runs of each batch together, so that
a repeated word is hashed once. A bucket's gain is the log ratio of its smoothed shares in the target and in the source; a
document's weight is the sum of its runs' gains. Gumbel noise from a digest of the id makes the highest scores a sample without
replacement.

Dealing: the source is read twice, once to count (each task hands on one row a bucket, summed by bucket; BUCKETS numbers reach the
driver) and once to score; no text is shuffled. Ranks come from one range sort of (score, id) and the sizes of its parts, so no
task sees more than its part. Long texts are translated and split in pieces of PIECE bytes.

Defined cases: a null text has no words, weight 0 and no rank; a text of fewer than LEAST_WORDS words has no rank; a row without id
draws the noise of an empty id and comes last among equal scores; rows that repeat an id have the same noise and are ranked each,
in any order among themselves; empty tables leave all gains at those of the empty counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, keyed
from factloom.session import stored

BUCKETS = 10_000
RUN = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
PIECE = 1 << 20
HELD_RUNS = 200_000

#: A-Z lowered; what is neither a digit nor a letter nor part of a longer character becomes a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; a piece ends where a separator is, so none is cut."""
    at, size = 0, len(text)
    while at < size:
        to = at + PIECE
        piece = text[at:to].translate(TABLE)
        while to < size and piece[-1:] != b" ":
            more = text[to:to + PIECE].translate(TABLE)
            cut = more.find(b" ") + 1 or len(more)
            piece, to = piece + more[:cut], to + cut
        yield piece.split()
        at = to


def count_words(text: bytes) -> int:
    return sum(map(len, word_pieces(text)))


def run_hashes(text: bytes, longest: int = RUN) -> Iterator[Counter]:
    """crc32 of each run of 1 to longest words joined by a blank, with how often it occurs, piece by piece.

    The hash of a run goes on from that of the run one word shorter, so no run is put together.
    """
    open_runs: list[int] = []
    for found in word_pieces(text):
        if longest == 1:
            yield _word_hashes(found)
            continue
        counts: Counter = Counter()
        for w in found:
            joined = b" " + w
            open_runs = [zlib.crc32(w), *(zlib.crc32(joined, c) for c in open_runs)][:longest]
            counts.update(open_runs)
            open_runs = open_runs[:longest - 1]
        yield counts


def _word_hashes(found: list[bytes]) -> Counter:
    counts: Counter = Counter()
    for w, n in Counter(found).items():
        counts[zlib.crc32(w)] += n
    return counts


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = RUN) -> np.ndarray:
    """How many runs of all texts (column text) fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches):
            held: Counter = Counter()
            for text in batch.column(0).cast(pa.binary()):
                for counts in run_hashes(text.as_py(), longest):
                    held.update(counts)
                    if len(held) > HELD_RUNS:
                        _add(total, held)
                        held.clear()
            _add(total, held)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def _add(total: np.ndarray, counts: Counter) -> None:
    if counts:
        hashes = np.fromiter(counts.keys(), np.int64, len(counts)) % len(total)
        total += np.bincount(hashes, np.fromiter(counts.values(), np.int64, len(counts)), len(total)).astype(np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target and in the source, rounded down."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of (doc_id, text)."""
    given = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = given.value
        for batch in chunks(batches):
            n_words, n_runs, weights = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                text, features, weight = text.as_py(), 0, 0
                for counts in run_hashes(text, longest):
                    if counts:
                        n = np.fromiter(counts.values(), np.int64, len(counts))
                        features += int(n.sum())
                        weight += int(gain[np.fromiter(counts.keys(), np.int64, len(counts)) % len(gain)] @ n)
                n_words.append(features if longest == 1 else count_words(text))
                n_runs.append(features)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_runs, weights))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_noise(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """weighed with score: weight and the Gumbel noise of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(scored: DataFrame, order: list, wanted: int) -> DataFrame:
    """The first `wanted` rows of scored in the given order, with rank from 1.

    The rows are sorted by ranges and numbered within each part as they are stored; the sizes of the parts, one number each, tell
    what stands before a part.
    """
    spark = scored.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))],
                                             [*batch.schema.names, "_part", "_place"])
            at += n

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema)
    placed = stored(scored.orderBy(*order).mapInArrow(number, f"{columns}, _part long, _place long"), "ranked")
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    start = spark.createDataFrame(starts, "_part long, _before long")
    return placed.join(F.broadcast(start), "_part").withColumn("rank", F.col("_before") + F.col("_place") + 1).filter(
        F.col("rank") <= wanted).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where a document isn't drawn) of each row of docs."""
    rows = keyed(docs, id_col, text_col)
    source = bucket_counts(rows.select("text"), buckets, longest)
    wanted_counts = bucket_counts(target.select(F.coalesce(target[target_col], F.lit("")).alias("text")), buckets, longest)
    scored = stored(with_noise(weigh(rows, gains(source, wanted_counts), longest), seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = scored.filter(F.col("n_words") >= least_words).select("row", "score", "doc_id")
    drawn = ranked(fit, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], fit.count() * percent // 100).select("row", "rank")
    return scored.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
