"""Document fingerprints by a threshold-scaled sketch: every shingle hash below a fixed fraction of the hash range is retained.

The share of retained hashes is the same for all documents, so the retained hashes of a union are the union of the retained
hashes, and containment can be estimated between documents of very unequal size. A fingerprint is text:
``size:digest:hashes`` with the size and digest of the whole shingle set and the retained 64-bit hashes, ascending, as base64.

Likeness of two fingerprints is the containment of the smaller retained set in the other; where one of them retains nothing,
it is 1 for equal shingle sets and else 0.

Neighbours by id need no global sort in one task: rows are dealt to id ranges (bounds from quantiles of the ids), sorted
within each, and the first row of a range is sent to the range before it as well.

Defined cases: a null or empty text has an empty shingle set ("0:digest:"); rows without id come last in the order; rows that
repeat an id are ordered by length and content; of a table with one row, the next document is that row itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SHINGLE, chunks, keyed, shingle_sets

ONE_IN = 8
RANGES_A_TASK = 4


def _retained(column: pa.Array, one_in: int, shingle: int) -> tuple[list[np.ndarray], list[str], list[int]]:
    """Retained hashes, digest and size of the shingle set of each text."""
    hashes, bounds = shingle_sets(column, shingle)
    most = np.uint64((1 << 64) // one_in)
    kept, digests = [], []
    for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = hashes[at:to]
        kept.append(own[:np.searchsorted(own, most)])
        digests.append(hashlib.blake2b(own.tobytes(), digest_size=8).hexdigest())
    return kept, digests, np.diff(bounds).tolist()


def _text(kept: np.ndarray, digest: str, size: int) -> str:
    return f"{size}:{digest}:{base64.b64encode(kept.astype('<u8').tobytes()).decode()}"


def _likeness(x: np.ndarray, x_digest: str, y: np.ndarray, y_digest: str) -> float:
    if not len(x) or not len(y):
        return float(x_digest == y_digest)
    return len(np.intersect1d(x, y, assume_unique=True)) / min(len(x), len(y))


def read_fingerprint(text: str) -> tuple[np.ndarray, str, int]:
    size, digest, hashes = text.split(":")
    return np.frombuffer(base64.b64decode(hashes), "<u8"), digest, int(size)


def likeness(x: str, y: str) -> float:
    """Estimated containment of the smaller document in the larger, from two fingerprints."""
    (a, a_digest, _), (b, b_digest, _) = read_fingerprint(x), read_fingerprint(y)
    return _likeness(a, a_digest, b, b_digest)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint of each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            own = zip(*_retained(batch.column(1), one_in, shingle), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_text(*x) for x in own], pa.string())], ["doc_id", "fingerprint"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def union_fingerprints(prints: DataFrame, by: str, column: str = "fingerprint") -> DataFrame:
    """by, size of the retained hashes of all fingerprints of a group together; the merge is a distinct union of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [read_fingerprint(t)[0].view(np.int64) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["key", "hashes"])

    rows = prints.select(prints[by].cast("string").alias("key"), prints[column].alias("fingerprint"))
    return rows.mapInArrow(run, "key string, hashes array<long>").select("key", F.explode("hashes").alias("hash")).distinct() \
        .groupBy("key").agg(F.count("*").alias("retained"))


def _ranges(ids: DataFrame, n: int) -> tuple[list[int], dict[int, int]]:
    """Bounds of at most n id ranges, and the largest id in each that has rows; both of bounded size. Range 0: no id."""
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] if n > 1 else []
    bounds = sorted(set(cuts or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_range_of(batch.column(0), bounds))], ["doc_id", "range"])

    heads = ids.mapInArrow(run, "doc_id long, range long").groupBy("range").agg(F.max("doc_id").alias("head")).collect()
    return bounds, {r["range"]: r["head"] for r in heads}


def _range_of(ids: pa.Array, bounds: list[int]) -> np.ndarray:
    place = 1 + np.searchsorted(np.array(bounds, np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, place)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = ONE_IN, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to it and to the next document, descending by id.

    The edited text has its last half (rounded down) replaced by as many characters of the next document's beginning. The
    texts are shuffled once.
    """
    rows = keyed(docs, id_col, text_col)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, heads = _ranges(rows.select("doc_id"), RANGES_A_TASK * n)
    present = sorted(heads)
    before = {heads[r]: present[(i + 1) % len(present)] for i, r in enumerate(present)}  # where a range's first row is the next one

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _range_of(batch.column(0), bounds)
            guests = [i for i, d in enumerate(batch.column(0).to_pylist()) if d in before]
            for part, where, guest in ((batch, own, False), (batch.take(pa.array(guests, pa.int64())), [before[batch.column(0)[i].as_py()] for i in guests], True)):
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(where, pa.int64()), pa.array([guest] * part.num_rows)],
                                                     ["doc_id", "text", "range", "guest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in chunks(batches):
            held = held[-1:] + list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            if len(held) > 1:
                yield _compared(held, one_in, shingle)
        if held and not held[-1][3]:
            yield _compared([held[-1], held[-1]], one_in, shingle)

    dealt = rows.mapInArrow(route, "doc_id long, text string, range long, guest boolean").repartition(n, "range")
    ordered = dealt.sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), F.length("text"), F.xxhash64("text"))
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                   "near_edited double, near_next double")


def _compared(rows: list[tuple], one_in: int, shingle: int) -> pa.RecordBatch:
    """Result rows of all but the last; a row's next is the one after it. Guests and what follows another range's rows give none."""
    real = [i for i in range(len(rows) - 1) if not rows[i][3]]
    texts = [rows[i][1] for i in real]
    following = [rows[i + 1 if rows[i + 1][2] == rows[i][2] else i][1] for i in real]
    edited = [t[:len(t) - len(t) // 2] + f[:len(t) // 2] for t, f in zip(texts, following, strict=True)]
    one, two, three = (list(zip(*_retained(pa.array(x, pa.string()), one_in, shingle), strict=True)) for x in (texts, edited, following))
    return pa.RecordBatch.from_arrays([
        pa.array([rows[i][0] for i in real], pa.int64()), pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array([_text(*x) for x in one], pa.string()), pa.array([_text(*x) for x in two], pa.string()),
        pa.array([_likeness(*x[:2], *y[:2]) for x, y in zip(one, two, strict=True)], pa.float64()),
        pa.array([_likeness(*x[:2], *y[:2]) for x, y in zip(one, three, strict=True)], pa.float64()),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
