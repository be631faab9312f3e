"""Vector codes: each part of a vector becomes the number of its nearest codebook entry; integer k-means fits the codebooks.

Components are made integers first, so every sum is exact and independent of how the rows are dealt. One pass cuts the vectors into
parts and stores, for each batch and part position, the distinct parts in lexicographic order with their counts. A round reads these
blocks: a depth-first walk over the trie of a block's parts carries the distances to all entries up to the current component, so
parts of one beginning share that sum; a leaf takes the nearest entry and adds its part to it, times its count. What a round hands
on is one row a block and entry, summed by entry; the codebooks (entries x components of numbers) are all that reaches the driver
or is broadcast. The last pass codes the vectors in place by the same walk; no vector is shuffled.

The walk goes down in frames of at most FRAME sibling nodes and takes the deepest frame first, so that it holds at most one
frame a component.

Defined cases: rows whose vector is null, or holds a null or non-finite component, are dropped. So is a vector of another length
than that of the smallest id, or whose length isn't a multiple of the parts. Integers beyond LARGEST either way count as LARGEST.
Rows that repeat an id are coded each, and the smallest ids are taken in the order of (id, components), a row without id after all
others. With fewer rows than entries, there are as many entries as rows. A label_error beyond 64 bits is null. An empty table has
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
FRAME = 4096
BLOCK_ROWS = 8192
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is neither null nor holds a null or non-finite component."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)))


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of each component of vectors of one length, a row each."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return np.clip(flat, -LARGEST, LARGEST).astype(np.int64).reshape(len(column), -1)


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, their counts, and the place of each given row among them."""
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)] if len(rows) else np.zeros(0, bool)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return rows[first], np.diff(np.r_[first, len(rows)]), place


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower) and squared distance of each of distinct parts in lexicographic order.

    A frame is (depth, first rows of its nodes, distances of its nodes to all entries up to depth). Opening a frame finds where
    the next component changes within its rows: these are the children, each with its parent's distances and one more square.
    """
    n, width = parts.shape
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.array([n])
    frames = [(0, np.zeros(min(n, 1), np.int64), ends, np.zeros((min(n, 1), len(entries)), np.int64))]
    while frames:
        depth, first, last, far = frames.pop()
        if not len(first):
            continue
        if depth == width:
            best = far.argmin(axis=1)
            code[first], error[first] = best, far[np.arange(len(best)), best]
            continue
        low, high = int(first[0]), int(last[-1])
        values = parts[low:high, depth]
        changed = np.r_[True, values[1:] != values[:-1]]
        changed[first - low] = True
        child = np.flatnonzero(changed)
        parent = np.searchsorted(first - low, child, side="right") - 1
        child_last = np.r_[child[1:], high - low] + low
        child = child + low
        for at in range((len(child) - 1) // FRAME * FRAME, -1, -FRAME):
            to = at + FRAME
            step = values[child[at:to] - low, None] - entries[None, :, depth]
            frames.append((depth + 1, child[at:to], child_last[at:to], far[parent[at:to]] + step * step))
    return code, error


def part_blocks(vectors: DataFrame, length: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(part, items, times): per batch and part position, the distinct parts in lexicographic order and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            whole = integers(block.column(0), scale).reshape(block.num_rows, parts, -1)
            items, times = [], []
            for p in range(parts):
                rows, counts, _ = distinct_parts(whole[:, p])
                items.append(rows.astype("<i4").tobytes())
                times.append(counts.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(items, pa.binary()), pa.array(times, pa.binary())],
                                             ["part", "items", "times"])

    return vectors.select("v").mapInArrow(run, "part int, items binary, times binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def next_codebooks(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the rounded-down mean of the parts nearest to it; an entry without parts stays."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for part, items, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = np.frombuffer(items, "<i4").reshape(-1, width).astype(np.int64)
                n = np.frombuffer(times, "<i4").astype(np.int64)
                code, _ = nearest_entries(rows, books[part])
                np.add.at(sums[part], code, rows * n[:, None])
                np.add.at(counts[part], code, n)
        part, entry = np.nonzero(counts)
        values = pa.FixedSizeListArray.from_arrays(pa.array(sums[part, entry].reshape(-1)), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), values],
                                         ["part", "entry", "n", "sums"])

    found = blocks.mapInArrow(run, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))).collect()
    out = books.copy()
    for r in found:
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (part, entry, component) of the rows of whole_vectors, all of one length; empty for an empty table."""
    seeds = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow().column(0).combine_chunks()
    if not len(seeds):
        return np.zeros((parts, 0, 0), np.int64)
    start = integers(seeds, scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    blocks = stored(part_blocks(vectors, start.shape[1], parts, scale), "blocks")
    for _ in range(rounds):
        books = next_codebooks(blocks, books)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal numbers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each vector."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            whole = integers(block.column(2), scale).reshape(block.num_rows, parts, -1)
            codes, total = np.zeros((block.num_rows, parts), np.uint8), np.zeros(block.num_rows, np.int64)
            for p in range(parts):
                rows, _, place = distinct_parts(whole[:, p])
                code, error = nearest_entries(rows, books[p])
                codes[:, p] = code[place]
                total += error[place]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(total)],
                                             ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def vector_codes(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256 of each kept row."""
    kept = whole_vectors(table, id_col, vector_col, label_col)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("n")).first()
    length = first["n"] if first else 0
    vectors = kept.filter((F.size("v") == length) & (F.lit(length) % parts == 0))
    books = fit_codebooks(vectors, parts, entries, rounds, scale)
    coded = stored(encode(vectors, books, scale), "codes")
    by_label = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
