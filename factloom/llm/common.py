"""What the operators share: the shape of their input, batches of text as numpy arrays, and word and shingle hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D. In UTF-8 these bytes only ever stand for themselves, so cutting
bytes is cutting code points. Hashes are 64 bit: a word is a polynomial over a fixed random value per byte, a shingle mixes
the hashes of its words by their place. All of it is deterministic across machines and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
CHUNK_BYTES = 2_000_000
BLOCK_BYTES = 500_000


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table with any further columns; a null text counts as an empty one."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the number as text, modulo n; a null number counts as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins; one more offset ends the last."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text; a longer single text is a batch of its own."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEPARATOR = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_BYTE_LOWERED = _BYTE_VALUE[_LOWER]
_BASE = 0xD1342543DE82EF95
_PLACES = mix((np.arange(64, dtype=np.uint64) + np.uint64(1000)) * _STEP) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and text number of each word."""
    plain = ~_SEPARATOR[body]
    begins, ends = plain.copy(), plain.copy()
    begins[1:] &= ~plain[:-1]
    ends[:-1] &= ~plain[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    first, last = first[first < len(body)], last[last >= 0]
    begins[first], ends[last] = plain[first], plain[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each word, its letters A-Z in lower case; works on blocks of bounded size cut between words."""
    out = np.empty(len(start), np.uint64)
    value = _BYTE_LOWERED if lower else _BYTE_VALUE
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK_BYTES, side="right")))
        base, n = start[at], int(end[to - 1] - start[at])
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value[body[base:base + n]] * up[:n], out=sums[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
        at = to
    return out


def shingle_hashes(hashes: np.ndarray, text: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each window of n words; a shorter text is one window of all its words."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = max(0, len(hashes) - n + 1)
    rolled = np.zeros(full, np.uint64)
    for k in range(n):
        rolled += hashes[k:k + full] * _PLACES[k]
    whole = text[:full] == text[n - 1:] if full else np.zeros(0, bool)
    bounds = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[bounds, len(text)])
    short = np.flatnonzero(size < n)
    tail = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        there = size[short] > k
        tail[there] += hashes[bounds[short][there] + k] * _PLACES[k]
    tail += size[short].astype(np.uint64) * _STEP
    numbers = np.r_[text[:full][whole], text[bounds[short]]]
    order = np.argsort(numbers, kind="stable")
    return mix(np.r_[rolled[whole], tail])[order], numbers[order]


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in ascending order; the second array tells where each text's begin."""
    body, offsets = text_buffer(column)
    start, end, text = words(body, offsets)
    hashes, numbers = shingle_hashes(word_hashes(body, start, end), text, n)
    order = np.lexsort((hashes, numbers))
    hashes, numbers = hashes[order], numbers[order]
    keep = np.r_[True, (hashes[1:] != hashes[:-1]) | (numbers[1:] != numbers[:-1])] if len(hashes) else np.zeros(0, bool)
    hashes, numbers = hashes[keep], numbers[keep]
    return hashes, np.searchsorted(numbers, np.arange(len(offsets)))
