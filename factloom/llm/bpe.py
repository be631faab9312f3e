"""Byte-level BPE encoding and decoding.

A pre-token that is a vocabulary entry is resolved by one probe of a minimal perfect hash over the vocabulary. Any other is
merged over a doubly linked list of its bytes with a heap of (rank, place) entries: O(n log n) for a pre-token of n bytes.
The vocabulary is the only broadcast value: its size is fixed by the file. Pre-tokens seen before come from a memo of bounded
size, so that the two tiers are asked once for most of the text.

Defined cases: a null or empty text has no ids; a repeated row gives a repeated result; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from factloom.llm.common import chunks, keyed

MEMO_ENTRIES = 300_000
PIECES_AT_ONCE = 200_000
_LOW = 0xFFFFFFFF
_ALL = 0xFFFFFFFFFFFFFFFF
_SEED = 0x9E3779B97F4A7C15
_SPREAD = 0xD6E8FEB86659FD93


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash: n keys on n slots. Keys fall into small buckets; each bucket stores the seed that sends its
    keys to free slots, and a bucket of one key stores its slot."""

    def __init__(self, keys: list[bytes], bucket_size: int = 4):
        self.n, self.buckets = len(keys), max(1, len(keys) // bucket_size)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.key_at: list[int] = [-1] * self.n
        free = np.ones(self.n, bool)
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            own = groups[b]
            if len(own) < 2:
                break
            held = np.array([hashes[i] for i in own], np.uint64)[:, None]
            d = 0
            while True:
                seeds = np.arange(d, d + 256, dtype=np.uint64) * np.uint64(_SEED)
                slots = (((held ^ seeds) * np.uint64(_SPREAD) >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)
                good = free[slots].all(axis=0)
                for c in np.flatnonzero(good):
                    if len(set(slots[:, c].tolist())) == len(own):
                        break
                else:
                    d += 256
                    if d > 1 << 22:
                        raise ValueError("two keys of the vocabulary share a hash")
                    continue
                self.shift[b] = d + int(c)
                free[slots[:, c]] = False
                for i, slot in zip(own, slots[:, c].tolist(), strict=True):
                    self.key_at[slot] = i
                break
        rest = iter(np.flatnonzero(free).tolist())
        for b, own in enumerate(groups):
            if len(own) == 1:
                slot = next(rest)
                self.shift[b], self.key_at[slot] = -slot - 1, own[0]

    def slot(self, key: bytes) -> int:
        """The slot of a key of the set; for any other bytes, some slot."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else (((h ^ d * _SEED & _ALL) * _SPREAD & _ALL) >> 32) % self.n


class Vocabulary:
    """What encoding and decoding need of a rank file; built once on the driver and sent to the executors."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.tokens = [keys[i] for i in self.hash.key_at]
        self.ids = [ranks[t] for t in self.tokens]
        self.by_id = {i: t for t, i in ranks.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in ranks.values()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: i for t, i in ranks.items() if len(t) > 1
                      for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}

    def whole(self, piece: bytes) -> int | None:
        """First tier: the id of a piece that is an entry of the vocabulary."""
        slot = self.hash.slot(piece)
        return self.ids[slot] if self.tokens[slot] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: lowest rank first, leftmost first among equals, over linked bytes.

        rank_at holds the present rank of the pair that begins at a place, which tells a stale heap entry.
        """
        find, push, pop, byte_ids = self.pairs.get, heapq.heappush, heapq.heappop, self.byte_ids
        ids = [byte_ids[b] for b in piece]
        n = len(ids)
        rank_at = [find(a << 32 | b) for a, b in zip(ids, ids[1:], strict=False)]
        heap = [rank << 32 | i for i, rank in enumerate(rank_at) if rank is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at.append(None)
        while heap:
            entry = pop(heap)
            i = entry & _LOW
            rank = entry >> 32
            if rank_at[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            rank_at[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank_at[i] = found = find(rank << 32 | ids[k])
                if found is not None:
                    push(heap, found << 32 | i)
            else:
                rank_at[i] = None
            h = before[i]
            if h >= 0:
                rank_at[h] = found = find(ids[h] << 32 | rank)
                if found is not None:
                    push(heap, found << 32 | h)
        return [i for i in ids if i >= 0]


class Encoder(dict):
    """Memo from pre-token to its ids as little-endian 32-bit numbers; asks the two tiers for what it doesn't hold.

    A full memo becomes the old one; what is used again moves over from it, the rest goes with the next change.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.cut, self.old = vocabulary, regex.compile(pattern), {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            data = piece.encode("utf-8")
            whole, parts = self.vocabulary.whole(data), self.vocabulary.packed
            packed = b"".join([parts[i] for i in self.vocabulary.merged(data)]) if whole is None else parts[whole]
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[piece] = packed
        return packed

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, in parts of bounded size."""
        if len(text) <= PIECES_AT_ONCE:
            yield b"".join(map(self.__getitem__, self.cut.findall(text)))
            return
        pieces = (m.group() for m in self.cut.finditer(text))
        while part := list(islice(pieces, PIECES_AT_ONCE)):
            yield b"".join(map(self.__getitem__, part))


def encode_text(text: str, ranks: dict[bytes, int], pattern: str) -> list[int]:
    """Ids of one text."""
    return np.frombuffer(b"".join(Encoder(Vocabulary(ranks), pattern).encode(text)), "<u4").tolist()


def decode_packed(packed: bytes, vocabulary: Vocabulary) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(vocabulary.by_id.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digest of the ids, digest of the bytes they decode to; with_ids adds the ids themselves.

    One pass over the scan, no shuffle; a task holds one batch of rows, the vocabulary and the memo.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path)))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary, pattern)
        for batch in chunks(batches):
            counts, id_digests, text_digests, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                n, ids, decoded, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for packed in encoder.encode(text):
                    n += len(packed) // 4
                    ids.update(packed)
                    decoded.update(decode_packed(packed, vocabulary))
                    if with_ids:
                        kept.append(np.frombuffer(packed, "<u4").astype(np.int32))
                counts.append(n)
                id_digests.append(ids.hexdigest())
                text_digests.append(decoded.hexdigest())
                lists.append(np.concatenate(kept) if kept else [])
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return keyed(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of a table of id lists; a null list decodes to nothing, an unknown id fails."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = shared.value
        for batch in batches:
            data = [b"".join(map(by_id.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    rows = encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, data binary")
