"""Token counts without encoding: rank-synchronous merging over ragged arrays.

The distinct pre-tokens of a batch lie behind each other in one flat array of symbols. Each round looks up the rank of every
adjacent pair, takes the lowest of each pre-token, and merges all its occurrences in all pre-tokens at once; sequences
without a mergeable pair leave. What survives is counted. Applying all occurrences of the lowest pair together equals one at
a time because a merge never makes a pair of lower rank than its own; the reader checks that of the file.

Strings of special tokens found in a text count one each, as the library does by default: they cut the text and what lies
between is cut into pre-tokens. Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows repeat.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factloom.llm.common import chunks, keyed

MEMO_ENTRIES = 300_000
PIECES_AT_ONCE = 200_000
NONE = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the file: printable Latin-1 for itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Ranks and results of the merges as sorted arrays, the symbols of single bytes, and the special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges"))
        if not plain or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are counted here")
        vocabulary = model["vocab"]
        left, right, made, born = [], [], [], {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if max(born.get(a, -1), born.get(b, -1)) > rank:
                raise ValueError("a merge comes before the one that makes its part")
            born.setdefault(a + b, rank)
            left.append(vocabulary[a])
            right.append(vocabulary[b])
            made.append(vocabulary[a + b])
        self.size = max(vocabulary.values()) + 1
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)
        self.byte_symbol = np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.byte_symbol[byte] = vocabulary[letter]
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens with options are not counted here")

    def pair_ranks(self, symbols: np.ndarray) -> np.ndarray:
        keys = symbols[:-1] * self.size + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        number = np.repeat(np.arange(len(pieces)), sizes)
        out = sizes.copy()
        while len(symbols) > 1:
            ranks = self.pair_ranks(symbols)
            ranks[number[1:] != number[:-1]] = NONE
            ranks = np.r_[ranks, NONE]
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            length = np.diff(np.r_[first, len(number)])
            lowest = np.minimum.reduceat(ranks, first)
            live = np.repeat(lowest != NONE, length)
            if not live.any():
                break
            hit = (ranks == np.repeat(lowest, length)) & live
            # in a run of overlapping occurrences every second one applies, from the left
            place = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run_start) % 2 == 0
            symbols = np.where(hit, self.made[np.where(hit, ranks, 0)], symbols)
            stay = live & ~np.r_[False, hit[:-1]]
            np.subtract.at(out, number[np.flatnonzero(hit)], 1)
            symbols, number = symbols[stay], number[stay]
        return out


class Counter:
    """Counts of texts; remembers a bounded number of pre-tokens."""

    def __init__(self, table: MergeTable, pattern: str):
        self.table, self.cut, self.memo = table, regex.compile(pattern), {}
        self.split = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo.clear()
            new = list(pieces)
        if new:
            self.memo.update(zip(new, self.table.counts([p.encode() for p in new]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the pre-tokens of all are merged together, a very long text in parts."""
        totals, held, size = [0] * len(texts), [], 0

        def settle() -> None:
            self.learn({p for _, pieces in held for p in pieces})
            for i, pieces in held:
                totals[i] += sum(map(self.memo.__getitem__, pieces))
            held.clear()

        for i, text in enumerate(texts):
            parts = self.split.split(text) if self.split and any(s in text for s in self.table.special) else [text]
            totals[i] += len(parts) - 1
            for part in parts:
                found = (m.group() for m in self.cut.finditer(part)) if len(part) > PIECES_AT_ONCE else iter(self.cut.findall(part))
                while pieces := list(islice(found, PIECES_AT_ONCE)):
                    held.append((i, pieces))
                    size += len(pieces)
                    if size >= PIECES_AT_ONCE:
                        settle()
                        size = 0
        settle()
        return totals


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. One pass over the scan, no shuffle; the merge table's size is fixed by its file."""
    shared = docs.sparkSession.sparkContext.broadcast(MergeTable(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, pattern)
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            tokens = np.array(counter.count(texts), np.int64)
            size = [len(t.encode()) for t in texts]
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
