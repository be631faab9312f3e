"""LM scoring by a weighted backoff automaton.

Tokens are words, A-Z lowered, and one end a text. The root of the automaton has an arc for every token, weighted by the
add-half unigram estimate. Each context word (and the beginning of a text) with kept bigrams is a state: its arcs carry the
absolutely discounted bigram estimate and its failure arc, taken on any other token, the mass that is left over what the root
gives to those tokens. One left-to-right traversal carries the state; the estimates of a state sum to one.

Every bigram that occurs ARC_LEAST times in the training texts gets an arc, at any size of corpus: all bigrams are counted, with
sums in each task first, and arcs, failure weights and root arcs are tables. Of these the tokens and arcs of HEAVY_SHARE, at most
1 / HEAVY_SHARE each, are broadcast; what a text needs of the others is joined by key, pre-aggregated by text. A bigram's key is
64 bit, of the hashes of its words: two bigrams of one key, expected once in 2^64 pairs of bigrams, would be counted together.
What is joined is dealt to PASSES by key, one after the other, so that only a part of it lies on disk at a time; rows of one id and
text, known by a 64-bit hash of both, count as copies of one. A task holds at most HOLD_KEYS keys and as many fresh tokens.

Defined cases: a null or empty text is one end; a row without id counts as id "" for the split; rows that repeat are counted
and scored each; without training texts every token has the estimate of an unseen one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks, crc_mod, keyed, text_buffer, word_hashes, words
from factloom.session import stored

HEAVY_SHARE = 5e-7
ARC_LEAST = 2
DISCOUNT = 0.5
HELD_OUT = (5, 1)
PASSES = 2  # a power of two
END = np.uint64(0x5DEECE66D1234567)
BEGIN = np.uint64(0x9FB21C651E98DF25)
TURN = 13
#: The bigrams of a state of this share of the tokens are dealt to so many parts.
WIDE_SHARE, WIDE_PARTS = 1e-4, 64
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HOLD_KEYS = 1_000_000
EMIT_ROWS = 200_000


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each token; every text ends with the end token."""
    body, offsets = text_buffer(column)
    start, end, text = words(body, offsets)
    hashes = word_hashes(body, start, end)
    n = len(offsets) - 1
    place = np.searchsorted(text, np.arange(n), side="right")
    return np.insert(hashes, place, END), np.insert(text, place, np.arange(n))


def pair_keys(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each token with the token (or the beginning) before it, and that state."""
    state = np.where(np.r_[True, text[1:] != text[:-1]], BEGIN, np.r_[BEGIN, hashes[:-1]]) if len(hashes) else hashes
    return (hashes ^ ((state << np.uint64(TURN)) | (state >> np.uint64(64 - TURN)))).view(np.int64), state.view(np.int64)


def _token(key: Column, state: Column) -> Column:
    """The token of a bigram's key."""
    return key.bitwiseXOR(F.shiftleft(state, TURN).bitwiseOR(F.shiftrightunsigned(state, 64 - TURN)))


def _summed(keys: np.ndarray, counts: np.ndarray, states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    if not len(keys):
        return keys, counts, states
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first), None if states is None else states[order[first]]


def _counted(parts: Iterator[tuple[np.ndarray, ...]], wide: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(key, n) of all keys of a task, or (key, n, state, part) of bigrams; at most a bounded number of keys is held before they are handed on."""
    keys, counts, states, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), None if wide is None else np.zeros(0, np.int64), []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        return _summed(np.concatenate([keys, *(f[0] for f in fresh)]), np.concatenate([counts, *(np.ones(len(f[0]), np.int64) for f in fresh)]),
                       None if states is None else np.concatenate([states, *(f[1] for f in fresh)]))

    def out() -> Iterator[pa.RecordBatch]:
        order = slice(None) if states is None else np.argsort(states, kind="stable")
        columns = [keys[order], counts[order]]
        if states is not None:
            columns += [states[order], np.where(np.isin(states[order], wide), columns[0] & WIDE_PARTS - 1, 0)]
        for at in range(0, len(keys), EMIT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[at:at + EMIT_ROWS]) for x in columns], ["key", "n", "state", "part"][:len(columns)])

    for part in parts:
        fresh.append(part)
        if sum(len(f[0]) for f in fresh) > HOLD_KEYS:
            keys, counts, states = merged()
            fresh = []
            if len(keys) > HOLD_KEYS:
                yield from out()
                keys, counts, states = keys[:0], counts[:0], None if states is None else states[:0]
    keys, counts, states = merged()
    yield from out()


class Automaton:
    """Heavy tokens with their counts, and the states, arcs and failure weights over them; all sorted arrays of bounded size."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.total, self.distinct = total, distinct
        self.floor = total + 0.5 * (distinct + 1)
        self.unigram = (self.counts + 0.5) / self.floor
        self.log_unigram = np.log10(self.unigram)
        self.begin = len(tokens)
        self.width = len(tokens) + 1
        self.arcs, self.arc_weight = np.zeros(0, np.int64), np.zeros(0)
        self.failure = np.zeros(self.width)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each token among the heavy ones, -1 for the others."""
        if not len(self.tokens):
            return np.full(len(hashes), -1, np.int64)
        keys = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.tokens, keys), len(self.tokens) - 1)
        return np.where(self.tokens[at] == keys, at, -1)

    def contexts(self, number: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The state before each token, as far as it is a heavy token or the beginning."""
        before = np.r_[-1, number[:-1]] if len(number) else number
        return np.where(np.r_[True, text[1:] != text[:-1]], self.begin, before) if len(number) else before

    def add_arcs(self, keys: np.ndarray, counts: np.ndarray, texts: int, failure: np.ndarray | None = None) -> None:
        """Arcs by state and token; failure weights are given where the states have further arcs than these."""
        order = np.argsort(keys)
        self.arcs, counts = keys[order], counts[order]
        state, token = self.arcs // self.width, self.arcs % self.width
        size = np.r_[self.counts, texts].astype(float)
        estimate = (counts - DISCOUNT) / size[state]
        self.arc_weight = np.log10(estimate)
        if failure is not None:
            self.failure = failure
            return
        given = np.bincount(state, estimate, self.width)
        at_root = np.bincount(state, self.unigram[token], self.width)
        self.failure = np.log10(np.maximum(1 - given, 1e-12) / np.maximum(1 - at_root, 1e-12))

    def weights(self, number: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each token adds to the log probability, and whether by an arc of this model; without what isn't heavy."""
        state = self.contexts(number, text)
        root = np.where(number >= 0, self.log_unigram[np.maximum(number, 0)], 0.0) if len(self.tokens) else np.zeros(len(number))
        out = root + np.where(state >= 0, self.failure[np.maximum(state, 0)], 0.0)
        found = np.zeros(len(number), bool)
        if len(self.arcs):
            keys = np.where((state >= 0) & (number >= 0), state * self.width + number, -1)
            at = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
            found = self.arcs[at] == keys
            out = np.where(found, self.arc_weight[at], out)
        return out, found


def _arrow(df: DataFrame) -> list[np.ndarray]:
    return [column.to_numpy() for column in df.toArrow().columns]


def _times(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key of each text once: key, text and how often."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], of[new], np.diff(np.r_[new, len(keys)])


def _freed(df: DataFrame, what: str) -> DataFrame:
    """The rows as a stored table; the shuffle files of its job are removed when it is written."""
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        return stored(df, what)
    finally:
        conf.set(FREE_SHUFFLES, before)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    context = docs.sparkSession.sparkContext
    rows = keyed(docs, id_col, text_col).withColumn("held_out", crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1])
    training = rows.filter(~F.col("held_out")).select("doc_id", "text")

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted((token_hashes(b.column(1))[0].view(np.int64),) for b in chunks(batches))

    unigrams = _freed(training.mapInArrow(count_tokens, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "unigrams")
    total, distinct = unigrams.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    texts = unigrams.filter(F.col("key") == int(END.view(np.int64))).agg(F.sum("n")).first()[0] or 0
    model = Automaton(*_arrow(unigrams.filter(F.col("n") >= heavy_share * total).select("key", "n")), total, distinct)
    begin, end = int(BEGIN.view(np.int64)), int(END.view(np.int64))
    wide = np.r_[model.tokens[model.counts >= WIDE_SHARE * total], begin]

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted((pair_keys(*token_hashes(b.column(1))) for b in chunks(batches)), wide)

    pairs = training.mapInArrow(count_pairs, "key long, n long, state long, part long").repartition("state", "part").groupBy(
        "state", "part", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= ARC_LEAST).select(
        "key", "state", "n", _token(F.col("key"), F.col("state")).alias("token"))
    unigram = (F.col("token_n") + 0.5) / F.lit(model.floor)
    arcs = _freed(pairs.join(unigrams.select(F.col("key").alias("token"), F.col("n").alias("token_n")), "token").drop("token"), "arcs")
    sizes = unigrams.filter(F.col("key") != end).select(F.col("key").alias("state"), F.col("n").alias("size")).unionByName(
        docs.sparkSession.range(1).select(F.lit(begin).cast("long").alias("state"), F.lit(texts).cast("long").alias("size")))
    given = arcs.groupBy("state").agg(F.sum(F.col("n") - DISCOUNT).alias("given"), F.sum(unigram).alias("at_root"))
    left = lambda x: F.greatest(1 - x, F.lit(1e-12))
    states = _freed(given.join(sizes, "state").select("state", "size", F.log10(left(F.col("given") / F.col("size")) / left(F.col("at_root"))).alias("failure")), "states")

    failure = np.zeros(model.width)
    key, weight = _arrow(states.filter((F.col("size") >= heavy_share * total) | (F.col("state") == begin)).select("state", "failure"))
    failure[np.where(key == begin, model.begin, model.number(key))] = weight
    token, state, n = _arrow(arcs.filter(F.col("n") >= heavy_share * total).select(_token(F.col("key"), F.col("state")), "state", "n"))
    model.add_arcs(np.where(state == begin, model.begin, model.number(state)) * model.width + model.number(token), n, texts, failure)
    built = context.broadcast(model)

    def traverse(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        m = built.value
        for batch in chunks(batches):
            hashes, text = token_hashes(batch.column(1))
            number, n = m.number(hashes), batch.num_rows
            known = number >= 0
            row = batch.column(3).to_numpy()
            weights, found = m.weights(number, text)
            keys, of = np.r_[hashes[~known].view(np.int64), pair_keys(hashes, text)[0][~found]], np.r_[text[~known], text[~found]]
            now = keys & PASSES - 1 == turn
            keys, of, times = _times(keys[now], of[now])
            k = len(keys)
            whole = n if turn == 0 else 0
            none = pa.nulls(k, pa.int64())
            first = np.searchsorted(text, np.arange(n))
            base = np.add.reduceat(np.where(known, m.log_unigram[np.maximum(number, 0)], 0.0), first) if len(m.tokens) else np.zeros(n)
            parts = [np.ones(n, np.int64), np.diff(np.r_[first, len(text)]), np.add.reduceat(known.astype(np.int64), first), base, np.add.reduceat(weights, first)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[row[:whole], row[of]]), pa.array(np.r_[row[:whole] * 0x5851F42D4C957F2D ^ 0x2545F491, keys]),
                pa.array(np.r_[np.zeros(whole, np.int64), times]), pa.concat_arrays([batch.column(0)[:whole], none]),
                pa.concat_arrays([batch.column(2)[:whole], pa.nulls(k, pa.bool_())]),
                *(pa.array(np.r_[x[:whole], np.zeros(k, x.dtype)]) for x in parts),
            ], ["row", "key", "times", "doc_id", "held_out", "copies", "tokens", "known", "base", "score"])

    root = F.log10((F.col("n") + 0.5) / F.lit(model.floor))
    of_tokens = unigrams.filter(F.col("n") < heavy_share * total).join(states.select(F.col("state").alias("key"), "failure"), "key", "left").select(
        "key", "n", root.alias("at_root"), (root + F.coalesce("failure", F.lit(0.0))).alias("weight"))
    of_arcs = arcs.filter(F.col("n") < heavy_share * total).join(states, "state").select(
        "key", F.lit(None).cast("long").alias("n"), F.lit(0.0).alias("at_root"),
        (F.log10((F.col("n") - DISCOUNT) / F.col("size")) - F.col("failure") - F.log10(unigram)).alias("weight"))
    # By content: a row is the same in each pass, in whatever order its rows come.
    source = rows.select("doc_id", "text", "held_out", F.xxhash64("doc_id", "text").alias("row"))
    by = lambda x: F.col("times") * F.coalesce(x, F.lit(0.0))
    sums = ["copies", "tokens", "known", "base", "score"]
    passes = []
    for turn in range(PASSES):
        ours = F.col("key").bitwiseAND(F.lit(PASSES - 1)) == turn
        passes.append(_freed(source.mapInArrow(
            lambda batches, t=turn: traverse(batches, t),
            "row long, key long, times long, doc_id long, held_out boolean, copies long, tokens long, known long, base double, score double").join(
            of_tokens.filter(ours).unionByName(of_arcs.filter(ours)), "key", "left").groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("copies").alias("copies"), F.sum("tokens").alias("tokens"),
            F.sum(F.col("known") + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
            F.sum(F.col("base") + by("at_root")).alias("base"), F.sum(F.col("score") + by("weight")).alias("score")), f"pass-{turn}"))
    merged = reduce(DataFrame.unionByName, passes).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in sums))
    unseen = (F.col("tokens") - F.col("known")) * F.log10(F.lit(0.5 / model.floor))
    each = lambda x: (F.col(x) / F.col("copies")).cast("long")
    return merged.select(
        "doc_id", "held_out", each("tokens").alias("n_tokens"), each("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.round((F.col("base") + unseen) / F.col("copies"), 9).alias("base_score"), F.round((F.col("score") + unseen) / F.col("copies"), 9).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
