"""MinHash near-dedup with bottom-k sketches from one hash function.

1. One pass gives each document the size and digest of its shingle set and the 48 smallest hashes of it. Documents of equal
   sets form one class, whose smallest id stands for it; copies are never paired.
2. The retained values of the classes are inverted lists. A class is listed under its rarest values only: two sets of enough
   likeness share so many retained values that they must meet under one of these (prefix principle), while a passage that many
   documents share is not among the rarest values of any but those it makes up.
3. Classes that meet any other get a sketch of 1,024 values, which for most is the whole set, and finer lists from it.
4. Lists are joined to their most central member first, which is linear in their length. Only members that this left in different
   components are paired with each other: in short lists directly, in long ones by what they differ in from that member.
5. A pair whose union sketch estimates too small a likeness goes; the rest is confirmed on the full shingle sets.

Of cut sets, the overlap and the estimate that are asked for lie six standard deviations under what a pair at the threshold
has on average: such a pair is lost with a probability of about 3e-7, any nearer pair with a smaller one. For whole sets both
are exact.

Defined cases: a null text counts as an empty one; a text without words has size 0 and is linked with nothing; a row without
id gets component null, is kept and linked with nothing; rows that repeat an id are grouped by their own texts each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SHINGLE, chunks, keyed, shingle_sets
from factloom.llm.components import components
from factloom.session import stored

KEPT = 48
FINE = 1024
SHORT = 16
LIKE = 75
HUB_PARTS = 128


def sketches(docs: DataFrame, kept: int = KEPT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the shingle set), set_id (digest of the whole set), sketch (its smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, bounds = shingle_sets(batch.column(1), shingle)
            signed = hashes.view(np.int64)
            digests, least = [], []
            for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.sort(signed[at:to])
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                least.append(own[:kept])
            columns = [batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.binary()), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_id", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, set_id binary, sketch array<long>")


def _least_overlap(size: Column, share: float, like: int, kept: int) -> Column:
    """Retained values that a set shares with any partner of enough likeness. Whole sets: exact; cut ones: six deviations."""
    cut = like / 100
    sampled = F.floor(size * cut - 6 * F.sqrt(size * cut * (1 - cut)))
    exact = F.ceil(size * share - 1e-9)
    return F.greatest(F.lit(1), F.when(size <= int(kept * cut), exact).otherwise(sampled)).cast("int")


def rare_postings(classes: DataFrame, like: int = LIKE, kept: int = KEPT) -> DataFrame:
    """(value, rep, n, center, small): each class under the rarest of its retained values, as many as the prefix principle asks for.

    A set shares at least like % of itself with a partner, and 2 like / (100 + like) of itself with one that isn't smaller;
    small marks the values that the second, shorter prefix holds. Values of one class only take the first places and need no
    list. center is the mean length of the lists a class would be in: it is highest for the text that others were made from.
    """
    values = classes.select("rep", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    often = classes.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = values.join(often, "value").groupBy("rep").agg(
        F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"),
        (F.sum("df") / F.first("size")).alias("center"))
    room = {name: (F.size("shared") + 1 - _least_overlap(F.col("size"), share, like, kept)).cast("int")
            for name, share in (("room", like / 100), ("small_room", 2 * like / (100 + like)))}
    return shared.withColumns(room).filter("room > 0").select(
        "rep", "n", "center", "small_room", F.posexplode(F.expr("slice(shared, 1, room).value")).alias("place", "value")
    ).select("value", "rep", "n", "center", (F.col("place") < F.col("small_room")).alias("small"))


def _like_sizes(like: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= like * F.greatest("n_a", "n_b")


def _estimated(pairs: DataFrame, classes: DataFrame, like: int, kept: int) -> DataFrame:
    """Pairs whose union sketch leaves enough likeness possible."""
    a = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("n_a"))
    b = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("n_b"))
    both = pairs.join(a, "a").join(b, "b")
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, kept)
    sketched = both.withColumn("u", union).withColumn("common", F.size(F.array_intersect("u", F.array_intersect("sketch_a", "sketch_b"))))
    share = like / 100
    size = F.size("u")
    whole = (F.col("n_a") <= kept) & (F.col("n_b") <= kept) & (size < kept)
    return sketched.filter(F.when(whole, 100 * F.col("common") >= like * size).otherwise(
        F.col("common") >= F.floor(size * share - 6 * F.sqrt(size * share * (1 - share))))).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, like: int, shingle: int) -> DataFrame:
    """Pairs whose full shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a"):
            (x, from_x), (y, from_y) = shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle)
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                u, v = x[from_x[i]:from_x[i + 1]], y[from_y[i]:from_y[i + 1]]
                common = len(np.intersect1d(u, v, assume_unique=True))
                good[i] = 100 * common >= like * (len(u) + len(v) - common) and common > 0
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _hubs(postings: DataFrame) -> DataFrame:
    """Each list's most central member."""
    return postings.groupBy("value").agg(F.max(F.struct("center", "rep", "n")).alias("hub"))


def _hub_pairs(postings: DataFrame, hubs: DataFrame, like: int) -> DataFrame:
    """Each list's hub with the others: one pair a posting at most, whatever the list's length."""
    pairs = postings.join(hubs, "value").filter("rep <> hub.rep").withColumns({"n_a": F.col("hub.n"), "n_b": F.col("n")})
    return _unordered(pairs.filter(_like_sizes(like)), "hub.rep", "rep")


def _unordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _cross_pairs(x: DataFrame, y: DataFrame, like: int) -> DataFrame:
    """Pairs of one list in different components, the smaller set from x."""
    x, y = (side.select("value", *[F.col(c).alias(f"{c}_{n}") for c in ("rep", "n", "component")]) for side, n in ((x, "a"), (y, "b")))
    pairs = x.join(y, "value").filter("component_a <> component_b and (n_a, rep_a) < (n_b, rep_b)").filter(_like_sizes(like))
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def _hub_differences(members: DataFrame, sets: DataFrame, like: int) -> DataFrame:
    """(hub, token, rep, n, component, d, linked, after): members of long lists under the rarest of their differences from the hub.

    A difference is a hash that only the member has, or the complement of one that only the hub has. Two members differ by
    |X| + |Y| - 2 |X & Y| of their differences X and Y, and may differ by (n_x + n_y) / 7 at a likeness of 75 %: so a pair of
    which one isn't linked to the hub shares at least half of the other's differences, about, and the prefix principle holds
    again. Pairs linked to the hub both are in one component already. d counts a member's differences, after those that follow
    in its order: with what follows their first common one, two members must still be able to share enough.

    The members of a hub are dealt to HUB_PARTS parts, and its set is copied to those of them that have members only.
    """
    may = (100 - like) / (100 + like)
    one = sets.select("rep", F.col("sketch").alias("own"))
    hub = sets.select(F.col("rep").alias("hub"), F.col("n").alias("n_hub"), F.col("sketch").alias("theirs"))
    lost = F.transform(F.array_except("theirs", "own"), lambda v: F.bitwise_not(v))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(HUB_PARTS)))
    hub_parts = dealt.select("hub", "part").distinct().join(hub, "hub")
    apart = dealt.join(one, "rep").join(hub_parts, ["hub", "part"]).withColumn("apart", F.concat(F.array_except("own", "theirs"), lost)).select(
        "hub", "rep", "n", "n_hub", "component", F.size("apart").alias("d"), "apart")
    tokens = apart.withColumn("token", F.explode("apart")).drop("apart")
    often = tokens.groupBy("hub", "token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(often, ["hub", "token"]).groupBy("hub", "rep", "n", "n_hub", "component", "d").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared")).withColumn("linked", F.col("d") <= (F.col("n") + F.col("n_hub")) * may)
    needed = F.when(F.col("linked"), F.ceil((F.col("d") - (F.col("n") - F.col("n_hub")) * may) / 2 - 1e-9)).otherwise(
        F.ceil(F.col("d") - F.col("n") * (may * (1 + 100 / like)) - 1e-9))
    room = F.size("shared") + 1 - F.greatest(needed, F.lit(1))
    return shared.withColumn("room", room.cast("int")).filter("room > 0").select(
        "hub", "rep", "n", "component", "d", "linked", (F.col("d") - F.size("shared")).alias("alone"),
        F.posexplode(F.expr("slice(shared, 1, room).token")).alias("place", "token")
    ).withColumn("after", F.col("d") - F.col("alone") - F.col("place") - 1).drop("alone", "place")


def _open_pairs(postings: DataFrame, hubs: DataFrame, labels: DataFrame, tested: DataFrame, sets: DataFrame, like: int, kept: int) -> DataFrame:
    """Members of one list that lie in different components and weren't compared yet.

    Short lists are enumerated, at most SHORT rows for each posting. In long ones, members are listed again by their differences
    from the hub; sets too large to be held whole are enumerated.
    """
    marked = postings.join(labels, F.col("rep") == F.col("node"), "left").select(
        "value", "rep", "n", "small", F.coalesce("component", "rep").alias("component"))
    lists = marked.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).filter("low < high")
    rows = stored(marked.join(lists.select("value", "m"), "value").join(hubs, "value").withColumn(
        "listed", (F.col("m") > SHORT) & (F.col("hub.n") <= kept)), "members")
    direct = rows.filter("not listed")
    long = rows.filter("listed")
    pairs = _cross_pairs(direct.filter("small"), direct, like)
    pairs = pairs.unionByName(_cross_pairs(long.filter("small"), long.filter(F.col("n") > kept), like))

    members = long.filter((F.col("n") <= kept) & (F.col("rep") != F.col("hub.rep"))).select(F.col("hub.rep").alias("hub"), "rep", "n", "component").distinct()
    apart = stored(_hub_differences(members, sets, like), "differences")
    x, y = (side.select("hub", "token", *[F.col(c).alias(f"{c}_{n}") for c in ("rep", "n", "component", "d", "linked", "after")])
            for side, n in ((apart.filter("not linked"), "a"), (apart, "b")))
    may = (100 - like) / (100 + like)
    more = x.join(y, ["hub", "token"]).filter("component_a <> component_b and (linked_b or rep_a < rep_b)").filter(_like_sizes(like)).filter(
        F.col("d_a") + F.col("d_b") - (F.col("n_a") + F.col("n_b")) * may <= 2 * (1 + F.least("after_a", "after_b")) + 1e-6)
    pairs = pairs.unionByName(more.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")))
    return stored(pairs.distinct(), "pairs").join(tested, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: int = LIKE, kept: int = KEPT,
                    fine: int = FINE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    rows = keyed(docs, id_col, text_col)
    own = stored(sketches(rows, kept, shingle), "sketches")
    linked = own.filter("doc_id is not null and n > 0")
    classes = stored(linked.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    met = rare_postings(classes, like, kept).select(F.col("rep").alias("doc_id")).distinct()
    texts = stored(rows.join(met, "doc_id", "left_semi"), "texts")
    finer = stored(sketches(texts, fine, shingle).select(F.col("doc_id").alias("rep"), "n", "sketch"), "sketches")
    postings = stored(rare_postings(finer, like, fine), "postings")

    hubs = stored(_hubs(postings), "hubs")
    tested = stored(_hub_pairs(postings, hubs, like), "pairs")
    links = stored(_confirmed(_estimated(tested, finer, like, fine), texts, like, shingle), "links")
    open_pairs = _open_pairs(postings, hubs, components(links), tested, finer, like, fine)
    more = _confirmed(_estimated(open_pairs, finer, like, fine), texts, like, shingle)
    labels = components(links.unionByName(stored(more, "links")))

    by_set = classes.select("set_id", "rep").join(labels, F.col("rep") == F.col("node"), "left").select(
        "set_id", F.coalesce("component", "rep").alias("component"))
    found = linked.select("doc_id", "n", "set_id").join(by_set, "set_id").select("doc_id", "n", "component")
    alone = own.filter("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    return found.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
