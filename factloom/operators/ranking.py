"""Fielded BM25, candidate merging, penalties and confidence.

Scoring never shuffles text. Each document row carries its token arrays, the per-term frequencies
are computed inside the row, and only one row of corpus statistics crosses the cluster.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.functions.text import prefix_overlap, round_half_up

# Saturation and length normalisation, overlap bonuses, path penalties.
K1 = 1.2
B = 0.75
OVERLAP_BONUS = {"behavior": 0, "identifier": 3, "structural": 3, "regex": 2, "doc": 2, "config": 0, "route": 3}
SOURCE_ORDER = ["behavior", "identifier", "structural", "regex", "doc", "config", "route"]
TEST_PENALTY, GENERATED_PENALTY, DEMO_PENALTY, DTS_PENALTY = 3, 10, 4, 6
LINE_BUCKET = 3


def term_frequencies(tokens: Column, terms: list[str]) -> Column:
    """Array of frequencies, one per term: exact hits count one, prefix hits in either direction a half."""
    return F.transform(F.array(*[F.lit(t) for t in terms]), lambda t: F.aggregate(
        tokens, F.lit(0.0), lambda acc, tok: acc + F.when(tok == t, 1.0).when(prefix_overlap(tok, t), 0.5).otherwise(0.0)))


def score_fielded(docs: DataFrame, terms: list[str], weights: dict[str, float], limit: int | None = None,
                  tie: list[str] | None = None) -> DataFrame:
    """Add ``score`` and ``matched`` to the documents that match at least one term.

    ``weights`` maps token-array columns to field weights. Two narrow passes: one row of statistics
    (document count, mean field lengths, document frequencies), then scoring with those constants. Terms
    live in arrays, so the plan stays the same size for any number of them.
    """
    terms = list(dict.fromkeys(terms))
    fields = list(weights)
    if not terms:
        return docs.limit(0).withColumn("score", F.lit(0.0)).withColumn("matched", F.array().cast("array<string>"))
    tf = {f: f"__tf_{f}" for f in fields}
    counted = docs.select("*", *[term_frequencies(F.col(f), terms).alias(tf[f]) for f in fields])
    in_any = lambda i: reduce(lambda a, b: a | b, [F.get(tf[f], F.lit(i)) > 0 for f in fields])
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.size(f)).alias(f"avg_{f}") for f in fields],
        *[F.count_if(in_any(i)).alias(f"df_{i}") for i in range(len(terms))],
    ).first()
    n = stats["n"] or 1
    idf = F.array(*[F.lit(math.log((n - stats[f"df_{i}"] + 0.5) / (stats[f"df_{i}"] + 0.5) + 1)) for i in range(len(terms))])

    def field_score(f: str) -> Column:
        norm = F.lit(1 - B) + F.lit(B) * F.size(f) / F.lit(float(stats[f"avg_{f}"] or 1.0))
        parts = F.zip_with(F.col(tf[f]), idf, lambda x, w: w * (x * F.lit(K1 + 1)) / (x + F.lit(K1) * norm))
        return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))) * F.lit(float(weights[f]))

    def field_matches(f: str) -> Column:
        words = F.array(*[F.lit(f"{f}:{t}") for t in terms])
        return F.filter(words, lambda _, i: F.get(tf[f], i) > 0)

    # The one-element array is a barrier: the score is computed once and rows without a hit stop here.
    result = F.struct(reduce(add, [field_score(f) for f in fields]).alias("score"),
                      F.concat(*[field_matches(f) for f in fields]).alias("matched"))
    scored = counted.select(*docs.columns, F.inline(F.filter(F.array(result), lambda r: r["score"] > 0)))
    if limit is not None:
        scored = scored.orderBy(F.desc("score"), *(tie or [])).limit(limit)
    return scored


def prefix_pairs(left: DataFrame, right: DataFrame, min_len: int = 1) -> DataFrame:
    """All (term, tok, weight) with equal strings or one a prefix of the other, as two equi-joins.

    ``left`` has a distinct ``term`` column, ``right`` a distinct ``tok`` column. Listing the prefixes
    of the longer string turns the theta join into hash joins, so no pair is ever tested in vain.
    """
    def prefixes(c: str) -> Column:
        longest = F.length(c)
        return F.when(longest >= min_len, F.transform(
            F.sequence(F.lit(min_len), F.greatest(longest, F.lit(min_len))), lambda k: F.substring(F.col(c), 1, k)))

    tok_longer = right.select("tok", F.explode(prefixes("tok")).alias("term")).join(left, "term").select(
        "term", "tok", F.when(F.col("term") == F.col("tok"), 1.0).otherwise(0.5).alias("weight"))
    term_longer = (
        left.select("term", F.explode(prefixes("term")).alias("tok"))
        .filter(F.col("tok") != F.col("term"))
        .join(right, "tok")
        .select("term", "tok", F.lit(0.5).alias("weight"))
    )
    return tok_longer.unionByName(term_longer)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. Spark cuts each task's groups to ``k`` before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def source_ordinal(source: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), source).cast("int")


MERGE_KEY = ["candidate_type", "file", "line", "col", "name"]


def merge_candidates(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Union rows of all retrievers and add up the scores of rows for the same place.

    The earliest source keeps its full score; every later row adds its score plus an overlap bonus,
    docs add half of theirs, configs add nothing. That is one sum, so it combines map-side.
    Needs ``src`` (retriever name), ``score``, ``sources`` and ``evidence`` besides the key columns.
    """
    keys = keys or MERGE_KEY
    bonus = reduce(lambda acc, s: acc.when(F.col("src") == s, OVERLAP_BONUS[s]), SOURCE_ORDER[1:],
                   F.when(F.col("src") == SOURCE_ORDER[0], OVERLAP_BONUS[SOURCE_ORDER[0]]))
    extra = (
        F.when(F.col("src").isin("behavior", "config"), F.lit(0))
        .when(F.col("src") == "doc", round_half_up(F.col("score") * 0.5) + bonus)
        .otherwise(F.col("score") + bonus)
    )
    rest = [c for c in candidates.columns if c not in {*keys, "src", "score", "sources", "evidence"}]
    first = F.struct(F.col("score").alias("score"), F.col("__extra").alias("extra"), F.col("src").alias("src"),
                     *[F.col(c) for c in rest])
    place = F.struct(source_ordinal(F.col("src")), -F.col("score"))
    grouped = candidates.withColumn("__extra", extra).groupBy(*keys).agg(
        F.min_by(first, place).alias("f"),
        F.sum("__extra").alias("extra"),
        F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
    )
    return grouped.select(
        *keys,
        *[F.col(f"f.{c}").alias(c) for c in rest],
        F.col("f.src").alias("src"),
        (F.col("f.score") + F.col("extra") - F.col("f.extra")).alias("score"),
        "sources",
        F.when(F.col("n_rows") > 1, F.array_append("evidence", F.lit("multi-retriever-overlap")))
        .otherwise(F.col("evidence")).alias("evidence"),
    )


def coalesce_candidates(merged: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Fold rows of one symbol within a three-line bucket into one.

    Row by row the fold is ``score = max(score, next) + 2``; in closed form the result is the maximum of
    ``s_i + 2 * (rows after i, plus one unless i is first)``. A bucket is at most three source lines.
    """
    bucketed = merged
    if keys is None:
        bucketed = merged.withColumn("__bucket", F.floor(F.col("line") / LINE_BUCKET) * LINE_BUCKET).withColumn(
            "__sym", F.coalesce("symbol", "matched", F.lit("")))
        keys = ["file", "__bucket", "__sym"]
    order = order or [source_ordinal(F.col("src")), F.desc("score"), F.col("line"), F.col("col"), F.col("candidate_type")]
    w = W.partitionBy(*keys)
    ranked = bucketed.withColumn("__i", F.row_number().over(w.orderBy(*order))).withColumn(
        "__n", F.count(F.lit(1)).over(w))
    value = F.col("score") + 2 * (F.col("__n") - F.col("__i") + F.when(F.col("__i") > 1, 1).otherwise(0))
    rest = [c for c in merged.columns if c not in {*keys, "score", "sources", "evidence", "candidate_type", "kind"}]
    out = ranked.groupBy(*keys).agg(
        F.max(value).alias("score"),
        F.min_by(F.struct(*[F.col(c) for c in rest], F.col("candidate_type"), F.col("kind")), "__i").alias("f"),
        F.bool_or(F.col("candidate_type") == "declaration").alias("has_decl"),
        F.min_by("kind", F.when(F.col("candidate_type") == "declaration", F.col("__i"))).alias("decl_kind"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
        F.count(F.lit(1)).alias("folded"),
    )
    as_decl = (F.col("f.candidate_type") == "doc") & F.col("has_decl")
    return out.select(
        *[k for k in keys if not k.startswith("__")],
        *[F.col(f"f.{c}").alias(c) for c in rest],
        F.when(as_decl, "declaration").otherwise(F.col("f.candidate_type")).alias("candidate_type"),
        F.when(as_decl, F.col("decl_kind")).otherwise(F.col("f.kind")).alias("kind"),
        "score", "sources", "evidence", "folded",
    )


def path_penalty(file: Column) -> Column:
    rooted = F.concat(F.lit("/"), file)
    return (
        F.when(file.rlike("\\.(spec|test|stories)\\.(ts|tsx|js|jsx)$"), TEST_PENALTY).otherwise(0)
        + F.when(rooted.rlike(paths.GENERATED_PATH), GENERATED_PENALTY).otherwise(0)
        + F.when(rooted.rlike(paths.DEMO_PATH), DEMO_PENALTY).otherwise(0)
        + F.when(F.endswith(file, F.lit(".d.ts")), DTS_PENALTY).otherwise(0)
    )


def rank_candidates(candidates: DataFrame, recipes: list[dict] | None = None) -> DataFrame:
    """Drop excluded paths, apply penalties and boosts, keep positive scores. Sorting is left to the caller."""
    recipes = recipes or []
    file = F.col("file")
    score = F.col("score") - path_penalty(file)
    score = score + F.when(F.size("sources") >= 3, 3).otherwise(0)
    rich = F.array_contains("sources", "structural") | F.exists("evidence", lambda e: F.startswith(e, F.lit("regex-match")))
    for recipe in recipes:
        ids = recipe.get("identifiers") or []
        names = F.coalesce(F.col("name").isin(ids), F.lit(False)) if ids else F.lit(True)
        score = score + F.when(names & rich, recipe["boost"]).otherwise(0)
    if recipes:
        lone = (F.size("sources") == 1) & (F.element_at("sources", 1) == "identifier")
        score = score - F.when(lone, 2).otherwise(0)
    kept = candidates.filter(~paths.in_skipped_dir(file) & ~paths.is_skipped_file(file))
    return kept.withColumn("score", score).filter(F.col("score") > 0)


RANK_ORDER = ["file", "line", "col", "name"]


def rank_order() -> list[Column]:
    return [F.desc("score"), *[F.col(c) for c in RANK_ORDER]]


def confidence(n_rows: Column, score: Column, sources: Column, evidence: Column, mode_confidence: Column) -> Column:
    """Decision list on the top row."""
    has = lambda s: F.array_contains(sources, s)
    overlap = F.exists(evidence, lambda e: F.contains(e, F.lit("overlap")))
    return (
        F.when(n_rows == 0, "low")
        .when((F.size(sources) > 1) & (score >= 15), "high")
        .when(has("structural") & (score >= 10), "high")
        .when(has("graph") & (score >= 10), "high")
        .when(overlap, "high")
        .when(score >= 15, "medium")
        .when(has("doc") & (score >= 8), "medium")
        .when(mode_confidence == "low", "low")
        .otherwise("medium")
    )
