"""Mixing sources to target weights by temperature.

A source of token share p gets weight p^t / sum p^t. Lowering the exponent t from 1 to 0 raises the entropy of the weights and
the number of times the small sources repeat; t is bisected to the entropy asked for, and raised again where the repetition
limit would be broken. Every bisection step is an aggregate over the table of sources, 32 cells of the interval at once.

The weights are realised as budgeted block permutations: the budget of a source is a number of whole epochs and a part of one.
Documents stand in the order of a keyed digest, whose first four digits are the block; the part takes blocks from the front
until its tokens are spent, and cuts only the last block between documents. Blocks are summed before they meet, so no task
gathers the documents of a source. Each epoch has a block order of its own.

Without a given number of tokens the budget is the smallest that lets every source in whole at least once: then mixing only
repeats, and leaves no document out. With one, a source over its budget is sampled, which is then the feature.

Tokens are words. Defined cases: null and empty texts have no tokens and come once; a null source is a source of its own; a
row without id stands in the order as the empty string; rows that repeat an id come and go together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WORD
from factloom.session import stored

TARGET_ENTROPY = 0.95
REPETITION_LIMIT = 1.5
SEED = "mix-1"
CELLS = 32
BLOCK_DIGITS = 4


def _key(doc_id: Column, *salt: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[s.cast("string") for s in salt], F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), _key(docs[id_col].cast("long")).alias("key"))


def _bisect(sources: DataFrame, share: float) -> float:
    """The largest exponent in [0, 1] at which the entropy of the weights reaches a share of the largest possible."""
    low, high = 0.0, 1.0
    log_p = F.log("tokens") - F.log(F.lit(float(sources.agg(F.max("tokens")).first()[0])))
    for _ in range(8):
        marks = [low + (high - low) * i / CELLS for i in range(CELLS + 1)]
        sums = sources.agg(F.count("*"), *[a for t in marks for a in (F.sum(F.exp(t * log_p)), F.sum(F.exp(t * log_p) * log_p))]).first()
        entropy = [math.log(z) - t * s / z for t, z, s in zip(marks, sums[1::2], sums[2::2], strict=True)]
        enough = [h >= share * math.log(sums[0]) - 1e-12 for h in entropy]
        if all(enough):
            return high
        if not enough[0]:
            return low
        at = max(i for i, e in enumerate(enough) if e)
        low, high = marks[at], marks[min(at + 1, CELLS)]
    return low


def temperature(sources: DataFrame, entropy: float = TARGET_ENTROPY, repetitions: float = REPETITION_LIMIT) -> float:
    """The exponent for a table (source, tokens) of positive counts: the entropy's, or the smallest within the repetition limit."""
    least, most = sources.agg(F.min("tokens"), F.max("tokens")).first()
    if least is None or least == most:
        return 1.0
    within = max(0.0, 1.0 - math.log(repetitions) / math.log(most / least))
    return max(within, _bisect(sources, entropy))


def mixing_plan(counted: DataFrame, budget: float | None = None, entropy: float = TARGET_ENTROPY, repetitions: float = REPETITION_LIMIT) -> DataFrame:
    """source, tokens, weight, epochs (whole ones), cut: documents of a key up to it come once more (null: none)."""
    blocks = stored(counted.groupBy("source", F.substring("key", 1, BLOCK_DIGITS).alias("block")).agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sources = stored(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "sources")
    t = temperature(sources, entropy, repetitions)
    most, whole = sources.agg(F.max("tokens"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(t)))).first()
    raised = F.pow(F.col("tokens").cast("double"), F.lit(t))
    # the budget that lets the largest source in once: weight_s * budget = tokens_s^t * most^(1 - t)
    granted = raised * (float(most) ** (1 - t) if budget is None else float(budget) / whole) if most else F.lit(0.0)
    plan = sources.select("source", "tokens", (raised / F.lit(whole or 1.0)).alias("weight"), granted.alias("granted")).select(
        "source", "tokens", "weight", F.floor(F.col("granted") / F.col("tokens") + 1e-9).alias("epochs"), "granted")
    plan = plan.withColumn("rest", F.greatest(F.col("granted") - F.col("epochs") * F.col("tokens"), F.lit(0.0)))
    before = "sum(tokens) over (partition by source order by block) - tokens"
    sums = blocks.selectExpr("source", "block", f"{before} as before", "tokens as in_block")
    last = sums.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).filter("before < rest").groupBy("source").agg(
        F.max(F.struct("block", "before", "rest")).alias("last")).select(F.col("source").alias("s"), "last.*")
    inside = counted.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, BLOCK_DIGITS) == F.col("block")))
    cuts = inside.selectExpr("source", "key", "rest", "before + sum(n_tokens) over (partition by source, block order by key) - n_tokens as before").filter(
        "before < rest").groupBy("source").agg(F.max("key").alias("cut")).select(F.col("source").alias("s"), "cut")
    return stored(plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "tokens", "weight", "epochs", "cut"), "plan")


def _copies(rows: DataFrame, plan: DataFrame, source: Column, key: Column) -> DataFrame:
    """The rows with the number of an epoch each, as often as the plan says; rows of sources without tokens come once."""
    mine = plan.select(F.col("source").alias("_source"), F.col("epochs").alias("_epochs"), F.col("cut").alias("_cut"))
    times = F.coalesce(F.col("_epochs"), F.lit(1)) + F.coalesce((key <= F.col("_cut")).cast("long"), F.lit(0))
    joined = rows.join(mine, source.eqNullSafe(F.col("_source")), "left").withColumn("_times", times).filter("_times > 0")
    return joined.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1))).drop("_source", "_epochs", "_cut", "_times")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **target: float) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block: one row for each time a document comes, and its block in that epoch's order."""
    counted = stored(_counted(docs, id_col, text_col, source_col), "counted")
    rows = _copies(counted, mixing_plan(counted, **target), F.col("source"), F.col("key"))
    return rows.select("doc_id", "source", "n_tokens", F.col("_epoch").alias("epoch"), F.substring(_key(F.col("doc_id"), F.col("_epoch")), 1, BLOCK_DIGITS).alias("block"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **target: float) -> DataFrame:
    """The rows of the table, each as often as the mix has it, with the columns they came with."""
    plan = mixing_plan(stored(_counted(docs, id_col, text_col, source_col), "counted"), **target)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return _copies(packed, plan, F.col("row").getField(source_col).cast("string"), _key(F.col("row").getField(id_col).cast("long"))).select("row.*")
