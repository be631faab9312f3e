"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Base measures come from whole texts. Beyond the two fixed base rules, each rule has a ratio in units of its own (UNITS), and a text
is rejected if its worst ratio lies over a cutoff of the fixed GRID: the rules are tightened together, so that one cutoff speaks for
all of them. In a stratum (a band of text length) the cutoffs are tested from the laxest to stricter ones, by an exact binomial test
on the labelled good texts, up to the first that fails: a fixed sequence needs no correction, so that only the strata share the
error probability (Bonferroni). With probability 1 - ERROR, all rules together reject at most FALSE_REJECTION of the good texts
of every stratum. Without enough labels a stratum has no cutoff, and nothing is rejected there beyond the base. Equal texts are one
trial. The grid and the units aren't fitted to any rows, so all labelled rows are holdouts.

Repeated windows are found by sorting one number per window (40 bits of hash, 24 bits of place) and comparing neighbours; where
a hash collides or a text has 2^24 words or more, the windows themselves are sorted.

Defined cases: a null or empty text has no words and fails the base; a label of a document labelled twice is the smaller one;
null labels count as none; rows that repeat an id are judged each by its own text; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import stored

SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"
BANDS = [200, 500, 1200]
GRID = [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]
FALSE_REJECTION = 0.005
ERROR = 0.05
#: Ratio of each rule, and what counts as one unit of it.
RULES = {
    "symbols": "n_symbols / nullif(word_chars, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)",
    "lines": "n_dup_lines / nullif(n_words, 0)",
    "capitals": "n_capitals / nullif(word_chars, 0)",
    "exclamations": "n_exclamations / nullif(word_chars, 0)",
}
UNITS = {"symbols": 1.0, "repeats": 2.0, "lines": 1.0, "capitals": 2.0, "exclamations": 0.5}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*BASE, "n_capitals", "n_exclamations"]
_PLACE_BITS = 24


def _kept_chars(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))


def _same_hash(x: Column, y: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS) == F.shiftright(y, _PLACE_BITS)


def _same_window(words: Column, i: Column, j: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.get(words, (i + k).cast("int")) == F.get(words, (j + k).cast("int")) for k in range(3)])


def _neighbour(array: Column, same) -> Column:
    """Elements of a sorted array that equal the one before or after."""
    return F.filter(array, lambda x, k: F.coalesce(same(x, F.get(array, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(array, k + 1)), F.lit(False)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with a struct column ``_measures``; the text is read once and nothing is shuffled."""
    text = F.coalesce(docs[text_col], F.lit(""))
    inner = F.btrim(text, F.lit(SEPARATORS))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SEPARATORS)) != "")
    step1 = docs.select("*", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATOR_RUN)).alias("_words"), lines.alias("_lines"))
    words, places = F.col("_words"), F.sequence(F.lit(0), F.size("_words") - 3)
    key = lambda i: F.shiftleft(F.xxhash64(*[F.get(words, i + k) for k in range(3)]), _PLACE_BITS).bitwiseOR(i.cast("long"))
    step2 = step1.withColumn("_keys", F.when(F.size("_words") >= 3, F.transform(places, key)).otherwise(F.array().cast("array<long>")))
    step3 = step2.withColumn("_keys", F.sort_array("_keys"))
    step4 = step3.withColumn("_hits", _neighbour(F.col("_keys"), _same_hash))
    hits = F.col("_hits")
    agree = F.forall(F.sequence(F.lit(1), F.greatest(F.size(hits) - 1, F.lit(1))), lambda k: F.coalesce(
        ~_same_hash(F.get(hits, k - 1), F.get(hits, k)) | _same_window(words, _place(F.get(hits, k - 1)), _place(F.get(hits, k))), F.lit(True)))
    by_window = F.transform(places, lambda i: F.struct(F.array(*[F.get(words, i + k) for k in range(3)]).alias("w"), i.cast("long").alias("p")))
    exact = F.transform(F.array(F.array_sort(by_window)), lambda s: F.transform(_neighbour(s, lambda x, y: x["w"] == y["w"]), lambda x: x["p"]))[0]
    found = F.when(F.size(hits) == 0, F.array().cast("array<long>")).when(
        agree & (F.size("_words") < 1 << _PLACE_BITS), F.transform(hits, _place)).otherwise(exact)
    step5 = step4.withColumn("_places", F.when((F.size(hits) == 0) & (F.size("_words") < 1 << _PLACE_BITS), F.array().cast("array<long>")).otherwise(F.sort_array(found)))
    covered = F.aggregate("_places", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).cast("long").alias("last")),
                          lambda a, p: F.struct((a["sum"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("sum"), p.alias("last")), lambda a: a["sum"])
    return step5.withColumn("_measures", F.struct(
        F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _kept_chars(text, "[^#*$%&|<>]+").alias("n_symbols"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"), _kept_chars(text, "[^A-Z]+").alias("n_capitals"), _kept_chars(text, "[^!]+").alias("n_exclamations"),
    )).drop("_words", "_lines", "_keys", "_hits", "_places")


def _base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def _stratum() -> Column:
    return reduce(lambda c, bound: c + (F.col("n_words") >= bound).cast("int"), BANDS, F.lit(0))


def _binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n p, exact up to rounding; 1 for a larger k, whose tail is no small one."""
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    log_top = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i)) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    series = F.aggregate(steps, F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")), lambda a, i: F.transform(
        F.array(a["term"] * (k - i + 1) / (n - k + i) * ((1 - p) / p)), lambda t: F.struct((a["sum"] + t).alias("sum"), t.alias("term")))[0], lambda a: a["sum"])
    return F.when(k < n * p, F.exp(log_top + F.log(series))).otherwise(1.0)


def worst_ratio() -> Column:
    """The largest of the rules' ratios, each in its unit; null for a text without words."""
    return F.greatest(*[F.expr(e) / F.lit(UNITS[r]) for r, e in RULES.items()])


def certified_cutoffs(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, n (distinct good texts), cutoff (the strictest certified one, null: none); at most one row a band.

    measures: doc_id, text_key (equal for equal texts) and the measures. Stricter cutoffs reject more, so their p-values grow along
    the sequence, and all before the first failure pass.
    """
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    rows = measures.join(good, "doc_id", "left_semi").filter(~_base_failed()).select(_stratum().alias("stratum"), "text_key", worst_ratio().alias("worst"))
    trials = rows.groupBy("stratum", "text_key").agg(F.max("worst").alias("worst"))
    counts = trials.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*[F.sum((F.col("worst") > c).cast("long")) for c in GRID]).alias("over"))
    passes = [F.when(_binomial_tail(F.get("over", i), F.col("n"), FALSE_REJECTION) <= ERROR / (len(BANDS) + 1), F.lit(c)) for i, c in enumerate(GRID)]
    return counts.select("stratum", "n", F.array_min(F.array(*passes)).alias("cutoff"))


def judged(measures: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The rows with base_failed and kept; the cutoffs have one row a length band, four in all."""
    marked = measures.withColumn("base_failed", _base_failed()).withColumn("_stratum", _stratum())
    cuts = cutoffs.select(F.col("stratum").alias("_stratum"), F.col("cutoff").alias("_cut"))
    over = F.coalesce(worst_ratio() > F.col("_cut"), F.lit(False))
    return marked.join(F.broadcast(cuts), "_stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "_cut")


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed and kept of each row."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    measures = stored(measured(own).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "_measures.*"), "measures")
    return judged(measures, certified_cutoffs(measures, labels)).select("doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with the columns they came with, whatever their names."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    own = stored(measured(packed).select("row", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "_measures"), "measured")
    measures = own.select(F.col("row").getField(id_col).cast("long").alias("doc_id"), "row", "text_key", "_measures.*")
    cutoffs = certified_cutoffs(measures.drop("row"), labels)
    return judged(measures, cutoffs).filter("kept").select("row.*")
