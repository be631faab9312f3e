"""A training corpus from raw documents: quality rules, near-dedup, redaction of secrets, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Between stages
the rows are written as Parquet. Stages handle null ids, null texts, repeated rows and empty tables as their operators say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, mixing, near_dup, quality_rules, secret_scan
from factloom.llm.queries import MULTI_RANKS
from factloom.session import scan, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie over a certified cutoff go."""
    return quality_rules.keep_good(docs, scan(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group stays; ids that any of their rows keeps stay."""
    verdicts = near_dup.near_duplicates(docs).filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = verdicts.filter("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the text; widely copied examples stay."""
    return secret_scan.redact_live(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again up to the repetition limit."""
    return mixing.mix_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with the digests of the ids and of what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_documents),
    ("near_dedup", one_of_each_group),
    ("secret_scan", without_secrets),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

#: Byte-level BPE has no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
