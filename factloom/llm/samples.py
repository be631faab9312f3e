"""Bounded samples of labelled documents, for the operators that fit a classifier."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import crc_mod, keyed

SAMPLE_BYTES = 24_000_000


def label_counts(labels: DataFrame, column: str, folds: int, held_out: int) -> tuple[int, int]:
    """How many documents of the learning folds bear label 0 and label 1."""
    rows = _learning(labels, column, folds, held_out).groupBy("label").count().collect()
    found = {r["label"]: r["count"] for r in rows}
    return found.get(0, 0), found.get(1, 0)


def _learning(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("label"))
    return rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != held_out)) \
        .groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, per_label: int,
                   most_bytes: int = SAMPLE_BYTES) -> tuple[pa.Array, list[int]]:
    """Texts and labels of at most per_label documents of each label and most_bytes bytes in all, in the order of a hash.

    Only rows of the learning folds are drawn. The same document is drawn whatever the partitions are; of rows that repeat an
    id, the first by content counts, of a document labelled twice the larger label. A document that doesn't fit into what is left
    of the bytes is passed over, those after it are still drawn.
    """
    known = _learning(labels, column, folds, held_out).withColumn("turn", F.xxhash64("doc_id"))
    drawn = known.filter("label = 0").orderBy("turn", "doc_id").limit(per_label).unionByName(
        known.filter("label = 1").orderBy("turn", "doc_id").limit(per_label))
    rows = keyed(docs).join(F.broadcast(drawn), "doc_id").withColumn("size", F.octet_length("text"))
    sizes = rows.groupBy("doc_id", "label", "turn").agg(F.max("size").alias("size")).orderBy("turn", "doc_id").collect()
    total, within = 0, []
    for r in sizes:
        if total + r["size"] > most_bytes:
            continue
        total += r["size"]
        within.append((r["doc_id"], r["label"]))
    if not within:
        return pa.array([], pa.string()), []
    spark = docs.sparkSession
    ids = spark.createDataFrame(within, "doc_id long, label int")
    table = keyed(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy(
        F.xxhash64("doc_id"), "doc_id").select("text", "label").toArrow()
    return table.column(0).combine_chunks().cast(pa.string()), table.column(1).to_pylist()
