"""Stored index: one Parquet folder per fact table of a version and a manifest row that names the version and what it holds."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.sources import log_store

# Layout version and age limit of a stored index.
SCHEMA_VERSION = 2
MAX_AGE_DAYS = 7

c = F.col


def scope_fingerprint(root: str, include_tests: bool) -> str:
    """Sixteen hex digits that name an index of a root and scope."""
    import hashlib

    return hashlib.sha1(f"{root}:{include_tests}".encode()).hexdigest()[:16]


def save(tables: dict[str, DataFrame], target: str, scope: str, keep: int = 2) -> None:
    """Write every fact table to the folder of a new version, then a manifest row for it.

    Manifest rows are appended and the newest one of a scope counts: a reader sees all tables of one version, the old or the new.
    Of each scope the newest ``keep`` versions stay, so that a reader may finish with the one before.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{target}/{version}/{name}")
    _announce(spark, target, scope, version, list(tables))
    newest = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("written")))
    for row in _manifest(spark, target).withColumn("turn", newest).filter(c("turn") > keep).select("version").collect():
        log_store.delete(spark, f"{target}/{row['version']}")


def _manifest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/_manifest")


def _announce(spark: SparkSession, target: str, scope: str, version: str, tables: list[str]) -> None:
    names = F.array(*[F.lit(n) for n in tables]).cast("array<string>")
    spark.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(scope).alias("scope"), F.lit(version).alias("version"),
                          F.current_timestamp().alias("written"), names.alias("tables")).write.mode("append").parquet(f"{target}/_manifest")


def load(spark: SparkSession, target: str, scope: str) -> dict[str, DataFrame] | None:
    """The tables of the newest version if layout, scope and age fit, else None; errors but a missing manifest are raised."""
    try:
        manifest = _manifest(spark, target).filter(c("scope") == scope)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    age = (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("written")) / 86400
    row = manifest.withColumn("age", age).orderBy(F.desc("written")).first()
    if not row or row["schema_version"] != SCHEMA_VERSION or row["age"] > MAX_AGE_DAYS or not row["tables"]:
        return None
    return {n: spark.read.parquet(f"{target}/{row['version']}/{n}") for n in row["tables"]}


def clear(spark: SparkSession, target: str) -> None:
    """Remove a stored index with its data: the manifest first, so that no reader finds what is being deleted."""
    log_store.delete(spark, f"{target}/_manifest")
    log_store.delete(spark, target)
