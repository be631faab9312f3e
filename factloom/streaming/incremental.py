"""Keep facts current: latest-per-key state, per-file invalidation and streaming maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import lexer
from factloom.operators import facts
from factloom.sources import log_store
from factloom.sources.configs import config_entries

c = F.col
FACTS = {"declarations": facts.declarations, "usages": facts.usages, "docs": facts.docs, "routes": facts.routes,
         "exports": facts.exports, "shapes": facts.shapes}


def latest_per_key(rows: DataFrame, keys: list[str], version: Column, columns: list[str]) -> DataFrame:
    """Last version per key and how many were seen. A plain aggregate: combines map-side, runs in update mode on streams."""
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), version).alias("s"), F.count(F.lit(1)).alias("versions")).select(*keys, "s.*", "versions")


def stale_files(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Files to read again or drop: (path, action). Dirty buffers count as changed whatever their time says."""
    i = indexed.select("path", c("mtime").alias("seen"))
    dirty = c("dirty") if "dirty" in current.columns else F.lit(False)
    n = current.select("path", c("mtime").alias("now"), dirty.alias("dirty"), F.lit(True).alias("present"))
    action = F.when(c("present").isNull(), "drop").when(c("seen").isNull() | c("dirty") | (c("seen") != c("now")), "extract")
    return i.join(n, "path", "full_outer").withColumn("action", action).filter(c("action").isNotNull()).select("path", "action")


def refresh_facts(old: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "file") -> DataFrame:
    """Fact table with the rows of changed files replaced."""
    return old.join(changed.select(c("path").alias(key)), key, "left_anti").unionByName(fresh)


def latest_diagnostics(stream: DataFrame) -> DataFrame:
    """Diagnostics stream to the last published version per file (update mode)."""
    return latest_per_key(stream, ["file"], c("version"), ["version", "diagnostics"])


def document_versions(edits: DataFrame) -> DataFrame:
    """Open-document state from an edit stream: last text, version number and edit count per path."""
    return latest_per_key(edits, ["path"], c("version"), ["version", "text"])


def index_stream(files: DataFrame, target: str, checkpoint: str, available_now: bool = True, merge_after: int = log_store.MERGE_AFTER,
                 grace_seconds: float = log_store.GRACE_SECONDS) -> StreamingQuery:
    """Maintain the stored fact tables from a stream of file versions (path, text, mtime); a null text means the file is gone.

    Each micro-batch keeps the newest version per path, cuts it once and appends its facts to the log-structured store; readers
    use ``indexed``. After ``merge_after`` batches they are merged into a run. A replayed batch replaces itself.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("text", "mtime"), "mtime").alias("s")).select("path", "s.*")
        live = newest.filter(c("text").isNotNull())
        tokens = lexer.tokens(live).persist()
        try:
            facts_of = {name: cut(tokens) for name, cut in FACTS.items()}
            facts_of["configs"] = config_entries(live)
            facts_of["files"] = live.select(c("path").alias("file"), "mtime")
            log_store.append(facts_of, newest.select(c("path").alias("file"), c("text").isNull().alias("gone")), target, batch_id)
        finally:
            tokens.unpersist()
        log_store.upkeep(batch.sparkSession, target, merge_after, grace_seconds)

    writer = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def indexed(spark: SparkSession, target: str, tables: list[str]) -> dict[str, DataFrame]:
    """Tables of one snapshot of the index: all of them show the same batches."""
    snap = log_store.snapshot(spark, target)
    return {t: log_store.read(spark, snap, t) for t in tables}


def file_stream(spark: SparkSession, folder: str, schema: str = "path string, text string, mtime timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def event_windows(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts per event-time window with a watermark; an extension, the engine itself has no event time."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
