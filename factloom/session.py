"""Session settings and the few cluster-facing helpers the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins, coalesces small shuffles and splits skewed partitions at run time.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "factloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; ``master`` is given only for local runs."""
    builder = SparkSession.builder.appName(app_name)
    settings = dict(ENGINE_CONF)
    if master:
        builder = builder.master(master)
        settings.update({
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        })
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a local one only where none is named on a local master."""
    conf = spark.sparkContext.getConf()
    shared = spark.sparkContext.getCheckpointDir() or conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="factloom-shared-")
        spark.sparkContext.setCheckpointDir(shared)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return shared


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative operators survive executor loss and keep short plans."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table written once to the shared folder: columnar, with sizes Spark can plan by, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _mounted(spark: SparkSession, folder: str) -> str | None:
    """The path under which executors see a shared folder as files; None where it is no such folder."""
    at = urlsplit(folder)
    if not at.scheme and not (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
        return None
    return {"file": unquote(at.path), "": folder}.get(at.scheme)


ROWS_PER_GROUP = 100_000
Batches = Iterator[pa.RecordBatch]


def stored_batches(df: DataFrame, make: Callable[[Batches], Batches], schema: str, what: str) -> DataFrame:
    """``stored`` of the rows that ``make`` has of the batches of ``df``, for rows so wide that handing them to the JVM value by value
    costs more than making them: each task writes its batches to a file as they are.

    A run of a task writes a file of its own and names it when it is whole. Spark takes the result of one run of every task, so the table
    is exactly the files it was told of; those of failed or repeated runs are never read. Where the shared folder isn't mounted, Spark writes.
    """
    spark = df.sparkSession
    folder = _mounted(spark, shared_dir(spark))
    if folder is None:
        return stored(df.mapInArrow(make, schema), what)
    folder = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def write(batches: Batches) -> Batches:
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        writer, waiting, rows = None, [], 0
        for batch in make(batches):
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= ROWS_PER_GROUP:
                writer = _append(writer, name, waiting)
                waiting, rows = [], 0
        if rows:
            writer = _append(writer, name, waiting)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"name": [name]})

    names = [r["name"] for r in df.mapInArrow(write, "name string").collect()]
    if not names:
        return stored(spark.createDataFrame([], schema), what)
    return spark.read.schema(schema).parquet(*(f"file://{quote(x)}" for x in names))


def _append(writer: pq.ParquetWriter | None, name: str, batches: list[pa.RecordBatch]) -> pq.ParquetWriter:
    rows = pa.Table.from_batches(batches)
    if writer is None:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        writer = pq.ParquetWriter(name, rows.schema, compression="zstd", compression_level=1)
    writer.write_table(rows)
    return writer


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the code base. Spark guesses what a scan holds from the size of its files, and rows with many
    equal values take a small part of their size there: what it takes for 10 MB can fill the driver's memory when it is broadcast."""
    return df.hint("merge")


SPREAD_BELOW = 64


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of very few splits enough tasks for CPU-heavy row work.

    Only a small table has fewer splits than this; a large one is never shuffled for it.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, SPREAD_BELOW)
    if df.rdd.getNumPartitions() < wanted:
        return df.repartition(wanted)
    return df


FILES_PER_TASK = 5_000


def dealt(df: DataFrame, rows: int, per_task: int = FILES_PER_TASK) -> DataFrame:
    """Narrow rows that become much larger in their task, dealt by their number: the bytes and splits of the input say nothing of it.

    A task gets at most ``per_task`` of about ``rows`` rows, and a small table a task for every core up to ``SPREAD_BELOW``.
    """
    return df.repartition(max(min(df.sparkSession.sparkContext.defaultParallelism, SPREAD_BELOW), -(-rows // per_task)))


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Parquet table of a data folder; the shape every registered query starts from."""
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
