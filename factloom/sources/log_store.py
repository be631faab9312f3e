"""A log-structured index: small batches are appended, merged into runs, and old files removed after a grace time.

``delta/<batch>`` holds the tables of a micro-batch and, written last, its marks: which files the batch is about, and which of them are
gone. ``run/<name>`` holds the same for a range of batches, each file in its newest version only. ``state/<number>`` is one row that
names the runs and the last batch they hold; the highest number counts. A reader takes a snapshot of one state and the finished
deltas after it, and reads nothing else, whatever is merged meanwhile.

A merge takes the deltas and as many of the last runs as are at most ``RATIO`` times as large, so a row is rewritten a
logarithmic number of times and there are logarithmically many runs. Tables are dealt by the hash of the file when merged, so a
merge of one table is one shuffle. There is one writer; a batch written again replaces itself, or is left out once it is merged.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATIO = 4
MERGE_AFTER = 8
GRACE_SECONDS = 3600.0
MARKS = "_files"

c = F.col


@dataclass(frozen=True)
class Run:
    name: str
    last_batch: int
    files: int


@dataclass(frozen=True)
class Snapshot:
    """One state and the finished deltas after it."""

    target: str
    number: int
    runs: tuple[Run, ...]
    deltas: tuple[int, ...]

    def parts(self) -> list[str]:
        return [f"{self.target}/run/{r.name}" for r in self.runs] + [f"{self.target}/delta/{b}" for b in self.deltas]


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark reads; none if it isn't there."""
    fs, at = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _finished(spark: SparkSession, path: str) -> bool:
    fs, at = _folder(spark, f"{path}/{MARKS}/_SUCCESS")
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def _states(spark: SparkSession, target: str) -> list[tuple[int, float, list[Run], int]]:
    """(number, time written, runs, last merged batch) of every state that is there, oldest first."""
    numbers = sorted(int(n) for n in _names(spark, f"{target}/state") if n.isdigit())
    if not numbers:
        return []
    rows = spark.read.schema("number long, written double, last_batch long, runs array<struct<name: string, last_batch: long, files: long>>").parquet(
        *[f"{target}/state/{n}" for n in numbers]).collect()
    return sorted((r["number"], r["written"], [Run(*x) for x in r["runs"]], r["last_batch"]) for r in rows)


def snapshot(spark: SparkSession, target: str) -> Snapshot:
    """What a reader sees from now on."""
    states = _states(spark, target)
    number, _, runs, last = states[-1] if states else (0, 0.0, [], -1)
    later = sorted(int(n) for n in _names(spark, f"{target}/delta") if n.isdigit() and int(n) > last)
    return Snapshot(target, number, tuple(runs), tuple(b for b in later if _finished(spark, f"{target}/delta/{b}")))


def append(tables: dict[str, DataFrame], marks: DataFrame, target: str, batch: int) -> None:
    """Add a batch: ``marks`` has (file, gone) for every file it is about, each table a ``file`` column. The marks come last."""
    spark = marks.sparkSession
    states = _states(spark, target)
    if states and batch <= states[-1][3]:
        return
    _write({**tables, MARKS: marks.select("file", "gone")}, f"{target}/delta/{batch}", batch)


def _write(tables: dict[str, DataFrame], path: str, batch: int | None = None) -> None:
    order = [t for t in tables if t != MARKS] + [MARKS]
    delete(tables[MARKS].sparkSession, f"{path}/{MARKS}")  # a part written again is unfinished until its marks are
    for name in order:
        df = tables[name] if batch is None else tables[name].withColumn("batch", F.lit(batch).cast("long"))
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def _union(spark: SparkSession, parts: Iterable[str], table: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/{table}") for p in parts])


def _newest(marks: DataFrame) -> DataFrame:
    return marks.groupBy("file").agg(F.max("batch").alias("batch"), F.max_by("gone", "batch").alias("gone"))


def read(spark: SparkSession, snap: Snapshot, table: str) -> DataFrame:
    """Rows of the newest version of every file that isn't gone; a plain read where one run holds all."""
    parts = snap.parts()
    if not parts:
        raise LookupError(f"nothing is stored at {snap.target}")
    if len(parts) == 1 and snap.runs:
        return spark.read.parquet(f"{parts[0]}/{table}").drop("batch")
    live = _newest(_union(spark, parts, MARKS)).filter(~c("gone"))
    return _union(spark, parts, table).join(live.select("file", "batch"), ["file", "batch"], "left_semi").drop("batch")


def _merged_runs(snap: Snapshot, files: int, ratio: int) -> int:
    """How many of the last runs go into the next one."""
    taken = 0
    for run in reversed(snap.runs):
        if run.files > ratio * files:
            break
        files += run.files
        taken += 1
    return taken


def merge(spark: SparkSession, target: str, ratio: int = RATIO) -> Snapshot:
    """Merge the deltas, and the runs that are not much larger, into one run; the state that names it is written last."""
    snap = snapshot(spark, target)
    if not snap.deltas:
        return snap
    deltas = [f"{target}/delta/{b}" for b in snap.deltas]
    taken = _merged_runs(snap, _union(spark, deltas, MARKS).count(), ratio)
    stay = snap.runs[:len(snap.runs) - taken]
    parts = [f"{target}/run/{r.name}" for r in snap.runs[len(stay):]] + deltas
    marks = _newest(_union(spark, parts, MARKS))
    if not stay:  # nothing older is left that a mark of a vanished file would hide
        marks = marks.filter(~c("gone"))
    name = uuid.uuid4().hex
    path = f"{target}/run/{name}"
    live = marks.filter(~c("gone")).select("file", "batch")
    tables = [t for t in _names(spark, parts[-1]) if t != MARKS]
    _write({**{t: _union(spark, parts, t).join(live, ["file", "batch"], "left_semi").repartition("file").sortWithinPartitions("file") for t in tables}, MARKS: marks}, path)
    runs = [*stay, Run(name, snap.deltas[-1], spark.read.parquet(f"{path}/{MARKS}").count())]
    _announce(spark, target, snap.number + 1, runs, snap.deltas[-1])
    return snapshot(spark, target)


def _announce(spark: SparkSession, target: str, number: int, runs: list[Run], last: int) -> None:
    rows = [(number, time.time(), last, [(r.name, r.last_batch, r.files) for r in runs])]
    spark.createDataFrame(rows, "number long, written double, last_batch long, runs array<struct<name: string, last_batch: long, files: long>>").coalesce(
        1).write.parquet(f"{target}/state/{number}")


def vacuum(spark: SparkSession, target: str, grace_seconds: float = GRACE_SECONDS) -> int:
    """Delete what the newest state doesn't name and hasn't been named for the grace time; says how many folders went.

    A folder is out of use from the state on that first leaves it out: readers that took a snapshot before have the grace time.
    """
    states = _states(spark, target)
    if not states:
        return 0
    now, gone = time.time(), []
    number, written, runs, last = states[-1]
    named = {r.name for r in runs}
    out_since: dict[str, float] = {}
    for k, (_, at, own, _) in enumerate(states):
        names = {r.name for r in own}
        for earlier in states[:k]:
            for r in earlier[2]:
                if r.name not in names:
                    out_since.setdefault(f"run/{r.name}", at)
    for b in _names(spark, f"{target}/delta"):
        if b.isdigit() and int(b) <= last:
            out_since[f"delta/{b}"] = next(at for _, at, _, upto in states if upto >= int(b))
    for r in _names(spark, f"{target}/run"):
        if r not in named:  # of a merge that never ended, or of a state that is deleted already
            out_since.setdefault(f"run/{r}", written)
    for k, (n, *_) in enumerate(states[:-1]):
        out_since[f"state/{n}"] = states[k + 1][1]
    for path, since in out_since.items():
        if now - since >= grace_seconds:
            gone.append(path)
    for path in sorted(gone, key=lambda p: not p.startswith("state/")):  # states first: none may name what is gone
        delete(spark, f"{target}/{path}")
    return len(gone)


def upkeep(spark: SparkSession, target: str, merge_after: int = MERGE_AFTER, grace_seconds: float = GRACE_SECONDS, ratio: int = RATIO) -> None:
    """What the writer calls after a batch: merge when enough deltas lie there, then remove what is long out of use."""
    if len(snapshot(spark, target).deltas) >= merge_after:
        merge(spark, target, ratio)
        vacuum(spark, target, grace_seconds)


def folders(spark: SparkSession, target: str) -> int:
    """How many batches, runs and states lie in an index."""
    return sum(len(_names(spark, f"{target}/{kind}")) for kind in ("delta", "run", "state"))
