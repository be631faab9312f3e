"""The log-structured index against a dictionary, with readers that look on while it is merged."""

import random

from pyspark.sql import functions as F

from factloom.sources import log_store as log

TABLES = {"a": "file string, n int", "b": "file string, word string"}


def _tables(spark, versions):
    return {"a": spark.createDataFrame([(f, v) for f, v in versions for _ in range(2)], TABLES["a"]),
            "b": spark.createDataFrame([(f, f"w{v}") for f, v in versions if v % 3], TABLES["b"])}


def _append(spark, target, batch, live, gone):
    marks = spark.createDataFrame([(f, False) for f, _ in live] + [(f, True) for f in gone], "file string, gone boolean")
    log.append(_tables(spark, live), marks, target, batch)


def _rows(spark, snap):
    return [sorted(map(tuple, log.read(spark, snap, t).collect())) for t in TABLES]


def _want(now):
    return [sorted((f, v) for f, v in now.items() for _ in range(2)), sorted((f, f"w{v}") for f, v in now.items() if v % 3)]


def test_batches_merge_into_few_runs(spark, tmp_path):
    rng, now, target = random.Random(4), {}, f"{tmp_path}/index"
    most, seen = 0, None
    for batch in range(27):
        names = rng.sample([f"f{i}" for i in range(20)], rng.randint(1, 4))
        live = [(f, batch) for f in names[:-1]]
        _append(spark, target, batch, live, names[-1:])
        now.update(live)
        now.pop(names[-1], None)
        if batch % 9 == 5:
            seen = log.snapshot(spark, target), dict(now)
        log.upkeep(spark, target, merge_after=4, grace_seconds=0 if batch % 9 != 7 else 3600, ratio=2)
        most = max(most, log.folders(spark, target))
        if batch % 9 in (0, 8):
            assert _rows(spark, log.snapshot(spark, target)) == _want(now)
    assert most <= 20 and seen
    snap = log.merge(spark, target, ratio=10**9)
    assert len(snap.runs) == 1 and not snap.deltas and _rows(spark, snap) == _want(now)
    assert spark.read.parquet(f"{target}/run/{snap.runs[0].name}/{log.MARKS}").filter("gone").count() == 0
    _append(spark, target, 26, [("f0", 999)], [])  # a replay of a merged batch changes nothing
    assert _rows(spark, log.snapshot(spark, target)) == _want(now)


def test_readers_see_one_state_while_it_is_merged(spark, tmp_path):
    target = f"{tmp_path}/index"
    for batch in range(3):
        _append(spark, target, batch, [("x", batch), (f"y{batch}", batch)], [])
    early = log.snapshot(spark, target)
    rows = _rows(spark, early)
    lazy = log.read(spark, early, "a")  # planned before the merge, run after it
    after = log.merge(spark, target)
    _append(spark, target, 3, [("x", 3)], ["y0"])
    assert log.vacuum(spark, target, grace_seconds=3600) == 0
    assert _rows(spark, early) == rows and sorted(map(tuple, lazy.collect())) == rows[0] and _rows(spark, after) == rows
    assert ("x", 3) in _rows(spark, log.snapshot(spark, target))[0]
    assert log.vacuum(spark, target, grace_seconds=0) == 3
    assert _rows(spark, after) == rows and log.snapshot(spark, target).deltas == (3,)


def test_unfinished_parts_are_not_seen(spark, tmp_path):
    target = f"{tmp_path}/index"
    _append(spark, target, 0, [("x", 1)], [])
    _tables(spark, [("x", 2)])["a"].withColumn("batch", F.lit(1).cast("long")).write.parquet(f"{target}/delta/1/a")  # the writer died here
    assert log.snapshot(spark, target).deltas == (0,) and ("x", 1) in _rows(spark, log.snapshot(spark, target))[0]
    _append(spark, target, 1, [("x", 2)], [])
    _tables(spark, [("x", 9)])["a"].withColumn("batch", F.lit(1).cast("long")).write.parquet(f"{target}/run/lost/a")  # and a merge here
    assert ("x", 2) in _rows(spark, log.snapshot(spark, target))[0]
    log.merge(spark, target)
    log.vacuum(spark, target, grace_seconds=0)
    assert log.folders(spark, target) == 2 and ("x", 2) in _rows(spark, log.snapshot(spark, target))[0]


def test_merges_are_geometric():
    snap = log.Snapshot("t", 3, (log.Run("a", 5, 100_000), log.Run("b", 9, 3_000), log.Run("c", 11, 500)), (12,))
    assert [log._merged_runs(snap, n, 4) for n in (10, 200, 700, 30_000)] == [0, 1, 2, 3]
