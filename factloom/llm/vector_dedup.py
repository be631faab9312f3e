"""Near-dedup of vectors by cosine, within labels, by comparing tiles in the order of their principal components.

1. Vectors of one label and equal direction bits form a class, whose smallest id stands for it; copies are never compared.
2. Principal components come from at most SAMPLE classes, those of the smallest digests (the bound is exact work's only sample: it
   sets an order, never a result). Classes are sorted by label, then along a Morton curve of their BOX leading components, by
   ranges, and cut into tiles of at most TILE classes.
3. Tiles of a label whose boxes of leading components lie further apart than vectors of enough cosine can are not paired. Pairs are
   found by equi-joins of the slabs of the first component that a tile covers.
4. In a pair of tiles, the products of the leading components are summed first. With the norms of the rest, they bound the
   cosine; pairs of vectors that can't reach the threshold stop there, the others go on in STEPS. Near the threshold, the cosine of the
   vectors as they came decides.
5. A pair of tiles hands on one row a class that has links: how many, and the smallest class that these links lead to. No pair of
   vectors ever becomes a row. Components follow from those rows, counts are sums of them.

What grows with the square of a label are pairs of tiles whose boxes meet; a pair of vectors in them costs BOX products.

Defined cases: a null label, or a vector that is null, zero, empty, or holds a null or non-finite component, is linked with
nothing; so is a row without id (its component is null, and it is kept). Vectors of different lengths are never linked. Rows that
repeat an id are compared each, and classes with one smallest id count as one in components. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from factloom.llm.components import components
from factloom.session import stored

LIKE = 0.98
SAMPLE = 4096
BOX = 8
BOX_BITS = 7
TILE = 1024
SIDE = 512
STEPS = (8, 16, 32)
#: From this share of open pairs in a block on, all products are summed at once.
DENSE = 0.1
SLICE = 8192
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length without nulls, a row each, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Each row at length 1; the largest component is taken out first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with that row of y."""
    x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v, usable; v keeps its precision."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"),
                          vectors[vector_col].cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    return rows.withColumn("usable", F.coalesce(usable, F.lit(False)))


def _digests(rows: DataFrame) -> DataFrame:
    """rows with key, a digest of label and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for label, v in zip(batch.column(1), batch.column(2), strict=True):
                x = v.values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16, salt=hashlib.md5(label.as_py().encode()).digest()).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "key"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label string, v {kind}, key binary")


def principal_components(classes: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Directions of falling second moment of the most frequent length's unit vectors, a column each; no columns for an empty table."""
    sample = classes.orderBy("key").limit(most).select("v").toArrow().column(0).combine_chunks()
    if not len(sample):
        return np.zeros((0, 0))
    sizes = np.diff(sample.offsets.to_numpy())
    x = unit(_matrix(sample.filter(pa.array(sizes == np.bincount(sizes).argmax()))))
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def rotated(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in the order of the components; vectors of another length stay as they are."""
    x = unit(x)
    return x @ axes if x.shape[1] == len(axes) else x


def _morton(lead: np.ndarray) -> np.ndarray:
    """Place on a Morton curve through the leading components."""
    cells = np.clip((lead + 1) * (1 << BOX_BITS - 1), 0, (1 << BOX_BITS) - 1).astype(np.int64)
    out = np.zeros(len(lead), np.int64)
    for bit in range(BOX_BITS - 1, -1, -1):
        for k in range(lead.shape[1]):
            out = (out << 1) | (cells[:, k] >> bit & 1)
    return out


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of rows that are equal in all columns."""
    n = len(columns[0])
    changed = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    at = np.r_[0, np.flatnonzero(changed) + 1, n] if n else np.zeros(1, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def tiles(classes: DataFrame, axes: np.ndarray, tile: int = TILE) -> DataFrame:
    """Tiles of (label, length): ids, numbers of copies, digests and components of their classes, and their box of leading components."""
    given = classes.sparkSession.sparkContext.broadcast(axes)
    kind = np.float32 if isinstance(classes.schema["v"].dataType.elementType, FloatType) else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            sizes, spot = _lengths(v), np.zeros(batch.num_rows, np.int64)
            for size in np.unique(sizes).tolist():
                own = sizes == size
                spot[own] = _morton(rotated(_matrix(v.filter(pa.array(own))), given.value)[:, :BOX])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(spot)], [*batch.schema.names, "length", "spot"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            x = _matrix(rows.column("v").combine_chunks())
            lead = np.zeros((len(x), BOX))
            lead[:, :min(BOX, x.shape[1])] = rotated(x, given.value)[:, :BOX]
            lists = [pa.array([rows.column(c).to_pylist()], t) for c, t in (("rep", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("key", pa.list_(pa.binary())))]
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([rows.column("label")[0].as_py()], pa.string()), pa.array([x.shape[1]], pa.int32()), *lists,
                pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([lead.min(axis=0)], pa.list_(pa.float64())),
                pa.array([lead.max(axis=0)], pa.list_(pa.float64()))], ["tile", "label", "length", "rep", "n", "key", "body", "low", "high"])

        for batch in batches:
            for at, to in _runs(batch.column("label").to_numpy(zero_copy_only=False), batch.column("length").to_numpy()):
                rows = batch.slice(at, to - at)
                if held and (held[0].column("label")[0] != rows.column("label")[0] or held[0].column("length")[0] != rows.column("length")[0]):
                    yield emit(pa.Table.from_batches(held))
                    held = []
                while rows.num_rows:
                    room = tile - sum(h.num_rows for h in held)
                    held.append(rows.slice(0, room))
                    rows = rows.slice(room)
                    if sum(h.num_rows for h in held) == tile:
                        yield emit(pa.Table.from_batches(held))
                        held = []
        if held:
            yield emit(pa.Table.from_batches(held))

    v = classes.schema["v"].dataType.simpleString()
    spread = classes.mapInArrow(place, f"key binary, label string, rep long, n long, v {v}, length int, spot long")
    spread = spread.repartitionByRange("label", "length", "spot", "key").sortWithinPartitions("label", "length", "spot", "key")
    return spread.mapInArrow(cut, "tile long, label string, length int, rep array<long>, n array<long>, key array<binary>, body binary, "
                                  "low array<double>, high array<double>")


def tile_pairs(cut: DataFrame, like: float = LIKE) -> DataFrame:
    """(a, b), a <= b: tiles of one label and length whose boxes come as near as vectors of enough cosine may lie.

    Unit vectors of cosine c lie sqrt(2 - 2c) apart, and no further in any component. Each tile is listed under the slabs of the
    first component that it covers, and the slab before them; the pair counts in the last of their first slabs only.
    """
    apart = max(2 - 2 * like, 0.0) ** 0.5 + SLACK
    width = max(apart, 0.05)
    slab = lambda x: F.floor((x + 2) / F.lit(width)).cast("int")
    boxes = cut.select("tile", "label", "length", "low", "high", (slab(F.col("low")[0]) - 1).alias("begin"), slab(F.col("high")[0]).alias("end"))
    listed = boxes.withColumn("slab", F.explode(F.sequence("begin", "end"))).drop("end")
    a, b = (listed.select("label", "length", "slab", *[F.col(c).alias(f"{c}_{x}") for c in ("tile", "low", "high", "begin")]) for x in "ab")
    met = a.join(b, ["label", "length", "slab"]).filter("tile_a <= tile_b and slab = greatest(begin_a, begin_b)")
    gap = lambda k: F.greatest(F.lit(0.0), F.col("low_a")[k] - F.col("high_b")[k], F.col("low_b")[k] - F.col("high_a")[k])
    distance = sum((gap(k) * gap(k) for k in range(1, BOX)), gap(0) * gap(0))
    return met.filter(distance <= apart * apart + SLACK).select(F.col("tile_a").alias("a"), F.col("tile_b").alias("b"))


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, like: float = LIKE, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in x, j in y) of rows whose cosine reaches like, block by block; same: of one tile, i < j only."""
    u, v = rotated(x, axes), rotated(y, axes)
    width = u.shape[1]
    steps = [k for k in STEPS if k < width] + [width]
    tails = [[np.sqrt(np.maximum((z[:, k:] ** 2).sum(axis=1), 0)) for k in steps] for z in (u, v)]
    for p in range(0, len(u), SIDE):
        for q in range(p if same else 0, len(v), SIDE):
            a, b = slice(p, p + SIDE), slice(q, q + SIDE)
            product = u[a, :steps[0]] @ v[b, :steps[0]].T
            possible = product + np.outer(tails[0][0][a], tails[1][0][b]) >= like - SLACK
            if same and p == q:
                possible = np.triu(possible, 1)
            i, j = np.nonzero(possible)
            if not len(i):
                continue
            if len(i) > DENSE * possible.size:
                product += u[a, steps[0]:] @ v[b, steps[0]:].T
                value = product[i, j]
            else:
                value = product[i, j]
                for k in range(1, len(steps)):
                    for at in range(0, len(i), SLICE):
                        s = slice(at, at + SLICE)
                        value[s] += np.einsum("ij,ij->i", u[p + i[s], steps[k - 1]:steps[k]], v[q + j[s], steps[k - 1]:steps[k]])
                    open_ = value + tails[0][k][p + i] * tails[1][k][q + j] >= like - SLACK
                    i, j, value = i[open_], j[open_], value[open_]
            good = value >= like + SLACK
            near = np.flatnonzero(np.abs(value - like) <= SLACK)
            for at in range(0, len(near), SLICE):
                s = near[at:at + SLICE]
                good[s] = cosine(x[p + i[s]], y[q + j[s]]) >= like
            if good.any():
                yield p + i[good], q + j[good]


def _settled(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lower the roots of linked places to the smallest that their links lead to, in place."""
    while True:
        least = np.minimum(root[i], root[j])
        before = root.copy()
        for ends in (root[i], root[j]):
            np.minimum.at(root, ends, least)
        while (root[root] != root).any():
            root[:] = root[root]
        if (root == before).all():
            return


def tile_links(pairs: DataFrame, cut: DataFrame, axes: np.ndarray, like: float = LIKE) -> DataFrame:
    """(tile, place, links, rep, root) of the classes that a pair of tiles links: how many vectors, and the smallest id they lead to."""
    given = cut.sparkSession.sparkContext.broadcast(axes)

    def matrix(body: pa.BinaryScalar, rows: int, size: int) -> np.ndarray:
        data = body.as_buffer()
        return np.frombuffer(data, np.float32 if data.size == 4 * rows * size else np.float64).reshape(rows, size).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (a, b, size), lists = (batch.column(k)[r].as_py() for k in range(3)), [batch.column(k)[r] for k in range(3, 9)]
                n_a, n_b, rep_a, rep_b = (x.values.to_numpy() for x in lists[:4])
                x, y = (matrix(z, len(m), size) for z, m in zip(lists[4:], (n_a, n_b), strict=True))
                same, k = a == b, len(x)
                reps, n = (rep_a, n_a) if same else (np.r_[rep_a, rep_b], np.r_[n_a, n_b])
                order = np.argsort(reps, kind="stable")
                turn = np.empty(len(reps), np.int64)
                turn[order] = np.arange(len(reps))
                links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))  # of turns
                for i, j in linked_pairs(x, y, given.value, like, same):
                    s, t = turn[i], turn[j if same else j + k]
                    by_turn = n[order]
                    links += np.bincount(s, by_turn[t], len(reps)).astype(np.int64) + np.bincount(t, by_turn[s], len(reps)).astype(np.int64)
                    _settled(root, s, t)
                found = np.flatnonzero(links)
                if len(found):
                    places = order[found]
                    second = np.zeros(len(places), bool) if same else places >= k
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.where(second, b, a)), pa.array(np.where(second, places - k, places).astype(np.int32)), pa.array(links[found]),
                        pa.array(reps[places]), pa.array(reps[order][root[found]])], ["tile", "place", "links", "rep", "root"])

    x, y = (cut.select(F.col("tile").alias(s), "length", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "rep", "body")]) for s in "ab")
    whole = pairs.join(x, "a").join(y.drop("length"), "b").select("a", "b", "length", "n_a", "n_b", "rep_a", "rep_b", "body_a", "body_b")
    return whole.mapInArrow(run, "tile long, place int, links long, rep long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", like: float = LIKE,
                 tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    rows = usable_rows(vectors, id_col, vector_col, label_col)
    usable = stored(_digests(rows.filter("usable").select("vec_id", "label", "v")), "vectors")
    classes = stored(usable.groupBy("key").agg(F.first("label").alias("label"), F.min("vec_id").alias("rep"), F.count("*").alias("n"),
                                               F.first("v").alias("v")), "classes")
    axes = principal_components(classes)
    cut = stored(tiles(classes, axes, tile), "tiles")
    pairs = stored(tile_pairs(cut, like), "tile-pairs")
    found = stored(tile_links(pairs, cut, axes, like), "tile-links")
    labels = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))

    sums = found.groupBy("tile", "place").agg(F.sum("links").alias("links"))
    members = cut.select("tile", F.posexplode(F.arrays_zip("key", "rep", "n")).alias("place", "m")).select("tile", "place", "m.key", "m.rep", "m.n")
    by_class = members.join(sums, ["tile", "place"], "left").join(labels, F.col("rep") == F.col("node"), "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = usable.select("vec_id", "key").join(by_class, "key").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
