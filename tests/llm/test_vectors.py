"""Vector dedup, vector codes and importance resampling against plain loops, and on unusual tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from factloom.llm import importance, queries, vector_codes, vector_dedup  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, n_links int, v string, row int, key string, component_id long"


def _groups(vectors, like):
    """(n_links, component) of (id, vector, label) with unique ids, by comparing all pairs."""
    n = len(vectors)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def usable(i):
        v = vectors[i][1]
        return v and vectors[i][2] is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    arrays = [np.array(v[1], float) if usable(i) else None for i, v in enumerate(vectors)]
    for i in range(n):
        for j in range(i):
            x, y = arrays[i], arrays[j]
            if x is None or y is None or vectors[i][2] != vectors[j][2] or len(x) != len(y):
                continue
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= like:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), vectors[i][0]), vectors[i][0])
    return {vectors[i][0]: (links[i], least[find(i)]) for i in range(n)}


def _planted(seed=5, dims=24):
    """A group of near copies of one vector, chains just over and under the threshold, copies, and vectors of all kinds."""
    rng = np.random.default_rng(seed)
    rows = [list(v) for v in rng.normal(size=(150, dims))]
    base = rng.normal(size=dims)
    rows += [list(base + rng.normal(size=dims) * 0.02) for _ in range(120)]
    for step in (0.19, 0.2005, 0.21):  # chords round the threshold
        v = base / np.linalg.norm(base)
        for _ in range(12):
            side = rng.normal(size=dims)
            side -= side @ v * v
            angle = 2 * math.asin(step / 2)
            v = math.cos(angle) * v + math.sin(angle) * side / np.linalg.norm(side)
            rows.append(list(v * rng.uniform(0.01, 50)))
    rows += [rows[3], rows[3], [2 * x for x in rows[3]], [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1),
             [], None, rows[5][:8], rows[5][:8], [1e-30 * x for x in rows[5]], [1e30 * x for x in rows[5]], [-x for x in rows[5]]]
    order = random.Random(seed).sample(range(len(rows)), len(rows))
    label = random.Random(seed + 1)
    return [(int(i) * 3, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label.choice([1, 1, 1, 2, None]))
            for i, v in zip(order, rows, strict=True)]


@pytest.mark.parametrize("tile", [7, vector_dedup.TILE])
def test_vector_dedup_brute_force(spark, tile):
    rows = _planted()
    table = spark.createDataFrame([(*r, 1, "x", 2, "k", 5) for r in rows], VECTORS).repartition(5)
    want = _groups([(i, v, k) for i, v, k in rows], vector_dedup.LIKE)
    found = vector_dedup.near_vectors(table, tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want and len(found) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert max(n for n, _ in want.values()) > 60 and sum(n > 0 for n, _ in want.values()) > 100


def test_vector_dedup_odd_tables(spark):
    table = spark.createDataFrame([(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [9.0, -2.0], 1), (2, [1.0, 2.01], 1), (7, [9.0, -2.0], 2)],
                                  "vec_id long, embedding array<double>, label int")
    found = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(table).collect())
    assert found == [((False, 2), 2, 2, True), ((False, 4), 0, 2, False), ((False, 4), 2, 2, False), ((False, 4), 2, 2, False), ((False, 7), 0, 7, True),
                     ((True, 0), 0, None, True)]
    assert vector_dedup.near_vectors(table.limit(0)).count() == 0
    assert vector_dedup.near_vectors(table.filter("vec_id = 7")).first().kept


def test_blocks_of_vectors_equal_all_pairs():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(700, 40)), rng.normal(size=40) + rng.normal(size=(700, 40)) * 0.1])
    x = x[rng.permutation(len(x))]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    u = vector_dedup.unit(x)
    for like in (0.98, 0.995, 0.5):
        for y, same in ((x, True), (x[:600], False)):
            c = u @ vector_dedup.unit(y).T
            want = np.triu(c >= like, 1) if same else c >= like
            found = np.zeros(want.shape, int)
            for i, j in vector_dedup.linked_pairs(x, y, axes, like, same):
                np.add.at(found, (i, j), 1)
            assert (found == want).all() and want.any()


def test_tile_pairs_lose_no_link(spark):
    rows = [(i, v, 1) for i, (_, v, _) in enumerate(_planted(9)) if v and len(v) == 24 and None not in v and all(map(math.isfinite, v)) and any(v)]
    classes = spark.createDataFrame([(str(i).encode(), "1", i, 1, v) for i, v, _ in rows], "key binary, label string, rep long, n long, v array<double>")
    axes = vector_dedup.principal_components(classes)
    cut = vector_dedup.tiles(classes, axes, 8).cache()
    assert sorted(x for r in cut.collect() for x in r.rep) == [i for i, _, _ in rows]
    met = {(r.a, r.b) for r in vector_dedup.tile_pairs(cut).collect()}
    tile_of = {x: r.tile for r in cut.collect() for x in r.rep}
    u = vector_dedup.unit(np.array([v for _, v, _ in rows]))
    pairs = np.argwhere(np.triu(u @ u.T >= vector_dedup.LIKE, 1))
    assert len(pairs) > 1000 and len(met) < len(set(tile_of.values())) ** 2 / 2
    assert all(tuple(sorted((tile_of[rows[i][0]], tile_of[rows[j][0]]))) in met for i, j in pairs)


def _codes(rows, parts, entries, rounds, scale):
    """vec_id: code, error, and the digest, by plain integers."""
    rows = sorted((i, [math.floor(scale * x) for x in v]) for i, v, _ in rows)
    width = len(rows[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            by = {}
            for c in cut:
                by.setdefault(near(c[p], p)[1], []).append(c[p])
            for k, own in by.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = {}
    for (i, _), c in zip(rows, cut, strict=True):
        found = [near(c[p], p) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
    text = ",".join(str(x) for p in books for e in p for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def test_vector_codes_brute_force(spark):
    rng = random.Random(2)
    rows = [(i * 7 % 211, [rng.choice([-0.75, -0.2, 0.0, 0.1, rng.gauss(0, 0.3)]) for _ in range(12)], rng.choice([1, 2, None])) for i in range(211)]
    rows = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    odd = [(900, None, 1), (901, [float("nan")] * 12, 1), (902, [None] * 12, 1), (903, [float("-inf")] + [0.0] * 11, 1), (904, [1.0] * 9, 1), (905, [], 2)]
    table = spark.createDataFrame([(*r, 1, "x", 2, "k", 5) for r in rows + odd], VECTORS).repartition(4)
    for parts, entries, rounds in ((4, 5, 6), (3, 16, 2), (1, 1, 1)):
        want, digest = _codes(rows, parts, entries, rounds, 4096)
        found = vector_codes.vector_codes(table, parts=parts, entries=entries, rounds=rounds).collect()
        assert {r.vec_id: (r.code, r.error) for r in found} == want and {r.codebooks_sha256 for r in found} == {digest}
        label = {i: k for i, _, k in rows}
        by_label = Counter()
        for i, (_, e) in want.items():
            by_label[label[i]] += e
        assert all(r.label_error == by_label[label[r.vec_id]] for r in found)


def test_vector_codes_odd_tables(spark):
    table = spark.createDataFrame([(5, [0.5] * 8, None), (5, [0.5] * 8, 1), (None, [1e300] * 8, 1), (1, [-1e300] * 8, 2)], "vec_id long, embedding array<double>, label int")
    found = vector_codes.vector_codes(table).collect()
    assert len(found) == 4 and {r.error for r in found} == {0}
    assert vector_codes.vector_codes(table.limit(0)).count() == 0
    assert vector_codes.vector_codes(table.select("vec_id", "label", table.embedding[0].alias("x")).selectExpr("vec_id", "label", "array(x) as embedding")).count() == 0


@pytest.mark.parametrize("width", [1, 5])
def test_trie_walk_equals_plain_distances(width):
    rng = np.random.default_rng(4)
    for n, values in ((0, 3), (1, 3), (9000, 3), (9000, 10**6)):
        parts, _, _ = vector_codes.distinct_parts(rng.integers(-values, values, size=(n, width)))
        entries = rng.integers(-values, values, size=(6, width))
        code, error = vector_codes.nearest_entries(parts, entries)
        far = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _resampled(docs, target, longest, buckets, percent, least, seed):
    def runs(text):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    source, wanted = Counter(), Counter()
    for _, t in docs:
        source.update(runs(t)[1])
    for t in target:
        wanted.update(runs(t)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    out = []
    for i, t in docs:
        w, found = runs(t)
        weight = sum(math.floor(1000 * math.log(float((wanted[b] + 1) * (s_all + buckets)) / float((source[b] + 1) * (t_all + buckets)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((r[:5] for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_importance_brute_force(spark, longest):
    rng = random.Random(longest)
    vocabulary = ["Stone", "river", "é", "日本", "x1", "don't", "a--b", "seven", "0", "\u0085", "ÀB", "light"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 19, 20, 40, 300])))) for i in range(300)]
    docs += [(1000, None), (1001, "\x00\x7f ~"), (1002, "z" * 5000), (1003, "river " * 4000), (None, "river stone " * 30)]
    target = [" ".join(rng.choice(vocabulary[:4]) for _ in range(30)) for _ in range(20)] + [None, ""]
    table = spark.createDataFrame([(*d, 1, "w", 2) for d in docs], "doc_id long, text string, rank int, score string, row int").repartition(6)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    found = importance.resample(table, wanted, longest=longest, buckets=97, percent=30)
    assert sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in found.collect()), key=str) == _resampled(docs, target, longest, 97, 30, 20, 2024)


def test_importance_odd_tables(spark):
    table = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "word " * 25), (2, "word " * 25), (3, None)], "doc_id long, text string")
    found = importance.resample(table, table.limit(0), percent=100).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2] and sorted(r.n_features for r in found) == [0, 3, 3, 25, 25]
    assert importance.resample(table.limit(0), table).count() == 0


def test_words_are_the_same_in_pieces(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(["a", "B", "é", " ", ".", "日", "\n", "xyz"]) for _ in range(3000)) + "q" * 500 + " tail"
    want = [w.encode() for w in WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    whole = sum(importance.run_hashes(text.encode(), 3), Counter())
    for piece in (1, 7, 64, 10**6):
        monkeypatch.setattr(importance, "PIECE", piece)
        assert [w for p in importance.word_pieces(text.encode()) for w in p] == want
        assert sum(importance.run_hashes(text.encode(), 3), Counter()) == whole


def test_registered_with_their_parameters():
    assert {"op11_embedding_near_dedup", "op12_vector_code_compression", "op13_importance_resampling"} <= set(queries.ORACLES)
    assert (vector_dedup.LIKE, vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS, vector_codes.SCALE) == (0.98, 8, 16, 6, 4096)
    assert (importance.BUCKETS, importance.RUN, importance.LEAST_WORDS, importance.PERCENT, importance.SEED) == (10_000, 1, 20, 10, 2024)
