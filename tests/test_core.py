"""Unit checks of scoring, budgets, diffs, streaming and storage on small data."""

import math
import os
import random
import tempfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import lexer, text
from factloom.operators import diff, graph, patterns, ranking, workflows
from factloom.plans import routing
from factloom.session import cut_lineage
from factloom.sources import files as src
from factloom.sources import store
from factloom.sources.configs import config_entries
from factloom.streaming import incremental


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["alpha", "alphabet"]), (2, ["beta"]), (3, [])], "id int, t array<string>")
    out = {r["id"]: r["score"] for r in ranking.score_fielded(docs, ["alpha"], {"t": 2.0}).collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    norm = 0.25 + 0.75 * 2 / 1.0
    assert set(out) == {1} and abs(out[1] - idf * 1.5 * 2.2 / (1.5 + 1.2 * norm) * 2) < 1e-9


def test_round_half_up(spark):
    assert spark.range(1).select(text.round_half_up(F.lit(-1.5)), text.round_half_up(F.lit(2.5))).first() == (-1, 3)


def test_coalesce_closed_form(spark):
    random.seed(3)
    data = [(g, i, random.randint(0, 30)) for g in range(6) for i in range(random.randint(1, 7))]
    df = spark.createDataFrame(data, "g int, i int, score long").select(
        F.col("g").cast("string").alias("file"), F.lit(1).alias("line"), "i", F.lit("s").alias("symbol"), F.lit(None).cast("string").alias("matched"),
        F.lit("usage").alias("candidate_type"), F.lit("x").alias("kind"), F.lit("doc").alias("src"), F.col("i").alias("col"), F.lit("s").alias("name"),
        "score", F.array(F.lit("e")).alias("evidence"), F.array(F.lit("doc")).alias("sources"))
    got = {r["file"]: r["score"] for r in ranking.coalesce_candidates(df, order=[F.col("i")]).collect()}
    for g in range(6):
        acc = None
        for _, _, s in sorted(x for x in data if x[0] == g):
            acc = s if acc is None else max(acc, s) + 2
        assert got[str(g)] == acc


def test_first_fit_against_loop(spark):
    random.seed(5)
    data = [(k, o, random.randint(1, 60)) for k in range(4) for o in random.sample(range(20000), 120)]
    df = spark.createDataFrame(data, "k int, o long, cost long")
    got = {(r["k"], r["o"]): r["taken"] for r in graph.first_fit(df, ["k"], "o", "cost", 300).collect()}
    for k in range(4):
        used = 0
        for _, o, cost in sorted(x for x in data if x[0] == k):
            take = used + cost <= 300
            used += cost if take else 0
            assert got[k, o] == take


def _greedy(costs, budget):
    left, out = budget, []
    for cost in costs:
        out.append(cost is not None and cost <= left)
        left -= cost if out[-1] else 0
    return out


@pytest.mark.parametrize("budget", [0, 1, 1000])
def test_first_fit_rounds_follow_the_budget_not_the_items(spark, budget, monkeypatch):
    """Items that each overflow what is left by one, zero and missing costs, one key with most rows."""
    rng = random.Random(budget)
    stairs = [x for i in range(400) for x in (1, 1000 - i)]
    lists = {"stairs": stairs, "hot": [rng.randint(0, 9) for _ in range(9000)], "large": [1001, 1000, 1], "missing": [None, 500, None, 500, 1], "none": [2000]}
    df = spark.createDataFrame([(k, o, x) for k, costs in lists.items() for o, x in enumerate(costs)], "k string, o long, cost long")
    cuts = []
    monkeypatch.setattr(graph, "cut_lineage", lambda d: cuts.append(1) or cut_lineage(d))
    got = {}
    for r in graph.first_fit(df, ["k"], "o", "cost", budget).orderBy("k", "o").collect():
        got.setdefault(r["k"], []).append(r["taken"])
    assert got == {k: _greedy(costs, budget) for k, costs in lists.items()}
    assert len(cuts) <= 2 + budget.bit_length()


def test_first_fit_of_nothing(spark):
    assert graph.first_fit(spark.createDataFrame([], "k string, o long, cost long"), ["k"], "o", "cost", 9).count() == 0


def test_walk_with_cycle_and_fan_out(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e"), ("e", "f")], "src string, dst string")
    seeds = spark.createDataFrame([("s", "a")], "seed string, node string")
    got = {(r["node"], r["depth"]) for r in graph.walk(edges, seeds, 2).collect()}
    assert got == {("a", 0), ("b", 1), ("d", 1), ("c", 2), ("e", 2)}
    assert {r["node"] for r in graph.walk(edges, seeds, 1, fan_out=1).collect()} == {"a", "b"}


def test_prefix_pairs_equal_brute_force(spark):
    left, right = ["ab", "abc", "x", "yz"], ["a", "ab", "abcd", "xy", "q"]
    got = {(r["term"], r["tok"]) for r in ranking.prefix_pairs(
        spark.createDataFrame([(x,) for x in left], "term string"), spark.createDataFrame([(x,) for x in right], "tok string")).collect()}
    assert got == {(a, b) for a in left for b in right if a.startswith(b) or b.startswith(a)}


def test_routing_vectors(spark):
    want = {
        "useEffect that returns a cleanup callback conditionally": ("structural", {"identifier", "structural", "regex"}),
        "where do we validate permissions": ("behavior", {"behavior", "doc"}),
        "where is Promise.all used": ("identifier", {"identifier"}),
        "switch without default": ("structural", {"structural"}), "await inside loop": ("structural", {"structural"}),
    }
    df = spark.createDataFrame([(q,) for q in want], "query string")
    for r in routing.route(df).select("query", "mode", "retrievers").collect():
        assert (r["mode"], set(r["retrievers"])) == want[r["query"]]


def test_hunks_and_diff_parser(spark):
    base = spark.createDataFrame([("a", "1\n2\n3\n4"), ("b", "x"), ("gone", "z")], "path string, text string")
    head = spark.createDataFrame([("a", "1\n9\n3"), ("b", "x")], "path string, text string")
    got = {(r["file"], r["start_line"], r["end_line"], r["kind"]) for r in src.changed_hunks(base, head).collect()}
    assert ("a", 2, 2, "replace") in got and ("a", 4, 4, "delete") in got and any(g[0] == "gone" for g in got)
    d = spark.createDataFrame([(1, "+++ b/src/x.ts\n@@ -1 +2,3 @@ f\n+a\n@@ -9,2 +12,0 @@\n+++ b/y.ts\n@@ -1 +1 @@")], "id int, diff string")
    assert {(r["file"], r["start_line"], r["end_line"]) for r in src.parse_unified_diff(d).collect()} == {
        ("src/x.ts", 2, 4), ("src/x.ts", 12, 12), ("y.ts", 1, 1)}


def test_pick_diagnostic_tiers(spark):
    diags = spark.createDataFrame([("f", 5, 0, 1, "A", "m"), ("f", 9, 0, 1, "B", "m"), ("f", 1, 0, 2, "W", "m")],
                                  "file string, line int, col int, severity int, code string, message string")
    t = spark.createDataFrame([(1, "f", 50, "B"), (2, "f", 9, None), (3, "f", 7, None), (4, "f", 30, None)], "target int, file string, line int, code string")
    got = {r["target"]: (r["tier"], r["line"]) for r in workflows.pick_diagnostic(t, diags).collect()}
    assert got == {1: (0, 9), 2: (1, 9), 3: (2, 5), 4: (3, 5)}


def test_type_change(spark):
    f = lambda a, b: spark.range(1).select(diff.type_change(F.lit(a), F.lit(b))).first()[0]
    assert [f("string", "string | number"), f("a | b", "a"), f("a|b", "b | a"), f("a", "b")] == ["widening", "narrowing", "equivalent", "incompatible"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab(){}[];'\"`$/\\\n*.,=> ", max_size=60))
def test_token_cutter_never_fails(body):
    rows = list(lexer.token_rows("a.tsx", body, everything=True))
    assert all(r[4] >= 1 for r in rows)


def test_lexer_edges():
    names = [n for n, _ in lexer._FIELDS]
    src_text = "const a = `x${ f({b: 1}) }y` + /[/}]/.test(q)\nexport const g = <T,>(x: T): x is Foo => x\nexport const h = 1"
    rows = [dict(zip(names, r)) for r in lexer.token_rows("m.ts", src_text)]
    assert [r["text"] for r in rows if r["node"] == "call"] == ["f", "test"]
    arrow = next(r for r in rows if r["node"] == "arrow")
    assert arrow["ann"] == "g" and arrow["ret"] == "x is Foo"
    assert not list(lexer.token_rows("e.ts", ""))


def test_store_and_stream(spark):
    root = tempfile.mkdtemp(prefix="factloom-test-")
    store.save({"t": spark.range(3)}, f"{root}/idx", "scope")
    assert store.load(spark, f"{root}/idx", "scope")["t"].count() == 3 and store.load(spark, f"{root}/idx", "other") is None
    store.clear(spark, f"{root}/idx")
    assert store.load(spark, f"{root}/idx", "scope") is None
    schema = "path string, text string, mtime timestamp"
    put = lambda rows: spark.createDataFrame(rows, "path string, text string, m long").select("path", "text", F.timestamp_seconds("m").alias("mtime")).write.mode(
        "append").parquet(f"{root}/in")
    run = lambda: incremental.index_stream(incremental.file_stream(spark, f"{root}/in", schema), f"{root}/out", f"{root}/ck").awaitTermination()
    put([("a.ts", "export const one = 1;", 1), ("b.ts", "export const two = 2;", 1)])
    run()
    put([("a.ts", "export const three = f(3);", 2)])
    run()
    rows = lambda table: incremental.indexed(spark, f"{root}/out", [table])[table].collect()
    assert {(r["file"], r["symbol"]) for r in rows("declarations")} == {("a.ts", "three"), ("b.ts", "two")}
    assert [r["identifier"] for r in rows("usages")] == ["f"]
    put([("b.ts", None, 3), ("app.json", '{"a": {"b": 1}}', 3)])
    run()
    assert [r["name"] for r in rows("exports")] == ["three"]
    assert {r["file"] for r in rows("declarations")} == {"a.ts"}
    assert [r["key_path"] for r in rows("configs")] == [["a", "b"]]


def test_stored_index_has_one_version(spark):
    root = tempfile.mkdtemp(prefix="factloom-test-")
    store.save({"t": spark.range(3)}, root, "scope")
    old = store.load(spark, root, "scope")
    store.save({"t": spark.range(5), "u": spark.range(1)}, root, "scope")
    assert old["t"].count() == 3 and store.load(spark, root, "scope")["t"].count() == 5
    store.save({"t": spark.range(7)}, root, "other")
    assert store.load(spark, root, "scope")["t"].count() == 5 and store.load(spark, root, "other")["t"].count() == 7
    store.save({"t": spark.range(6)}, root, "scope")
    assert len([n for n in os.listdir(root) if n != "_manifest"]) == 3  # two of one scope, one of the other
    store.clear(spark, root)
    assert not os.path.exists(root)
    assert store.load(spark, f"{root}/none", "scope") is None


def test_nothing_is_left_out_by_depth_or_size(spark):
    deep = "/".join(f"d{i}" for i in range(12)) + "/m.ts"
    nested = '{"k":' * 10 + "7" + "}" * 10
    files = spark.createDataFrame([(deep, "export const a = 1;"), ("big.ts", "//" + "x" * 600_000), ("conf/a/b/c/d/e/x.json", nested),
                                   ("y.json", '{"flat": [1, {"z": null}]}')], "path string, text string")
    assert {r["path"] for r in src.in_scope(files).collect()} == {deep, "big.ts"}
    assert src.in_scope(files, max_bytes=500_000).count() == 1 and src.in_scope(files, max_depth=8).count() == 1
    found = {(len(r["key_path"]), r["text"].split(": ")[1]) for r in config_entries(files).collect()}
    assert found == {(10, "7"), (2, "1")}


def test_stale_files(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, mtime int")
    new = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("d", 1, False)], "path string, mtime int, dirty boolean")
    assert {tuple(r) for r in incremental.stale_files(old, new).collect()} == {("b", "extract"), ("c", "drop"), ("d", "extract")}


def test_context_window_equals_cut(spark):
    body = "a\nb\nc\nd"
    df = spark.createDataFrame([("f", body)], "path string, text string")
    from factloom.operators.facts import file_lines

    by_window = {r["line"]: r["context"] for r in patterns.context_window(file_lines(df), 1).collect()}
    cut = df.select(patterns.snippet_of(F.col("text"), F.lit(2))[1].alias("x")).first()["x"]
    assert by_window[2] == cut == "1: a\n2: b\n3: c"


def test_hot_key_budget_uses_chunks(spark):
    df = spark.range(20000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.lit(1).alias("c"))
    out = graph.prefix_sum(df, ["k"], "o", "c", "s")
    assert out.filter("s <> o + 1").count() == 0
    assert out.select(F.floor(F.col("o") / graph.CHUNK)).distinct().count() > 1


def test_gather_context_classes(spark):
    edges = spark.createDataFrame([("a.ts", "b.ts"), ("a.ts", "b.test.ts"), ("b.ts", "c.ts")], "src string, dst string")
    files = spark.createDataFrame([("a.ts", 40), ("b.ts", 30), ("c.ts", 10), ("b.test.ts", 5)], "path string, cost long")
    seeds = spark.createDataFrame([("q", "a.ts")], "seed string, node string")
    got = {r["node"]: (r["class"], r["taken"]) for r in graph.gather_context(edges, seeds, files, max_tokens=60).collect()}
    assert got == {"a.ts": ("must-modify", True), "b.ts": ("verify-only", False), "c.ts": ("skip", False), "b.test.ts": ("skip", False)}


def test_hints_and_next_steps(spark):
    d = spark.createDataFrame([("TS2345", "props differ"), ("TS2345", "other")], "code string, message string")
    assert [r["hint"] for r in workflows.cause_hints(d).collect()] == ["react-prop-type-mismatch", None]
    step = spark.createDataFrame([("param_required: pay", "a.ts"), (None, "b.ts")], "x string, f string").select(
        workflows.next_step(F.col("x"), F.col("f")).alias("s")).collect()
    assert step[0]["s"] == "Callers of `pay` may lack an argument" and step[1]["s"] == "Trace the impact of b.ts"


def test_latest_diagnostics_stream(spark):
    root = tempfile.mkdtemp(prefix="factloom-test-")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "file string, version long, diagnostics string").write.parquet(f"{root}/in")
    stream = spark.readStream.schema("file string, version long, diagnostics string").parquet(f"{root}/in")
    q = incremental.latest_diagnostics(stream).writeStream.outputMode("complete").format("memory").queryName("diag_now").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["file"], r["diagnostics"]) for r in spark.table("diag_now").collect()} == {("a", "y"), ("b", "z")}
    assert os.path.isdir(root)


def test_git_versions(spark):
    import subprocess

    root = tempfile.mkdtemp(prefix="factloom-test-")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    put = lambda body: open(os.path.join(root, "a.ts"), "w").write(body)
    git("init", "-b", "main")
    put("export const a = 1;\n")
    git("add", "-A"), git("commit", "-m", "one")
    git("checkout", "-b", "work")
    put("export const b = 1;\n")
    git("commit", "-am", "two")
    base = src.merge_base(root)
    old, new = src.read_git_version(spark, root, base), src.read_git_version(spark, root, "HEAD", "head")
    assert [r["text"] for r in old.collect()] == ["export const a = 1;\n"]
    assert {tuple(r) for r in src.changed_files(old, new).collect()} == {("a.ts", "modified")}
    assert src.merge_base(root, "no-such-branch") is not None


def test_calls_are_matched_by_file_and_name(spark):
    from factloom.operators import diff

    calls = spark.createDataFrame([("u.ts", "a.ts", "f", 1, 1)], "caller_file string, callee_file string, callee string, line int, arg_count int")
    arity = spark.createDataFrame([("a.ts", "f", 1, 1), ("b.ts", "f", 0, 0)], "callee_file string, callee string, min_args int, max_args int")
    rows = diff.call_compatibility(calls, arity).collect()
    assert [(r.callee_file, r.compatible) for r in rows] == [("a.ts", True)]


def test_long_alias_changes_are_seen(spark):
    from factloom.functions import lexer
    from factloom.operators import diff, facts

    def shapes(last):
        body = "export type Kind = " + " | ".join(f"'member_number_{i}'" for i in range(15)) + f" | '{last}';\n"
        return facts.shapes(lexer.tokens(spark.createDataFrame([("packages/a/src/k.ts", body)], "path string, text string")))

    assert diff.diff_exports(shapes("old"), shapes("new")).count() == 1
