"""The token table: how files are dealt, what is stored, and one pass over it for exports."""

import re
import sys

from pyspark.sql import functions as F

import pyarrow.parquet as pq
import pytest

from factloom.functions import lexer
from factloom.operators import facts, graph, scopes, structural
from factloom.session import _mounted, dealt, stored_batches
from factloom.tables import code_queries, corpus, module_corpus

SOURCES = [
    ("a.ts", "export function f(x: string, y = 1): number { return g(x); }\nexport { f as h, type T } from './b';\n"),
    ("b.tsx", "/** Note. */\nexport default class K { run() { return <Box>{this.v}</Box>; } }\nmodule.exports.z = 1;\n"),
    ("c.ts", ""), ("d.ts", "\n\n"), ("e.ts", "export * from './a'; const { p, q: [r] } = s"),
]


def customers(spark, tmp_path, rows):
    spark.range(rows).select(
        F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"), (F.col("id") % 25).cast("int").alias("c_nationkey"),
        F.lit(1.5).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def leaves(df):
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return plan.size()


def test_small_input_files_are_dealt_by_their_number(spark, tmp_path):
    files = corpus.customer_files(spark, customers(spark, tmp_path, 60_000))
    assert files.rdd.getNumPartitions() == 12  # one small split, 60,000 modules
    assert dealt(spark.range(95), 95, per_task=10).rdd.getNumPartitions() == 10
    assert dealt(spark.range(5), 5, per_task=10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_tokens_are_a_table_with_a_known_size(spark, tmp_path):
    kept = corpus.kept_tokens(spark, customers(spark, tmp_path, 30), "customer")
    assert not kept.is_cached and len(kept.inputFiles()) > 0
    assert kept.select("file").distinct().count() == 30
    assert corpus.kept_tokens(spark, str(tmp_path), "customer") is kept


def test_files_cut_together_give_the_rows_of_each_alone():
    for everything in (False, True):
        alone = [row for file in SOURCES for row in lexer.token_rows(*file, everything)]
        assert [tuple(r.values()) for r in lexer.token_batch(SOURCES, everything).to_pylist()] == alone
    assert lexer.token_batch([]).num_rows == 0


def test_a_token_takes_few_steps():
    """Lines of Python run per token: columns are looked up for a whole batch, not row by row."""
    code = ("import { a as b } from './m';\nexport async function f(x: string, y = 1): Promise<number> {\n"
            "  for (const s of items) { await load(s, `v${s.id}`); }\n  switch (k) { case L.Low: break; default: g(); }\n  return x / 2;\n}\n") * 20
    lexer.token_batch([("a.ts", code)])  # imports done on first use are not counted
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        lexer.token_batch([("a.ts", code)])
    finally:
        sys.settrace(before)
    assert steps / len(lexer.cut(code)[0]) < 61


def test_cutting_goes_on_after_templates_and_patterns():
    kinds, texts, offs, lines, cols, comments = lexer.cut("a = `x${b}y\n${c}z` / 2;\nd = /[/]q/g // e\n\u00a0f")
    assert texts == ["a", "=", "`x${", "b", "}y\n${", "c", "}z`", "/", "2", ";", "d", "=", "/[/]q/g", "f"]
    assert kinds[2:7:2] == ["tpl"] * 3 and kinds[7] == "op" and kinds[12] == "regex"
    assert (lines[5], cols[5], lines[12], cols[12], lines[13], cols[13]) == (2, 2, 3, 4, 4, 1) and comments == {13: ["// e"]}


def test_exports_read_the_tokens_once(spark, tmp_path):
    path = f"{tmp_path}/tokens"
    lexer.tokens(spark.createDataFrame(SOURCES, ["path", "text"])).write.parquet(path)
    found = facts.exports(spark.read.parquet(path))
    assert leaves(found) == 1
    got = {(r["file"], r["name"], r["exported_as"], r["kind"], r["is_type_only"], r["module"]) for r in found.collect()}
    assert got == {("a.ts", "f", "f", "function", False, None), ("a.ts", "f", "h", "reexport", False, "./b"), ("a.ts", "T", "T", "reexport", True, "./b"),
                   ("b.tsx", "K", "K", "class", False, None), ("b.tsx", "z", "z", "cjs", False, None), ("e.ts", "*", "*", "reexport", False, "./a")}


def test_catalog_tokens_are_dealt_by_files(spark, tmp_path, monkeypatch):
    dealings = []
    monkeypatch.setattr(module_corpus, "dealt", lambda df, rows: dealings.append(rows) or dealt(df, rows))
    for name in ("customer", "part", "supplier", "region", "nation"):
        key = name[0]
        extra = {"customer": [(F.col("id") % 3).cast("int").alias("c_nationkey")], "nation": [F.col("id").cast("int").alias("n_regionkey")]}
        spark.range(3).select(F.col("id").alias(f"{key}_{name[:4]}key" if name in ("part", "supplier", "customer") else f"{key}_{name}key"),
                              *extra.get(name, [])).write.parquet(f"{tmp_path}/{name}.parquet")
    files, _ = module_corpus.catalog(spark, str(tmp_path))
    assert dealings == [files.count()]


def test_tasks_write_the_token_table(spark):
    files = spark.createDataFrame(SOURCES, ["path", "text"]).repartition(3)
    kept = lexer.stored_tokens(files, "t")
    assert kept.schema == lexer.tokens(files).schema
    assert sorted(map(str, kept.collect())) == sorted(map(str, lexer.tokens(files).collect()))
    assert all(pq.ParquetFile(x.removeprefix("file://")).metadata.created_by.startswith("parquet-cpp") for x in kept.inputFiles())
    none = lexer.stored_tokens(files.filter("path is null"), "t")
    assert none.schema == kept.schema and none.count() == 0


def test_a_file_that_no_task_named_is_not_read(spark, tmp_path):
    def make(batches):
        for batch in batches:
            yield from [batch, batch]

    kept = stored_batches(spark.range(5, numPartitions=1), make, "id bigint", "numbers")
    (at,) = kept.inputFiles()
    pq.write_table(pq.read_table(at.removeprefix("file://")), at.removeprefix("file://").replace("part-", "part-9"))
    assert sorted(r["id"] for r in kept.collect()) == sorted([*range(5), *range(5)])


def test_a_task_that_fails_gives_no_table(spark):
    def make(batches):
        yield next(batches)
        raise ValueError("cut off")

    with pytest.raises(Exception, match="cut off"):
        stored_batches(spark.range(5, numPartitions=1), make, "id bigint", "numbers")


def test_only_mounted_folders_are_written_by_tasks(spark):
    assert _mounted(spark, "/a b/c") == "/a b/c" and _mounted(spark, "file:///a%20b/c") == "/a b/c"
    assert _mounted(spark, "hdfs://host/a") is None and _mounted(spark, "viewfs:///in/a") is None


def test_extents_read_the_tokens_once(spark, tmp_path):
    code = "export function f(x: string) { for await (const s of x) { g(s); } try { g(); } catch (e) { h(e); } return (q) => q; }\nconst k = w => w;"
    table = lexer.stored_tokens(spark.createDataFrame([("a.ts", code)], ["path", "text"]), "t")
    assert leaves(scopes.extents(table)) == 1
    everything = {tuple(r) for r in scopes.local_scopes(table).select("file", "name", "start", "end").collect()}
    assert {x[1] for x in everything} == {"x", "s", "e", "q", "w"}
    wanted = spark.createDataFrame([("a.ts", "s"), ("a.ts", "w"), ("b.ts", "x")], ["file", "name"])
    assert {tuple(r) for r in scopes.local_scopes(table, wanted).select("file", "name", "start", "end").collect()} == {x for x in everything if x[1] in "sw"}


def test_no_side_that_grows_with_the_code_is_broadcast(spark):
    """A guess from file sizes would broadcast these; at their real size they don't fit the driver."""
    table = lexer.stored_tokens(spark.createDataFrame(SOURCES, ["path", "text"]), "t")
    for found in (facts.shapes(table), graph.hover(facts.shapes(table), facts.docs(table))):
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()


def test_auto_import_has_every_exported_function(spark, tmp_path):
    """Guards of customer modules and functions of order modules, too; apps have no package, so their path is the file."""
    folder = customers(spark, tmp_path, 3)
    spark.createDataFrame([(7, 2, "O", "5-LOW"), (8, 9, "F", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(
        f"{folder}/orders.parquet")
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(f"{folder}/nation.parquet")
    got = sorted((r["def_symbol"], r["import_path"]) for r in code_queries.auto_import(spark, folder).collect())
    assert got == sorted([(f"{name}{k}", f"@shop/nation{k}/customer{k}") for k in range(3) for name in ("customer", "isInfo")] + [
        ("order7", "apps/app7/src/order7.spec.ts")])


def test_plain_text_is_cut_like_any_other():
    """A template at the end sends the same text the longer way."""
    code = "a = 'x\\\ny' /* b\nc */ + 1.5e3; // d\n\tlet $e_ = (f?.g ?? \"h\") => { i++ };\n'j"
    short, long = lexer.cut(code), lexer.cut(code + "\n`k`")
    assert [x[:-1] for x in long[:5]] == list(short[:5]) and long[5] == short[5] == {3: ["/* b\nc */"], 6: ["// d"]} and short[0][-2:] == ["op", "id"]


def test_scans_of_declarations_are_compiled(spark, tmp_path):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    table = lexer.stored_tokens(spark.createDataFrame(SOURCES, ["path", "text"]), "t")
    for found in (facts.declarations(table).drop("path_tokens", "symbol_tokens"), facts.exports(table)):
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(found._jdf.queryExecution().executedPlan())
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_tokens_tell_names_that_their_file_gives_a_meaning():
    code = "import { a as b } from './m';\nexport const c = (p) => { b(p, q); s.c(); };\nfunction f() {\n  let d = x => c; }\n"
    rows = lexer.token_batch([("a.ts", code), ("z.ts", "q(b, p, c);")]).to_pylist()
    named = lambda flag, file: {r["text"] for r in rows if r[flag] and r["file"] == file}
    assert named("known", "a.ts") >= {"b", "c", "f"} and not named("known", "a.ts") & {"p", "q", "s", "d", "x"}
    assert named("param_name", "a.ts") == {"p", "x"} and not named("known", "z.ts") | named("param_name", "z.ts")
    assert [r["line"] for r in rows if r["leads_line"]] == [1, 2, 3, 4, 1]


def test_references_move_only_names_with_a_meaning(spark):
    files = [("a.ts", "export function f(x: string) { g(x); const f2 = 1; h(f2); return f; }"), ("b.ts", "import { f } from './a'; f(1); { const f = 2; f; } k(f);")]
    table = lexer.stored_tokens(spark.createDataFrame(files, ["path", "text"]), "t")
    decls, bindings = facts.declarations(table), graph.import_bindings(table)
    modules = graph.resolve_modules(bindings, spark.createDataFrame(files, ["path", "text"]))
    refs = graph.references(table, bindings, modules, graph.definitions(facts.exports(table), decls, bindings, modules), decls)
    assert sorted((r["file"], r["local"], r["col"]) for r in refs.collect()) == [("a.ts", "f", 65), ("b.ts", "f", 9), ("b.ts", "f", 25), ("b.ts", "f", 53)]
    assert "known" in refs._jdf.queryExecution().optimizedPlan().toString()


def test_error_sites_move_first_rows_and_calls_only(spark):
    table = lexer.stored_tokens(spark.createDataFrame([("a.ts", "const a = f(1) + b.c + d;\nreturn x;\n  y.z;\n")], ["path", "text"]), "t")
    found = facts.nodes_at_lines(table, spark.createDataFrame([("a.ts", x) for x in (1, 2, 3, 4)], ["file", "line"]))
    assert sorted((r["line"], r["kind"]) for r in found.collect()) == [(1, "variable"), (2, "return"), (3, "expression")]
    assert "leads_line" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_node_has_two_edges_in_the_stream(spark, monkeypatch):
    """What is open where a node starts is read at its own first edge; an interval from the file's start would double the stream."""
    asked = []
    count = structural.count_inside
    monkeypatch.setattr(structural, "count_inside", lambda intervals, *rest, **more: asked.append(intervals) or count(intervals, *rest, **more))
    table = lexer.stored_tokens(spark.createDataFrame([("a.ts", "useEffect(() => { f(g(1)); return () => h(); }, []);")], ["path", "text"]), "t")
    found = {(r["node"], r["identifier"]): r for r in structural.predicate_table(table).collect()}
    assert asked[-1].count() == facts.nodes(table).count() + 1  # and one callback
    assert found["call", "useEffect"]["p_returns_cleanup"] and not found["call", "useEffect"]["p_inside_hook"] is None
    assert found["call", "g"]["p_inside_hook"] and not found["call", "g"]["p_hook_callback"]
