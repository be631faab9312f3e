"""Operators on a hand-written workspace: what the engine is for, checked by example."""

from pyspark.sql import functions as F

from factloom.operators import diff, facts, graph, patterns, structural, workflows
from factloom.plans import find_code as fc
from factloom.sources import files as src
from factloom.sources.configs import config_entries

APP = "packages/app/src/"


def rows(df, *cols):
    return {tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()}


def refs_of(ws, files):
    bindings = graph.import_bindings(ws.tokens)
    modules = graph.resolve_modules(bindings, files, src.packages(files))
    defs = graph.definitions(ws.exports, ws.declarations, bindings, modules)
    return graph.references(ws.tokens, bindings, modules, defs, ws.declarations)


def test_scope_and_scan(shop_files):
    code = src.in_scope(shop_files)
    names = rows(code, "path")
    assert "packages/core/src/sdk.ts" in names and "web/server.js" in names
    assert not any("node_modules" in n or ".test." in n for n in names)
    assert APP + "effects.test.ts" in rows(src.in_scope(shop_files, include_tests=True), "path")
    assert rows(src.in_scope(shop_files, roots=["packages/core"]), "package") == {"core"}


def test_declarations(shop):
    d = rows(shop.declarations, "symbol", "kind", "is_exported")
    assert {("Status", "enum", True), ("Item", "interface", True), ("Handler", "type", True), ("createClient", "function", True),
            ("unusedLocal", "function", False), ("Worker", "class", True), ("Base", "class", False), ("app", "variable", False)} <= d
    assert not any(x[0] == "fetchItem" for x in d)  # nested


def test_usages_and_enclosing(shop):
    u = rows(shop.usages, "identifier", "kind", "enclosing_symbol")
    assert ("Promise.all", "member-call", "helper") in u
    assert ("process.env.DATABASE_URL", "env-usage", None) in u
    assert ("import.meta.env.MODE", "env-usage", None) in u
    assert ("Card", "jsx-tag", "Panel") in u and ("Badge", "jsx-tag", "Panel") in u
    assert ("encodeURIComponent", "call", "fetchItem") in u
    assert ("useEffect", "import", None) in u and ("React", "import", None) in u
    assert not any(x[0] == "process.env.LIST" for x in u)  # only the outermost access counts


def test_docs_and_titles(shop):
    d = rows(shop.docs, "kind", "text", "attached_symbol")
    assert ("jsdoc", "Creates the client.", "createClient") in d
    assert ("comment", "validates that the caller has the permission", "checkAccess") in d
    assert ("test-title", "lets admins in", None) in d


def test_exports(shop):
    e = rows(shop.exports, "file", "name", "exported_as", "kind")
    core = "packages/core/src/index.ts"
    assert {(core, "*", "*", "reexport"), (core, "parseBody", "parse", "reexport"), ("web/server.js", "default", "default", "cjs"),
            ("web/server.js", "table", "table", "cjs")} <= e


def test_shapes(shop):
    s = {r["name"]: r for r in shop.shapes.collect()}
    assert s["createClient"]["signature"] == "const createClient = (base, retries?) => ..."
    assert [m["name"] for m in s["Item"]["members"]] == ["id", "note"] and s["Item"]["members"][1]["optional"]
    assert s["Status"]["enum_members"] == ["Open", "Held", "Closed"]
    assert s["checkAccess"]["params"][1]["rest"] and s["checkAccess"]["return_type"] == "boolean"
    arity = {r["callee"]: (r["min_args"], r["max_args"]) for r in diff.arity_of(shop.shapes).collect()}
    assert arity["checkAccess"] == (1, None) and arity["parseBody"] == (1, 2)
    assert [m["name"] for m in s["Worker"]["members"]] == ["size", "run"]


def test_routes(shop):
    r = rows(shop.routes, "method", "path", "framework")
    assert {("GET", "/items/:id", "express"), (None, "/static", "express"), ("POST", "/orders", "fastify"),
            (None, "/home", "route-map"), ("GET", "/api/items", "next-app-router")} <= r


def test_configs(shop_files):
    e = rows(config_entries(shop_files), "kind", F.array_join("key_path", "."))
    assert {("config", "features.darkMode"), ("route", "api.endpoint"), ("route", "api.tags.1"), ("env", "DATABASE_URL"),
            ("package", "scripts.test"), ("package", "devDependencies.typescript"), ("config", "cache_ttl"), ("config", "tool.shop.feature_toggle")} <= e
    assert not any("SECRET" in x[1] for x in e)


def test_structural(shop):
    p = shop.predicates.filter(F.col("file").startswith(APP)).collect()
    by = {(r["identifier"], r["line"]): r for r in p if r["node"] in ("call", "function", "loop", "switch")}
    assert by["useEffect", 7]["p_returns_cleanup"] and by["useEffect", 7]["p_conditional"] and by["useEffect", 7]["p_hook_callback"]
    assert by["useEffect", 12]["p_no_cleanup"] and not by["useEffect", 12]["p_returns_cleanup"]
    assert by["useEffect", 13]["p_functional_state_updater"] and not by["useEffect", 14]["p_functional_state_updater"]
    assert by["loadAll", 15]["p_await_in_loop"] and not by["loadLater", 19]["p_await_in_loop"]
    assert by["label", 3]["p_switch_no_default"] and not by["labelAll", 11]["p_switch_no_default"]
    assert by["safe", 23]["p_has_try_catch"] and by["loadAll", 15]["p_no_try_catch"]
    hits = structural.structural_matches(shop.predicates, ["no-try-catch"], [], async_only=True).filter("locator = 'declaration'")
    assert {"loadAll", "loadLater", "helper"} <= rows(hits, "identifier") and "safe" not in rows(hits, "identifier")


def test_pattern_and_regex(shop_files):
    code = src.in_scope(shop_files)
    assert rows(patterns.find_pattern(code, "await $CALL($$$ARGS)"), "file") == {
        APP + "structural.ts", "packages/core/src/sdk.ts"}
    assert rows(patterns.find_pattern(code, "$A === $B"), "match") >= {"role === 'admin'", "s === Status.Open"}
    hits = patterns.regex_hits(code, [{"id": "multi", "pattern": r"if \(id\) \{\s+return", "flags": "g"}])
    assert rows(hits, "file", "line") == {(APP + "effects.tsx", 8)}


def test_resolution_and_references(shop, shop_files):
    bindings = graph.import_bindings(shop.tokens)
    modules = graph.resolve_modules(bindings.unionByName(shop.exports.filter("module is not null").select(
        "file", "line", F.lit(0).alias("col"), F.col("exported_as").alias("local"), F.col("name").alias("imported"), "module")),
        shop_files, src.packages(shop_files), src.tsconfig_aliases(shop_files))
    m = rows(modules, "file", "module", "target")
    assert (APP + "effects.tsx", "@lib/structural", APP + "structural.ts") in m
    assert (APP + "effects.tsx", "@demo/core", "packages/core/src/index.ts") in m
    defs = graph.definitions(shop.exports, shop.declarations, bindings, modules)
    d = rows(defs, "file", "exported_as", "def_file", "def_name")
    core = "packages/core/src/index.ts"
    assert {(core, "createClient", "packages/core/src/sdk.ts", "createClient"), (core, "parse", "packages/core/src/validate.ts", "parseBody"),
            (core, "Status", "packages/types/src/index.ts", "Status")} <= d
    refs = graph.references(shop.tokens, bindings, modules, defs, shop.declarations)
    r = rows(refs, "def_symbol", "file", "line")
    assert ("checkAccess", APP + "effects.test.ts", 3) in r and ("checkAccess", "packages/core/src/validate.ts", 11) in r
    edges = rows(graph.call_edges(refs), "caller", "callee", "arg_count")
    assert ("guard", "checkAccess", 1) in edges
    assert rows(graph.test_files(refs, ["def_symbol"]).filter("def_symbol = 'checkAccess'"), "file", "type") == {(APP + "effects.test.ts", "test")}
    paths = rows(graph.auto_import(defs.filter("def_name = 'checkAccess'"), src.packages(shop_files)), "import_path")
    assert paths == {"@demo/core/validate"}


def test_heritage_symbols_and_lookups(shop):
    assert rows(graph.implementations(facts.heritage(shop.tokens), "Base"), "name") == {"Worker"}
    tree = rows(graph.document_symbols(shop.nodes, shop.declarations).filter(F.col("file").contains("structural")), "name", "parent", "depth")
    assert ("run", "Worker", 1) in tree and ("label", None, 0) in tree
    assert rows(graph.workspace_symbols(shop.declarations, "label"), "symbol") == {"label", "labelAll"}
    assert rows(graph.resolve_symbol(shop.declarations, "label"), "symbol") == {"label"}
    assert rows(facts.type_guards(shop.tokens), "func_name", "guarded_type") == {("isOpen", "Status.Open")}


def test_exhaustiveness(shop, shop_files):
    switches = diff.resolve_switches(shop.switches, refs_of(shop, shop_files))
    out = {r["line"]: r for r in diff.exhaustiveness(diff.enums_of(shop.shapes), switches).collect()}
    assert out[4]["missing"] == ["Closed"] and not out[4]["is_exhaustive"] and out[12]["is_exhaustive"]


def test_same_names_in_two_files(spark):
    """Two enums of one name: a switch is held against the one its file imports, under whatever name."""
    files = spark.createDataFrame([
        ("a/one.ts", "export enum Mode { On, Off }\n"),
        ("a/two.ts", "export enum Mode { Read, Write }\n"),
        ("a/use.ts", "import { Mode } from './one';\nexport function f(m: Mode) { switch (m) { case Mode.On: break; } }\n"),
        ("a/other.ts", "import { Mode as M } from './two';\nexport function g(m: M) { switch (m) { case M.Read: break; case M.Write: break; } }\n"),
    ], "path string, text string")
    ws = fc.Workspace(files)
    refs = refs_of(ws, files)
    got = rows(diff.exhaustiveness(diff.enums_of(ws.shapes), diff.resolve_switches(ws.switches, refs)).withColumn(
        "missing", F.array_join("missing", ",")), "file", "enum_file", "missing")
    assert got == {("a/use.ts", "a/one.ts", "Off"), ("a/other.ts", "a/two.ts", "")}
    params = ws.shapes.filter("params is not null").select("file", F.col("name").alias("fn"), F.inline("params")).drop("name", "optional", "rest")
    assert rows(graph.type_definitions(params, ws.declarations, refs), "fn", "type_file") == {("f", "a/one.ts"), ("g", "a/two.ts")}


def test_find_code_vectors(shop):
    out, route = fc.find_code(shop, "useEffect that returns a cleanup callback conditionally")
    top = out.orderBy(F.desc("score")).first()
    assert route["mode"] == "structural" and top["file"].endswith("effects.tsx") and top["line"] == 7 and "useEffect" in top["snippet"]
    out, route = fc.find_code(shop, "where do we validate permissions")
    assert route["mode"] == "behavior" and any("validate.ts" in r["file"] for r in out.collect())
    out, route = fc.find_code(shop, "where is Promise.all used")
    assert route["retrievers"] == ["identifier"] and out.orderBy(F.desc("score")).first()["name"] == "Promise.all"
    out, _ = fc.find_code(shop, "DATABASE_URL")
    files = {r["file"] for r in out.collect()}
    assert APP + "config.ts" in files and ".env.example" in files


def test_simulation_and_root_cause(spark, shop, shop_files):
    refs = refs_of(shop, shop_files)
    calls = graph.call_edges(refs)
    recipes = spark.createDataFrame([
        (1, "packages/core/src/validate.ts", "checkAccess", "add_required_param", "tenant", "string"),
        (2, "packages/types/src/index.ts", "Status", "add_enum_member", "Lost", None)],
        "change int, file string, symbol string, recipe string, name string, type_text string")
    out = {r["change"]: r for r in workflows.simulate_changes(shop.shapes, recipes, calls, diff.resolve_switches(shop.switches, refs)).collect()}
    assert out[1]["kind"] == "param_required" and out[1]["risk"] == "breaking" and out[1]["breaking_callers"] >= 1
    assert out[2]["kind"] == "enum_member_added" and out[2]["open_switches"] == 1


def test_completions_and_types(shop, shop_files):
    bindings = graph.import_bindings(shop.tokens)
    got = rows(graph.completions(shop.tokens, bindings, APP + "effects.tsx", 8, "c"), "label")
    assert {"count", "createClient"} <= got
    params = shop.shapes.filter("name = 'label'").select("file", "name", F.inline("params")).toDF("file", "fn", "name", "optional", "rest", "type_text")
    assert rows(graph.type_definitions(params, shop.declarations, refs_of(shop, shop_files)), "type_file", "type_kind") == {("packages/types/src/index.ts", "enum")}


def test_wrappers(shop):
    w = {r["name"]: (r["target"], r["wrapper_confidence"]) for r in fc.wrappers(shop).collect()}
    assert w["guard"] == ("checkAccess", 0.9)
