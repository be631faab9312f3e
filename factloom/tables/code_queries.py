"""Code operators over the modules written from customers and orders.

The SQL side never sees the source text: it predicts the facts from the tables, so extraction is
checked against an independent statement of what the code says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators import diff, facts, graph, patterns, ranking, structural, workflows
from factloom.plans import advice
from factloom.plans import find_code as fc
from factloom.session import stored
from factloom.sources import files as src
from factloom.tables import corpus
from factloom.tables.registry import query

c = F.col
long = lambda x: c(x).cast("long").alias(x)

CFILE = "'packages/nation' || c_nationkey || '/src/customer' || c_custkey || '.ts'"
OFILE = "'apps/app' || o_orderkey % 25 || '/src/order' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.spec' ELSE '' END || '.ts'"
PRIO = "o_orderpriority[1]"


def customer_tokens(spark: SparkSession, sf_dir: str, version: str = "head") -> DataFrame:
    return corpus.kept_tokens(spark, sf_dir, "customer", version)


def order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.kept_tokens(spark, sf_dir, "order")


def both_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_tokens(spark, sf_dir).unionByName(order_tokens(spark, sf_dir))


# --- extraction --------------------------------------------------------------------------------

@query(f"""
SELECT 'customer' || c_custkey AS symbol, 'function' AS kind, {CFILE} AS file, 4::BIGINT AS line, 0::BIGINT AS col, true AS is_exported, 'customer' || c_custkey AS tokens FROM customer
UNION ALL SELECT 'Customer' || c_custkey || 'Info', 'interface', {CFILE}, 8, 0, true, 'customer' || c_custkey || 'info' FROM customer
UNION ALL SELECT 'balance' || c_custkey, 'variable', {CFILE}, 10, 13, true, 'balance' || c_custkey FROM customer
UNION ALL SELECT 'Level' || c_custkey, 'enum', {CFILE}, 11, 0, true, 'level' || c_custkey FROM customer
UNION ALL SELECT 'isInfo' || c_custkey, 'function', {CFILE}, 13, 0, true, 'is info' || c_custkey FROM customer""")
def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level declarations (FX-1)."""
    d = facts.declarations(customer_tokens(spark, sf_dir))
    return d.select("symbol", "kind", "file", long("line"), long("col"), "is_exported", F.array_join("symbol_tokens", " ").alias("tokens"))


_CALL = f"CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END"


@query(f"""
WITH o AS (SELECT *, {OFILE} AS file, 'order' || o_orderkey AS me FROM orders)
SELECT 'customer' || o_custkey AS identifier, 'import' AS kind, file, 1::BIGINT AS line, NULL::VARCHAR AS enclosing, NULL::BIGINT AS argc FROM o
UNION ALL SELECT 'Level' || o_custkey, 'import', file, 2, NULL, NULL FROM o
UNION ALL SELECT 'process.env.REGION_' || {PRIO}, 'env-usage', file, 5, me, NULL FROM o
UNION ALL SELECT 'customer' || o_custkey, 'call', file, 7, me, {_CALL} FROM o
UNION ALL SELECT n, 'call', file, 6, me, a FROM o, (VALUES ('1', 'load', 1), ('2', 'save', 1), ('2', 'report', 1), ('5', 'useEffect', 2), ('5', 'setCount', 1), ('5', 'clear', 0)) v(p, n, a) WHERE p = {PRIO}
UNION ALL SELECT 'app.get', 'member-call', file, 9, NULL, 2 FROM o WHERE o_orderkey % 10 = 0
UNION ALL SELECT 'describe', 'call', file, 10, NULL, 2 FROM o WHERE o_orderkey % 7 = 0
UNION ALL SELECT me, 'call', file, 10, NULL, 0 FROM o WHERE o_orderkey % 7 = 0""")
def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, member calls, imports and environment reads with their enclosing function (FX-2..5)."""
    u = facts.usages(order_tokens(spark, sf_dir))
    return u.select("identifier", "kind", "file", long("line"), c("enclosing_symbol").alias("enclosing"), long("argc"))


@query(f"""
SELECT {CFILE} AS file, 4::BIGINT AS line, 'jsdoc' AS kind, 'Looks up the balance of ' || c_name || '.' AS text, 'customer' || c_custkey AS symbol FROM customer
UNION ALL SELECT {CFILE}, 10, 'comment', 'flag of segment ' || c_mktsegment, 'balance' || c_custkey FROM customer
UNION ALL SELECT {OFILE}, 10, 'test-title', 'order ' || o_orderkey || ' totals', NULL FROM orders WHERE o_orderkey % 7 = 0""")
def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSDoc, leading comments and test titles (FX-6)."""
    d = facts.docs(both_tokens(spark, sf_dir))
    return d.select("file", long("line"), "kind", "text", c("attached_symbol").alias("symbol"))


@query(f"""
SELECT {CFILE} AS file, name, kind, line::BIGINT AS line, t AS is_type_only FROM (
  SELECT *, unnest([{{'name': 'customer' || c_custkey, 'kind': 'function', 'line': 4, 't': false}}, {{'name': 'Customer' || c_custkey || 'Info', 'kind': 'interface', 'line': 8, 't': true}},
    {{'name': 'balance' || c_custkey, 'kind': 'const', 'line': 10, 't': false}}, {{'name': 'Level' || c_custkey, 'kind': 'enum', 'line': 11, 't': false}},
    {{'name': 'isInfo' || c_custkey, 'kind': 'function', 'line': 13, 't': false}}], recursive := true) FROM customer)""")
def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported names (FX-9)."""
    return facts.exports(customer_tokens(spark, sf_dir)).select("file", "name", "kind", long("line"), "is_type_only")


@query(f"""
SELECT {CFILE} AS file, 'customer' || c_custkey AS name, 'function customer' || c_custkey || '(status, priority' || CASE WHEN c_custkey % 2 = 0 THEN '?' ELSE '' END || '): number' AS signature,
   'status:string,priority:string' AS params, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS min_args, 2::BIGINT AS max_args FROM customer
UNION ALL SELECT {CFILE}, 'Customer' || c_custkey || 'Info', 'interface Customer' || c_custkey || 'Info {{ name, segment }}', NULL, NULL, NULL FROM customer
UNION ALL SELECT {CFILE}, 'balance' || c_custkey, 'const balance' || c_custkey || ': unknown', NULL, NULL, NULL FROM customer
UNION ALL SELECT {CFILE}, 'Level' || c_custkey, 'enum Level' || c_custkey || ' {{ Low, High' || CASE WHEN c_custkey % 2 = 1 THEN ', Top' ELSE '' END || ' }}', NULL, NULL, NULL FROM customer
UNION ALL SELECT {CFILE}, 'isInfo' || c_custkey, 'function isInfo' || c_custkey || '(x): x is Customer' || c_custkey || 'Info', 'x:unknown', 1, 1 FROM customer""")
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declaration shapes and arity (FX-10, FX-14, FX-16)."""
    s = facts.shapes(customer_tokens(spark, sf_dir))
    is_fn = c("params").isNotNull()
    return s.select("file", "name", "signature",
                    F.when(is_fn, F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["type_text"])), ",")).alias("params"),
                    F.when(is_fn, facts.min_arity()).cast("long").alias("min_args"), F.when(is_fn, facts.max_arity()).cast("long").alias("max_args"))


@query(f"""
SELECT {OFILE} AS file, 9::BIGINT AS line, 'GET' AS method, '/orders/' || o_orderkey AS path, 'express' AS framework, 'GET /orders/' || o_orderkey AS text FROM orders WHERE o_orderkey % 10 = 0""")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route definitions (FX-7)."""
    return facts.routes(order_tokens(spark, sf_dir)).select("file", long("line"), "method", "path", "framework", "text")


@query(f"""
SELECT {OFILE} AS file, line::BIGINT AS line, '@shop/nation' || c_nationkey || '/customer' || o_custkey AS module, sym || o_custkey AS symbols
FROM orders JOIN customer ON c_custkey = o_custkey, (VALUES (1, 'customer'), (2, 'Level')) v(line, sym)""")
def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by line pattern (FX-11, T-12)."""
    lines = facts.file_lines(corpus.order_files(spark, sf_dir))
    return facts.imports(lines).select("file", long("line"), "module", F.array_join("symbols", ",").alias("symbols"))


@query(f"""
SELECT {CFILE} AS file, name, kind, line::BIGINT AS line FROM (SELECT *, unnest([{{'name': 'customer' || c_custkey, 'kind': 'function', 'line': 4}},
  {{'name': 'Customer' || c_custkey || 'Info', 'kind': 'interface', 'line': 8}}, {{'name': 'balance' || c_custkey, 'kind': 'variable', 'line': 10}},
  {{'name': 'Level' || c_custkey, 'kind': 'enum', 'line': 11}}, {{'name': 'isInfo' || c_custkey, 'kind': 'function', 'line': 13}}], recursive := true) FROM customer)""")
def file_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports by line text (FX-12, T-13)."""
    lines = facts.file_lines(corpus.customer_files(spark, sf_dir))
    out = facts.file_exports(lines, facts.declarations(customer_tokens(spark, sf_dir)))
    return out.select("file", "name", "kind", long("line"))


@query(f"""
SELECT {OFILE} AS file, 'Level' || o_custkey AS enum, CASE WHEN {PRIO} = '3' THEN 'High,Low' ELSE 'Low' END AS handled, {PRIO} = '4' AS has_default
FROM orders WHERE {PRIO} IN ('3', '4')""")
def switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switch statements with the members they handle (FX-15)."""
    return facts.switches(order_tokens(spark, sf_dir)).select("file", "enum", F.array_join("handled", ",").alias("handled"), "has_default")


@query(f"""
SELECT {CFILE} AS file, 13::BIGINT AS line, 'isInfo' || c_custkey AS func_name, 'Customer' || c_custkey || 'Info' AS guarded_type FROM customer""")
def type_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-defined type guards (FX-18)."""
    return facts.type_guards(customer_tokens(spark, sf_dir)).select("file", long("line"), "func_name", "guarded_type")


@query(f"SELECT {CFILE} AS file, 13::BIGINT AS line, 'typeof-check' AS narrowing, 'x' AS symbol, 'object' AS checked FROM customer")
def type_narrowings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrowing comparisons (FX-17, FX-19)."""
    return facts.narrowings(customer_tokens(spark, sf_dir)).select("file", long("line"), "narrowing", "symbol", "checked")


@query(f"""
WITH s AS (
 SELECT {CFILE} AS file, 'function' AS node, 'customer' || c_custkey AS name, 4::BIGINT AS line, 0::BIGINT AS depth FROM customer
 UNION ALL SELECT {CFILE}, 'interface', 'Customer' || c_custkey || 'Info', 8, 0 FROM customer
 UNION ALL SELECT {CFILE}, 'variable', 'balance' || c_custkey, 10, 0 FROM customer
 UNION ALL SELECT {CFILE}, 'enum', 'Level' || c_custkey, 11, 0 FROM customer
 UNION ALL SELECT {CFILE}, 'function', 'isInfo' || c_custkey, 13, 0 FROM customer)
SELECT * FROM s""")
def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol tree of every file (FX-22, T-6)."""
    t = customer_tokens(spark, sf_dir)
    return graph.document_symbols(facts.nodes(t), facts.declarations(t)).select("file", "node", "name", long("line"), long("depth"))


@query(f"""
SELECT {CFILE} AS file, 'customer' || c_custkey AS name, 'function customer' || c_custkey || '(status, priority' || CASE WHEN c_custkey % 2 = 0 THEN '?' ELSE '' END || '): number' AS signature,
 'Looks up the balance of ' || c_name || '.' AS doc FROM customer""")
def hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature and documentation of documented exports (T-4)."""
    t = customer_tokens(spark, sf_dir)
    return graph.hover(facts.shapes(t), facts.docs(t)).filter(c("doc").isNotNull()).select("file", "name", "signature", "doc")


# --- structure ---------------------------------------------------------------------------------

@query(f"""
WITH o AS (SELECT {OFILE} AS file, {PRIO} AS p, o_orderkey FROM orders), n AS (
 SELECT file, 'function' AS node, 4 AS line, p = '3' OR p = '4' AS conditional, p = '5' AS returns_function, p = '2' AS has_try, p = '3' AS open_switch, p = '1' AS await_loop, false AS inside_hook, false AS hook, p = '5' AS updater, 1 AS k FROM o
 UNION ALL SELECT file, 'loop', 6, false, false, false, false, true, false, false, false, 1 FROM o WHERE p = '1'
 UNION ALL SELECT file, 'try', 6, false, false, true, false, false, false, false, false, 1 FROM o WHERE p = '2'
 UNION ALL SELECT file, 'switch', 6, false, false, false, p = '3', false, false, false, false, 1 FROM o WHERE p IN ('3', '4')
 UNION ALL SELECT file, 'call', 6, false, true, false, false, false, true, true, true, 1 FROM o WHERE p = '5'
 UNION ALL SELECT file, 'call', 6, false, false, false, false, false, true, false, true, 1 FROM o WHERE p = '5'
 UNION ALL SELECT file, 'call', 6, false, false, false, false, false, true, false, false, 1 FROM o WHERE p = '5'
 UNION ALL SELECT file, 'arrow', 6, false, true, false, false, false, true, false, true, 1 FROM o WHERE p = '5'
 UNION ALL SELECT file, 'arrow', 6, false, false, false, false, false, true, false, false, 2 FROM o WHERE p = '5'
 UNION ALL SELECT file, 'call', 6, false, false, false, false, false, false, false, false, CASE p WHEN '2' THEN 2 ELSE 1 END FROM o WHERE p IN ('1', '2')
 UNION ALL SELECT file, 'call', 7, false, false, false, false, false, false, false, false, 1 FROM o
 UNION ALL SELECT file, 'call', 9, false, false, false, false, false, false, false, false, 1 FROM o WHERE o_orderkey % 10 = 0
 UNION ALL SELECT file, 'call', 10, false, false, false, false, false, false, false, false, 2 FROM o WHERE o_orderkey % 7 = 0
 UNION ALL SELECT file, 'arrow', 10, false, false, false, false, false, false, false, false, 1 FROM o WHERE o_orderkey % 7 = 0)
SELECT file, node, line::BIGINT AS line, conditional, returns_function, has_try, open_switch, await_loop, inside_hook, hook, updater, sum(k)::BIGINT AS n FROM n GROUP BY ALL""")
def structural_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates of every syntax node (FLT-3..12)."""
    p = structural.predicate_table(order_tokens(spark, sf_dir))
    cols = {"conditional": "conditional", "returns_function": "returns_function", "has_try": "has_try_catch", "open_switch": "switch_no_default",
            "await_loop": "await_in_loop", "inside_hook": "inside_hook", "hook": "hook_callback", "updater": "functional_state_updater"}
    named = p.select("file", "node", long("line"), *[c("p_" + s).alias(n) for n, s in cols.items()])
    return named.groupBy("file", "node", "line", *cols).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT {OFILE} AS file, 6::BIGINT AS line, 'useEffect' AS identifier, 'returns-cleanup,hook-callback' AS matched, 15::BIGINT AS score FROM orders WHERE {PRIO} = '5'""")
def structural_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """useEffect calls that return a cleanup, scored by matched predicates (FLT-13)."""
    table = structural.predicate_table(order_tokens(spark, sf_dir))
    hits = structural.structural_matches(table, ["returns-cleanup", "hook-callback"], ["useEffect"])
    return hits.select("file", long("line"), "identifier", F.array_join("matched_predicates", ",").alias("matched"), "score")


@query(f"SELECT {OFILE} AS file, 6::BIGINT AS line, 'setCount(prev => prev + 1)' AS match FROM orders WHERE {PRIO} = '5'")
def find_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code pattern with holes (FLT-14, T-20)."""
    return patterns.find_pattern(corpus.order_files(spark, sf_dir), "setCount($A => $A + $B)").select("file", long("line"), "match")


@query(f"""
SELECT {OFILE} AS file, 'process-env' AS regex, 5::BIGINT AS line, 'order' || o_orderkey AS enclosing FROM orders
UNION ALL SELECT {OFILE}, 'updater-arrow', 6, 'order' || o_orderkey FROM orders WHERE {PRIO} = '5'""")
def regex_with_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe regexes with the nearest function header above (FLT-15, WIN-5)."""
    files = corpus.order_files(spark, sf_dir)
    specs = [{"id": "process-env", "pattern": r"process\.env\.\w+", "flags": "g"}, {"id": "updater-arrow", "pattern": r"set\w+\s*\(\s*\w+\s*=>\s*\w+", "flags": "g"}]
    heads = patterns.nearest_header(facts.file_lines(files))
    hits = patterns.regex_hits(files, specs).join(heads.select("file", "line", "enclosing"), ["file", "line"])
    return hits.select("file", "regex", long("line"), "enclosing")


# --- resolution and references -----------------------------------------------------------------

_RESOLVED: dict[tuple, tuple] = {}


def resolved(spark: SparkSession, sf_dir: str):
    """References over the whole generated workspace, imports resolved through the package manifests.

    Resolved once per session and stored like the token rows: ten queries read the same reference table.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RESOLVED:
        files = corpus.source_files(spark, sf_dir).select("path")
        t = both_tokens(spark, sf_dir)
        bindings = stored(graph.import_bindings(t), "bindings")
        modules = stored(graph.resolve_modules(bindings, files, src.packages(corpus.manifests(spark, sf_dir))), "modules")
        decls = stored(facts.declarations(t).drop("path_tokens", "symbol_tokens"), "declarations")
        defs = stored(graph.definitions(stored(facts.exports(t), "exports"), decls, bindings, modules), "definitions")
        refs = stored(graph.references(t, bindings, modules, defs, decls), "references")
        _RESOLVED[key] = (refs, defs, decls, t)
    return _RESOLVED[key]


_REFS = f"""
WITH r AS (
 SELECT {CFILE} AS def_file, 'customer' || c_custkey AS def_symbol, {OFILE} AS file, line, line = 1 AS is_import FROM orders JOIN customer ON c_custkey = o_custkey, (VALUES (1), (7)) v(line)
 UNION ALL SELECT {CFILE}, 'Level' || c_custkey, {OFILE}, 2, true FROM orders JOIN customer ON c_custkey = o_custkey
 UNION ALL SELECT {CFILE}, 'Level' || c_custkey, {OFILE}, 6, false FROM orders JOIN customer ON c_custkey = o_custkey, (VALUES ('3'), ('3'), ('4')) v(p) WHERE {PRIO} = p
 UNION ALL SELECT {CFILE}, 'Customer' || c_custkey || 'Info', {CFILE}, 13, false FROM customer
 UNION ALL SELECT {OFILE}, 'order' || o_orderkey, {OFILE}, 9, false FROM orders WHERE o_orderkey % 10 = 0
 UNION ALL SELECT {OFILE}, 'order' || o_orderkey, {OFILE}, 10, false FROM orders WHERE o_orderkey % 7 = 0)
"""


@query(_REFS + "SELECT def_file, def_symbol, file, line::BIGINT AS line, is_import, count(*) AS n FROM r GROUP BY ALL")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references of all symbols (T-1, JN-10)."""
    refs = resolved(spark, sf_dir)[0]
    return refs.groupBy("def_file", "def_symbol", "file", long("line"), "is_import").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT {CFILE} AS callee_file, 'customer' || c_custkey AS callee, {OFILE} AS caller_file, 'order' || o_orderkey AS caller, {_CALL}::BIGINT AS arg_count
FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT {OFILE}, 'order' || o_orderkey, {OFILE}, NULL, 0 FROM orders WHERE o_orderkey % 7 = 0""")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved call graph, one row per call site (T-8)."""
    return graph.call_edges(resolved(spark, sf_dir)[0]).select("callee_file", "callee", "caller_file", "caller", long("arg_count"))


@query(f"""
SELECT c_custkey, 'customer' || c_custkey AS symbol, count(*) AS calls, count(DISTINCT {OFILE}) AS files FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def incoming_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming call counts of every exported function; partial sums before the shuffle (T-8)."""
    e = graph.call_edges(resolved(spark, sf_dir)[0]).filter(F.startswith("callee", F.lit("customer")))
    return e.groupBy("callee").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("caller_file").alias("files")).select(
        F.regexp_extract("callee", "(\\d+)$", 1).cast("long").alias("c_custkey"), c("callee").alias("symbol"), "calls", "files")


@query(f"""
SELECT {CFILE} AS def_file, 'customer' || c_custkey AS def_symbol, {OFILE} AS file, 2::BIGINT AS refs, 'spec' AS type FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 7 = 0""")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test files per exported function with reference counts (T-18)."""
    refs = resolved(spark, sf_dir)[0].filter(c("def_file") != c("file")).filter(F.startswith("def_symbol", F.lit("customer")))
    return graph.test_files(refs, ["def_file", "def_symbol"])


@query(_REFS + f"""
, e AS (SELECT {CFILE} AS file, name FROM (SELECT *, unnest(['customer' || c_custkey, 'Customer' || c_custkey || 'Info', 'balance' || c_custkey, 'Level' || c_custkey, 'isInfo' || c_custkey]) AS name FROM customer)
  UNION ALL SELECT {OFILE}, 'order' || o_orderkey FROM orders)
SELECT file AS def_file, name AS def_symbol FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.def_file = e.file AND r.def_symbol = e.name
  AND regexp_extract('/' || r.file, '/(packages|apps)/([^/]+)/', 2) <> regexp_extract('/' || e.file, '/(packages|apps)/([^/]+)/', 2))""")
def unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports without a use in another package (JN-12, T-27)."""
    refs, _, _, t = resolved(spark, sf_dir)
    ex = facts.exports(t).select(c("file").alias("def_file"), c("name").alias("def_symbol")).withColumn("package", paths.package_of(c("def_file")))
    return graph.unused_exports(ex, refs, ["def_file", "def_symbol"]).select("def_file", "def_symbol")


@query(f"""
SELECT {CFILE} AS def_file, name || c_custkey AS def_symbol, '@shop/nation' || c_nationkey || '/customer' || c_custkey AS import_path FROM customer, (VALUES ('customer'), ('isInfo')) v(name)
UNION ALL SELECT {OFILE}, 'order' || o_orderkey, {OFILE} FROM orders JOIN customer ON c_custkey = o_custkey""")
def auto_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import path of every exported function of all modules (T-28)."""
    t = both_tokens(spark, sf_dir)
    defs = facts.exports(t).filter(c("kind") == "function").select(c("file").alias("def_file"), c("name").alias("def_name"))
    out = graph.auto_import(defs, src.packages(corpus.manifests(spark, sf_dir)))
    return out.select("def_file", c("def_name").alias("def_symbol"), "import_path")


@query(f"""
SELECT file, line::BIGINT AS line, 'customer' || key AS old, 'client' || key AS new FROM (
 SELECT {CFILE} AS file, 4 AS line, c_custkey AS key FROM customer
 UNION ALL SELECT {OFILE}, line, o_custkey FROM orders, (VALUES (1), (7)) v(line))""")
def rename_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit preview of renaming every exported function (T-9)."""
    refs, _, decls, _ = resolved(spark, sf_dir)
    wanted = decls.filter(F.startswith("symbol", F.lit("customer"))).select(c("file").alias("def_file"), c("symbol").alias("def_symbol"))
    edits = graph.rename_edits(refs, wanted, decls, "client")
    return edits.select("file", long("line"), "old", F.concat("new", F.regexp_extract("old", "(\\d+)$", 1)).alias("new"))


# --- diffs and workflows -----------------------------------------------------------------------

_DIFF = f"""
WITH d AS (
 SELECT c_custkey AS k, {CFILE} AS file, unnest(CASE c_custkey % 10
  WHEN 0 THEN [{{'name': 'Customer' || c_custkey || 'Info', 'kind': 'removed', 'risk': 'breaking', 'reason': 'export "Customer' || c_custkey || 'Info" (interface) is gone'}}]
  WHEN 1 THEN [{{'name': 'customer' || c_custkey, 'kind': 'param_required', 'risk': 'breaking', 'reason': 'parameter "region" is new and must be passed'}}]
  WHEN 2 THEN [{{'name': 'customer' || c_custkey, 'kind': 'return_type_changed', 'risk': 'risky', 'reason': 'returned "number" before, now "string"'}}]
  WHEN 3 THEN [{{'name': 'Level' || c_custkey, 'kind': 'enum_member_added', 'risk': 'risky', 'reason': 'enum value "Extra" is new; switches may miss it'}}]
  WHEN 4 THEN [{{'name': 'Level' || c_custkey, 'kind': 'enum_member_removed', 'risk': 'breaking', 'reason': 'enum value "High" is gone'}}]
  WHEN 5 THEN [{{'name': 'extra' || c_custkey, 'kind': 'added', 'risk': 'safe', 'reason': 'export "extra' || c_custkey || '" (const) is new'}}]
  WHEN 6 THEN [{{'name': 'customer' || c_custkey, 'kind': 'param_required', 'risk': 'breaking', 'reason': 'parameter "priority" must now be passed'}}]
  WHEN 7 THEN [{{'name': 'customer' || c_custkey, 'kind': 'param_added', 'risk': 'safe', 'reason': 'parameter "note" is new and optional'}}]
  WHEN 8 THEN [{{'name': 'Customer' || c_custkey || 'Info', 'kind': 'interface_shape_changed', 'risk': 'breaking', 'reason': 'property "vip" is new and must be set'}}]
  ELSE [] END, recursive := true) FROM customer)
"""


def both_versions(spark: SparkSession, sf_dir: str):
    return facts.shapes(customer_tokens(spark, sf_dir, "head")), facts.shapes(customer_tokens(spark, sf_dir, "edited"))


@query(_DIFF + "SELECT file, name, kind, risk, reason FROM d")
def api_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two snapshots of all modules (D-1, D-2, JN-6, JN-7)."""
    return diff.diff_exports(*both_versions(spark, sf_dir)).select("file", "name", "kind", "risk", "reason")


_GUARD = _DIFF + f""", u AS (SELECT o_custkey AS k, count(*) AS n,
   count(*) FILTER ({PRIO} IN ('3', '4')) AS sw, count(*) FILTER ({PRIO} = '3') AS sw3, count(*) FILTER ({_CALL} < 3) AS few3, count(*) FILTER ({_CALL} < 2) AS few2 FROM orders GROUP BY 1),
 g AS (SELECT d.*, coalesce(CASE WHEN name LIKE 'customer%' THEN 2 * n WHEN name LIKE 'Level%' THEN n + 2 * sw3 + (sw - sw3) ELSE 0 END, 0) AS cross_package,
   CASE WHEN name LIKE 'Customer%' AND kind <> 'removed' THEN 1 ELSE 0 END AS same_package,
   coalesce(CASE WHEN kind = 'enum_member_added' THEN sw3 WHEN kind = 'enum_member_removed' AND d.k % 2 = 1 THEN sw3 ELSE 0 END, 0) AS open_switches,
   coalesce(CASE WHEN d.k % 10 = 1 THEN few3 WHEN d.k % 10 = 6 THEN few2 ELSE 0 END, 0) AS breaking_callers
   FROM d LEFT JOIN u USING (k))
"""


def guard_entries(spark: SparkSession, sf_dir: str):
    base, head = both_versions(spark, sf_dir)
    refs, _, _, t = resolved(spark, sf_dir)
    edges = graph.call_edges(refs)
    return diff.api_guard(base, head, refs, facts.switches(t), edges), refs, t


@query(_GUARD + """SELECT file, name, kind, CASE WHEN risk = 'risky' AND cross_package = 0 THEN 'safe' ELSE risk END AS risk, cross_package::BIGINT AS cross_package,
 open_switches::BIGINT AS open_switches, breaking_callers::BIGINT AS breaking_callers FROM g""")
def api_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract changes with consumers, open switches and breaking callers (T-22)."""
    return guard_entries(spark, sf_dir)[0].select(
        "file", "name", "kind", "risk", long("cross_package"), long("open_switches"), long("breaking_callers"))


@query(_GUARD + """, r AS (SELECT kind, CASE WHEN risk = 'risky' AND cross_package = 0 THEN 'safe' ELSE risk END AS risk FROM g)
SELECT count(*) AS changed, count(*) FILTER (risk = 'breaking') AS breaking, count(*) FILTER (risk = 'risky') AS risky, count(*) FILTER (risk = 'safe') AS safe,
 CASE WHEN count(*) FILTER (risk = 'breaking') > 0 THEN 'major' WHEN count(*) FILTER (risk = 'safe' AND kind IN ('added', 'param_added')) > 0 THEN 'minor' ELSE 'patch' END AS semver FROM r""")
def api_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk counts and semver advice (AGG-12)."""
    return diff.api_summary(guard_entries(spark, sf_dir)[0])


def _steps_sql() -> str:
    """The steps of the changes above, from the table of sentences."""
    key = "CASE WHEN kind = 'interface_shape_changed' THEN 'member_required' ELSE kind END"
    arms = " ".join(f"WHEN '{k}' THEN {steps!r}" for k, steps in advice.STEPS.items())
    what = "regexp_extract(reason, '\"([^\"]+)\"', 1)"
    return f"replace(replace(array_to_string(CASE {key} {arms} ELSE {advice.OTHER_STEPS!r} END, ' / '), '{{name}}', name), '{{what}}', {what})"


@query(_DIFF + f"SELECT file, name, {_steps_sql()} AS steps FROM d")
def migration_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migration advice per change (D-11)."""
    d = diff.diff_exports(*both_versions(spark, sf_dir))
    steps = diff.migration_steps(c("name"), c("kind"), F.element_at("changes", 1)["reason"])
    return d.select("file", "name", F.array_join(steps, " / ").alias("steps"))


@query(f"""
SELECT {OFILE} AS file, 'Level' || o_custkey AS enum, CASE WHEN {PRIO} = '3' THEN CASE WHEN o_custkey % 2 = 1 THEN 'Top' ELSE '' END
  ELSE CASE WHEN o_custkey % 2 = 1 THEN 'High,Top' ELSE 'High' END END AS missing, {PRIO} = '4' OR o_custkey % 2 = 0 AS is_exhaustive
FROM orders WHERE {PRIO} IN ('3', '4')""")
def enum_exhaustiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches against the members of their enum (D-6..9, JN-16)."""
    refs, _, _, t = resolved(spark, sf_dir)
    out = diff.exhaustiveness(diff.enums_of(facts.shapes(t)), diff.resolve_switches(facts.switches(t), refs))
    return out.select("file", "enum", F.array_join("missing", ",").alias("missing"), "is_exhaustive")


@query(f"""
SELECT 'Level' || o_custkey AS enum, count(*) FILTER ({PRIO} = '3') AS affected, count(*) FILTER ({PRIO} = '4') AS safe FROM orders WHERE {PRIO} IN ('3', '4') GROUP BY 1""")
def added_member_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches that would miss a new enum member (D-7, AGG-16)."""
    refs, _, _, t = resolved(spark, sf_dir)
    results = diff.exhaustiveness(diff.enums_of(facts.shapes(t)), diff.resolve_switches(facts.switches(t), refs))
    return diff.added_member_impact(results).drop("enum_file")


@query(f"""
SELECT {OFILE} AS caller_file, 'customer' || o_custkey AS callee, {_CALL} >= CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS compatible,
 CASE WHEN {_CALL} < CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END THEN 'Too few args: ' || {_CALL} || ' passed, ' || CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END || ' required' END AS issue FROM orders""")
def call_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call against the arity of its target (D-4, JN-15)."""
    refs, _, _, t = resolved(spark, sf_dir)
    arity = diff.arity_of(facts.shapes(t))
    calls = graph.call_edges(refs).filter(F.startswith("callee", F.lit("customer")))
    out = diff.call_compatibility(calls, arity)
    return out.select("caller_file", "callee", "compatible", "issue")


@query(_DIFF + """SELECT file, CASE WHEN k % 10 = 5 THEN 12 WHEN k % 10 IN (0, 8) THEN 8 WHEN k % 10 IN (3, 4) THEN 11 ELSE 4 END::BIGINT AS start_line FROM d""")
def changed_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed line ranges between the snapshots (SRC-17, SRC-18)."""
    base, head = corpus.customer_files(spark, sf_dir), corpus.customer_files(spark, sf_dir, "edited")
    return src.changed_hunks(base, head).select("file", long("start_line"))


@query(_DIFF + """SELECT DISTINCT file, 'modified' AS status FROM d""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content hash differs (SRC-17)."""
    base, head = corpus.customer_files(spark, sf_dir), corpus.customer_files(spark, sf_dir, "edited")
    return src.changed_files(base, head).select(c("path").alias("file"), "status")


@query(f"""
WITH u AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER ({PRIO} = '3') AS sw3, count(*) FILTER ({PRIO} = '4') AS sw4 FROM orders GROUP BY 1),
s AS (SELECT {CFILE} AS file, c_custkey AS k, CASE WHEN c_custkey % 10 IN (1, 2, 6, 7) THEN 'customer' || c_custkey WHEN c_custkey % 10 = 8 THEN 'Customer' || c_custkey || 'Info' WHEN c_custkey % 10 IN (3, 4) THEN 'Level' || c_custkey END AS name,
  CASE WHEN c_custkey % 10 IN (1, 2, 6, 7) THEN 'function' WHEN c_custkey % 10 = 8 THEN 'interface' ELSE 'enum' END AS kind FROM customer WHERE c_custkey % 10 IN (1, 2, 3, 4, 6, 7, 8)),
r AS (SELECT s.*, coalesce(CASE WHEN kind = 'function' THEN 2 * n WHEN kind = 'enum' THEN n + 2 * sw3 + sw4 ELSE 1 END, CASE WHEN kind = 'interface' THEN 1 ELSE 0 END)::BIGINT AS refs FROM s LEFT JOIN u USING (k))
SELECT file, name, kind, refs, CASE WHEN refs > 10 THEN 'high' WHEN refs > 3 THEN 'medium' ELSE 'low' END AS risk FROM r""")
def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed symbols with their blast radius (JN-9, AGG-7, T-17)."""
    base, head = corpus.customer_files(spark, sf_dir), corpus.customer_files(spark, sf_dir, "edited")
    t = customer_tokens(spark, sf_dir, "edited")
    ranges = diff.symbol_ranges(facts.nodes(t), t)
    refs = resolved(spark, sf_dir)[0]
    return diff.semantic_diff(src.changed_hunks(base, head), ranges, refs)


SIMULATED = ["add_required_param", "add_optional_param", "remove_param", "add_enum_member", "remove_enum_member", "change_return_type"]


@query(f"""
WITH u AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER ({_CALL} < 3) AS lt3, count(*) FILTER ({_CALL} < 2) AS lt2, count(*) FILTER ({_CALL} < 1 OR {_CALL} > 3) AS opt_bad,
  count(*) FILTER ({_CALL} <> 1) AS ne1, count(*) FILTER ({PRIO} = '3') AS sw3 FROM orders GROUP BY 1),
b AS (SELECT c_custkey AS k, c_custkey % 6 AS r, coalesce(n, 0) AS n, coalesce(lt3, 0) AS lt3, coalesce(lt2, 0) AS lt2, coalesce(opt_bad, 0) AS opt_bad, coalesce(ne1, 0) AS ne1, coalesce(sw3, 0) AS sw3 FROM customer LEFT JOIN u ON k = c_custkey)
SELECT CASE WHEN r IN (3, 4) THEN 'Level' ELSE 'customer' END || k AS symbol,
 ['add_required_param', 'add_optional_param', 'remove_param', 'add_enum_member', 'remove_enum_member', 'change_return_type'][r + 1] AS recipe,
 ['param_required', 'param_added', 'param_removed', 'enum_member_added', 'enum_member_removed', 'return_type_changed'][r + 1] AS kind,
 ['breaking', 'safe', 'breaking', 'risky', 'breaking', 'risky'][r + 1] AS risk,
 (CASE r WHEN 0 THEN lt2 WHEN 1 THEN CASE WHEN k % 2 = 0 THEN opt_bad ELSE lt2 END WHEN 2 THEN ne1 ELSE 0 END)::BIGINT AS breaking_callers,
 (CASE WHEN r = 3 THEN sw3 ELSE 0 END)::BIGINT AS open_switches FROM b""")
def simulate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One simulated change per customer module, recipes in turn (D-10, T-31)."""
    refs, _, _, t = resolved(spark, sf_dir)
    shapes_ = facts.shapes(t).filter(F.startswith("file", F.lit("packages/")))
    options = ", ".join(f"'{r}'" for r in SIMULATED)
    made = corpus.customer_modules(spark, sf_dir).select(
        c("key").alias("change"), c("path").alias("file"), F.expr(f"element_at(array({options}), cast(key % 6 + 1 as int))").alias("recipe"))
    recipes = made.withColumn("symbol", F.concat(F.when(F.contains("recipe", F.lit("enum")), "Level").otherwise("customer"), c("change").cast("string"))).withColumn(
        "name", F.when(c("recipe") == "remove_param", "priority").when(c("recipe") == "remove_enum_member", "High").when(
            c("recipe") == "add_enum_member", "Extra").otherwise("extra")).withColumn("type_text", F.lit("string"))
    out = workflows.simulate_changes(shapes_, recipes, graph.call_edges(refs), diff.resolve_switches(facts.switches(t), refs))
    return out.select("symbol", "recipe", "kind", "risk", long("breaking_callers"), long("open_switches"))


@query(f"""
SELECT {OFILE} AS file, 7::BIGINT AS line, 'TS2554' AS code, 'customer' || o_custkey AS symbol FROM orders WHERE {_CALL} < CASE WHEN o_custkey % 10 IN (1) THEN 3 WHEN o_custkey % 10 = 6 OR o_custkey % 2 = 1 THEN 2 ELSE 1 END
UNION ALL SELECT {OFILE}, 6, 'TS2339', 'Level' || o_custkey FROM orders WHERE o_custkey % 10 = 4 AND {PRIO} = '3'""")
def derived_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors the edited modules cause in their users (SVC-9)."""
    return _diagnostics(spark, sf_dir)[0].select("file", long("line"), "code", "symbol")


def _diagnostics(spark: SparkSession, sf_dir: str):
    refs, _, _, t = resolved(spark, sf_dir)
    head = facts.shapes(customer_tokens(spark, sf_dir, "edited"))
    calls = graph.call_edges(refs).filter(F.startswith("callee", F.lit("customer")))
    diags = workflows.derive_diagnostics(calls, diff.arity_of(head), switches=diff.resolve_switches(facts.switches(t), refs), enums=diff.enums_of(head))
    return diags, refs, t, head


_ERR = f"""
WITH e AS (SELECT o_orderkey, o_custkey AS k FROM orders WHERE {_CALL} < CASE WHEN o_custkey % 10 IN (1) THEN 3 WHEN o_custkey % 10 = 6 OR o_custkey % 2 = 1 THEN 2 ELSE 1 END)
"""


@query(_ERR + f"""SELECT 'order' || o_orderkey AS error, 'definition-site' AS source, {CFILE} AS cause_file,
 (5 + CASE WHEN k % 10 <> 9 THEN 13 + CASE WHEN (k % 10 = 3 OR (k % 10 = 4 AND k % 2 = 1)) AND (SELECT count(*) FROM orders o WHERE o.o_custkey = e.k AND {PRIO} = '3') > 0 THEN 3 ELSE 0 END ELSE 0 END)::BIGINT AS score,
 CASE WHEN k % 10 <> 9 THEN 'high' ELSE 'medium' END AS confidence FROM e JOIN customer ON c_custkey = k""")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored causes of every wrong-argument error (T-23)."""
    diags, refs, t, head = _diagnostics(spark, sf_dir)
    base_files, head_files = corpus.customer_files(spark, sf_dir), corpus.customer_files(spark, sf_dir, "edited")
    entries = diff.api_guard(facts.shapes(customer_tokens(spark, sf_dir)), head, refs, facts.switches(t))
    errors = diags.filter(c("code") == workflows.ARITY_CODE).join(
        refs.filter(c("argc").isNotNull()).select("file", "line", c("def_symbol").alias("symbol"), "def_file", "def_symbol", "enclosing").distinct(),
        ["file", "line", "symbol"]).select(c("enclosing").alias("error"), "file", "def_file", "def_symbol")
    none = errors.limit(0).select("error", c("def_symbol").alias("caller"), c("file").alias("caller_file"))
    out = workflows.root_causes(errors, src.changed_files(base_files, head_files), entries, none, diags)
    return out.select("error", "source", "cause_file", long("score"), "confidence")


@query(_GUARD + f""", f AS (SELECT regexp_extract(file, 'packages/([^/]+)/', 1) AS package, k, kind,
  CASE WHEN risk = 'risky' AND cross_package = 0 THEN 'safe' ELSE risk END AS risk FROM g),
 s AS (SELECT package, count(*) AS changed, count(*) FILTER (risk = 'breaking') AS breaking, count(*) FILTER (risk = 'risky') AS risky,
  count(*) FILTER (risk <> 'safe' AND kind IN ('param_required', 'return_type_changed', 'param_removed')) AS signatures FROM f GROUP BY 1)
SELECT package, changed::BIGINT AS changed, breaking::BIGINT AS breaking, risky::BIGINT AS risky, signatures::BIGINT AS signatures,
 CASE WHEN breaking > 0 OR signatures > 0 OR risky > 0 THEN 'needs-attention' ELSE 'safe' END AS verdict,
 CASE WHEN breaking > 0 OR signatures > 0 THEN concat_ws(', ', CASE WHEN breaking > 0 THEN breaking || ' breaking change(s)' END, CASE WHEN signatures > 0 THEN signatures || ' changed signature(s)' END)
      WHEN risky > 0 THEN risky || ' risky change(s) to review' ELSE 'nothing found against it' END AS verdict_reason FROM s""")
def verify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per package for the edited snapshot (T-30)."""
    entries, refs, t = guard_entries(spark, sf_dir)
    base, head = corpus.customer_files(spark, sf_dir), corpus.customer_files(spark, sf_dir, "edited")
    changed = src.changed_files(base, head).withColumn("package", paths.package_of(c("path")))
    # Errors and open switches sit in files outside the change set, so both inputs are empty for these packages.
    no_diags = refs.limit(0).select("file", F.lit(1).alias("severity"))
    no_switches = refs.limit(0).select(c("file").alias("enum_file"), F.lit(True).alias("is_exhaustive"))
    out = workflows.verify_changes(changed, no_diags, entries, no_switches, refs.filter("is_test"), ["package"])
    return out.select("package", long("changed"), long("breaking"), long("risky"), long("signatures"), "verdict", "verdict_reason")


@query(_GUARD + f""", f AS (SELECT regexp_extract(file, 'packages/([^/]+)/', 1) AS package, k, kind,
  CASE WHEN risk = 'risky' AND cross_package = 0 THEN 'safe' ELSE risk END AS risk FROM g),
 w AS (SELECT package, count(*) AS switches FROM f JOIN orders ON o_custkey = k WHERE {PRIO} = '3' AND k % 2 = 1 GROUP BY 1),
 s AS (SELECT package, count(*) AS changed, count(*) FILTER (risk = 'breaking') AS breaking, count(*) FILTER (risk = 'risky') AS risky,
  count(*) FILTER (risk <> 'safe' AND kind IN ('param_required', 'return_type_changed', 'param_removed')) AS signatures FROM f GROUP BY 1)
SELECT package, changed::BIGINT AS changed, 0::BIGINT AS errors, breaking::BIGINT AS breaking, coalesce(switches, 0)::BIGINT AS switches, risky::BIGINT AS risky, signatures::BIGINT AS signatures,
 CASE WHEN breaking > 0 OR signatures > 0 OR risky > 0 OR switches > 0 THEN 'needs-attention' ELSE 'safe' END AS verdict,
 CASE WHEN breaking > 0 OR signatures > 0 OR switches > 0 THEN concat_ws(', ', CASE WHEN breaking > 0 THEN breaking || ' breaking change(s)' END,
   CASE WHEN switches > 0 THEN switches || ' open switch(es)' END, CASE WHEN signatures > 0 THEN signatures || ' changed signature(s)' END)
      WHEN risky > 0 THEN risky || ' risky change(s) to review' ELSE 'nothing found against it' END AS verdict_reason FROM s LEFT JOIN w USING (package)""")
def verify_changes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per package from all inputs: API entries, derived errors and the switches over the enums of the changed files (T-30)."""
    entries, refs, _ = guard_entries(spark, sf_dir)
    diags, _, t, head = _diagnostics(spark, sf_dir)
    base, edited = corpus.customer_files(spark, sf_dir), corpus.customer_files(spark, sf_dir, "edited")
    changed = src.changed_files(base, edited).withColumn("package", paths.package_of(c("path")))
    switches = diff.exhaustiveness(diff.enums_of(head), diff.resolve_switches(facts.switches(t), refs))
    out = workflows.verify_changes(changed, diags, entries, switches, refs.filter("is_test"), ["package"])
    return out.select("package", *[long(x) for x in ("changed", "errors", "breaking", "switches", "risky", "signatures")], "verdict", "verdict_reason")


# --- search over code --------------------------------------------------------------------------

def workspace(spark: SparkSession, sf_dir: str) -> fc.Workspace:
    files = corpus.source_files(spark, sf_dir).select("path", "text").unionByName(corpus.manifests(spark, sf_dir))
    ws = fc.Workspace(files)
    ws.__dict__["tokens"] = both_tokens(spark, sf_dir)
    return ws


@query()
def find_code_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search for a behavior question over all modules (T-21)."""
    out, _ = fc.find_code(workspace(spark, sf_dir), "where is the balance fetched with fallback", include_tests=True)
    return out.select("file", "line", "name", "candidate_type", "score")


@query(f"""
WITH h AS (SELECT {OFILE} AS file, o_orderkey FROM orders WHERE {PRIO} = '5')
SELECT file, 6::BIGINT AS line, 'useEffect' AS name, (12 + 15 + 3 + 3 + CASE WHEN o_orderkey % 7 = 0 THEN -3 ELSE 0 END)::BIGINT AS score FROM h ORDER BY 4 DESC, 1 LIMIT 10""")
def find_code_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search for an identifier with structural cues over all modules (T-21)."""
    out, _ = fc.find_code(workspace(spark, sf_dir), "useEffect that returns a cleanup callback", include_tests=True)
    return out.select("file", long("line"), "name", "score")


@query(f"""
SELECT {OFILE} AS file, line::BIGINT AS line, CASE line WHEN 5 THEN 'incompatible_assignment' WHEN 7 THEN 'wrong_return_type'
 ELSE CASE WHEN {PRIO} IN ('3', '4') THEN 'unhandled_enum_member' ELSE 'bad_call_argument' END END AS site FROM orders, (VALUES (5), (6), (7)) v(line)""")
def error_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-site class of three lines of every order module (FX-21)."""
    t = order_tokens(spark, sf_dir)
    targets = corpus.order_modules(spark, sf_dir).select(c("path").alias("file"), F.explode(F.array(F.lit(5), F.lit(6), F.lit(7))).alias("line"))
    at = facts.nodes_at_lines(t, targets)
    return at.select("file", long("line"), workflows.error_site(c("kind")).alias("site"))


@query(f"""
SELECT {CFILE} AS file, 'customer' || c_custkey AS name, 'function customer' || c_custkey || '(status, priority' || CASE WHEN c_custkey % 2 = 0 THEN '?' ELSE '' END || '): number' AS signature FROM customer
UNION ALL SELECT {CFILE}, 'Customer' || c_custkey || 'Info', 'interface Customer' || c_custkey || 'Info {{ name, segment }}' FROM customer
UNION ALL SELECT {CFILE}, 'balance' || c_custkey, 'const balance' || c_custkey || ': unknown' FROM customer
UNION ALL SELECT {CFILE}, 'Level' || c_custkey, 'enum Level' || c_custkey || ' {{ Low, High' || CASE WHEN c_custkey % 2 = 1 THEN ', Top' ELSE '' END || ' }}' FROM customer
UNION ALL SELECT {CFILE}, 'isInfo' || c_custkey, 'function isInfo' || c_custkey || '(x): x is Customer' || c_custkey || 'Info' FROM customer""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol tree with signatures (T-24)."""
    t = customer_tokens(spark, sf_dir)
    out = graph.outline(graph.document_symbols(facts.nodes(t), facts.declarations(t)), facts.shapes(t))
    return out.select("file", "name", "signature")


@query(f"""
SELECT {CFILE} AS file, 'Customer' || c_custkey || 'Info' AS name, 'segment' AS member, 'Segment' AS type_text FROM customer""")
def typed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with a named type, the input of type definition lookups (T-3)."""
    s = facts.shapes(customer_tokens(spark, sf_dir)).filter(c("kind") == "interface")
    return s.select("file", "name", F.inline("members")).toDF("file", "owner", "member", "optional", "type_text").filter(
        c("type_text").rlike("^[A-Z]")).select("file", c("owner").alias("name"), "member", "type_text")


@query(f"""
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT {CFILE} AS file, 'customer' || c_custkey AS name, 'Looks up the balance of ' || c_name || '.' AS doc, coalesce(2 * n, 0) AS refs, coalesce(n, 0) AS files
FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def inspect_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature, doc and reference counts of documented exports (T-14)."""
    t = customer_tokens(spark, sf_dir)
    out = graph.inspect_symbols(facts.shapes(t), facts.docs(t), resolved(spark, sf_dir)[0])
    return out.filter(c("doc").isNotNull()).select("file", "name", "doc", "refs", "files")


@query(_ERR + f""", o AS (SELECT o_orderkey, k, {OFILE} AS file, {PRIO} AS p FROM e JOIN orders USING (o_orderkey))
SELECT o_orderkey AS target, file, CASE WHEN k % 10 = 4 AND p = '3' THEN 6 ELSE 7 END::BIGINT AS line,
 CASE WHEN k % 10 = 4 AND p = '3' THEN 'TS2339' ELSE 'TS2554' END AS code, CASE WHEN k % 10 = 4 AND p = '3' THEN 'unhandled_enum_member' ELSE 'wrong_return_type' END AS site FROM o""")
def explain_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's error nearest to line 6, with the class of its site (T-19)."""
    diags, _, t, _ = _diagnostics(spark, sf_dir)
    wrong = diags.filter(c("code") == workflows.ARITY_CODE).select("file").distinct()
    targets = corpus.order_modules(spark, sf_dir).select(c("key").alias("target"), c("path").alias("file"), F.lit(6).alias("line"),
                                                         F.lit(None).cast("string").alias("code")).join(wrong, "file", "left_semi")
    out = workflows.explain_errors(targets, diags, t)
    return out.select("target", "file", long("line"), "code", "site")
