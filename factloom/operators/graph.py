"""Symbol resolution, reference and call graphs, breadth-first walks and budgeted selection.

There is no type checker: a definition is (file, exported name), imports are resolved by path, package
name or alias, re-exports by pointer doubling. All of it is equi-joins on short keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import paths, text
from factloom.functions.lexer import KEYWORDS
from factloom.operators import reexports, scopes
from factloom.operators.ranking import top_per_key
from factloom.session import cut_lineage, shuffled, stored

# Walk limits of the tools.
FAN_OUT = 20
IMPACT_DEPTH = 3
CONTEXT_DEPTH = 2
MAX_TOKENS = 100_000
BODY_LINES = 30
SYMBOL_LIMIT = COMPLETION_LIMIT = 20
REFERENCE_LIMIT = 100
# Words before the name of a class member.
MEMBER_WORDS = ["get", "set", "static", "async", "readonly", "public", "private", "protected", "abstract", "override"]

c = F.col
EXT = "\\.(d\\.ts|tsx|ts|jsx|js|mjs|cjs)$"


# --- imports and definitions -------------------------------------------------------------------

def import_bindings(tokens: DataFrame) -> DataFrame:
    """(file, line, col, local, imported, module) per imported name."""
    ids = tokens.filter((c("kind") == "id") & (c("s1") == "import") & c("module").isNotNull() & (c("ord") > c("stmt"))
                        & ~c("text").isin("from", "as", "type", "import") & ~F.coalesce(c("p1"), F.lit("")).isin(".", "?."))
    named = c("open_role") == "names"
    imported = (
        F.when(named & (c("p1") == "as"), c("p2")).when(named, c("text"))
        .when((c("p1") == "as") & (c("p2") == "*"), F.lit("*")).otherwise("default")
    )
    return ids.filter(F.coalesce(c("n1"), F.lit("")) != "as").select(
        "file", "line", "col", c("text").alias("local"), imported.alias("imported"), "module")


def _resolve_dots(path: Column) -> Column:
    """``a/b/../c`` to ``a/c``."""
    empty = F.array().cast("array<string>")
    folded = F.aggregate(F.split(path, "/"), empty, lambda acc, p: F.when(
        p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin(".", ""), acc).otherwise(F.array_append(acc, p)))
    return F.array_join(folded, "/")


def file_keys(files: DataFrame) -> DataFrame:
    """Keys a module path may use for a file: without extension, and the folder for index files."""
    stem = F.regexp_replace("path", EXT, "")
    is_index = stem.rlike("(^|/)index$")
    keys = F.when(is_index, F.array(stem, F.regexp_replace(stem, "/?index$", ""))).otherwise(F.array(stem))
    return files.select(c("path").alias("target"), F.explode(keys).alias("key"))


def resolve_modules(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None,
                    aliases: DataFrame | None = None) -> DataFrame:
    """Distinct (file, module) of ``imports`` with the file they mean; unresolved modules are dropped."""
    return resolve_options(module_options(imports, packages, aliases), files)


def resolve_options(options: DataFrame, files: DataFrame) -> DataFrame:
    """The first of each module's options that a file answers to: (file, module, target)."""
    found = options.join(shuffled(file_keys(files)), "key")
    return found.groupBy("file", "module").agg(F.min_by("target", F.struct("rank", "target")).alias("target"))


def module_options(imports: DataFrame, packages: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(file, module, rank, key): the keys that a module path of a file may stand for, in the order they are tried."""
    wanted = imports.select("file", "module").distinct()
    folder = F.array_join(paths.dirs_of(c("file")), "/")
    bare = F.regexp_replace("module", "\\.(tsx?|jsx?|mjs|cjs)$", "")
    relative = wanted.filter(F.startswith("module", F.lit("."))).select(
        "file", "module", F.lit(0).alias("rank"), _resolve_dots(F.concat(folder, F.lit("/"), bare)).alias("key"))
    options = relative
    outside = wanted.filter(~F.startswith("module", F.lit(".")))
    if packages is not None:
        seg = F.split("module", "/")
        n = F.when(F.startswith("module", F.lit("@")), 2).otherwise(1)
        sub = F.array_join(F.slice(seg, n + 1, 1 << 20), "/")
        named = outside.withColumn("name", F.array_join(F.slice(seg, 1, n), "/")).withColumn("sub", sub).join(
            packages.select("name", "dir"), "name")
        keys = F.when(c("sub") == "", F.array(F.concat("dir", F.lit("/src")), c("dir"))).otherwise(
            F.array(F.concat("dir", F.lit("/src/"), "sub"), F.concat("dir", F.lit("/"), "sub")))
        options = options.unionByName(named.select("file", "module", F.posexplode(keys).alias("i", "key")).select(
            "file", "module", (c("i") + 1).alias("rank"), "key"))
    if aliases is not None:
        # Alias prefix join as an equi-join: list the module's prefixes.
        pref = outside.select("file", "module", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("module")), lambda k: F.substring("module", 1, k))).alias("prefix"))
        star = aliases.withColumn("prefix", F.regexp_replace("alias", "\\*$", ""))
        hit = pref.join(star, "prefix").filter(F.endswith("alias", F.lit("*")) | (c("prefix") == c("module")))
        goal = F.concat_ws("/", F.when(c("dir") != "", c("dir")), "base_url", F.replace(
            "target", F.lit("*"), F.substring(c("module"), F.length("prefix") + 1, F.lit(1 << 20))))
        options = options.unionByName(hit.select("file", "module", (c("ordinal") + 10).alias("rank"),
                                                 F.regexp_replace(_resolve_dots(goal), EXT, "").alias("key")))
    return options


def definitions(exports: DataFrame, declarations: DataFrame, bindings: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, exported_as) to (def_file, def_name, def_line, def_kind) through re-exports and barrels of any depth."""
    return reexports.resolved(exports, declarations, bindings, modules)[0]


def goto_definition(uses: DataFrame, bindings: DataFrame, modules: DataFrame, defs: DataFrame, declarations: DataFrame) -> DataFrame:
    """(file, name) of ``uses`` to where the name is defined: a declaration of the file, else what the import leads to."""
    wanted = uses.select("file", "name").distinct()
    own = wanted.join(declarations.select("file", c("symbol").alias("name"), c("file").alias("def_file"), c("symbol").alias("def_name"),
                                          c("line").alias("def_line"), c("kind").alias("def_kind")), ["file", "name"])
    far = wanted.join(bindings.select("file", c("local").alias("name"), "imported", "module"), ["file", "name"]).join(modules, ["file", "module"]).join(
        defs.select(c("file").alias("target"), c("exported_as").alias("imported"), *reexports.DEF), ["target", "imported"])
    return own.unionByName(far.select("file", "name", *reexports.DEF).join(own.select("file", "name"), ["file", "name"], "left_anti")).distinct()


def references(tokens: DataFrame, bindings: DataFrame, modules: DataFrame, defs: DataFrame, declarations: DataFrame) -> DataFrame:
    """Every use of an exported or top-level symbol: (def_file, def_symbol, local name, file, line, col, package, is_test, is_import).

    Imported names and same-file names are both joined on (file, name), in the dealing of the stream that leaves out the names
    that a local binding hides. Names that their file neither imports nor declares stay where they are.
    """
    bound = bindings.join(shuffled(modules), ["file", "module"]).join(
        shuffled(defs.select(c("file").alias("target"), c("exported_as").alias("imported"), "def_file", "def_name")), ["target", "imported"]).select(
        "file", c("local").alias("name"), "def_file", c("def_name").alias("def_symbol"), F.lit(-1).alias("decl_ord"))
    local = declarations.select("file", c("symbol").alias("name"), c("file").alias("def_file"), c("symbol").alias("def_symbol"),
                                c("ord").alias("decl_ord"))
    names = stored(bound.unionByName(local), "names")  # read twice
    member = (c("open_role") == "class") & c("p1").isin("{", "}", ";", "*", *MEMBER_WORDS)
    key = ((c("n1") == ":") & c("open_role").isin("object", "interface", "type")) | member
    ids = tokens.filter(
        c("known") & (c("kind") == "id") & ~F.coalesce(c("p1"), F.lit("")).isin(".", "?.") & ~F.coalesce(key, F.lit(False))
        & ~c("text").isin(*KEYWORDS) & ~((c("s1") == "import") & (F.coalesce(c("n1"), F.lit("")) == "as"))
    ).select("file", c("text").alias("name"), "ord", "line", "col", (c("s1") == "import").alias("is_import"), "sym", "argc", "node")
    hidden = scopes.local_scopes(tokens, names, known=True)
    hit = scopes.unshadowed(ids, hidden).join(shuffled(names), ["file", "name"]).filter(c("ord") != c("decl_ord"))
    return hit.select(
        "def_file", "def_symbol", c("name").alias("local"), "file", "line", "col", paths.package_of(c("file")).alias("package"),
        paths.is_test_file(c("file")).alias("is_test"), F.coalesce("is_import", F.lit(False)).alias("is_import"),
        c("sym").alias("enclosing"), F.when(c("node") == "call", c("argc")).alias("argc"))


def call_edges(refs: DataFrame) -> DataFrame:
    """Resolved calls: one row per call site."""
    return refs.filter(c("argc").isNotNull()).select(
        c("file").alias("caller_file"), c("enclosing").alias("caller"), c("def_file").alias("callee_file"),
        c("def_symbol").alias("callee"), "line", c("argc").alias("arg_count"))


# --- lookups -----------------------------------------------------------------------------------

def find_references(refs: DataFrame, symbols: DataFrame, limit: int | None = REFERENCE_LIMIT) -> DataFrame:
    """First ``limit`` references per symbol by file and position; ``symbols`` has (def_file, def_symbol)."""
    hit = refs.join(symbols, ["def_file", "def_symbol"], "left_semi")
    if limit is None:
        return hit
    return top_per_key(hit, ["def_file", "def_symbol"], [c("file"), c("line"), c("col")], limit)


def references_by_file(refs: DataFrame, keys: list[str]) -> DataFrame:
    return refs.groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("refs"), F.min("line").alias("first_line"))


def references_by_package(refs: DataFrame, own_package: Column, keys: list[str]) -> DataFrame:
    """Same-package and cross-package counts per symbol."""
    same = c("package").eqNullSafe(own_package)
    return refs.groupBy(*keys).agg(F.count_if(same).alias("same_package"), F.count_if(~same).alias("cross_package"))


def unused_exports(exported: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Exports without a use from another package; outside any package, without any use at all.

    ``exported`` and ``refs`` both have the keys and ``package`` (of the export, of the use).
    """
    uses = refs.select(*keys, c("package").alias("use_package")).distinct()
    own = exported.withColumnRenamed("package", "own_package")
    crossing = own.join(uses, keys).filter(c("own_package").isNull() | (
        c("use_package").isNotNull() & (c("use_package") != c("own_package")))).select(*keys).distinct()
    return exported.join(crossing, keys, "left_anti")


def test_files(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Test files that use a symbol, with reference counts and the kind of test."""
    return refs.filter(paths.is_test_file(c("file"))).groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("refs")).withColumn(
        "type", paths.test_file_type(c("file")))


def batch_lookup(wanted: DataFrame, symbols: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Signature and reference count per wanted name; unknown names stay as rows with found = false."""
    found = wanted.join(symbols, key, "left").join(counts, key, "left")
    return found.withColumn("refs", F.coalesce("refs", F.lit(0)))


def workspace_symbols(declarations: DataFrame, query: str, limit: int = SYMBOL_LIMIT) -> DataFrame:
    hit = declarations.filter(F.contains(F.lower("symbol"), F.lit(query.lower())))
    exact = F.when(c("symbol") == query, 0).when(F.startswith(F.lower("symbol"), F.lit(query.lower())), 1).otherwise(2)
    return hit.orderBy(exact, "symbol", "file", "line").limit(limit)


def resolve_symbol(declarations: DataFrame, name: str, file_hint: str | None = None) -> DataFrame:
    """One declaration per name: exact with the file hint, else the last exact one, else the first that contains it."""
    exact = c("symbol") == name
    hinted = F.contains("file", F.lit(file_hint)) if file_hint else F.lit(False)
    hit = declarations.filter(F.contains(F.lower("symbol"), F.lit(name.lower())))
    tier = F.when(exact & hinted, 0).when(exact, 1).otherwise(2)
    last_first = F.when(tier == 1, -c("line")).otherwise(c("line"))
    file_desc = F.when(tier == 1, c("file"))
    return hit.orderBy(tier, F.desc_nulls_last(file_desc), "file", last_first).limit(1)


def hover(shapes: DataFrame, docs: DataFrame) -> DataFrame:
    """Signature with the attached documentation."""
    d = docs.filter(c("kind") == "jsdoc").groupBy("file", c("attached_symbol").alias("name")).agg(F.min_by("text", "line").alias("doc"))
    return shapes.select("file", "name", "line", "kind", "signature").join(shuffled(d), ["file", "name"], "left")


def inspect_symbols(shapes: DataFrame, docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Signature, documentation, reference count and using files of every exported symbol."""
    counts = refs.groupBy(c("def_file").alias("file"), c("def_symbol").alias("name")).agg(
        F.count(F.lit(1)).alias("refs"), F.countDistinct("file").alias("files"))
    out = hover(shapes, docs).join(counts, ["file", "name"], "left")
    return out.withColumn("refs", F.coalesce("refs", F.lit(0))).withColumn("files", F.coalesce("files", F.lit(0)))


def type_definitions(names: DataFrame, type_decls: DataFrame, refs: DataFrame) -> DataFrame:
    """Declarations of the types named in ``type_text``; wrappers like Promise<T> and T[] are looked through.

    A name means what it refers to in its own file, so types that share a name in other files are no answer.
    """
    parts = F.array_distinct(F.regexp_extract_all("type_text", F.lit("([A-Za-z_$][\\w$]*)"), 1))
    named = names.withColumn("local", F.explode(parts))
    meant = refs.join(named.select("file", "local").distinct(), ["file", "local"], "left_semi").select(
        "file", "local", c("def_file").alias("type_file"), c("def_symbol").alias("symbol")).distinct()
    return named.join(meant, ["file", "local"]).drop("local").join(
        type_decls.filter(c("kind").isin("interface", "type", "class", "enum")).select(
            "symbol", c("file").alias("type_file"), c("line").alias("type_line"), c("kind").alias("type_kind")), ["type_file", "symbol"])


def implementations(heritage: DataFrame, symbol: str) -> DataFrame:
    return heritage.filter(c("parent") == symbol)


def resolved_heritage(heritage: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, name) with (parent_file, parent): what the parent's name means in the file, wherever it is declared."""
    meant = refs.select("file", c("local").alias("parent"), c("def_file").alias("parent_file"), c("def_symbol").alias("meant")).distinct()
    return heritage.join(meant, ["file", "parent"]).select("file", "name", "parent_file", c("meant").alias("parent")).distinct()


def all_implementations(resolved: DataFrame) -> DataFrame:
    """(file, name, ancestor_file, ancestor, direct) for every ancestor, however far up, in rounds of doubling."""
    node = lambda file, name: F.concat_ws("#", file, name)
    names = stored(resolved.select("file", "name").unionByName(resolved.select(c("parent_file").alias("file"), c("parent").alias("name"))).distinct().withColumn(
        "node", node("file", "name")), "nodes")
    up = stored(resolved.select(node("file", "name").alias("file"), node("parent_file", "parent").alias("target")).distinct(), "parents")
    near = up.select("file", c("target").alias("via"), F.lit(True).alias("direct"))
    reach = reexports.star_closure(up).join(near, ["file", "via"], "left").withColumnRenamed("file", "child")
    below = names.select(c("node").alias("child"), c("file").alias("own_file"), "name")
    above = names.select(c("node").alias("via"), c("file").alias("ancestor_file"), c("name").alias("ancestor"))
    return reach.join(below, "child").join(above, "via").select(
        c("own_file").alias("file"), "name", "ancestor_file", "ancestor", F.coalesce("direct", F.lit(False)).alias("direct"))


def call_hierarchy(edges: DataFrame, symbol: str, direction: str = "incoming") -> DataFrame:
    """One hop of callers or callees with call counts."""
    if direction == "incoming":
        return edges.filter(c("callee") == symbol).groupBy("caller_file", "caller").agg(
            F.count(F.lit(1)).alias("calls"), F.min("line").alias("first_line"))
    return edges.filter(c("caller") == symbol).groupBy("callee_file", "callee").agg(
        F.count(F.lit(1)).alias("calls"), F.min("line").alias("first_line"))


def rename_edits(refs: DataFrame, symbols: DataFrame, declarations: DataFrame, new_name: str) -> DataFrame:
    """Edit preview: the declaration and every use, as (file, line, col, old, new). Nothing is written."""
    uses = refs.join(symbols, ["def_file", "def_symbol"], "left_semi").select("file", "line", "col", c("def_symbol").alias("old"))
    own = declarations.select(c("file").alias("def_file"), c("symbol").alias("def_symbol"), "line", "col").join(
        symbols, ["def_file", "def_symbol"], "left_semi").select(c("def_file").alias("file"), "line", "col", c("def_symbol").alias("old"))
    return uses.unionByName(own).distinct().withColumn("new", F.lit(new_name))


def completions(tokens: DataFrame, bindings: DataFrame, file: str, line: int, prefix: str, limit: int = COMPLETION_LIMIT) -> DataFrame:
    """Names in scope of a file that start with the prefix, nearest declaration first."""
    near = tokens.filter((c("file") == file) & (c("kind") == "id") & ~c("text").isin(*KEYWORDS)
                         & (c("p1").isin("const", "let", "var", "function", "class", "interface", "type", "enum") | (c("open_role") == "params")
                            | (c("p1").isin("[", "{") & c("p2").isin("const", "let", "var"))))
    names = near.select(c("text").alias("label"), F.abs(c("line") - line).alias("distance")).unionByName(
        bindings.filter(c("file") == file).select(c("local").alias("label"), F.abs(c("line") - line).alias("distance")))
    return names.filter(F.startswith("label", F.lit(prefix))).groupBy("label").agg(F.min("distance").alias("distance")).orderBy(
        "distance", "label").limit(limit)


def document_symbols(nodes: DataFrame, declarations: DataFrame) -> DataFrame:
    """Named nodes with their parent symbol and depth, in source order.

    Depth comes from a running count over interval edges, the parent from the stream of the level above; no nodes are paired.
    """
    named = nodes.filter(c("name").isNotNull() & c("node").isin("function", "arrow", "funcexpr", "method", "class", "interface", "enum"))
    own = named.select("file", c("start").alias("id"), "start", "until", "name", "node", "line", "col")
    edges = own.select("file", c("start").alias("at"), "id", F.lit(1).alias("edge")).unionByName(
        own.select("file", (c("until") + 1).alias("at"), "id", F.lit(-1).alias("edge")))
    w = W.partitionBy("file").orderBy("at", "edge", "id").rowsBetween(W.unboundedPreceding, 0)
    depth = edges.withColumn("depth", F.sum("edge").over(w) - 1).filter(c("edge") == 1).select("file", "id", "depth")
    # The parent is the last node before it one level up: each node also stands, as a parent, in the stream of the level below.
    tree = own.join(depth, ["file", "id"])
    streams = tree.withColumn("level", c("depth")).withColumn("above", F.lit(None).cast("string")).unionByName(
        tree.withColumn("level", c("depth") + 1).withColumn("above", c("name")).withColumn("depth", F.lit(None).cast("long")))
    up = W.partitionBy("file", "level").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    placed = streams.withColumn("parent", F.last("above", ignorenulls=True).over(up)).filter(c("depth").isNotNull())
    variables = declarations.filter(c("kind").isin("variable", "type")).select(
        "file", c("ord").alias("start"), c("symbol").alias("name"), c("kind").alias("node"), "line", "col",
        F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"))
    return placed.select("file", "start", "name", "node", "line", "col", "depth", "parent").unionByName(variables)


def outline(symbols: DataFrame, shapes: DataFrame) -> DataFrame:
    return symbols.join(shapes.select("file", "name", "signature"), ["file", "name"], "left")


def auto_import(defs: DataFrame, packages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Import path of every definition: node_modules package, else alias, else package name plus subpath, else the file."""
    d = defs.select("def_file", "def_name").distinct()
    vendored = F.regexp_extract("def_file", "(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)", 1)
    folder = F.regexp_extract("def_file", "^((?:.*/)?(?:packages|apps|libs|modules|services)/[^/]+)/", 1)
    d = d.withColumn("dir", folder).join(packages.select("dir", "name"), "dir", "left")
    rest = F.substring(c("def_file"), F.length("dir") + 2, F.lit(1 << 20))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "^src/", ""), "/?index\\.tsx?$", ""), "\\.tsx?$", ""), "/$", "")
    by_package = F.when(c("name").isNotNull(), F.when(clean == "", c("name")).otherwise(F.concat("name", F.lit("/"), clean)))
    alias_path = F.lit(None).cast("string")
    if aliases is not None:
        stem = F.regexp_replace("def_file", EXT, "")
        root = _resolve_dots(F.concat_ws("/", F.when(c("dir") != "", c("dir")), "base_url", F.regexp_replace("target", "\\*$", "")))
        a = aliases.filter(F.endswith("alias", F.lit("*")) & F.endswith("target", F.lit("*"))).select(
            root.alias("root"), F.regexp_replace("alias", "\\*$", "").alias("alias_prefix"), "ordinal")
        parts = F.split(stem, "/")
        ups = d.select("def_file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)),
                                                         lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
        best = ups.join(a, "root").groupBy("def_file").agg(F.min_by(F.struct("root", "alias_prefix"), "ordinal").alias("m")).select(
            "def_file", F.concat("m.alias_prefix", F.substring(F.regexp_replace("def_file", EXT, ""), F.length("m.root") + 2, F.lit(1 << 20))).alias("by_alias"))
        d = d.join(best, "def_file", "left")
        alias_path = c("by_alias")
    return d.select("def_name", "def_file", F.coalesce(F.when(vendored != "", vendored), alias_path, by_package, c("def_file")).alias("import_path"))


# --- walks and budgets -------------------------------------------------------------------------

def walk(edges: DataFrame, seeds: DataFrame, max_depth: int, fan_out: int | None = None) -> DataFrame:
    """Breadth-first levels from every seed: (seed, node, depth) with the smallest depth.

    ``edges`` has (src, dst), ``seeds`` (seed, node). Each level is one join, one distinct and one anti join
    against the nodes already reached; levels are checkpointed so a lost executor costs one level.
    """
    step = edges.select("src", "dst").distinct()
    if fan_out is not None:
        step = top_per_key(step, ["src"], [c("dst")], fan_out).select("src", "dst")
    step = cut_lineage(step)
    level = cut_lineage(seeds.select("seed", "node").distinct())
    reached = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        nxt = level.join(step, level["node"] == step["src"]).select("seed", c("dst").alias("node")).distinct()
        level = cut_lineage(nxt.join(reached.select("seed", "node"), ["seed", "node"], "left_anti"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level.withColumn("depth", F.lit(depth)))
    return reached


def impact_severity(n: Column) -> Column:
    return F.when(n > 20, "HIGH").when(n >= 5, "MEDIUM").otherwise("LOW")


def impact_trace(edges: DataFrame, seeds: DataFrame, ref_counts: DataFrame, max_depth: int = IMPACT_DEPTH) -> DataFrame:
    """Reached nodes and references by depth class per seed. ``ref_counts`` has (node, refs, is_alias)."""
    reached = walk(edges, seeds, max_depth).join(ref_counts, "node", "left").withColumn("refs", F.coalesce("refs", F.lit(0))).withColumn(
        "is_alias", F.coalesce("is_alias", F.lit(False)))
    refs = lambda cond: F.sum(F.when(cond, c("refs")).otherwise(0))
    return reached.groupBy("seed").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("max_depth"), refs(c("depth") == 0).alias("direct_refs"),
        refs((c("depth") > 0) & c("is_alias")).alias("alias_refs"), refs((c("depth") > 0) & ~c("is_alias")).alias("transitive_refs"),
    ).withColumn("severity", impact_severity(c("direct_refs") + c("alias_refs") + c("transitive_refs")))


CHUNK = 4096


def prefix_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Running sum of ``value`` by ``order`` (integer) within the keys, safe for keys that hold most rows.

    Rows are summed per (keys, chunk of the order), chunk totals are accumulated, and only chunks meet in a
    window together; a hot key is spread over its chunks.
    """
    # Dealt by chunk on purpose: rows that come dealt by the keys alone would leave a hot key in one task.
    chunked = df.withColumn("__chunk", F.floor(c(order) / CHUNK)).repartition(*keys, "__chunk")
    totals = chunked.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__total"))
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__chunk", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    within = W.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return chunked.withColumn("__in", F.sum(value).over(within)).join(offsets, [*keys, "__chunk"]).withColumn(
        out, c("__in") + c("__before")).drop("__chunk", "__in", "__before")


def first_fit(items: DataFrame, keys: list[str], order: str, cost: str, budget: int) -> DataFrame:
    """Greedy selection in order: take an item if it still fits the budget, skip it otherwise. Adds ``taken``.

    The sequential rule is replayed by size classes. While at least u and less than 2u is left, u a power of two, every item under u
    fits, and an item of u or more that fits leaves less than u. So the class ends with the first item that is taken and leaves less
    than u, and one prefix sum over the items under u finds it. In a round every key goes through the class that it is in; the rounds
    are at most the binary digits of the budget, whatever the items. A key that can't take its least item any more is done.

    Items of cost 0 always fit. Orders are unique within a key; items with a null key, order or cost are not taken.
    """
    # Rounds read this narrow copy, not the plan that produced the items.
    work = cut_lineage(items.select(*keys, c(order).cast("long").alias("__o"), c(cost).cast("long").alias("__c")).filter(
        (c("__c") > 0) & (c("__c") <= budget)))
    state = cut_lineage(work.groupBy(*keys).agg(F.min("__c").alias("least")).select(
        *keys, "least", F.lit(budget).cast("long").alias("left"), F.lit(None).cast("long").alias("pos")))
    rounds = None
    while not state.isEmpty():
        turn = state.withColumn("unit", F.expr("shiftleft(1L, length(bin(left)) - 1)"))
        live = work.join(turn, keys).filter((c("__c") <= c("left")) & (c("pos").isNull() | (c("__o") > c("pos")))).withColumn(
            "__small", F.when(c("__c") < c("unit"), c("__c")).otherwise(0))
        after = c("left") - (c("__sum") - c("__small")) - c("__c")
        ends = prefix_sum(live, keys, "__o", "__small", "__sum").withColumn("after", after).filter((c("after") >= 0) & (c("after") < c("unit")))
        ended = ends.groupBy(*keys).agg(F.min(F.struct("__o", "after")).alias("end"))
        part = cut_lineage(turn.join(ended, keys, "left").select(*keys, "least", "pos", c("end.__o").alias("stop"), c("end.after").alias("after"), "unit"))
        rounds = part if rounds is None else rounds.unionByName(part)
        state = part.filter(c("after") >= c("least")).select(*keys, "least", c("after").alias("left"), c("stop").alias("pos"))
    o, k = c(order).cast("long"), c(cost).cast("long")
    free = F.lit(budget >= 0) & (k == 0)
    if rounds is None:
        return items.withColumn("taken", F.coalesce(free, F.lit(False)))
    steps = rounds.groupBy(*keys).agg(F.collect_list(F.struct("pos", "stop", "unit")).alias("__rounds"))  # one a class
    within = lambda r: (r["pos"].isNull() | (o > r["pos"])) & (r["stop"].isNull() | (o < r["stop"])) & (k < r["unit"])
    taken = F.exists("__rounds", lambda r: within(r) | (o == r["stop"]).eqNullSafe(True))
    return items.join(steps, keys, "left").withColumn("taken", F.coalesce(free | taken, free, taken, F.lit(False))).drop("__rounds")


def context_class(depth: Column, is_test: Column) -> Column:
    return F.when(is_test, "skip").when(depth == 0, "must-modify").when(depth == 1, "verify-only").otherwise("skip")


def gather_context(edges: DataFrame, seeds: DataFrame, files: DataFrame, max_tokens: int = MAX_TOKENS,
                   depth: int = CONTEXT_DEPTH) -> DataFrame:
    """Files around the seeds, classified by distance and cut to a token budget in depth order.

    ``edges`` and ``seeds`` are over file paths; ``files`` has (path, cost) with the tokens of the part shown.
    """
    reached = walk(edges, seeds, depth, FAN_OUT).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    placed = reached.withColumn("class", context_class(c("depth"), paths.is_test_file(c("node")))).join(
        files.select(c("path").alias("node"), "cost"), "node", "left").withColumn("cost", F.coalesce("cost", F.lit(0)))
    wanted = placed.filter(c("class") != "skip")
    order = W.partitionBy("seed").orderBy("depth", "node")
    ranked = wanted.withColumn("ord", F.row_number().over(order))  # at most 1 + FAN_OUT files per seed
    chosen = first_fit(ranked, ["seed"], "ord", "cost", max_tokens)
    return placed.join(chosen.select("seed", "node", "taken"), ["seed", "node"], "left").withColumn(
        "taken", F.coalesce("taken", F.lit(False)))
