"""Fact tables as filters and small joins over token rows.

Every function takes the ``tokens`` table. Lines are 1-based and columns 0-based throughout.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import paths, text
from factloom.functions.lexer import BEFORE_NAMES, DECL_WORDS, KEYWORDS
from factloom.session import shuffled

# Words and names the extraction rules look for.
MODIFIERS = ["export", "default", "async", "abstract", "declare"]
HTTP_METHODS = ["get", "post", "put", "patch", "delete", "options", "head", "all", "use"]
NEXT_HANDLERS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"]
TEST_CALLS = ["describe", "it", "test"]
ROUTE_MAP_KEYS = ["method", "url", "path", "route", "handler", "component", "action"]
IMPORT_WORDS = ["import", "from", "as", "type"]
FUNCTION_NODES = ["function", "arrow", "funcexpr", "method"]

c = F.col


def _leads_statement(back: int) -> Column:
    """The word ``back`` tokens ahead of this one is reached from the statement start by modifiers only, at most three."""
    modifiers = F.when(c("s1").isin(MODIFIERS), F.when(c("s2").isin(MODIFIERS), F.when(c("s3").isin(MODIFIERS), 3).otherwise(2)).otherwise(1)).otherwise(0)
    gap = c("ord") - back - c("stmt")
    return (gap >= 0) & (gap <= modifiers)


def exported() -> Column:
    return F.coalesce(c("s1") == "export", F.lit(False))


def _declares() -> tuple[Column, Column]:
    """Whether an identifier is the name of a declaration at any level, and the word that declares it."""
    star = (c("p1") == "*") & (c("p2") == "function")
    enum_const = (c("p2") == "const") & (c("p1") == "enum")
    later = (c("p1") == ",") & (
        c("s1").isin("const", "let", "var") | ((c("s1") == "export") & c("s2").isin("const", "let", "var"))
    ) & c("n1").isin("=", ":") & c("open_role").isNull()
    word = (
        F.when(star, "function")
        .when(later, F.when(c("s1") == "export", c("s2")).otherwise(c("s1")))
        .otherwise(c("p1"))
    )
    after_word = (c("p1").isin(DECL_WORDS) & _leads_statement(1)) | ((star | enum_const) & _leads_statement(2))
    return (c("kind") == "id") & ~c("text").isin(*KEYWORDS) & (after_word | later), word


def _declared_names(tokens: DataFrame) -> DataFrame:
    """Name tokens of declarations at any level, with their declaring ``word``."""
    declared, word = _declares()
    return tokens.filter(c("p1").isin(BEFORE_NAMES)).filter(declared).withColumn("word", word)


def declarations(tokens: DataFrame) -> DataFrame:
    """Top-level functions, variables, classes, interfaces, types and enums."""
    is_var = c("word").isin("const", "let", "var")
    kind = F.when(is_var & c("fn_init"), "function").when(is_var, "variable").otherwise(c("word"))
    return _declared_names(tokens.filter(c("open") == -1)).select(
        c("text").alias("symbol"),
        kind.alias("kind"),
        "file",
        F.when(is_var, c("line")).otherwise(c("stmt_line")).alias("line"),
        F.when(is_var, c("col")).otherwise(c("stmt_col")).alias("col"),
        exported().alias("is_exported"),
        text.path_tokens("file").alias("path_tokens"),
        text.symbol_tokens("text").alias("symbol_tokens"),
        "ord", "stmt",
    )


def usages(tokens: DataFrame) -> DataFrame:
    """Calls, member calls, imports, JSX tags and environment reads: one filter, no shuffle."""
    is_call = (c("node") == "call") & ~(c("p1").isin("function", "new"))
    member = c("p1").isin(".", "?.")
    is_import = (
        (c("kind") == "id") & (c("s1") == "import") & ~c("text").isin(IMPORT_WORDS) & (c("ord") > c("stmt"))
        & (F.coalesce(c("n1"), F.lit("")) != "as") & ~member
        & ~F.coalesce(c("s2"), F.lit("")).isin("(", ".")
    )
    is_jsx = c("node") == "jsx"
    parts = F.split("chain", "\\.")
    env = (
        (c("kind") == "id") & ~F.coalesce(c("n1"), F.lit("")).isin(".", "?.")
        & (c("chain").rlike("^process\\.env\\.[^.]+$") | c("chain").rlike("^import\\.meta\\.env\\.[^.]+$"))
    )
    base = dict(path=text.path_tokens("file").alias("path_tokens"))

    def rows(df: DataFrame, identifier: Column, normalized: Column, kind: Column, line: Column, col: Column,
             env_key: Column | None = None, inside: bool = True) -> DataFrame:
        return df.select(
            identifier.alias("identifier"), normalized.alias("normalized"), kind.alias("kind"), "file",
            line.alias("line"), col.alias("col"),
            (c("sym") if inside else F.lit(None).cast("string")).alias("enclosing_symbol"),
            (c("sym_kind") if inside else F.lit(None).cast("string")).alias("enclosing_kind"),
            base["path"],
            (env_key if env_key is not None else F.lit(None).cast("string")).alias("env_key"),
            F.when(kind.isin("call", "member-call"), c("argc")).alias("argc"),
        )

    # One pass: a token can be at most one call/import/jsx row and one env row.
    kind = (
        F.when(is_call & member, "member-call").when(is_call, "call").when(is_import, "import").when(is_jsx, "jsx-tag")
    )
    hits = tokens.withColumn("use", kind)
    main = rows(
        hits.filter(c("use").isNotNull()),
        F.when(c("use") == "jsx-tag", c("n1")).when(c("use") == "member-call", c("chain")).otherwise(c("text")),
        F.when(c("use") == "jsx-tag", c("n1")).otherwise(c("text")),
        c("use"),
        F.when(c("use") == "member-call", c("chain_line")).otherwise(c("line")),
        F.when(c("use") == "member-call", c("chain_col")).otherwise(c("col")),
    ).withColumn("enclosing_symbol", F.when(c("kind") != "import", c("enclosing_symbol"))).withColumn(
        "enclosing_kind", F.when(c("kind") != "import", c("enclosing_kind")))
    key = F.element_at(parts, -1)
    envs = rows(tokens.filter(env), c("chain"), F.lower(key), F.lit("env-usage"), c("chain_line"), c("chain_col"), key)
    return main.unionByName(envs)


def unquote(s: Column) -> Column:
    """Content of a plain string or a template without substitutions; null for anything else."""
    return F.when(s.rlike("^('[\\s\\S]*'|\"[\\s\\S]*\"|`[^$]*`)$"), F.substring(s, F.lit(2), F.length(s) - 2))


def docs(tokens: DataFrame) -> DataFrame:
    """JSDoc and leading comments of exported declarations, and titles of test blocks."""
    heads = _declared_names(tokens).filter(exported() & c("doc").isNotNull() & (c("p1") != ","))
    body = F.regexp_replace(text.strip_comment_markers("jsdoc"), "(?s)(^|\\n)\\s*@\\w+.*$", "")
    jsdoc = F.when(c("jsdoc").isNotNull(), F.trim(body))
    comment = text.strip_comment_markers("doc")
    fields = F.array(
        F.struct(F.lit("jsdoc").alias("kind"), jsdoc.alias("text")),
        F.struct(F.lit("comment").alias("kind"),
                 F.when(~comment.eqNullSafe(jsdoc), comment).alias("text")),
    )
    notes = heads.select("file", c("stmt_line").alias("line"), c("text").alias("attached_symbol"),
                         F.inline(fields)).filter(F.coalesce(c("text"), F.lit("")) != "")
    titles = (
        tokens.filter((c("node") == "call") & c("text").isin(TEST_CALLS) & ~c("p1").isin(".", "?.").eqNullSafe(True))
        .withColumn("title", unquote(c("n2"))).filter(c("title").isNotNull() & (c("argc") > 0))
        .select("file", "line", F.lit(None).cast("string").alias("attached_symbol"),
                F.lit("test-title").alias("kind"), c("title").alias("text"))
    )
    return notes.unionByName(titles).select(
        "file", "line", "kind", "text", text.doc_tokens("text").alias("tokens"), "attached_symbol")


def exports(tokens: DataFrame) -> DataFrame:
    """ES module and CommonJS exports, one row per exported name. One pass: a token says which of the five forms it is."""
    out, is_id = exported(), c("kind") == "id"
    none, no = F.lit(None).cast("string"), F.lit(False)

    def row(when: Column, name: Column, exported_as: Column, kind: Column, line: Column, is_type_only: Column, module: Column) -> tuple[Column, Column]:
        return when, F.when(when, F.struct(name.alias("name"), exported_as.alias("exported_as"), kind.alias("kind"), line.alias("line"),
                                     is_type_only.alias("is_type_only"), module.alias("module")))

    declared, word = _declares()
    decl = row(is_id & out & (F.coalesce(c("s2"), F.lit("")) != "default") & declared, c("text"), c("text"),
               F.when(word.isin("let"), "var").otherwise(word), c("stmt_line"), word.isin("interface", "type"), none)
    # export default <name> | export default function name() {} | export default class Name {}
    headed = c("n1").isin("function", "class") & c("n2").rlike("^[A-Za-z_$]")
    default = row(
        is_id & out & (c("text") == "default") & (c("ord") == c("stmt") + 1),
        F.when(headed, c("n2"))
        .when(c("n1").rlike("^[A-Za-z_$][\\w$]*$") & ~c("n1").isin(*KEYWORDS, "async")
              & F.coalesce(c("n2").isin(";", "}", "export", "import"), F.lit(True)), c("n1"))
        .otherwise("default"),
        F.when(headed, c("n2")).otherwise("default"), F.when(headed, c("n1")).otherwise("default"), c("stmt_line"), no, none)
    # export { a, b as c } [from 'm']
    lists = row(is_id & out & (c("open_role") == "names") & c("p1").isin("{", ",", "type") & (c("text") != "type"), c("text"),
                F.when(c("n1") == "as", c("n2")).otherwise(c("text")), F.when(c("module").isNotNull(), "reexport").otherwise("unknown"), c("line"),
                (c("s2") == "type") | (c("p1") == "type"), c("module"))
    star = F.lit("*")
    stars = row(out & (c("text") == "*") & (c("ord") == c("stmt") + 1) & (c("n1") == "from"), star, star, F.lit("reexport"), c("stmt_line"), no, c("module"))
    cjs_name = F.when(c("chain") == "module.exports", "default").otherwise(
        F.regexp_extract("chain", "^(?:module\\.)?exports\\.(.+)$", 1))
    is_cjs = is_id & (c("n1") == "=") & (c("chain_ord") == c("stmt")) & c("chain").rlike("^(module\\.exports(\\..+)?|exports\\..+)$")
    cjs = row(is_cjs, cjs_name, cjs_name, F.lit("cjs"), c("stmt_line"), no, none)
    whens, rows = zip(decl, default, lists, stars, cjs)
    found = tokens.filter(out | (c("n1") == "=")).filter(reduce(or_, whens)).select("file", F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())), "ord")
    return found.select("file", "name", "exported_as", "kind", "line", "is_type_only", "module", "ord")


def nodes(tokens: DataFrame) -> DataFrame:
    """Syntax nodes with their token interval: an ancestor's interval contains its descendants' ``ord``."""
    return tokens.filter(c("node").isNotNull()).select(
        "file", "node", c("ord").alias("start"), c("until"), "body", "params", "line", "col",
        c("ann").alias("name"), "text", "chain", "argc", "fn", "sym", "sym_kind", "ret", "is_async", "open", "p1", "n2")


def members(tokens: DataFrame) -> DataFrame:
    """Members of interfaces and classes, enum members and function parameters, keyed by their bracket."""
    ids = tokens.filter(c("open_role").isin("params", "interface", "enum", "class") & (c("kind") == "id"))
    first = c("p1").isin("{", ",", ";", "}", "readonly", "public", "private", "protected", "static") | (c("ord") == c("stmt"))
    prop = c("n1").isin(":", "?", ";", "=", "}", "!") | c("n1").isNull()
    param = (c("open_role") == "params") & c("p1").isin("(", ",", "...", "readonly", "public", "private", "protected")
    iface = (c("open_role") == "interface") & first & c("n1").isin(":", "?") & (c("n2") != "(")
    enum = (c("open_role") == "enum") & c("p1").isin("{", ",")
    klass = (c("open_role") == "class") & first & ~c("text").isin(*KEYWORDS, "constructor", "readonly", "public",
                                                                  "private", "protected", "static", "async")
    klass_ok = klass & (prop | (c("node") == "method"))
    what = F.when(param, "param").when(iface, "property").when(enum, "enum").when(klass_ok, "property")
    typed = F.when(c("node").isNull(), c("ann"))
    return ids.withColumn("what", what).filter(c("what").isNotNull()).select(
        "file", c("open").alias("owner"), "ord", "what", c("text").alias("name"),
        ((c("n1") == "?") | ((c("what") == "param") & c("has_default"))).alias("optional"),
        (c("p1") == "...").alias("rest"), typed.alias("type_text"))


def shapes(tokens: DataFrame) -> DataFrame:
    """Signature of every exported declaration: parameters, members, enum values, return type and text."""
    named = _declared_names(tokens).filter(exported())
    names = named.select("file", c("text").alias("name"), "word", c("stmt_line").alias("line"), "ord", "ann", "fn_init")
    heads = tokens.filter(c("node").isin(*FUNCTION_NODES, "class", "interface", "enum") & (c("s1") == "export")).select(
        "file", c("ann").alias("name"), "node", "stmt_line", "body", "params", "ret", "open").filter(c("open") == -1)
    keyed = names.join(
        shuffled(heads.select("file", "name", c("stmt_line").alias("line"), "node", "body", "params", "ret")),
        ["file", "name", "line"], "left")
    owner = F.when(c("node").isin(FUNCTION_NODES), c("params")).otherwise(c("body"))
    lists = members(tokens).groupBy("file", "owner").agg(F.array_sort(F.collect_list(
        F.struct("ord", "what", "name", "optional", "rest", "type_text"))).alias("items"))
    joined = keyed.withColumn("owner", owner).join(shuffled(lists), ["file", "owner"], "left").withColumn(
        "items", F.coalesce("items", F.array().cast(
            "array<struct<ord:int,what:string,name:string,optional:boolean,rest:boolean,type_text:string>>")))

    def pick(what: str) -> Column:
        return F.filter("items", lambda x: x["what"] == what)

    is_fn = c("node").isin(FUNCTION_NODES)
    params = F.when(is_fn, F.transform(pick("param"), lambda x: F.struct(
        x["name"].alias("name"), x["optional"].alias("optional"), x["rest"].alias("rest"),
        x["type_text"].alias("type_text"))))
    props = F.when(c("node").isin("interface", "class"), F.transform(pick("property"), lambda x: F.struct(
        x["name"].alias("name"), x["optional"].alias("optional"), x["type_text"].alias("type_text"))))
    enum = F.when(c("node") == "enum", F.transform(pick("enum"), lambda x: x["name"]))
    listing = lambda arr: F.array_join(F.transform(arr, lambda x: x["name"]), ", ")
    plist = F.array_join(F.transform(pick("param"), lambda x: F.concat(
        F.when(x["rest"], "...").otherwise(""), x["name"], F.when(x["optional"], "?").otherwise(""))), ", ")
    signature = (
        F.when(c("node") == "interface", F.concat(F.lit("interface "), c("name"), F.lit(" { "), listing(pick("property")), F.lit(" }")))
        .when(c("node") == "class", F.concat(F.lit("class "), c("name"), F.lit(" { "), listing(pick("property")), F.lit(" }")))
        .when(c("node") == "enum", F.concat(F.lit("enum "), c("name"), F.lit(" { "), listing(pick("enum")), F.lit(" }")))
        .when(is_fn & c("word").isin("const", "let", "var"), F.concat(
            F.lit("const "), c("name"), F.lit(" = ("), plist, F.lit(") => "), F.coalesce("ret", F.lit("..."))))
        .when(is_fn, F.concat(F.lit("function "), c("name"), F.lit("("), plist, F.lit("): "), F.coalesce("ret", F.lit("unknown"))))
        .when(c("word") == "type", F.concat(F.lit("type "), c("name"), F.lit(" = "), F.coalesce("ann", F.lit(""))))
        .when(c("word").isin("const", "let", "var"), F.concat(F.lit("const "), c("name"), F.lit(": "), F.coalesce("ann", F.lit("unknown"))))
        .otherwise(F.concat_ws(" ", "word", "name"))
    )
    return joined.select(
        "file", "name", F.when(c("word") == "let", "var").otherwise(c("word")).alias("kind"), "line",
        signature.alias("signature"), params.alias("params"), F.when(is_fn, c("ret")).alias("return_type"),
        props.alias("members"), enum.alias("enum_members"))


def min_arity() -> Column:
    return F.size(F.filter("params", lambda p: ~p["optional"] & ~p["rest"]))


def max_arity() -> Column:
    """Null where a rest parameter accepts any number of arguments."""
    return F.when(~F.exists("params", lambda p: p["rest"]), F.size("params"))


def routes(tokens: DataFrame) -> DataFrame:
    """Route definitions in their five shapes."""
    none = F.lit(None).cast("string")
    root = F.when(F.contains(c("chain"), F.lit(".")), F.element_at(F.split("chain", "\\."), 1))
    calls = tokens.filter((c("node") == "call") & c("p1").isin(".", "?."))
    verb = F.lower("text")
    direct = calls.filter(verb.isin(HTTP_METHODS) & (c("argc") >= 1)).withColumn("path", unquote(c("n2"))).filter(
        c("path").isNotNull()).select(
        "file", c("chain_line").alias("line"), F.when(verb != "use", F.upper("text")).alias("method"), "path",
        F.when(F.contains(F.coalesce(root, F.lit("")), F.lit("fastify")), "fastify").otherwise("express").alias("framework"),
        root.alias("enclosing_symbol"),
        text.route_tokens(F.concat_ws(" ", verb, "path", F.coalesce(root, F.lit("")))).alias("tokens"),
        F.concat_ws(" ", F.upper("text"), "path").alias("text"))

    # Literal string properties of object literals, folded to one row per object.
    value = unquote(c("n2"))
    props = tokens.filter((c("kind") == "id") & (c("n1") == ":") & (c("open_role") == "object") & c("p1").isin("{", ",")
                          & c("text").isin(ROUTE_MAP_KEYS))
    objects = props.groupBy("file", "open").agg(
        *[F.max(F.when(c("text") == k, F.coalesce(value, F.lit("")))).alias(f"has_{k}") for k in ROUTE_MAP_KEYS],
        *[F.max(F.when(c("text") == k, value)).alias(k) for k in ("method", "url", "path", "route")])
    braces = tokens.filter((c("role") == "object")).select("file", c("ord").alias("open"), "line", c("p1").alias("before"))
    call_open = calls.filter(c("text") == "route").select("file", (c("params") + 1).alias("open"), c("chain_line").alias("call_line"))
    found = objects.join(braces, ["file", "open"])
    registered = found.join(call_open, ["file", "open"]).filter(c("method").isNotNull() & c("url").isNotNull()).select(
        "file", c("call_line").alias("line"), F.upper("method").alias("method"), c("url").alias("path"),
        F.lit("fastify").alias("framework"), none.alias("enclosing_symbol"),
        text.route_tokens(F.concat_ws(" ", "method", "url", F.lit("route"))).alias("tokens"),
        F.concat_ws(" ", F.upper("method"), "url").alias("text"))
    target = F.coalesce("path", "route")
    mapped = found.filter(
        (c("has_path").isNotNull() | c("has_route").isNotNull())
        & (c("has_handler").isNotNull() | c("has_component").isNotNull() | c("has_action").isNotNull())
    ).select(
        "file", "line", F.upper("method").alias("method"), target.alias("path"), F.lit("route-map").alias("framework"),
        none.alias("enclosing_symbol"),
        text.route_tokens(F.concat_ws(" ", F.coalesce("method", F.lit("")), F.coalesce(target, F.lit("")), F.lit("route map"))).alias("tokens"),
        F.concat_ws(" ", F.coalesce(F.upper("method"), F.lit("ROUTE")), F.coalesce(target, F.lit("?"))).alias("text"))

    url = route_of_path(c("file"))
    handlers = _declared_names(tokens.filter(c("file").rlike("(^|/)route\\.\\w+$"))).filter(
        exported() & c("text").isin(NEXT_HANDLERS)).select(
        "file", c("stmt_line").alias("line"), c("text").alias("method"), url.alias("path"),
        F.lit("next-app-router").alias("framework"), c("text").alias("enclosing_symbol"),
        text.route_tokens(F.concat_ws(" ", "text", F.coalesce(url, F.lit("")), F.lit("next handler"))).alias("tokens"),
        F.concat_ws(" ", "text", F.coalesce(url, c("file"))).alias("text"))
    pages = tokens.filter(F.contains(F.concat(F.lit("/"), "file"), F.lit("/pages/api/")) & exported()
                          & (c("text") == "default") & (c("ord") == c("stmt") + 1)).select(
        "file", c("stmt_line").alias("line"), none.alias("method"), url.alias("path"),
        F.lit("next-pages-api").alias("framework"), none.alias("enclosing_symbol"),
        text.route_tokens(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.lit("api handler pages"))).alias("tokens"),
        F.concat_ws(" ", F.lit("handler"), F.coalesce(url, c("file"))).alias("text"))
    return direct.unionByName(registered).unionByName(mapped).unionByName(handlers).unionByName(pages)


def route_of_path(file: Column) -> Column:
    pages = F.regexp_extract(file, "pages/api/(.+?)(?:/index)?\\.\\w+$", 1)
    app = F.regexp_extract(file, "app/(.+?)/route\\.\\w+$", 1)
    return F.when(pages != "", F.concat(F.lit("/api/"), pages)).when(app != "", F.concat(F.lit("/"), app))


def file_lines(files: DataFrame, path: str = "path", body: str = "text") -> DataFrame:
    """(file, line, content), 1-based."""
    return files.select(c(path).alias("file"), F.posexplode(text.lines(body)).alias("i", "content")).select(
        "file", (c("i") + 1).alias("line"), "content")


# Import and re-export line patterns, tried in this order.
IMPORT_PATTERNS = {
    "named": "import\\s+\\{([^}]+)\\}\\s+from\\s+['\"]([^'\"]+)['\"]",
    "default": "import\\s+(\\w+)\\s+from\\s+['\"]([^'\"]+)['\"]",
    "namespace": "import\\s+\\*\\s+as\\s+(\\w+)\\s+from\\s+['\"]([^'\"]+)['\"]",
    "side_effect": "import\\s+(['\"])([^'\"]+)['\"]",
}
REEXPORT_LINE = "export\\s+\\{([^}]+)\\}\\s+from"
BARREL_LINE = "export\\s+\\*\\s+from\\s+['\"]([^'\"]+)['\"]"


def imports(lines: DataFrame) -> DataFrame:
    """Imports by line pattern: module, imported symbols and style."""
    style = F.lit(None).cast("string")
    for name, pattern in reversed(IMPORT_PATTERNS.items()):
        style = F.when(c("content").rlike(pattern), name).otherwise(style)
    hit = lines.filter(F.contains("content", F.lit("import"))).withColumn("style", style).filter(c("style").isNotNull())
    grab = lambda g: F.coalesce(*[
        F.when(c("style") == n, F.regexp_extract("content", p, g)) for n, p in IMPORT_PATTERNS.items()])
    split_names = F.filter(F.transform(F.split(grab(1), ","), lambda s: F.trim(
        F.element_at(F.split(F.trim(s), " as "), 1))), lambda s: s != "")
    symbols = F.when(c("style") == "side_effect", F.array().cast("array<string>")).otherwise(split_names)
    return hit.select("file", "line", grab(2).alias("module"), symbols.alias("symbols"),
                      (c("style") == "default").alias("is_default"), (c("style") == "namespace").alias("is_namespace"))


def file_exports(lines: DataFrame, decls: DataFrame) -> DataFrame:
    """Exports by line text: declarations on a line that says export, re-exports and barrels."""
    direct = decls.filter(c("is_exported")).select("file", c("symbol").alias("name"), "kind", "line")
    with_export = lines.filter(F.contains("content", F.lit("export")))
    names = F.regexp_extract("content", REEXPORT_LINE, 1)
    again = with_export.filter(names != "").select("file", "line", F.explode(F.transform(
        F.split(names, ","), lambda s: F.trim(F.element_at(F.split(F.trim(s), " as "), 1)))).alias("name")).filter(
        c("name") != "").join(direct.select("file", "name"), ["file", "name"], "left_anti").groupBy("file", "name").agg(
        F.min("line").alias("line")).select("file", "name", F.lit("re-export").alias("kind"), "line")
    module = F.regexp_extract("content", BARREL_LINE, 1)
    barrels = with_export.filter(module != "").select(
        "file", F.concat(F.lit('* from "'), module, F.lit('"')).alias("name"), F.lit("barrel").alias("kind"), "line")
    return direct.unionByName(again).unionByName(barrels)


def switches(tokens: DataFrame) -> DataFrame:
    """Switch statements with the enum members their cases name and whether they have a default."""
    heads = tokens.filter((c("node") == "switch") & c("body").isNotNull()).select(
        "file", c("ord").alias("switch"), "body", "line", "col")
    arms = tokens.filter((c("open_role") == "switch") & c("text").isin("case", "default")).select(
        "file", c("open").alias("body"),
        F.when((c("text") == "case") & c("n2").isin(".", "?."), c("n1")).alias("enum"),
        F.when((c("text") == "case") & c("n2").isin(".", "?."), c("n3")).alias("member"),
        ((c("text") == "default") & (c("n1") == ":")).alias("is_default"),
        F.when((c("text") == "case") & ~c("n2").isin(".", "?.").eqNullSafe(True), unquote(c("n1"))).alias("literal"))
    per = arms.groupBy("file", "body").agg(
        F.max("enum").alias("enum"), F.array_sort(F.collect_set("member")).alias("handled"),
        F.array_sort(F.collect_set("literal")).alias("literals"), F.bool_or("is_default").alias("has_default"))
    return heads.join(per, ["file", "body"], "left").select(
        "file", "switch", "body", "line", "col", "enum",
        F.coalesce("handled", F.array().cast("array<string>")).alias("handled"),
        F.coalesce("literals", F.array().cast("array<string>")).alias("literals"),
        F.coalesce("has_default", F.lit(False)).alias("has_default"))


def type_guards(tokens: DataFrame) -> DataFrame:
    """Functions whose return type is ``x is T``."""
    guarded = F.regexp_extract("ret", "^\\s*\\w+\\s+is\\s+(.+?)\\s*$", 1)
    return tokens.filter(c("node").isin(FUNCTION_NODES) & (c("open") == -1) & (guarded != "")).select(
        "file", "line", F.when(c("node") == "function", c("ann")).otherwise("<anonymous>").alias("func_name"),
        guarded.alias("guarded_type"))


def narrowings(tokens: DataFrame) -> DataFrame:
    """Comparison sites that narrow a type: discriminant, typeof and instanceof checks."""
    op = c("n1").isin("===", "!==")
    ids = tokens.filter(c("kind") == "id")
    disc = ids.filter(op & F.contains("chain", F.lit("."))).select(
        "file", c("chain_line").alias("line"), F.lit("discriminant-check").alias("narrowing"),
        F.element_at(F.split("chain", "\\."), 1).alias("symbol"), c("text").alias("field"), c("n1").alias("op"),
        c("n2").alias("checked"))
    type_of = ids.filter((c("p1") == "typeof") & op).select(
        "file", "line", F.lit("typeof-check").alias("narrowing"), c("text").alias("symbol"),
        F.lit(None).cast("string").alias("field"), c("n1").alias("op"), c("n2").alias("checked"))
    instance = ids.filter(c("n1") == "instanceof").select(
        "file", "line", F.lit("instanceof-check").alias("narrowing"), c("chain").alias("symbol"),
        F.lit(None).cast("string").alias("field"), c("n1").alias("op"), c("n2").alias("checked"))
    return disc.unionByName(type_of).unionByName(instance).withColumn(
        "checked", F.coalesce(unquote(c("checked")), c("checked")))


def heritage(tokens: DataFrame) -> DataFrame:
    """(file, name, parent, direct, line, col) edges of ``extends`` and ``implements`` clauses; direct for the first of a clause.

    A name belongs to the last head before it if that head's body comes later. The names of a clause and its heads are one
    ordered stream per file, in which a running count of type brackets tells parents from their type arguments.
    """
    heads = c("node").isin("class", "interface") & c("body").isNotNull()
    name = (c("kind") == "id") & c("s1").isin("class", "interface", "export", "abstract", "default")
    rows = tokens.filter(heads | name).select("file", "ord", "text", "node", "body", "ann", "line", "col", "p1", "n1", "n2", "n3")
    closed = F.when(c("n1") == ">", 1 + F.when(c("n2") == ">", 1 + F.when(c("n3") == ">", 1).otherwise(0)).otherwise(0)).otherwise(0)
    opened = F.when(c("p1") == "<", 1).otherwise(0)
    order = W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(c("node").isin("class", "interface"), F.struct(c("ord").alias("start"), "body", c("ann").alias("name"), "line", "col"))
    placed = rows.withColumn("head", F.last(head, ignorenulls=True).over(order)).filter((c("ord") > c("head.start")) & (c("ord") < c("head.body")))
    clause = W.partitionBy("file", "head.start").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    deep = placed.withColumn("angle", opened + F.coalesce(F.sum(opened - closed).over(clause), F.lit(0)))
    return deep.filter((c("angle") == 0) & (c("p1").isin("extends", "implements") | (c("p1") == ","))).select(
        "file", "head.name", c("text").alias("parent"), (c("p1") != ",").alias("direct"), "head.line", "head.col")


# Statement word to the kind of node an error on its line points at.
STATEMENT_KINDS = {
    "return": "return", "const": "variable", "let": "variable", "var": "variable", "import": "import", "export": "export",
    "switch": "switch", "case": "switch", "default": "switch", "if": "conditional", "class": "class", "function": "function",
    "async": "function",
}


def nodes_at_lines(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Kind of the outermost node that starts on each wanted (file, line): statement word first, else what the line holds.

    Only the first row of a line and its calls tell it; the others aren't moved.
    """
    at = tokens.filter(c("leads_line") | (c("node") == "call")).join(targets.select("file", "line").distinct(), ["file", "line"], "left_semi")
    head = F.struct((c("ord") == c("stmt")).alias("starts"), "s1", "chain", "open_role", "n1")
    per = at.groupBy("file", "line").agg(F.min_by(head, "ord").alias("f"), F.bool_or(F.coalesce(c("node") == "call", F.lit(False))).alias("calls"))
    by_word = F.lit(None).cast("string")
    for word, kind in STATEMENT_KINDS.items():
        by_word = F.when(c("f.starts") & (c("f.s1") == word), kind).otherwise(by_word)
    kind = F.coalesce(by_word, F.when(c("calls"), "call"), F.when(F.contains("f.chain", F.lit(".")), "property"),
                      F.when((c("f.open_role") == "object") & (c("f.n1") == ":"), "object"), F.lit("expression"))
    return per.select("file", "line", kind.alias("kind"))
