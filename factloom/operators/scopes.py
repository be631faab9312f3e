"""Local bindings as scope intervals, and the innermost scope of a name at a place.

A binding below the top level holds from the bracket that opens its scope to the token that ends it. Scopes of one name in one
file lie inside each other or apart, so the innermost scope at a place is the last one that began at the depth reached there: a running
count over the edges of the intervals gives the depth, and the last beginning of that depth is an as-of lookup in the same order.
Neither step pairs uses with scopes.

Known: parameters (plain, rest, destructured by objects), bare arrow parameters, const, let and var (plain, destructured), nested
declarations, loop variables and caught errors. Type parameters bind nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.lexer import KEYWORDS
from factloom.session import shuffled, stored

c = F.col
FEW = 100_000  # rows of a few short columns that every task may hold
# Words that bind the name after them.
VALUE_WORDS = ["const", "let", "var"]
NESTED_WORDS = ["function", "class", "interface", "type", "enum"]
PARAM_LEADS = ["(", ",", "...", "readonly", "public", "private", "protected"]
FUNCTION_NODES = ["function", "arrow", "funcexpr", "method"]


def extents(tokens: DataFrame) -> DataFrame:
    """(file, kind, key, end): where the scope that a bracket opens ends, by what the bracket is for. One pass: a token opens up to two."""
    function, loop = c("node").isin(*FUNCTION_NODES), (c("node") == "loop") & (c("text") == "for")
    block = (c("text") == "{") & c("close").isNotNull()

    def one(when: Column, kind: str, key: Column, end: str) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), key.alias("key"), c(end).alias("end")))

    rows = F.array(one(block, "block", c("ord"), "close"), one(function & c("params").isNotNull(), "params", c("params"), "until"),
                   one(loop, "for", c("ord") + F.when(c("n1") == "await", 2).otherwise(1), "until"), one(function, "function", c("ord"), "until"))
    return tokens.filter(block | function | loop).select("file", F.inline(F.filter(rows, lambda x: x.isNotNull())))


def _scope(kind: Column, key: Column) -> Column:
    return F.struct(kind.alias("kind"), key.cast("int").alias("key"))


def _found(rows: DataFrame, scope: Column) -> DataFrame:
    """The generator keeps the choice of scope one expression, whatever reads its fields."""
    return rows.select("file", c("text").alias("name"), "ord", F.inline(F.array(scope))).filter(c("kind").isNotNull())


def _word_scope(word: Column, role: Column, bracket: Column) -> Column:
    """Scope of a name after const, let or var: the loop or block round it, for var the function."""
    return _scope(F.when(word == "var", "function").when(role == "for", "for").otherwise("block"), F.when(word == "var", c("fn")).otherwise(bracket))


def single_binders(tokens: DataFrame) -> DataFrame:
    """Names bound one at a time: parameters, declared values, nested declarations, caught errors."""
    ids = tokens.filter((c("kind") == "id") & ((c("open") >= 0) | (c("n1") == "=>")) & ~c("text").isin(*KEYWORDS)).select(
        "file", "ord", "text", "open", "open_role", "p1", "n1", "s1", "stmt", "fn")
    valued = c("p1").isin(*VALUE_WORDS)
    later = (c("p1") == ",") & c("s1").isin(*VALUE_WORDS) & c("n1").isin("=", ":", ",", ";")
    nested = c("p1").isin(*NESTED_WORDS) & ((c("ord") - 1 == c("stmt")) | ((c("ord") - 2 == c("stmt")) & c("s1").isin("async", "abstract", "declare", "const")))
    scope = (
        F.when((c("n1") == "=>") & ~F.coalesce(c("p1") == ")", F.lit(False)), _scope(F.lit("params"), c("ord")))
        .when((c("open_role") == "params") & c("p1").isin(*PARAM_LEADS) & (c("n1") != ">"), _scope(F.lit("params"), c("open")))
        .when((c("open_role") == "catch") & (c("p1") == "("), _scope(F.lit("block"), c("ord") + F.when(c("n1") == ":", 4).otherwise(2)))
        .when(valued | later, _word_scope(F.when(valued, c("p1")).otherwise(c("s1")), c("open_role"), c("open")))
        .when(nested, _scope(F.lit("block"), c("open")))
    )
    return _found(ids, scope)


def pattern_binders(tokens: DataFrame) -> DataFrame:
    """Names bound by destructuring, at any depth: those that lie in the last pattern that began before them.

    The stream per file holds only where patterns begin and the names that may stand in one. An array's bracket has no row: its
    names lie in the bracket of its first name, and its scope is that of the function round it.
    """
    valued = c("p1").isin(*VALUE_WORDS)
    starts = (c("text") == "{") & (valued | ((c("open_role") == "params") & c("p1").isin("(", ",")))
    inside = (c("kind") == "id") & c("p1").isin("{", ",", ":", "...", "[") & c("n1").isin(",", "}", "]", "=") & ~c("text").isin(*KEYWORDS)
    rows = tokens.filter(starts | inside).select("file", "ord", "text", "open", "open_role", "p1", "p2", "close", "fn", inside.alias("inside"))
    pattern = F.when((c("text") == "{") & ~c("inside"), F.struct("close", "open", "open_role", "p1"))
    array = F.when((c("p1") == "[") & c("p2").isin(*VALUE_WORDS), c("open"))
    by_place = W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("pattern", F.last(pattern, ignorenulls=True).over(by_place)).withColumn("array", F.last(array, ignorenulls=True).over(by_place))
    scope = F.when(c("ord") < c("pattern.close"), F.when(c("pattern.open_role") == "params", _scope(F.lit("params"), c("pattern.open"))).otherwise(
        _word_scope(c("pattern.p1"), c("pattern.open_role"), c("pattern.open")))).when(
        (c("open") == c("array")) & c("p1").isin("[", ",", "..."), _scope(F.lit("function"), c("fn")))
    return _found(seen.filter("inside"), scope)


def binders(tokens: DataFrame) -> DataFrame:
    """(file, name, ord, kind, key): every name bound below the top level, with the bracket or node that bounds its scope."""
    return single_binders(tokens).unionByName(pattern_binders(tokens))


def local_scopes(tokens: DataFrame, names: DataFrame | None = None, known: bool = False) -> DataFrame:
    """(file, name, start, end) of each local scope of a name, or of the (file, name) of ``names``; top-level bindings have none.

    ``known`` says that all of ``names`` are imported or declared at the top level of their file. Where few are bound again, the brackets
    stay where they are.
    """
    if names is None:
        bound = binders(tokens)
    else:
        bound = single_binders(tokens.filter("known") if known else tokens).unionByName(pattern_binders(tokens)).join(
            names.select("file", "name").distinct(), ["file", "name"], "left_semi")
        bound = stored(bound, "bound")
        bound = F.broadcast(bound) if bound.count() <= FEW else shuffled(bound)
    return bound.join(extents(tokens), ["file", "kind", "key"]).groupBy(
        "file", "name", F.least("key", "ord").alias("start")).agg(F.max("end").alias("end"))  # a caught error stands before its block


def innermost(uses: DataFrame, scopes: DataFrame) -> DataFrame:
    """``uses`` (file, name, ord, ...) with the number of local scopes of their name round them, and where the innermost starts.

    One ordered stream per file and name. At a place, a scope that begins there holds already, and one that ends there still.
    """
    columns = [x for x in uses.columns if x not in ("file", "name", "ord")]
    rest = F.struct(*columns) if columns else F.lit(0)
    # A place can be the edge of several scopes and several uses; the order is: beginnings, uses, endings.
    edge = lambda at, turn, step: scopes.select("file", "name", c(at).alias("ord"), F.lit(turn).alias("turn"), F.lit(step).alias("step"))
    typed = uses.select("file", "name", "ord", F.lit(1).alias("turn"), F.lit(0).alias("step"), rest.alias("rest"))
    stream = typed.unionByName(edge("start", 0, 1), allowMissingColumns=True).unionByName(edge("end", 2, -1), allowMissingColumns=True)
    order = W.partitionBy("file", "name").orderBy("ord", "turn").rowsBetween(W.unboundedPreceding, 0)
    deep = stream.withColumn("scopes", F.sum("step").over(order))
    level = W.partitionBy("file", "name", "scopes").orderBy("ord", "turn").rowsBetween(W.unboundedPreceding, 0)
    found = deep.withColumn("scope_start", F.last(F.when(c("step") == 1, c("ord")), ignorenulls=True).over(level)).filter(c("turn") == 1)
    kept = [c("rest")[x].alias(x) for x in columns]
    return found.select("file", "name", "ord", *kept, c("scopes").cast("int").alias("scopes"), F.when(c("scopes") > 0, c("scope_start")).alias("scope_start"))


def unshadowed(uses: DataFrame, scopes: DataFrame) -> DataFrame:
    """``uses`` that no local scope of their name surrounds: what is left means the import or the top-level declaration.

    Only the running count is needed here, not which scope it is.
    """
    columns = uses.columns
    edges = scopes.select("file", "name", c("start").alias("ord"), F.lit(0).alias("turn"), F.lit(1).alias("step")).unionByName(
        scopes.select("file", "name", c("end").alias("ord"), F.lit(2).alias("turn"), F.lit(-1).alias("step")))
    stream = uses.withColumn("turn", F.lit(1)).withColumn("step", F.lit(0)).unionByName(edges, allowMissingColumns=True)
    order = W.partitionBy("file", "name").orderBy("ord", "turn").rowsBetween(W.unboundedPreceding, 0)
    return stream.withColumn("scopes", F.sum("step").over(order)).filter((c("turn") == 1) & (c("scopes") == 0)).select(*columns)
