"""Where an exported name is defined, through re-exports and barrels of any depth.

A node is (file, exported name). It is either defined in its file, passed on from one name of another file, or provided by
``export *``. The links form a graph whose ends are the definitions. Pointer doubling follows it: each round joins the pointers
with themselves, so a pointer that crossed n links crosses 2n, and rounds are the logarithm of the longest chain. A round that
finds no new (node, definition) ends the loop: a definition n links away has nodes at every smaller distance.

A name that a file exports itself hides the one an ``export *`` of that file would provide; ``default`` is never provided. Names
that several barrels provide differently keep all their definitions. Nodes that reach none are reported, with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import shuffled, stored

c = F.col
DEF = ["def_file", "def_name", "def_line", "def_kind"]


def star_closure(stars: DataFrame) -> DataFrame:
    """(file, via) for every file that a chain of ``export *`` leads to, by doubling: chains of n links take log n rounds."""
    reach = stored(stars.select("file", c("target").alias("via")).distinct(), "reach")
    size = reach.count()
    while size:
        on = reach.select(c("file").alias("via"), c("via").alias("further"))
        reach = stored(reach.unionByName(reach.join(on, "via").select("file", c("further").alias("via"))).distinct(), "reach")
        grown = reach.count()
        if grown == size:
            break
        size = grown
    return reach


def name_links(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, name, to_file, to_name) links between nodes: named ones, and those of ``export *`` for each name it provides.

    ``direct`` has (file, exported_as) of what files define; ``edges`` (file, exported_as, target, wanted), wanted ``*`` for all.
    """
    named = edges.filter(c("wanted") != "*").select(
        "file", c("exported_as").alias("name"), c("target").alias("to_file"), c("wanted").alias("to_name")).distinct()
    stars = edges.filter(c("wanted") == "*").select("file", "target").distinct()
    explicit = direct.select("file", c("exported_as").alias("name")).unionByName(named.select("file", "name")).distinct()
    reach = star_closure(stars)
    provided = reach.join(explicit.filter(c("name") != "default").withColumnRenamed("file", "via"), "via").select("file", "name").distinct().join(
        explicit, ["file", "name"], "left_anti")
    nodes = explicit.unionByName(provided).select(c("file").alias("target"), "name")
    passed = provided.join(stars, "file").join(nodes, ["target", "name"]).select("file", "name", c("target").alias("to_file"), c("name").alias("to_name"))
    # A name that is defined in the file ends there, whatever else passes it on.
    return named.join(direct.select("file", c("exported_as").alias("name")).distinct(), ["file", "name"], "left_anti").unionByName(passed)


def follow(direct: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions of all nodes (file, exported_as, def_...), and the nodes without one (file, exported_as, reason).

    The reason is ``cycle`` for names that only lead back to themselves, ``missing`` for those that lead to what no known file exports.
    """
    ends = direct.select(c("file").alias("to_file"), c("exported_as").alias("to_name")).distinct().withColumn("ended", F.lit(True))
    pointers = stored(links.join(ends, ["to_file", "to_name"], "left").select(
        "file", "name", "to_file", "to_name", F.coalesce("ended", F.lit(False)).alias("ended")), "pointers")
    found = -1
    while True:
        counts = pointers.agg(F.count_if("ended"), F.count_if(~c("ended"))).first()
        if counts[0] == found or not counts[1]:
            break
        found = counts[0]
        on = pointers.select(c("file").alias("to_file"), c("name").alias("to_name"), c("to_file").alias("next_file"), c("to_name").alias("next_name"), "ended")
        moved = pointers.filter(~c("ended")).drop("ended").join(on, ["to_file", "to_name"]).select(
            "file", "name", c("next_file").alias("to_file"), c("next_name").alias("to_name"), "ended")
        pointers = stored(pointers.filter("ended").unionByName(moved).distinct(), "pointers")
    own = direct.select("file", "exported_as", *DEF).distinct()
    there = own.select(c("file").alias("to_file"), c("exported_as").alias("to_name"), *DEF)
    led = pointers.filter("ended").join(there, ["to_file", "to_name"]).select("file", c("name").alias("exported_as"), *DEF)
    known = own.unionByName(led).distinct()
    left = links.select("file", c("name").alias("exported_as")).distinct().join(known, ["file", "exported_as"], "left_anti")
    turning = pointers.filter(~c("ended")).select("file", c("name").alias("exported_as")).distinct().withColumn("reason", F.lit("cycle"))
    return known, left.join(turning, ["file", "exported_as"], "left").withColumn("reason", F.coalesce("reason", F.lit("missing")))


def export_edges(exports: DataFrame, declarations: DataFrame, bindings: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What files define themselves (file, exported_as, def_...) and what they pass on (file, exported_as, target, wanted)."""
    decl = declarations.select("file", c("symbol").alias("name"), c("line").alias("decl_line"), c("kind").alias("decl_kind"))
    own = exports.filter(~c("kind").isin("reexport") & (c("name") != "*")).join(shuffled(decl), ["file", "name"], "left")
    imported = bindings.join(shuffled(modules), ["file", "module"]).select("file", c("local").alias("name"), c("imported"), "target")
    direct = own.filter((c("kind") != "unknown") | c("decl_line").isNotNull()).select(
        "file", "exported_as", c("file").alias("def_file"), c("name").alias("def_name"), F.coalesce("decl_line", "line").alias("def_line"),
        F.coalesce("decl_kind", "kind").alias("def_kind"))
    passed = own.filter((c("kind") == "unknown") & c("decl_line").isNull()).join(imported, ["file", "name"]).select(
        "file", "exported_as", "target", c("imported").alias("wanted"), "name", "line")
    # A whole module under one name is defined where the name is.
    spaces = passed.filter(c("wanted") == "*").select("file", "exported_as", c("file").alias("def_file"), c("name").alias("def_name"), c("line").alias("def_line"),
                                                      F.lit("namespace").alias("def_kind"))
    # A name from a module that isn't known has no target; of such a module as a whole nothing is known.
    again = exports.filter(c("kind") == "reexport").join(modules, ["file", "module"], "left").select(
        "file", "exported_as", "target", c("name").alias("wanted")).filter(c("target").isNotNull() | (c("wanted") != "*"))
    return direct.unionByName(spaces).distinct(), again.unionByName(passed.filter(c("wanted") != "*").drop("name", "line"))


def resolved(exports: DataFrame, declarations: DataFrame, bindings: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``follow`` over the edges of ``export_edges``; a code base that passes nothing on needs no round."""
    direct, edges = export_edges(exports, declarations, bindings, modules)
    # Only these kinds give edges: a glance at the exports saves the joins.
    if exports.filter(c("kind").isin("reexport", "unknown")).isEmpty() or edges.isEmpty():
        return direct, direct.select("file", "exported_as", F.lit("missing").alias("reason")).limit(0)
    direct, edges = stored(direct, "direct"), stored(edges, "edges")
    return follow(direct, stored(name_links(direct, edges), "links"))
