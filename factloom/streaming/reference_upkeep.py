"""Keep the reference table current: after an edit, only the files whose references can have changed are resolved again.

What changes is found by small joins from the edited files outwards:

1. Facts of edited files are replaced.
2. A module path is resolved anew if its file was edited, or if one of its options names a file that came or went.
3. Definitions are followed again for the frontier: the edited files, those with new module targets, and all that pass names on
   from these, found by walking re-exports backwards. What lies outside keeps its definitions, and ends the links that lead there.
4. References are resolved again in edited files, files with new module targets, and files that import a name whose definition is
   another than before. All other rows stay as they are.

The tables are those of ``build``; with ``log_store`` each is appended as the rows of the files in ``touched``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import facts, graph, reexports
from factloom.session import stored

c = F.col
Tables = dict[str, DataFrame]
BY_FILE = ["bindings", "exports", "declarations", "options"]


def _facts(tokens: DataFrame, packages: DataFrame | None, aliases: DataFrame | None) -> Tables:
    """The tables that follow from a file's own tokens."""
    bindings, exports = stored(graph.import_bindings(tokens), "bindings"), stored(facts.exports(tokens), "exports")
    modules = bindings.select("file", "module").unionByName(exports.filter(c("module").isNotNull()).select("file", "module"))
    return {"bindings": bindings, "exports": exports, "declarations": stored(facts.declarations(tokens), "declarations"),
            "options": stored(graph.module_options(modules, packages, aliases), "options")}


def build(tokens: DataFrame, files: DataFrame, packages: DataFrame | None = None, aliases: DataFrame | None = None) -> Tables:
    """All tables from all tokens: the facts, and files, modules, definitions and references."""
    out = _facts(tokens, packages, aliases)
    out["files"] = stored(files.select("path"), "files")
    out["modules"] = stored(graph.resolve_options(out["options"], files), "modules")
    out["definitions"] = stored(graph.definitions(out["exports"], out["declarations"], out["bindings"], out["modules"]), "definitions")
    out["references"] = stored(graph.references(tokens, out["bindings"], out["modules"], out["definitions"], out["declarations"]), "references")
    return out


def _replaced(old: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    return old.join(files, "file", "left_anti").select(*old.columns).unionByName(fresh)


def _of(table: DataFrame, files: DataFrame) -> DataFrame:
    return table.join(files, "file", "left_semi")


def _new_targets(old: Tables, now: Tables, edited: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules after the edit, and the files of which some module means another file than before."""
    affected = _of(now["options"], edited).select("file", "module").unionByName(
        now["options"].join(graph.file_keys(moved), "key").select("file", "module")).distinct()
    affected = stored(affected, "affected")
    again = stored(graph.resolve_options(now["options"].join(affected, ["file", "module"], "left_semi"), now["files"]), "modules-again")
    stay = old["modules"].join(edited, "file", "left_anti").join(affected, ["file", "module"], "left_anti")
    before = old["modules"].join(affected, ["file", "module"], "left_semi").join(edited, "file", "left_anti")
    after = again.join(edited, "file", "left_anti")
    other = before.exceptAll(after).unionByName(after.exceptAll(before)).select("file").distinct()
    return stay.unionByName(again), stored(other, "retargeted")


def frontier(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The seeds and all files that pass names on from them, level by level; ``edges`` has (file, target)."""
    back = edges.select(c("target").alias("from"), "file").distinct()
    reached = level = stored(seeds.select("file").distinct(), "reached")
    while not level.isEmpty():
        level = stored(level.select(c("file").alias("from")).join(back, "from").select("file").distinct().join(reached, "file", "left_anti"), "level")
        reached = reached.unionByName(level)
    return reached


def _definitions(old: Tables, now: Tables, files: DataFrame) -> DataFrame:
    """Definitions of the names of ``files``; links to other files end at the definitions these have."""
    direct, edges = reexports.export_edges(_of(now["exports"], files), _of(now["declarations"], files), _of(now["bindings"], files), _of(now["modules"], files))
    edges = stored(edges, "edges")
    outside = edges.select(c("target").alias("file")).distinct().join(files, "file", "left_anti")
    known = _of(old["definitions"], outside).select("file", "exported_as", *reexports.DEF)
    ends = stored(direct.unionByName(known), "ends")
    if edges.isEmpty():
        return _of(ends, files)
    return _of(reexports.follow(ends, stored(reexports.name_links(ends, edges), "links"))[0], files)


def update(old: Tables, tokens: DataFrame, edited: DataFrame, files: DataFrame, packages: DataFrame | None = None,
           aliases: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """The tables after an edit, and the files (file) whose references were resolved again.

    ``tokens`` are those of all files after the edit, of which only touched files are read; ``edited`` has the paths (file) of changed,
    new and deleted files, ``files`` all paths after it.
    """
    edited = stored(edited.select("file").distinct(), "edited")
    fresh = _facts(_of(tokens, edited), packages, aliases)
    now: Tables = {t: _replaced(old[t], edited, fresh[t]) for t in BY_FILE}
    now["files"] = stored(files.select("path"), "files")
    moved = now["files"].exceptAll(old["files"]).unionByName(old["files"].exceptAll(now["files"]))
    now["modules"], retargeted = _new_targets(old, now, edited, stored(moved, "moved"))
    now = {t: df if t == "files" else stored(df, t) for t, df in now.items()}

    passing = now["exports"].filter(c("kind") == "reexport").join(now["modules"], ["file", "module"]).select("file", "target").unionByName(
        now["exports"].filter(c("kind") == "unknown").select("file", "name").join(
            now["bindings"].select("file", c("local").alias("name"), "module"), ["file", "name"]).join(now["modules"], ["file", "module"]).select("file", "target"))
    again = frontier(edited.unionByName(retargeted), passing)
    fresh_defs = stored(_definitions(old, now, again), "definitions-again")
    known = _of(old["definitions"], again)
    changed = known.exceptAll(fresh_defs).unionByName(fresh_defs.exceptAll(known)).select("file", "exported_as").distinct()
    now["definitions"] = stored(_replaced(old["definitions"], again, fresh_defs), "definitions")

    importers = changed.select(c("file").alias("target"), c("exported_as").alias("imported")).join(
        now["modules"].join(now["bindings"].select("file", "module", "imported"), ["file", "module"]), ["target", "imported"]).select("file")
    touched = stored(edited.unionByName(retargeted).unionByName(importers).distinct(), "touched")
    own = {t: _of(now[t], touched) for t in ("bindings", "modules", "declarations")}
    fresh_refs = graph.references(_of(tokens, touched), own["bindings"], own["modules"], now["definitions"], own["declarations"])
    now["references"] = stored(_replaced(old["references"], touched, fresh_refs), "references")
    return now, touched
