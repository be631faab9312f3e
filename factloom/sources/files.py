"""File tables: scans, scopes, snapshots, overlays, packages, changed files and hunks."""

from __future__ import annotations

import difflib
import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths, text

c = F.col


def read_tree(spark: SparkSession, root: str, version: str = "head") -> DataFrame:
    """Every text file below ``root``: (path, text, mtime, length, version), paths relative to the root."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    uri = text.uri_to_path(F.regexp_replace(c("_metadata.file_path"), "^file:/+", "/"))
    files = raw.select(uri.alias("full"), c("value").alias("text"),
                       c("_metadata.file_modification_time").alias("mtime"), c("_metadata.file_size").alias("length"))
    return with_package(files.withColumn("path", text.relative_path("full", root)).drop("full").withColumn("version", F.lit(version)))


def read_env_templates(spark: SparkSession, root: str, version: str = "head") -> DataFrame:
    """Env templates below a local root. Spark's readers hide dot files, so the driver lists the few names and tasks read them."""
    found = [os.path.join(d, n) for d, subs, names in os.walk(root) for n in names if n.lower() in paths.ENV_TEMPLATES]
    listing = spark.createDataFrame([(p,) for p in found], "full string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies = []
            for full in pdf["full"]:
                with open(full, encoding="utf-8", errors="replace") as f:
                    bodies.append(f.read())
            stat = [os.stat(full) for full in pdf["full"]]
            yield pd.DataFrame({"full": pdf["full"], "text": bodies, "mtime": pd.to_datetime([x.st_mtime_ns // 1000 for x in stat], unit="us"),
                                "length": [x.st_size for x in stat]})

    files = listing.mapInPandas(run, "full string, text string, mtime timestamp, length long")
    return with_package(files.withColumn("path", text.relative_path("full", root)).drop("full").withColumn("version", F.lit(version)))


def with_package(files: DataFrame) -> DataFrame:
    return files.withColumn("package", paths.package_of(c("path"))).withColumn("is_test", paths.is_test_file(c("path")))


def in_scope(files: DataFrame, roots: list[str] | None = None, include_tests: bool = False, max_files: int | None = None,
             extensions: list[str] | None = None, max_bytes: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Code files of a scope: folders skipped by name, tests only on request.

    ``max_files`` keeps the first files by path, ``max_bytes`` and ``max_depth`` leave out larger and deeper ones; all are off
    by default: a cluster has no need for them.
    """
    p = c("path")
    length = c("length") if "length" in files.columns else F.octet_length("text")
    keep = ~paths.in_skipped_dir(p) & ~paths.is_skipped_file(p)
    if max_bytes is not None:
        keep = keep & (length <= max_bytes)
    if max_depth is not None:
        keep = keep & (paths.folder_depth(p) <= max_depth)
    keep = keep & (paths._ends_with_any(p, extensions) if extensions else paths.is_code_file(p))
    if not include_tests:
        keep = keep & ~paths.is_test_file(p)
    if roots:
        cond = F.lit(False)
        for r in roots:
            r = r.strip("/")
            cond = cond | (p == r) | F.startswith(p, F.lit(r + "/"))
        keep = keep & cond
    out = files.filter(keep)
    return out.orderBy("path").limit(max_files) if max_files is not None else out


def with_overlay(files: DataFrame, overlay: DataFrame) -> DataFrame:
    """Unsaved buffers over stored text. ``overlay`` has (path, text); new paths are added, changed ones dirty."""
    o = overlay.select("path", c("text").alias("buffer"))
    joined = files.join(o, "path", "full_outer")
    return joined.withColumn("dirty", c("buffer").isNotNull() & ~c("buffer").eqNullSafe(c("text"))).withColumn(
        "text", F.coalesce("buffer", "text")).drop("buffer")


def packages(manifests: DataFrame) -> DataFrame:
    """(package, name, dir) from package.json texts."""
    return manifests.filter(text.base_name("path") == "package.json").select(
        F.regexp_replace("path", "/?package\\.json$", "").alias("dir"),
        F.get_json_object("text", "$.name").alias("name"),
    ).filter(c("name").isNotNull()).withColumn("package", text.base_name("dir"))


def workspace_globs(manifests: DataFrame) -> DataFrame:
    """Workspace folder patterns from package.json ``workspaces`` and pnpm-workspace.yaml."""
    listed = manifests.filter(text.base_name("path") == "package.json").select(F.explode(F.from_json(F.coalesce(
        F.get_json_object("text", "$.workspaces.packages"), F.get_json_object("text", "$.workspaces")), "array<string>")).alias("glob"))
    pnpm = manifests.filter(text.base_name("path") == "pnpm-workspace.yaml").select(F.explode(F.regexp_extract_all(
        "text", F.lit("(?m)^\\s*-\\s*['\"]?([^'\"\\n]+?)['\"]?\\s*$"), 1)).alias("glob"))
    return listed.unionByName(pnpm).distinct()


def discover_packages(files: DataFrame) -> DataFrame:
    """Package folders: conventional parents, workspace globs and folders with a manifest."""
    conventional = files.select(F.regexp_extract("path", "^((?:.*/)?(?:packages|apps|libs|modules|services)/[^/]+)/", 1).alias("dir"))
    globs = workspace_globs(files).select(F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(
        "glob", "\\.", "\\\\."), "\\*+", "[^/]+"), F.lit("$")).alias("rx"))
    dirs = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(paths.dirs_of(c("path"))), F.lit(1))),
                                              lambda n: F.array_join(F.slice(paths.dirs_of(c("path")), 1, n), "/"))).alias("dir")).distinct()
    by_glob = dirs.join(globs, F.expr("dir rlike rx"), "left_semi")
    return conventional.filter(c("dir") != "").unionByName(by_glob).distinct().withColumn("package", text.base_name("dir"))


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """Paths whose content differs between two snapshots, with added/removed/modified status.

    Only a hash of the text crosses the shuffle.
    """
    b = base.select("path", F.xxhash64("text").alias("b"), F.length("text").alias("bl"))
    h = head.select("path", F.xxhash64("text").alias("h"), F.length("text").alias("hl"))
    status = F.when(c("b").isNull(), "added").when(c("h").isNull(), "removed").otherwise("modified")
    return b.join(h, "path", "full_outer").filter(
        ~c("b").eqNullSafe(c("h")) | ~c("bl").eqNullSafe(c("hl"))).select("path", status.alias("status"))


def changed_hunks(base: DataFrame, head: DataFrame) -> DataFrame:
    """Changed line ranges of the new text, zero context. A pure deletion points at the line after it."""
    pair = head.select("path", c("text").alias("new")).join(base.select("path", c("text").alias("old")), "path", "full_outer")
    pair = pair.filter(~c("new").eqNullSafe(c("old")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, new, old in zip(pdf["path"], pdf["new"], pdf["old"]):
                a, b = (old or "").split("\n"), (new or "").split("\n")
                for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    if tag != "equal":
                        rows.append((path, j1 + 1, max(j2, j1 + 1), i1 + 1, max(i2, i1 + 1), tag))
            yield pd.DataFrame(rows, columns=["file", "start_line", "end_line", "base_start", "base_end", "kind"])

    return pair.mapInPandas(run, "file string, start_line int, end_line int, base_start int, base_end int, kind string")


def parse_unified_diff(diff: DataFrame, body: str = "diff") -> DataFrame:
    """Hunks of ``git diff --unified=0`` texts: the file of a hunk is the last +++ line above it."""
    from pyspark.sql import Window as W

    keep = [x for x in diff.columns if x != body]
    ls = diff.select(*keep, F.posexplode(text.lines(body)).alias("i", "l"))
    file = F.regexp_extract("l", "^\\+\\+\\+ (?:b/)?(.+)$", 1)
    w = W.partitionBy(*keep).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ls = ls.withColumn("file", F.last(F.when(file != "", file), ignorenulls=True).over(w))
    start = F.regexp_extract("l", "^@@ -\\S+ \\+(\\d+)(?:,(\\d+))? @@", 1)
    count = F.regexp_extract("l", "^@@ -\\S+ \\+(\\d+)(?:,(\\d+))? @@", 2)
    n = F.when(count == "", 1).otherwise(count.try_cast("int"))
    first = start.try_cast("int")
    return ls.filter(start != "").select(*keep, "file", first.alias("start_line"), F.greatest(first + n - 1, first).alias("end_line"))


def _git(root: str, *args: str) -> str | None:
    run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    return run.stdout if run.returncode == 0 else None


def merge_base(root: str, target: str | None = None) -> str | None:
    """Base commit: the given branch, else main, master, develop, else the previous commit."""
    for branch in [target] if target else ["main", "master", "develop"]:
        found = _git(root, "merge-base", "HEAD", branch)
        if found:
            return found.strip()
    found = _git(root, "rev-parse", "HEAD~1")
    return found.strip() if found else None


def read_git_version(spark: SparkSession, root: str, ref: str, version: str = "base") -> DataFrame:
    """File table of a commit. The driver lists only paths; the executors read the contents."""
    listing = _git(root, "ls-tree", "-r", "--name-only", ref) or ""
    names = spark.createDataFrame([(p,) for p in listing.split("\n") if p], "path string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [_git(root, "show", f"{ref}:{p}") for p in pdf["path"]]})

    return with_package(names.mapInPandas(run, "path string, text string").filter(c("text").isNotNull()).withColumn(
        "version", F.lit(version)))


def tsconfig_aliases(files: DataFrame) -> DataFrame:
    """(dir, ordinal, alias, target) of tsconfig ``paths``; targets are relative to the tsconfig's folder."""
    conf = files.filter(text.base_name("path") == "tsconfig.json").select(
        F.regexp_replace("path", "/?tsconfig\\.json$", "").alias("dir"),
        F.from_json(F.get_json_object("text", "$.compilerOptions.paths"), "map<string,array<string>>").alias("paths"),
        F.coalesce(F.get_json_object("text", "$.compilerOptions.baseUrl"), F.lit(".")).alias("base_url"))
    return conf.select("dir", "base_url", F.posexplode(F.map_entries("paths")).alias("ordinal", "e")).select(
        "dir", "ordinal", c("e.key").alias("alias"), F.explode("e.value").alias("target"), "base_url")


def nearest_config(dirs: DataFrame, configs: DataFrame) -> DataFrame:
    """For each folder, the closest ancestor folder that holds a config: explode ancestors, equi-join, deepest wins."""
    parts = F.split("from_dir", "/")
    up = dirs.select("from_dir", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).alias("dir")).distinct()
    return up.join(configs.select("dir").distinct(), "dir").groupBy("from_dir").agg(
        F.max_by("dir", F.length("dir")).alias("dir"))


def line_range(body: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(text.lines(body), first, F.greatest(last - first + 1, F.lit(0))), "\n")
