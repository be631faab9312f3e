"""Re-exports, local scopes and symbol trees against plain loops on random graphs and hand-written files."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import lexer
from factloom.operators import facts, graph, reexports, scopes

DIRECT = "file string, exported_as string, def_file string, def_name string, def_line int, def_kind string"
EDGES = "file string, exported_as string, target string, wanted string"


def _walked(direct, edges):
    """{(file, name): definitions}, and {(file, name): reason}, by following every link one by one."""
    own, named, stars = {}, {}, {}
    for f, e, df, dn in direct:
        own.setdefault((f, e), set()).add((df, dn))
    for f, e, t, w in edges:
        if w == "*":
            stars.setdefault(f, set()).add(t)
        else:
            named.setdefault((f, e), set()).add((t, w))
    files = {f for f, _ in own} | {f for f, *_ in edges} | {t for _, _, t, _ in edges}
    explicit = set(own) | set(named)
    names = {f: {n for g, n in explicit if g == f} for f in files}
    grown = True
    while grown:
        grown = False
        for f in files:
            for t in stars.get(f, ()):
                more = {n for n in names.get(t, ()) if n != "default"} - names[f]
                names[f] |= more
                grown |= bool(more)
    found, left = {}, {}
    for f in files:
        for n in names[f]:
            seen, queue, ends = set(), [(f, n)], set()
            while queue:
                at = queue.pop()
                if at in seen:
                    continue
                seen.add(at)
                if at in own:
                    ends |= own[at]
                elif at in named:
                    queue += named[at]
                elif at[1] in names.get(at[0], ()):
                    queue += [(t, at[1]) for t in stars.get(at[0], ()) if at[1] in names.get(t, ())]
            if ends:
                found[f, n] = ends
            else:
                left[f, n] = seen
    return found, left


@pytest.mark.parametrize("seed", [1, 2])
def test_reexports_against_walks(spark, seed):
    rng = random.Random(seed)
    files, names = [f"f{i}" for i in range(12)], ["a", "b", "c", "default"]
    direct = {(f, rng.choice(names)) for f in rng.sample(files, 5) for _ in range(2)}
    direct = [(f, n, f, n.upper()) for f, n in sorted(direct)]
    edges = {(f, "*", rng.choice(files), "*") for f in rng.sample(files, 7)} | {
        (f, n, rng.choice(files), rng.choice(names)) for f in files for n in rng.sample(names, 1)}
    edges = sorted(x for x in edges if x[0] != x[2] or x[3] != "*")
    d = spark.createDataFrame([(*x, 1, "k") for x in direct], DIRECT)
    known, left = reexports.follow(d, reexports.name_links(d, spark.createDataFrame(edges, EDGES)))
    found = {}
    for r in known.collect():
        found.setdefault((r.file, r.exported_as), set()).add((r.def_file, r.def_name))
    want, open_ = _walked(direct, edges)
    assert found == want and {(r.file, r.exported_as) for r in left.collect()} == set(open_)


def test_long_chain_and_cycle_of_three(spark):
    files = [(f"c/m{i}.ts", f"export {{ x }} from './m{i + 1}';") for i in range(40)] + [("c/m40.ts", "const y = 1;\nexport { y as x };")]
    files += [(f"r/m{i}.ts", f"export {{ z }} from './m{(i + 1) % 3}';") for i in range(3)]
    files += [("n/a.ts", "import * as all from '../c/m40';\nexport { all };"), ("n/b.ts", "export * from './a';\nexport { gone } from 'elsewhere';"),
              ("n/c.ts", "export * from './b';\nexport const all = 3;")]
    f = spark.createDataFrame(files, "path string, text string")
    t = lexer.tokens(f).cache()
    bindings, exports = graph.import_bindings(t), facts.exports(t)
    modules = graph.resolve_modules(bindings.select("file", "module").unionByName(exports.filter("module is not null").select("file", "module")), f)
    known, left = reexports.resolved(exports, facts.declarations(t), bindings, modules)
    found = {(r.file, r.exported_as): (r.def_file, r.def_name, r.def_kind) for r in known.collect()}
    assert all(found[f"c/m{i}.ts", "x"] == ("c/m40.ts", "y", "variable") for i in range(41))
    assert found["n/b.ts", "all"] == ("n/a.ts", "all", "namespace") and found["n/c.ts", "all"] == ("n/c.ts", "all", "variable")
    assert {(r.file, r.exported_as, r.reason) for r in left.collect()} == {
        *((f"r/m{i}.ts", "z", "cycle") for i in range(3)), ("n/b.ts", "gone", "missing"), ("n/c.ts", "gone", "missing")}
    at = spark.createDataFrame([("c/m40.ts", "y"), ("c/m3.ts", "x")], "file string, name string")
    assert [(r.file, r.def_file, r.def_name) for r in graph.goto_definition(at, bindings, modules, known, facts.declarations(t)).collect()] == [("c/m40.ts", "c/m40.ts", "y")]


SHADOWS = """import { item, other, list } from './lib';
export function plain(x: string) { return item(x); }
function byParam(item: number, { other, deep: { list } }: Props) { return item + other + list; }
const bare = item => item + 1;
const arrow = async (item: Map<string, Item>, ...list) => { list(item); };
function blocks() {
  if (item) { const item = 2; use(item); }
  use(item);
  for (const item of other) { use(item); }
  use(item);
  try { risky(); } catch (item) { use(item); }
  try { risky(); } catch (other: any) { use(other); }
  use(item, other);
}
function patterns() { const { a, item: other, ...list } = load(); use(other, list); const [item, second] = pair(); return item; }
function hoisted() { if (other) { var item = 1; } return item; }
function inner() { function item() { return 1; } class other {} return item(other); }
class Box { run(item: string) { return item; } get list() { return item; } }
const shorthand = { item, other: item, list };
let several = 1, more = item;
function later() { let p = 1, item = 2; return item; }
"""


def test_shadowed_names_are_no_references(spark):
    files = spark.createDataFrame([("src/a.ts", SHADOWS), ("src/lib.ts", "export const item = f;\nexport const other = 1;\nexport const list = [];\n")], "path string, text string")
    t = lexer.tokens(files).cache()
    bindings, exports, decls = graph.import_bindings(t), facts.exports(t), facts.declarations(t)
    modules = graph.resolve_modules(bindings, files)
    refs = graph.references(t, bindings, modules, graph.definitions(exports, decls, bindings, modules), decls)
    found = sorted((r.local, r.line) for r in refs.filter("file = 'src/a.ts' and def_file = 'src/lib.ts'").collect())
    want = {"item": [1, 2, 7, 8, 10, 13, 18, 19, 19, 20], "other": [1, 9, 13, 16], "list": [1, 19]}
    assert found == sorted((n, line) for n, lines in want.items() for line in lines)


def test_innermost_scope_equals_loop(spark):
    rng = random.Random(6)
    rows, uses = [], []
    for file in "ab":
        for name in "xyz":
            def cut(low, high, depth):
                at = low
                while depth and at < high - 2 and rng.random() < 0.8:
                    start = rng.randint(at, high - 2)
                    end = rng.randint(start + 1, high)
                    rows.append((file, name, start, end))
                    cut(start + 1, end - 1, depth - 1)
                    at = end + 1
            cut(0, 200, 5)
            uses += [(file, name, rng.randint(0, 210), i) for i in range(60)]
    found = {(r.file, r.name, r.tag): (r.scopes, r.scope_start) for r in scopes.innermost(
        spark.createDataFrame(uses, "file string, name string, ord int, tag int"), spark.createDataFrame(rows, "file string, name string, start int, end int")).collect()}
    assert len(found) == len(uses) and max(n for n, _ in found.values()) > 2
    for f, n, o, tag in uses:
        round_ = [s for g, m, s, e in rows if (g, m) == (f, n) and s <= o <= e]
        assert found[f, n, tag] == (len(round_), max(round_) if round_ else None)
    free = scopes.unshadowed(spark.createDataFrame(uses, "file string, name string, ord int, tag int"),
                             spark.createDataFrame(rows, "file string, name string, start int, end int"))
    assert {(r.file, r.name, r.tag) for r in free.collect()} == {k for k, (n, _) in found.items() if not n}


def test_parents_at_any_depth(spark):
    deep = "".join(f"function f{i}() {{ " for i in range(12)) + "}" * 12 + "\nclass K { m() { function g() {} } n() {} }\nfunction last() {}\n"
    t = lexer.tokens(spark.createDataFrame([("d.ts", deep)], "path string, text string"))
    found = {r.name: (r.depth, r.parent) for r in graph.document_symbols(facts.nodes(t), facts.declarations(t)).collect()}
    assert all(found[f"f{i}"] == (i, f"f{i - 1}" if i else None) for i in range(12))
    assert found["m"] == (1, "K") and found["g"] == (2, "m") and found["n"] == (1, "K") and found["last"] == (0, None)
