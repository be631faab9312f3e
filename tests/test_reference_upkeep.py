"""References after edits, against resolving everything again."""

import random

from factloom.functions import lexer
from factloom.streaming import reference_upkeep as upkeep


def _module(rng, i, n):
    """A module that imports, passes on and defines names of modules before it."""
    lines, names = [], []
    for k in range(rng.randint(0, 2) if i else 0):
        j = rng.randrange(i)
        lines.append(f"import {{ v{j} as use{k} }} from './m{j}';")
        names.append(f"use{k}")
    if i and rng.random() < 0.5:
        lines.append(f"export {{ v{rng.randrange(i)} as v{i} }} from './m{rng.randrange(i)}';")
    else:
        lines.append(f"export const v{i} = {rng.randint(1, 9)};")
    if i and rng.random() < 0.4:
        lines.append(f"export * from './m{rng.randrange(i)}';")
    lines += [f"export function f{i}(x: number) {{ return {' + '.join([*names, 'x'])}; }}"]
    return "\n".join(lines)


def _state(tables):
    return {t: sorted(map(str, df.collect())) for t, df in tables.items() if t in ("modules", "definitions", "references")}


def _tokens(spark, texts):
    files = spark.createDataFrame(sorted(texts.items()), "path string, text string")
    return files, lexer.tokens(files).cache()


def test_edits_equal_a_full_build(spark):
    rng, n = random.Random(5), 14
    texts = {f"src/m{i}.ts": _module(rng, i, n) for i in range(n)}
    files, tokens = _tokens(spark, texts)
    tables = upkeep.build(tokens, files)
    changed, gone = rng.sample(sorted(texts), 2)
    texts[changed] = _module(rng, int(changed[5:-3]), n)
    texts.pop(gone)
    texts[f"src/m{n}.ts"] = _module(rng, n, n)
    files, tokens = _tokens(spark, texts)
    edited = spark.createDataFrame([(changed,), (gone,), (f"src/m{n}.ts",)], "file string")
    tables, _ = upkeep.update(tables, tokens, edited, files)
    assert _state(tables) == _state(upkeep.build(tokens, files))


def test_only_importers_of_changed_names_are_resolved(spark):
    texts = {"a.ts": "export const one = 1;\nexport const two = 2;\n", "b.ts": "export * from './a';\n", "z.ts": "export const z = 1;\n"}
    texts |= {f"u{i}.ts": f"import {{ {'one' if i % 2 else 'two'} }} from './b';\nexport const u{i} = {'one' if i % 2 else 'two'};\n" for i in range(6)}
    files, tokens = _tokens(spark, texts)
    tables = upkeep.build(tokens, files)
    for text, want in (("export const one = 5;\nexport const two = 2;\n", {"a.ts"}),  # a body changes, no definition
                       ("export const one = 5;\n", {"a.ts", "u0.ts", "u2.ts", "u4.ts"})):  # a name goes
        texts["a.ts"] = text
        files, tokens = _tokens(spark, texts)
        tables, touched = upkeep.update(tables, tokens, spark.createDataFrame([("a.ts",)], "file string"), files)
        assert {r.file for r in touched.collect()} == want
    assert tables["references"].filter("def_symbol = 'two'").count() == 0
