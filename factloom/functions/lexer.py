"""Cut TS/JS text into token rows inside Arrow batches.

This is the only per-character Python step. It yields one row per token with its neighbours, bracket
pairs and statement start; every fact (declarations, calls, exports, shapes, predicates ...) is then a
DataFrame query over those rows. It is tolerant: broken text still yields rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from factloom.session import stored_batches

_TOKEN = re.compile(
    r"[^\S\n]*(?:(?P<id>[A-Za-z_$\u0080-￿][\w$]*)|(?P<nl>\n)|(?P<com>//[^\n]*|/\*[\s\S]*?\*/)"
    r"|(?P<str>'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\")"
    r"|(?P<tpl>`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{))"
    r"|(?P<num>\d[\w.]*)"
    r"|(?P<op>=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|[^\w\s]))"
)
# The same pieces, with the blanks between them, of ASCII text without templates and divisions: what a piece is shows in how it begins.
_PIECE = re.compile(
    r"[^\S\n]+|[A-Za-z_$][\w$]*|\n|//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|\d[\w.]*"
    r"|=>|\.\.\.|\?\.(?!\d)|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|[^\w\s]"
)
_BEGINS = {x: "nl" if x == "\n" else "" if x.isspace() else "num" if x.isdigit() else "id" if x.isalpha() or x in "_$" else
           {"'": "str", '"': "str", "/": "com"}.get(x, "op") for x in map(chr, range(128))}
_TPL_REST = re.compile(r"\}(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:`|\$\{)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")

KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends finally for "
    "function if import in instanceof new return super switch this throw try typeof var void while with "
    "yield await let".split()
)
_STARTERS = frozenset(
    "const let var function class interface type enum export import if for while do switch try return throw "
    "async declare abstract namespace case default break continue".split()
)
DECL_WORDS = ["function", "class", "interface", "type", "enum", "const", "let", "var"]
BEFORE_NAMES = [*DECL_WORDS, "*", ","]  # what can stand before the name that a declaration gives
_LOOPS = frozenset(("for", "while", "do"))
_CONTROL = frozenset(("if", "for", "while", "switch", "catch", "with"))
_OPEN = {"(": ")", "[": "]", "{": "}"}

TOKEN_SCHEMA = (
    "file string, ord int, kind string, text string, line int, col int, depth int, open int, open_role string, "
    "role string, close int, p1 string, p2 string, n1 string, n2 string, n3 string, chain string, "
    "chain_ord int, chain_line int, chain_col int, stmt int, stmt_line int, stmt_col int, s1 string, s2 string, "
    "s3 string, module string, doc string, jsdoc string, fn int, sym string, sym_kind string, node string, "
    "body int, until int, params int, argc int, ann string, ret string, is_async boolean, fn_init boolean, has_default boolean, "
    "known boolean, param_name boolean, leads_line boolean"
)
_FIELDS = [part.strip().split(" ") for part in TOKEN_SCHEMA.split(",")]
_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in _FIELDS])
_PAD = 130
_ROLE_WORDS = frozenset(("(", "=>", "{", "class", "interface", "enum", "type"))
_EXTENT_WORDS = frozenset(("{", "for", "while", "do", "switch", "try", "if"))
_KEPT_OPS = frozenset(("(", "{", "?", "=>", "===", "!==", "*", "}"))
_TYPE_MARKS, _LINKS = frozenset((":", "?")), frozenset((".", "?.", "="))
_CLOSERS = frozenset((")", "]", "}"))
_AFTER_BODY = frozenset((")", ",", ".", ";", "else", "catch", "finally", "while", "from"))
_ENDED_ROLES = frozenset(("object", "names", "type", None))
_LIST_ROLES = frozenset(("object", "enum", "params", "call"))
_UNSPLIT_ROLES = frozenset(("object", "enum", "names"))
_FN_NODES, _NAMED_NODES = frozenset(("arrow", "function", "funcexpr", "method")), frozenset(("function", "method", "class"))
_EDGE = 3  # neighbours and statement words that a row names
_FLUSH_CHARS = 250_000


def _cut_plain(pieces: list[str]):
    """``cut`` of text that consists of these pieces."""
    kinds, texts, offs, lines, cols, comments = [], [], [], [], [], {}
    line, bol = 1, 0
    for tok, pos in zip(pieces, accumulate(map(len, pieces), initial=0)):
        kind = _BEGINS[tok[0]]
        if not kind:
            continue
        if kind == "nl":
            line, bol = line + 1, pos + 1
            continue
        if kind == "com":
            comments.setdefault(len(kinds), []).append(tok)
        else:
            kinds.append("op" if kind == "str" and len(tok) == 1 else kind)  # a quote that nothing closes
            texts.append(tok)
            offs.append(pos)
            lines.append(line)
            cols.append(pos - bol)
        if (kind == "com" or kind == "str") and "\n" in tok:
            line += tok.count("\n")
            bol = pos + tok.rindex("\n") + 1
    return kinds, texts, offs, lines, cols, comments


def cut(text: str):
    """Plain token lists: kinds, texts, offsets, lines, columns and the comments before each token."""
    if "`" not in text and text.isascii():
        pieces = _PIECE.findall(text)
        if "/" not in pieces:  # a division or a pattern
            return _cut_plain(pieces)
    kinds, texts, offs, lines, cols, comments = [], [], [], [], [], {}
    pos, line, bol, n, tpl_depth, depth = 0, 1, 0, len(text), [], 0
    while pos < n:
        for m in _TOKEN.finditer(text, pos):
            kind, end = m.lastgroup, m.end()
            if kind == "nl":
                line, bol = line + 1, end
                continue
            tok = m[kind]
            pos = end - len(tok)
            if kind == "op":
                if tok == "}":
                    if tpl_depth and tpl_depth[-1] == depth:  # a substitution ends, its template goes on
                        rest = _TPL_REST.match(text, pos)
                        if rest:
                            kind, tok, end = "tpl", rest.group(), rest.end()
                            if tok.endswith("`"):
                                tpl_depth.pop()
                    if kind == "op":
                        depth -= 1
                elif tok == "{":
                    depth += 1
                elif tok == "/":
                    prev = texts[-1] if texts else "("
                    value = kinds and (kinds[-1] in ("num", "str", "regex") or prev in (")", "]", "}")
                                       or (kinds[-1] == "id" and prev not in KEYWORDS))
                    pattern = None if value else _REGEX.match(text, pos)
                    if pattern:
                        kind, tok, end = "regex", pattern.group(), pattern.end()
            elif kind == "tpl" and tok.endswith("${"):
                tpl_depth.append(depth)
            if kind == "com":
                comments.setdefault(len(kinds), []).append(tok)
            else:
                kinds.append(kind)
                texts.append(tok)
                offs.append(pos)
                lines.append(line)
                cols.append(pos - bol)
            if kind != "id" and kind != "op" and "\n" in tok:
                line += tok.count("\n")
                bol = pos + tok.rindex("\n") + 1
            if end != m.end():  # what the pattern can't tell goes further than its match
                pos = end
                break
        else:
            break
    return kinds, texts, offs, lines, cols, comments


def pair_brackets(texts: list[str], kinds: list[str]):
    """Enclosing opener, matching closer, nesting depth and comma count of every token."""
    n = len(texts)
    opens, depths, close, commas, stack = [-1] * n, [0] * n, {}, {}, []
    inner, depth = -1, 0
    for i, t in enumerate(texts):
        if kinds[i] == "op":
            if t in _CLOSERS and stack:
                for back in range(len(stack) - 1, -1, -1):
                    if _OPEN[texts[stack[back]]] == t:
                        for left in reversed(stack[back:]):  # unclosed inner groups end here too
                            close[left] = i
                        del stack[back:]
                        inner, depth = (stack[-1] if stack else -1), len(stack)
                        break
            opens[i], depths[i] = inner, depth
            if t in _OPEN:
                stack.append(i)
                inner, depth = i, depth + 1
            elif t == "," and stack:
                commas[inner] = commas.get(inner, 0) + 1
        else:
            opens[i], depths[i] = inner, depth
    for left in stack:
        close[left] = n
    return opens, depths, close, commas


def _type_end(texts, i, close, stops):
    """First token at or after ``i`` that ends a type or expression in the same bracket group."""
    n, angle = len(texts) - _PAD, 0
    while i < n:
        t = texts[i]
        if t in _CLOSERS or (t in stops and angle <= 0):
            return i
        angle += (t == "<") - (t == ">")
        i = close.get(i, i) + 1 if t in _OPEN else i + 1
    return n


class Cut(NamedTuple):
    """One file's tokens: lists by token, dicts and sets of the few tokens that have a value, and the tokens that become rows."""

    kinds: list
    texts: list
    lines: list
    cols: list
    depths: list
    opens: list
    stmt: list
    fn: list
    sym: list
    sym_kind: list
    chain: dict
    chain_ord: dict
    role: dict
    close: dict
    module: dict
    doc: dict
    jsdoc: dict
    node: dict
    body: dict
    until: dict
    params: dict
    argc: dict
    ann: dict
    ret: dict
    is_async: dict
    fn_init: set
    defaults: set
    kept: list


def cut_file(file: str, text: str, everything: bool = False) -> Cut:
    kinds, texts, offs, lines, cols, comments = cut(text)
    opens, depths, close, commas = pair_brackets(texts, kinds)
    n = len(texts)
    opening, extending, linking = ([i for i, t in enumerate(texts) if t in words] for words in (_ROLE_WORDS, _EXTENT_WORDS, _LINKS))
    typed = [i - 1 for i, t in enumerate(texts) if t in _TYPE_MARKS and i]
    texts += [None] * _PAD  # reading past either end gives None
    at = texts.__getitem__
    jsx_ok = not file.endswith(".ts")

    # Roles of brackets, and the function, class and statement nodes they open.
    role, node, name, body, until, params, ret, is_async = {}, {}, {}, {}, {}, {}, {}, {}
    fn_init, ann = set(), {}

    def slice_text(a, b):
        return text[offs[a]:offs[b - 1] + len(texts[b - 1])] if a < b else None

    def value_end(i):
        """Last token of an expression body; a statement word on a new line ends it without a semicolon."""
        e = _type_end(texts, i, close, (";", ","))
        for k in range(i + 1, e):
            if lines[k] > lines[k - 1] and opens[k] == opens[i] and texts[k] in _STARTERS:
                return k - 1
        return e - 1

    def name_before(i):
        """Binding name of a function value starting at token ``i``: ``x = <fn>`` or ``x: T = <fn>``."""
        j = i - 1
        if at(j) == "async":
            j -= 1
        if at(j) == "=":
            j -= 1
            if kinds[j] == "id" and at(j - 1) in ("const", "let", "var", ","):
                return j
            k = j
            while k > 0 and opens[k] == opens[j] and texts[k] not in (";", "=", "{", "}") and j - k < 40:
                if texts[k] == ":" and kinds[k - 1] == "id":
                    return k - 1
                k -= 1
        return None

    for i in opening:
        t = texts[i]
        if t == "(" and kinds[i] == "op":
            p, c = at(i - 1), close[i]
            j = i - 1
            if p == ">":  # generic call or generic function: step back over <...>
                angle = 0
                while j >= 0 and i - j < 60:
                    angle += (texts[j] == ">") - (texts[j] == "<")
                    j -= 1
                    if angle == 0:
                        break
                p = at(j)
            after = at(c + 1)
            decl = p == "function" or at(j - 1) == "function" or (at(j - 1) == "*" and at(j - 2) == "function")
            owner = role.get(opens[i])
            if p == "await" and at(j - 1) == "for":
                role[i] = "for"
            elif p in _CONTROL and at(j - 1) != ".":
                role[i] = p
            elif decl or after == "=>" or (after == "{" and kinds[j] == "id" and p not in KEYWORDS):
                role[i] = "params"
            elif after == ":" and (c + 2) < n and owner not in ("interface", "type"):
                k = c + 2
                k = close.get(k, k) + 1 if texts[k] == "{" else k
                e = _type_end(texts, k, close, (";", "=", ",", "{", "=>", "?", ":"))
                method = owner in ("class", "object") and kinds[j] == "id"
                role[i] = "params" if at(e) == "=>" or (at(e) == "{" and method) else None
            if role.get(i) == "params":
                e, start, nm = c + 1, i, None
                if at(e) == ":":
                    k = e + 1
                    k2 = close.get(k, k) + 1 if at(k) == "{" else k
                    e = _type_end(texts, k2, close, (";", "=", ",", "{", "=>"))
                    ret[i] = slice_text(k, e)
                arrow = at(e) == "=>"
                if arrow:
                    e += 1
                    start = i - 1 if at(i - 1) == "async" else i
                    nm = name_before(j + 1)
                    what = "arrow"
                elif decl:
                    s = j if p == "function" else j - 1
                    s = s if texts[s] == "function" else s - 1
                    nm = j if p not in ("function", "*") else name_before(s)
                    what = "function" if p not in ("function", "*") else "funcexpr"
                    start = s - 1 if at(s - 1) == "async" else s
                else:
                    nm, what, start = j, "method", j
                    while at(start - 1) in ("async", "static", "get", "set", "public", "private", "protected"):
                        start -= 1
                if at(e) == "{":
                    role[e], body[start], until[start] = "fn", e, close[e]
                else:
                    until[start] = value_end(e) if arrow else c
                node[start], params[start] = what, i
                is_async[start] = "async" in texts[max(0, start - 3):i] and at(start) in ("async", "function", "static")
                if nm is not None:
                    name[start] = nm
                    if what in ("arrow", "funcexpr"):
                        fn_init.add(nm)
            elif i not in role:
                role[i] = "sig" if owner in ("interface", "type") else (
                    "call" if (kinds[j] == "id" and p not in KEYWORDS) or p in (")", "]") else "group")
                if role[i] == "call" and kinds[j] == "id":
                    node[j], until[j], params[j] = "call", c, i
        elif t == "=>" and kinds[i - 1] == "id" and at(i - 1) != ")" and i > 0:
            start = i - 2 if at(i - 2) == "async" else i - 1
            node[start], params[start] = "arrow", i - 1
            is_async[start] = at(start) == "async"
            nm = name_before(start)
            if nm is not None:
                name[start] = nm
                fn_init.add(nm)
            if at(i + 1) == "{":
                role[i + 1], body[start], until[start] = "fn", i + 1, close[i + 1]
            else:
                until[start] = value_end(i + 1)
        elif t in ("class", "interface", "enum", "type") and kinds[i] == "id" and at(i - 1) != "." and i + 1 < n \
                and kinds[i + 1] == "id" and at(i + 1) not in ("from", "extends"):
            e = i + 2
            while e < n and texts[e] not in ("{", ";", ")") and e - i < 80:
                e += 1
            if at(e) == "{":
                role[e] = t
                if t != "type":
                    node[i], name[i], body[i], until[i] = t, i + 1, e, close[e]
            if t == "type":
                eq = next((k for k in range(i + 2, min(n, i + 40)) if texts[k] == "="), None)
                if eq is not None:
                    e2 = _type_end(texts, eq + 1, close, (";",))
                    for k in range(eq + 2, e2):
                        if lines[k] > lines[k - 1] and texts[k] in _STARTERS and opens[k] == opens[i]:
                            e2 = k
                            break
                    ann[i + 1] = slice_text(eq + 1, e2)
        elif t == "{" and i not in role and kinds[i] == "op":
            p = at(i - 1)
            if p == ")":
                role[i] = "block"
            elif p in ("else", "try", "finally", "do"):
                role[i] = p
            elif p in ("import", "export") or (p == "type" and at(i - 2) in ("import", "export")) \
                    or (p == "," and at(i - 3) == "import"):
                role[i] = "names"
            elif p in ("=", "(", ",", "[", "return", "?", "&&", "||", "??", "...", "default", ":"):
                role[i] = "object"
            else:
                role[i] = "block"

    opener_of = {c: o for o, c in close.items()}
    for i in extending:  # bodies of control statements, extents of loops, switches and tries
        t = texts[i]
        if t == "{" and at(i - 1) == ")" and role.get(i) == "block":
            role[i] = role.get(opener_of.get(i - 1)) or "block"
        if kinds[i] == "id" and at(i - 1) != "." and t in ("for", "while", "do", "switch", "try", "if"):
            j = i + 1
            if at(j) == "await":
                j += 1
            if at(j) == "(":
                j = close[j] + 1
            node[i] = "loop" if t in _LOOPS else t
            if at(j) == "{":
                body[i], until[i] = j, close[j]
            else:
                until[i] = _type_end(texts, j, close, (";",))
            if t == "while" and at(j) == ";":
                del node[i]

    # Statement starts, leading comments, enclosing functions and symbols.
    stmt_of, module_of = [0] * n, {}
    current, fns, syms = {-1: None}, [], []
    enclosing_fn, sym, sym_kind = [-1] * n, [None] * n, [None] * n
    names_in = {i for i, r in role.items() if r == "names"}
    fn_end = sym_end = n  # where the innermost function and symbol end
    here_fn, here_sym, here_kind = -1, None, None
    for i, o in enumerate(opens):
        t = texts[i]
        if fn_end < i:
            while fns and fns[-1][1] < i:
                fns.pop()
            here_fn, fn_end = fns[-1] if fns else (-1, n)
        if sym_end < i:
            while syms and syms[-1][2] < i:
                syms.pop()
            here_sym, here_kind, sym_end = syms[-1] if syms else (None, None, n)
        start = current.get(o)
        if start is None or (t in _STARTERS and i and kinds[i] == "id" and lines[i] > lines[i - 1]
                             and (o == -1 or texts[o] == "{") and role.get(o) not in _UNSPLIT_ROLES):
            start = current[o] = i
        if o in names_in:
            start = current[o] = stmt_of[o]
        stmt_of[i] = start
        if t == ";" or (t == "}" and role.get(opener_of.get(i)) not in _ENDED_ROLES and texts[i + 1] not in _AFTER_BODY):
            current[o] = None
        elif t == "," and o >= 0 and role.get(o) in _LIST_ROLES:
            current[o] = None
        enclosing_fn[i] = here_fn
        if i in node:
            what = node[i]
            if what in _FN_NODES:
                fns.append((i, until[i]))
                here_fn, fn_end = fns[-1]
            if what in _NAMED_NODES or (i in name and what in ("arrow", "funcexpr") and at(name[i] - 1) in ("const", "let", "var")):
                if i in name:
                    syms.append((texts[name[i]], "function" if what in ("arrow", "funcexpr") else what, until[i]))
                    here_sym, here_kind, sym_end = syms[-1]
        if syms:
            sym[i], sym_kind[i] = here_sym, here_kind
        if t in ("from", "import") and i + 1 < n and kinds[i + 1] == "str":
            module_of[start] = texts[i + 1][1:-1]

    for i in typed:  # type annotations of parameters, members and variables
        if kinds[i] == "id" and i not in ann:
            k = i + 2 if texts[i + 1] == "?" and at(i + 2) == ":" else (i + 1 if texts[i + 1] == ":" else None)
            if k is not None and role.get(opens[i]) in ("params", "interface", "class", "type") or (
                    k is not None and at(i - 1) in ("const", "let", "var")):
                e = _type_end(texts, k + 1, close, (",", ";", "="))
                for q in range(k + 2, e):
                    if lines[q] > lines[q - 1] and role.get(opens[i]) in ("interface", "class", "type") \
                            and kinds[q] == "id" and opens[q] == opens[i] and texts[q - 1] not in ("|", "&", ":"):
                        e = q
                        break
                ann[i] = slice_text(k + 1, e)

    defaults = set()
    chain, chain_ord = {}, {}  # of names that stand after a dot; others are their own chain
    for i in linking:
        t = texts[i]
        if t == "=":  # parameters with an initialiser
            if role.get(opens[i]) == "params":
                defaults.add(stmt_of[i])
        elif i and i + 1 < n and kinds[i - 1] == "id" and kinds[i + 1] == "id":
            if texts[i - 1] != "this":
                chain[i + 1], chain_ord[i + 1] = f"{chain.get(i - 1) or texts[i - 1]}.{texts[i + 1]}", chain_ord.get(i - 1, i - 1)
            else:
                chain_ord[i + 1] = i - 1

    if jsx_ok:
        for i in range(n):
            if texts[i] == "<" and i + 1 < n and kinds[i + 1] == "id" and texts[i + 1][0].isupper() \
                    and offs[i + 1] == offs[i] + 1 and not (i and (kinds[i - 1] in ("num", "str") or at(i - 1) in (")", "]")
                                                              or (kinds[i - 1] == "id" and at(i - 1) not in KEYWORDS))):
                node[i] = "jsx"

    argc = {}
    for i, what in node.items():
        if what == "call":
            po = params[i]
            argc[i] = 0 if close[po] == po + 1 else commas.get(po, 0) + 1 - (at(close[po] - 1) == ",")
    starred = {s: [c for c in notes if c.startswith("/**")] for s, notes in comments.items()}
    ann.update((i, texts[nm]) for i, nm in name.items())
    return Cut(
        kinds, texts, lines, cols, depths, opens, stmt_of, enclosing_fn, sym, sym_kind, chain, chain_ord, role, close, module_of,
        {s: notes[-1] for s, notes in comments.items()}, {s: notes[-1] for s, notes in starred.items() if notes}, node, body, until,
        params, argc, ann, {i: ret.get(params.get(i)) for i, what in node.items() if what != "call"}, is_async, fn_init, defaults,
        [i for i in range(n) if everything or kinds[i] == "id" or texts[i] in _KEPT_OPS or i in node])


_FLAT = ("texts", "lines", "cols", "kinds", "depths", "opens", "stmt", "fn", "sym", "sym_kind")
_SOME = ("chain", "chain_ord", "role", "close", "module", "doc", "jsdoc", "node", "body", "until", "params", "argc", "ann", "ret", "is_async", "fn_init", "defaults")


def token_batch(files: list[tuple[str, str]], everything: bool = False) -> pa.RecordBatch:
    """Token rows of some files. What is known of all their tokens lies end to end and is converted once; a row looks up its own, its
    neighbours', its statement's and its bracket's by number. Strings are numbers of a dictionary until the end."""
    words = ("texts", "kinds", "sym", "sym_kind")
    flat: dict[str, list] = {x: [None if x in words else 0] * _EDGE for x in _FLAT}
    spots, values, sizes = ({x: [] for x in _SOME} for _ in range(3))  # of the few tokens that have a value
    ords, counts, bases, size = [], [], [], _EDGE
    gaps = {x: [None if x in words else 0] * _EDGE for x in _FLAT}
    for file, text in files:
        f = cut_file(file, text, everything)
        n = len(f.kinds)
        bases.append(size)
        counts.append(len(f.kept))
        ords += f.kept
        size += n + _EDGE
        del f.texts[n:]
        for x, flat_x in flat.items():
            flat_x += getattr(f, x)
            flat_x += gaps[x]
        for x, spots_x in spots.items():
            some = getattr(f, x)
            sizes[x].append(len(some))
            if some:
                spots_x += some
                if isinstance(some, dict):
                    values[x] += some.values()

    starts = np.array(bases, dtype=np.int64)
    number_of_file = np.repeat(np.arange(len(files)), counts)
    base, own = np.repeat(starts, counts), np.array(ords, dtype=np.int64)
    at = base + own
    numbers = {x: np.array(flat[x], dtype=np.int32) for x in _FLAT if x not in words}
    codes, spellings = {}, {}
    for x in words:
        coded = pa.array(flat[x], type=pa.string()).dictionary_encode()
        codes[x], spellings[x] = coded.indices.fill_null(-1).to_numpy(), coded.dictionary
    stmt, open_ = numbers["stmt"][at], numbers["opens"][at]
    places = {"ord": at, "stmt": base + stmt}

    def found(x: str, where: np.ndarray) -> np.ndarray:
        """Which of the values of the few tokens is that of a token; -1 for tokens that have none."""
        number = np.full(size, -1, dtype=np.int32)
        number[np.repeat(starts, sizes[x]) + np.array(spots[x], dtype=np.int64)] = np.arange(len(spots[x]), dtype=np.int32)
        return number[where]

    def some(x: str, where: np.ndarray, without: np.ndarray | None = None) -> pa.Array:
        """Values of the tokens ``where``; null for tokens that have none and the rows ``without``."""
        wanted = found(x, where)
        none = wanted < 0 if without is None else (wanted < 0) | without
        made = pa.array(values[x], type=_ARROW.field(x).type)
        if pa.types.is_string(made.type):
            coded = made.dictionary_encode()
            return pa.DictionaryArray.from_arrays(coded.indices.take(pa.array(wanted, mask=none)), coded.dictionary)
        return made.take(pa.array(wanted, mask=none))

    def word(x: str, where: np.ndarray) -> pa.Array:
        code = codes[x][where]
        return pa.DictionaryArray.from_arrays(pa.array(code, mask=code < 0), spellings[x])

    def spelled(words_: list[str], where: np.ndarray) -> np.ndarray:
        """Whether the tokens ``where`` are among some words."""
        is_in = np.array(pc.is_in(spellings["texts"], pa.array(words_)), dtype=bool)
        return np.append(is_in, False)[codes["texts"][where]]

    columns = {x: some(x, at) for x in ("role", "close", "node", "body", "until", "params", "argc", "ann", "ret", "is_async")}
    columns["kind"] = word("kinds", at)
    is_name = np.append(np.array(pc.equal(spellings["kinds"], "id"), dtype=bool), False)[codes["kinds"][at]]
    columns |= {"module": some("module", places["stmt"]), "doc": some("doc", places["stmt"], ~is_name), "jsdoc": some("jsdoc", places["stmt"], ~is_name)}
    columns["open_role"] = some("role", np.maximum(base + open_, 0), open_ < 0)
    columns["fn_init"], columns["has_default"] = pa.array(found("fn_init", at) >= 0), pa.array(found("defaults", places["stmt"]) >= 0)
    # A name's chain is its spelling unless it stands after a dot; the dotted ones follow the spellings in the dictionary.
    chained, linked = found("chain_ord", at), found("chain", at)
    chain_ord = np.where(chained < 0, own, np.append(np.array(values["chain_ord"], dtype=np.int64), 0)[chained]).astype(np.int32)
    code = np.where(linked < 0, np.where(is_name, codes["texts"][at], -1), linked + len(spellings["texts"])).astype(np.int32)
    spellings["chain"] = pa.concat_arrays([spellings["texts"], pa.array(values["chain"], type=pa.string())])
    columns["chain"] = pa.DictionaryArray.from_arrays(pa.array(code, mask=code < 0), spellings["chain"])
    places["chain"] = base + chain_ord
    columns |= {"ord": pa.array(own.astype(np.int32)), "stmt": pa.array(stmt), "open": pa.array(open_), "chain_ord": pa.array(chain_ord)}
    columns["file"] = pa.DictionaryArray.from_arrays(pa.array(number_of_file.astype(np.int32)), pa.array([f for f, _ in files], type=pa.string()))
    for x in ("sym", "sym_kind"):
        columns[x] = word(x, at)
    for x, y in (("depth", "depths"), ("fn", "fn")):
        columns[x] = pa.array(numbers[y][at])
    for name, of, step in (("text", "ord", 0), ("p1", "ord", -1), ("p2", "ord", -2), ("n1", "ord", 1), ("n2", "ord", 2), ("n3", "ord", 3),
                           ("s1", "stmt", 0), ("s2", "stmt", 1), ("s3", "stmt", 2)):
        columns[name] = word("texts", places[of] + step)
    for of, prefix in (("ord", ""), ("stmt", "stmt_"), ("chain", "chain_")):
        for name, x in (("line", "lines"), ("col", "cols")):
            columns[prefix + name] = pa.array(numbers[x][places[of]])
    line = numbers["lines"][at]
    columns["leads_line"] = pa.array(np.append(True, (line[1:] != line[:-1]) | (number_of_file[1:] != number_of_file[:-1]))[:len(line)])
    named = number_of_file * len(spellings["texts"]) + codes["texts"][at]
    given = is_name & (spelled(["import"], places["stmt"]) | ((open_ == -1) & spelled(BEFORE_NAMES, at - 1)))
    columns["known"] = pa.array(is_name & np.isin(named, named[given]))
    in_params = np.array(pc.fill_null(pc.equal(columns["open_role"].dictionary_decode(), "params"), False), dtype=bool)
    given = is_name & (in_params | spelled(["=>"], at + 1))
    columns["param_name"] = pa.array(is_name & np.isin(named, named[given]))
    made = [columns[f.name] for f in _ARROW]
    return pa.RecordBatch.from_arrays([x.dictionary_decode() if isinstance(x, pa.DictionaryArray) else x for x in made], schema=_ARROW)


def token_rows(file: str, text: str, everything: bool = False) -> Iterator[tuple]:
    return (tuple(row.values()) for row in token_batch([(file, text)], everything).to_pylist())


def _cutting(everything: bool):
    """Batches of (file, text) to batches of token rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in batches:
            for file, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source:
                    some.append((file, source))
                    size += len(source)
                if size >= _FLUSH_CHARS:
                    yield token_batch(some, everything)
                    some, size = [], 0
        yield token_batch(some, everything)

    return run


def tokens(files: DataFrame, path: str = "path", text: str = "text", everything: bool = False) -> DataFrame:
    """Token rows of every file. Narrow: no shuffle, files stay in their partition.

    For function, class and similar nodes ``ann`` holds the node's name; for names it holds the declared type. ``known`` marks
    the names that their file may import or declare at its top level, wherever they stand; ``param_name`` those that a parameter of their
    file may have; ``leads_line`` the first row of a line.
    """
    return files.select(path, text).mapInArrow(_cutting(everything), TOKEN_SCHEMA)


def stored_tokens(files: DataFrame, what: str, path: str = "path", text: str = "text", everything: bool = False) -> DataFrame:
    """``tokens`` as a table in the shared folder."""
    return stored_batches(files.select(path, text), _cutting(everything), TOKEN_SCHEMA, what)
