"""Tokenizers and string helpers as Column builders.

The five tokenizers differ on purpose: symbols split camel case, docs keep words of three letters
and more, configs also split on ``-`` and ``_``, routes also on ``/``, queries keep letters only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the tokenizers.
CAMEL_BOUNDARY = "([a-z])([A-Z])"
SYMBOL_SPLIT = "[^a-zA-Z0-9]+"
DOC_STRIP = "[^a-z0-9\\s]"
CONFIG_STRIP = "[^a-z0-9\\s\\-_]"
CONFIG_SPLIT = "[\\s\\-_]+"
ROUTE_STRIP = "[^a-z0-9/\\s\\-_]"
ROUTE_SPLIT = "[\\s\\-_/]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _longer_than(tokens: Column, n: int) -> Column:
    return F.filter(tokens, lambda t: F.length(t) > n)


def split_camel(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), CAMEL_BOUNDARY, "$1 $2")


def symbol_tokens(c: Column | str) -> Column:
    """camelCase, PascalCase and snake_case parts of a name, two letters and longer."""
    return _longer_than(F.split(F.lower(split_camel(c)), SYMBOL_SPLIT), 1)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def path_tokens(path: Column | str) -> Column:
    """Symbol tokens of the file name without its last extension."""
    return symbol_tokens(F.regexp_replace(base_name(path), "(?<=.)\\.[^.]*$", ""))


def doc_tokens(c: Column | str) -> Column:
    return _longer_than(F.split(F.regexp_replace(F.lower(_col(c)), DOC_STRIP, " "), "\\s+"), 2)


def config_tokens(c: Column | str) -> Column:
    return _longer_than(F.split(F.regexp_replace(F.lower(_col(c)), CONFIG_STRIP, " "), CONFIG_SPLIT), 1)


def route_tokens(c: Column | str) -> Column:
    return _longer_than(F.split(F.regexp_replace(F.lower(_col(c)), ROUTE_STRIP, " "), ROUTE_SPLIT), 1)


def attached_symbol_tokens(c: Column | str) -> Column:
    """Camel-split words of the symbol a doc hangs on; no length filter."""
    return F.split(F.lower(split_camel(c)), "\\s+")


def words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), "\\s+"), lambda w: w != "")


def bigram_phrases(c: Column | str) -> Column:
    """Neighbouring word pairs after dropping words of one or two letters."""
    return _bigrams(_longer_than(F.split(F.lower(_col(c)), "\\s+"), 2))


def _bigrams(ws: Column) -> Column:
    left = F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0)))
    right = F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))


def prefix_overlap(a: Column, b: Column) -> Column:
    """Equal, or one string starts the other."""
    return F.startswith(a, b) | F.startswith(b, a)


def round_half_up(c: Column) -> Column:
    """Round to the nearest integer, ties toward plus infinity."""
    return F.floor(c + F.lit(0.5)).cast("long")


def token_estimate(c: Column | str) -> Column:
    return F.ceil(F.length(_col(c)) / F.lit(3.0)).cast("long")


def fingerprint(c: Column | str, n: int = 16) -> Column:
    return F.substring(F.sha1(_col(c).cast("binary")), 1, n)


def lines(c: Column | str) -> Column:
    return F.split(_col(c), "\n", -1)


def strip_comment_markers(c: Column | str) -> Column:
    out = F.regexp_replace(_col(c), "^/\\*\\*?\\s*|\\s*\\*/$", "")
    out = F.regexp_replace(out, "(?m)^\\s*//\\s*", "")
    return F.trim(F.regexp_replace(out, "(?m)^\\s*\\*\\s?", ""))


def path_to_uri(path: Column | str) -> Column:
    parts = F.transform(F.split(_col(path), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit("file://"), F.array_join(parts, "/"))


def uri_to_path(uri: Column | str) -> Column:
    raw = F.regexp_replace(_col(uri), "^file://", "")
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def relative_path(path: Column | str, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    p = _col(path)
    return F.when(F.startswith(p, F.lit(prefix)), F.substring(p, len(prefix) + 1, 1 << 30)).otherwise(p)
