"""Text operators over documents, pages, conversations, benchmark, events and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths, text
from factloom.operators import facts, patterns, ranking
from factloom.plans import routing
from factloom.plans import vocabulary as v
from factloom.sources import configs
from factloom.session import scan, spread
from factloom.tables.registry import query

c = F.col

SEARCH_TERMS = ["license", "token", "thention", "released"]
FIELD_TERMS = ["license", "src1", "en", "under"]

SQL_DOC_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda t: length(t) > 2)"


def _bm25_sql(source: str, fields: dict[str, float], terms: list[str], key: str) -> str:
    """SQL for the fielded score: ``source`` yields the key and one token list per field."""
    union = " UNION ALL ".join(
        f"SELECT {key}, '{f}' AS field, {w} AS weight, {f} AS toks, len({f}) AS flen FROM src" for f, w in fields.items())
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""
    WITH src AS ({source}), f AS ({union}), q(term) AS (VALUES {values}),
    n AS (SELECT count(*) AS n FROM src),
    a AS (SELECT field, avg(flen) AS mean FROM f GROUP BY field),
    hit AS (
        SELECT {key}, field, weight, flen, term, sum(CASE WHEN tok = term THEN 1.0 ELSE 0.5 END) AS tf
        FROM (SELECT {key}, field, weight, flen, unnest(toks) AS tok FROM f) JOIN q
          ON starts_with(tok, term) OR starts_with(term, tok)
        GROUP BY ALL),
    d AS (SELECT term, count(DISTINCT {key}) AS df FROM hit GROUP BY term)
    SELECT {key}, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * flen / mean)) * weight), 4) AS score
    FROM hit JOIN d USING (term) JOIN a USING (field), n GROUP BY {key}"""


@query(_bm25_sql(f"SELECT doc_id, {SQL_DOC_TOKENS} AS tokens FROM documents", {"tokens": 6.0}, SEARCH_TERMS, "doc_id"))
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matching document with its score (AGG-1..4)."""
    docs = spread(scan(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.doc_tokens("text").alias("tokens"))
    return ranking.score_fielded(docs, SEARCH_TERMS, {"tokens": 6.0}).select("doc_id", F.round("score", 4).alias("score"))


_TOP = _bm25_sql(f"SELECT doc_id, {SQL_DOC_TOKENS} AS tokens FROM documents", {"tokens": 6.0}, SEARCH_TERMS, "doc_id")


@query(f"SELECT doc_id, score FROM ({_TOP}) ORDER BY score DESC, doc_id LIMIT 50")
def bm25_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The doc retriever's cut: best 50 by score (SRT-1)."""
    scored = bm25_documents(spark, sf_dir)
    return scored.orderBy(F.desc("score"), "doc_id").limit(50)


@query(_bm25_sql(f"SELECT doc_id, {SQL_DOC_TOKENS} AS body, [source] AS path, [lang] AS symbol FROM documents",
                 {"symbol": 8.0, "path": 3.0, "body": 5.0}, FIELD_TERMS, "doc_id"))
def bm25_fielded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three weighted fields: body, source and language."""
    docs = spread(scan(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select(
        "doc_id", text.doc_tokens("text").alias("body"), F.array("source").alias("path"), F.array("lang").alias("symbol"))
    scored = ranking.score_fielded(docs, FIELD_TERMS, {"symbol": 8.0, "path": 3.0, "body": 5.0})
    return scored.select("doc_id", F.round("score", 4).alias("score"))


@query(rf"""
WITH vocab AS (SELECT DISTINCT unnest({SQL_DOC_TOKENS}) AS tok FROM documents),
terms AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: length(t) > 1)) AS term FROM part)
SELECT term, tok, CASE WHEN tok = term THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight
FROM terms JOIN vocab ON starts_with(tok, term) OR starts_with(term, tok)""")
def prefix_vocab_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part name words against the document vocabulary by prefix, as equi-joins (STR-1, JN-4)."""
    vocab = spread(scan(spark, sf_dir, "documents").select("text")).select(F.explode(text.doc_tokens("text")).alias("tok")).distinct()
    terms = scan(spark, sf_dir, "part").select(F.explode(text.symbol_tokens("p_name")).alias("term")).distinct()
    return ranking.prefix_pairs(terms, vocab)


@query(f"SELECT doc_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM (SELECT doc_id, {SQL_DOC_TOKENS} AS toks FROM documents)")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(scan(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", text.doc_tokens("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(r"""
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'),
       lambda t: length(t) > 1), ' ') AS tokens
FROM (SELECT p_partkey, 'get' || upper(p_type[1]) || lower(p_type[2:]) || '_' || p_name || p_brand AS name FROM part)""")
def symbol_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat('get', upper(substring(p_type, 1, 1)), lower(substring(p_type, 2)), '_', p_name, p_brand)")
    return scan(spark, sf_dir, "part").select("p_partkey", F.array_join(text.symbol_tokens(name), " ").alias("tokens"))


_PATH = r"regexp_replace(string_split(url, '/')[-1], '(.)\.[^.]*$', '\1')"


@query(rf"""
SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace({_PATH}, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'),
       lambda t: length(t) > 1), ' ') AS path_tokens,
       array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(url), '[^a-z0-9/\s\-_]', ' ', 'g'), '[\s\-_/]+'),
       lambda t: length(t) > 1), ' ') AS route_tokens
FROM pages""")
def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path tokens and route tokens of page addresses."""
    return scan(spark, sf_dir, "pages").select(
        "page_id", F.array_join(text.path_tokens("url"), " ").alias("path_tokens"), F.array_join(text.route_tokens("url"), " ").alias("route_tokens"))


@query(r"""
SELECT event_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(event_type || '-kind_of ' || props), '[^a-z0-9\s\-_]', ' ', 'g'),
       '[\s\-_]+'), lambda t: length(t) > 1), ' ') AS tokens FROM events""")
def config_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("event_type", F.lit("-kind_of "), "props")
    return scan(spark, sf_dir, "events").select("event_id", F.array_join(text.config_tokens(body), " ").alias("tokens"))


@query(r"""
SELECT conv_id, turn, len(w) AS n_words, greatest(len(w) - 1, 0) AS n_phrases,
       md5(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), '|')) AS digest
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: length(t) > 2) AS w FROM conversations)""")
def phrase_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = text.bigram_phrases("text")
    kept = F.size(F.filter(F.split(F.lower("text"), "\\s+"), lambda t: F.length(t) > 2))
    return scan(spark, sf_dir, "conversations").select(
        "conv_id", "turn", kept.cast("long").alias("n_words"), F.size(phrases).cast("long").alias("n_phrases"),
        F.md5(F.array_join(phrases, "|")).alias("digest"))


TEXT_REGEXES = [
    {"id": "license", "pattern": r"Released under the [A-Z]+ License", "flags": "g"},
    {"id": "secret", "pattern": r'token = "[0-9a-f]+"', "flags": "gi"},
    {"id": "address", "pattern": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "flags": "g"},
]


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, regex, line, match FROM (
  SELECT doc_id, 'license' AS regex, line, unnest(regexp_extract_all(content, 'Released under the [A-Z]+ License')) AS match FROM l
  UNION ALL SELECT doc_id, 'secret', line, unnest(regexp_extract_all(content, '(?i)token = "[0-9a-f]+"')) FROM l
  UNION ALL SELECT doc_id, 'address', line, unnest(regexp_extract_all(content, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) FROM l)""")
def regex_line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regex search over whole texts with the line of each match (FLT-15)."""
    files = spread(scan(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("path"), "text"))
    return patterns.regex_hits(files, TEXT_REGEXES).select(
        c("file").cast("long").alias("doc_id"), "regex", c("line").cast("long").alias("line"), "match")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
w AS (SELECT doc_id, line, content, lag(content) OVER x AS a, lead(content) OVER x AS b FROM l WINDOW x AS (PARTITION BY doc_id ORDER BY line))
SELECT doc_id, line, trim(content) AS snippet, md5(concat_ws(chr(10), (line - 1)::VARCHAR || ': ' || a, line::VARCHAR || ': ' || content,
       (line + 1)::VARCHAR || ': ' || b)) AS context FROM w WHERE contains(content, 'License')""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines around every licence line, numbered (FX-20, WIN-2): cut from the row's own text, no window shuffle."""
    docs = spread(scan(spark, sf_dir, "documents").select("doc_id", "text").filter(F.contains("text", F.lit("License"))))
    ls = text.lines("text")
    hit = docs.select("doc_id", "text", F.posexplode(ls).alias("i", "content")).filter(F.contains("content", F.lit("License")))
    snippet, context = patterns.snippet_of(c("text"), c("i") + 1)
    return hit.select("doc_id", (c("i") + 1).cast("long").alias("line"), snippet.alias("snippet"), F.md5(context).alias("context"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, max(line) AS last_line, sum(length(content))::BIGINT AS n_chars FROM l GROUP BY doc_id""")
def file_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spread(scan(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("path"), "text"))
    return facts.file_lines(files).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line").cast("long").alias("last_line"), F.sum(F.length("content")).alias("n_chars")).select(
        c("file").cast("long").alias("doc_id"), "n_lines", "last_line", "n_chars")


@query(r"""
WITH j AS (SELECT event_id, '{"api": {"route": "/' || event_type || '/' || user_id || '", "tags": ["' || event_type || '", ' || user_id || ']}, "props": ' || props || ', "on": true, "none": null}' AS j FROM events)
SELECT event_id, 'api.route' AS key_path, '/' || (j->>'$.api.route')[2:] AS value, 'route' AS kind FROM j
UNION ALL SELECT event_id, 'api.tags.0', j->>'$.api.tags[0]', 'route' FROM j
UNION ALL SELECT event_id, 'api.tags.1', j->>'$.api.tags[1]', 'route' FROM j
UNION ALL SELECT event_id, 'props.k', j->>'$.props.k', 'config' FROM j
UNION ALL SELECT event_id, 'on', 'true', 'config' FROM j""")
def config_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of nested JSON configs wrapped around every event's props (SRC-11)."""
    docs = scan(spark, sf_dir, "events").select("event_id", F.expr(
        """concat('{"api": {"route": "/', event_type, '/', user_id, '", "tags": ["', event_type, '", ', user_id, ']}, "props": ', props, ', "on": true, "none": null}')""").alias("text"))
    return configs.json_leaves(docs).select(
        "event_id", F.array_join("key_path", ".").alias("key_path"), "value", configs.config_kind(c("key_path")).alias("kind"))


@query(r"""
SELECT event_id, 2 AS line, 'env' AS kind, 'EVENT_' || upper(event_type) AS key, 'EVENT_' || upper(event_type) || '=' || user_id AS text,
       'event ' || event_type || CASE WHEN length(user_id::VARCHAR) > 1 THEN ' ' || user_id ELSE '' END AS tokens FROM events
UNION ALL SELECT event_id, 4, 'env', 'VALUE', 'VALUE=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 'value' || CASE WHEN floor(value) > 9 THEN ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE '' END FROM events""")
def env_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY=VALUE lines of env templates written from events (SRC-12)."""
    files = scan(spark, sf_dir, "events").select(c("event_id").cast("string").alias("path"), F.expr(
        r"concat('# ', event_id, '\nEVENT_', upper(event_type), '=', user_id, '\n\n VALUE = ', cast(floor(value) as bigint), '\nplain words')").alias("text"))
    return configs.env_entries(files).select(
        c("file").cast("long").alias("event_id"), "line", "kind", F.element_at("key_path", 1).alias("key"), "text", F.array_join("tokens", " ").alias("tokens"))


@query(r"""
SELECT c_custkey, key, section, text FROM (
  SELECT c_custkey, 'build' AS key, 'scripts' AS section, 'build: tsc -p ' || lower(c_mktsegment) AS text FROM customer
  UNION ALL SELECT c_custkey, '@shop/nation' || c_nationkey, 'dependencies', 'dependencies: @shop/nation' || c_nationkey FROM customer
  UNION ALL SELECT c_custkey, lower(c_mktsegment) || '-kit', 'devDependencies', 'devDependencies: ' || lower(c_mktsegment) || '-kit' FROM customer)""")
def package_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts and dependencies of package.json texts written from customers (SRC-10)."""
    files = scan(spark, sf_dir, "customer").select(c("c_custkey").cast("string").alias("path"), F.expr(
        """concat('{"name": "c', c_custkey, '", "scripts": {"build": "tsc -p ', lower(c_mktsegment), '"}, "dependencies": {"@shop/nation', c_nationkey,
        '": "1.0.0"}, "devDependencies": {"', lower(c_mktsegment), '-kit": "^2"}}')""").alias("text"))
    return configs.package_entries(files).select(
        c("file").cast("long").alias("c_custkey"), F.element_at("key_path", 2).alias("key"), F.element_at("key_path", 1).alias("section"), "text")


@query(r"""
SELECT page_id, regexp_matches(p, '\.(ts|tsx|js|jsx|mjs|cjs)$') AND NOT regexp_matches(string_split(p, '/')[-1], '(\.d\.ts|\.min\.(js|cjs|mjs)|\.bundle\.(js|cjs|mjs)|\.map|\.lock|-lock\.json)$') AS is_code,
       regexp_matches(string_split(p, '/')[-1], '\.(spec|test|stories)\.(ts|tsx|js|jsx|mjs|cjs)$') AS is_test,
       len(list_filter(string_split(p, '/')[1:-2], lambda d: starts_with(d, '.') OR d IN ('node_modules', 'dist', 'build', 'es', 'coverage', '__pycache__', '__generated__', '__mocks__'))) > 0 AS skipped_dir,
       nullif(regexp_extract('/' || p, '/(packages|apps|libs|modules|services)/([^/]+)/', 2), '') AS package,
       CASE WHEN p LIKE '%.tsx' THEN 'tsx' WHEN p LIKE '%.jsx' THEN 'jsx' WHEN regexp_matches(p, '\.(js|mjs|cjs)$') THEN 'js' ELSE 'ts' END AS script_kind
FROM (SELECT page_id, ['packages', 'apps', 'dist', 'src', '.cache'][page_id % 5 + 1] || '/' || string_split(url, '/')[4] || '/' || string_split(url, '/')[5] || ['/a.ts', '/a.test.tsx', '/b.min.js', '/es/c.jsx', '/d.d.ts', '/e.mjs'][page_id % 6 + 1] AS p FROM pages)""")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, test, skip and package classification of paths written from page addresses (SRC-5..8, SRC-23)."""
    p = F.expr("""concat(element_at(array('packages', 'apps', 'dist', 'src', '.cache'), cast(page_id % 5 + 1 as int)), '/', element_at(split(url, '/'), 4), '/',
        element_at(split(url, '/'), 5), element_at(array('/a.ts', '/a.test.tsx', '/b.min.js', '/es/c.jsx', '/d.d.ts', '/e.mjs'), cast(page_id % 6 + 1 as int)))""")
    t = scan(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    return t.select("page_id", paths.is_code_file(c("p")).alias("is_code"), paths.is_test_file(c("p")).alias("is_test"),
                    paths.in_skipped_dir(c("p")).alias("skipped_dir"), paths.package_of(c("p")).alias("package"),
                    paths.script_kind(c("p")).alias("script_kind"))


@query(r"""
SELECT doc_id, ceil(length(text) / 3.0)::BIGINT AS tokens, substring(sha1(text), 1, 16) AS fp, floor(n_chars / -7.0 + 0.5)::BIGINT AS rounded FROM documents""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimate, fingerprint and half-up rounding (STR-2, STR-4, STR-6)."""
    return scan(spark, sf_dir, "documents").select(
        "doc_id", text.token_estimate("text").alias("tokens"), text.fingerprint("text").alias("fp"),
        text.round_half_up(c("n_chars") / F.lit(-7.0)).alias("rounded"))


@query(r"""
SELECT page_id, 'file://' || replace(replace(replace(replace(replace(replace(p, '%', '%25'), ' ', '%20'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS uri, p AS back,
       p[7:] AS rel FROM (SELECT page_id, '/root/' || replace(replace(url, '://', '/'), ':', '') || ' x' AS p FROM pages)""")
def uri_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path to URI and back, and the path relative to a root (STR-5)."""
    p = F.expr("concat('/root/', replace(replace(url, '://', '/'), ':', ''), ' x')")
    t = scan(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    uri = text.path_to_uri("p")
    return t.select("page_id", uri.alias("uri"), text.uri_to_path(uri).alias("back"), text.relative_path("p", "/root").alias("rel"))


# --- query routing -----------------------------------------------------------------------------

ROUTED_TEMPLATES = [
    "useEffect that returns a cleanup callback conditionally", "where do we validate permissions for", "where is Promise.all used in",
    "switch without default", "await inside loop for", "where is the feature flag configured for", "which env variable has API_KEY for",
    "async function without try catch near", "real implementation of the api handler for", "retry with backoff when fetch fails on",
    "setState based on previous state in useEffect", "plain words about",
]


def event_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text queries written from events."""
    options = ", ".join(f"'{t}'" for t in ROUTED_TEMPLATES)
    return scan(spark, sf_dir, "events").select(
        F.expr("concat('e', event_id)").alias("qid"),
        F.expr(f"concat(element_at(array({options}), cast(event_id % {len(ROUTED_TEMPLATES)} + 1 as int)), ' ', event_type, ' ', user_id)").alias("query"))


def routed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event queries plus every conversation turn as it stands."""
    said = scan(spark, sf_dir, "conversations").select(F.expr("concat('c', conv_id, '.', turn)").alias("qid"), c("text").alias("query"))
    return event_queries(spark, sf_dir).unionByName(said)


def _routing_sql() -> str:
    lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    fam = []
    for f in v.BEHAVIOR_FAMILIES:
        per = " + ".join(f"CASE WHEN t = '{k}' THEN 3 WHEN starts_with(t, '{k}') OR starts_with('{k}', t) THEN 1 ELSE 0 END"
                         for k in v.BEHAVIOR_FAMILIES[f]["classifier"])
        fam.append(f"coalesce(list_sum(list_transform(terms, lambda t: {per})), 0)")
    cue = lambda *ws: "(" + " OR ".join(f"list_contains(cues, '{w}')" for w in ws) + ")"
    hook = "len(list_filter(exact_ids, lambda w: regexp_matches(w, '^use[A-Z]'))) > 0"
    without, ret, trying = cue("without"), cue("return", "returns"), cue("try", "catch")
    preds = {
        "conditional": cue("conditional", "conditionally", "if"), "has_try": f"({trying} AND NOT {without})", "no_try": f"({trying} AND {without})",
        "await_loop": cue("loop", "await"), "sw": cue("switch", "default"), "no_cleanup": f"({cue('cleanup')} AND {without})",
        "ret_cleanup": f"({cue('cleanup')} AND {ret} AND NOT {without})", "ret_fn": f"({ret} AND ({cue('callback')} OR {hook}))",
    }
    any_pred = "(" + " OR ".join(preds.values()) + ")"
    preds["hook_cb"] = f"({hook} AND ({cue('callback')} OR {any_pred}))"
    n_pred = " + ".join(f"({p})::INT" for p in preds.values())
    options = lst(ROUTED_TEMPLATES)
    clean = r"regexp_replace(regexp_replace(w, '[^a-zA-Z0-9.]', '', 'g'), '\.+$', '')"
    word = lambda alts: f"regexp_matches(low, '(^|[^A-Za-z0-9_])({alts})($|[^A-Za-z0-9_])')"
    return rf"""
    WITH q AS (
      SELECT 'e' || event_id AS qid, {options}[event_id % {len(ROUTED_TEMPLATES)} + 1] || ' ' || event_type || ' ' || user_id AS query FROM events
      UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations),
    a AS (SELECT qid, query, lower(query) AS low, list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> '') AS words FROM q),
    b AS (SELECT *, list_filter(list_transform(words, lambda w: {clean}), lambda w: w <> '') AS clean,
          list_transform(words, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')) AS letters FROM a),
    d AS (SELECT *, list_distinct(list_filter(clean, lambda w: contains(w, '.') AND regexp_matches(w, '^[A-Za-z]'))) AS dotted_ids,
          list_distinct(list_filter(clean, lambda w: NOT (contains(w, '.') AND regexp_matches(w, '^[A-Za-z]')) AND NOT list_contains({lst(v.STOP_WORDS)}, lower(w))
             AND (regexp_matches(w, '^[A-Z]') OR regexp_matches(w, '^use[A-Z]') OR (regexp_matches(w, '[a-z][A-Z]') AND length(w) > 3)))) AS exact_ids,
          list_filter(letters, lambda w: list_contains({lst(v.STRUCTURAL_CUES)}, w)) AS cues FROM b),
    e AS (SELECT *, list_filter(list_transform(list_filter(words, lambda w: NOT list_contains(list_concat(exact_ids, dotted_ids), {clean})),
             lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w: length(w) >= 2 AND NOT list_contains({lst(v.STOP_WORDS)}, w)) AS nl FROM d),
    f AS (SELECT *, list_concat(nl, cues) AS terms FROM e),
    g AS (SELECT qid, low, words, len(cues) AS n_cues, (len(exact_ids) + len(dotted_ids)) * 3 AS id_score, {n_pred} AS n_pred, {' + '.join(fam)} AS behavior_score,
          len(nl) AS n_nl, {hook} AS hook FROM f),
    h AS (SELECT *, n_pred * 2 + n_cues AS structural_score FROM g)
    SELECT qid, n_cues::BIGINT AS n_cues, id_score::BIGINT AS id_score, structural_score::BIGINT AS structural_score, behavior_score::BIGINT AS behavior_score, n_nl::BIGINT AS n_terms,
      CASE WHEN id_score > 0 AND structural_score > 2 THEN 'structural' WHEN id_score > 0 AND behavior_score <= 2 THEN 'identifier'
           WHEN behavior_score > 2 AND structural_score > 2 THEN 'mixed' WHEN behavior_score > 2 THEN 'behavior' WHEN structural_score > 2 THEN 'structural' ELSE 'behavior' END AS mode,
      CASE WHEN id_score > 0 AND (structural_score > 2 OR behavior_score <= 2) THEN 'high' WHEN behavior_score > 2 AND structural_score > 2 THEN 'medium'
           WHEN behavior_score > 5 THEN 'high' WHEN behavior_score > 2 THEN 'medium' WHEN structural_score > 2 THEN 'medium' ELSE 'low' END AS mode_confidence,
      {word('route|endpoint|url|path|api|handler')} AS route_like,
      len(list_filter(words, lambda w: regexp_matches(w, '^[A-Z][A-Z0-9_]{{2,}}$') AND contains(w, '_'))) > 0 OR {word('config|env|flag|toggle|setting|variable|secret')} AS config_like,
      hook OR {word('react|component|jsx|hook')} AS react_like,
      {word('real|actual|root|implementation|where.*(handled|defined|implemented)')} AS implementation_root
    FROM h"""


@query(_routing_sql())
def query_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode, confidence and traits of every query text (Q-1..Q-6)."""
    routed = routing.route(routed_queries(spark, sf_dir))
    return routed.select(
        "qid", F.size("cues").cast("long").alias("n_cues"), c("id_score").cast("long").alias("id_score"),
        c("structural_score").cast("long").alias("structural_score"), c("behavior_score").cast("long").alias("behavior_score"),
        F.size("nl_tokens").cast("long").alias("n_terms"), "mode", "mode_confidence", "route_like", "config_like", "react_like", "implementation_root")


@query(r"""
WITH t(i, ret, rec) AS (VALUES
 (0, 'identifier,regex,structural', 'react.useeffect.conditional-cleanup'), (1, 'behavior,doc', ''), (2, 'identifier', ''), (3, 'structural', ''), (4, 'structural', ''),
 (5, 'behavior,config,doc,regex', 'config.feature-flag'), (6, 'config,identifier,regex', 'config.env-var'), (7, 'structural', ''),
 (8, 'behavior,config,doc,identifier,regex,route', 'express.route-definition,next.api-route'), (9, 'behavior,doc', ''),
 (10, 'identifier,regex,structural', 'react.useeffect.functional-state-updater'), (11, 'behavior,doc', ''))
SELECT 'e' || event_id AS qid, CASE WHEN event_type = 'error' AND i IN (3, 4, 7) THEN 'behavior,doc,structural'
       WHEN event_type = 'error' AND i = 6 THEN 'behavior,config,doc,identifier,regex' WHEN event_type = 'error' AND i IN (2, 10) THEN 'behavior,doc,' || ret ELSE ret END AS retrievers, rec AS recipes
FROM events JOIN t ON i = event_id % 12""")
def query_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrievers and recipes chosen for the templated queries (Q-8, Q-9)."""
    routed = routing.route(event_queries(spark, sf_dir))
    return routed.select("qid", F.array_join(F.array_sort("retrievers"), ",").alias("retrievers"),
                         F.array_join(F.array_sort("recipes"), ",").alias("recipes"))
