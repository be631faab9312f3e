"""The registered queries of the subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import (
    bpe,
    fingerprints,
    importance,
    lm_score,
    mixing,
    near_dup,
    quality_rules,
    secret_scan,
    subword_classifier,
    token_counts,
    toxicity,
    vector_codes,
    vector_dedup,
)
from factloom.session import scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNT_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(scan(spark, sf_dir, "documents"), public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(scan(spark, sf_dir, "documents"), public_tokenizers.path(COUNT_FILE), public_tokenizers.PATTERN, TOKEN_LIMIT)


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(scan(spark, sf_dir, "documents"))


ORACLES["op2_minhash_near_dedup"] = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS s FROM toks)),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = d.doc_id LEFT JOIN size USING (doc_id)"""


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(scan(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels"))


_GRID = ", ".join(map(str, quality_rules.GRID))
_WORST = "greatest(" + ", ".join(f"{e} / {quality_rules.UNITS[r]}::DOUBLE" for r, e in quality_rules.RULES.items()) + ")"
_BAND = " + ".join(f"(n_words >= {b})::INT" for b in quality_rules.BANDS)
_A = quality_rules.FALSE_REJECTION
ORACLES["op4_quality_rules"] = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM t, unnest(range(1, len(w) - 1)) AS u(p)),
hit AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM hit, unnest([0, 1, 2]) AS v(k) GROUP BY doc_id),
m AS MATERIALIZED (SELECT t.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))
    - len(list_distinct(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_capitals,
  length(regexp_replace(x, '[^!]', '', 'g')) AS n_exclamations FROM t LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_BAND} AS stratum FROM m),
good AS (SELECT DISTINCT stratum, x, {_WORST} AS worst FROM b JOIN t USING (doc_id) JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)
  WHERE quality = 1 AND NOT base_failed),
tested AS (SELECT stratum, cutoff, count(*) AS n, count(*) FILTER (worst > cutoff) AS k FROM good, unnest([{_GRID}]) AS g(cutoff) GROUP BY ALL),
cuts AS (SELECT stratum, min(cutoff) AS cutoff FROM tested WHERE k < n * {_A} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1)
  - lgamma(n - i + 1) + i * ln({_A}) + (n - i) * ln(1 - {_A})))) <= {quality_rules.ERROR} / {len(quality_rules.BANDS) + 1} GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({_WORST} > c.cutoff, false) AS kept
FROM b LEFT JOIN cuts c USING (stratum)"""


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(scan(spark, sf_dir, "documents"))


@query
def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(scan(spark, sf_dir, "documents"))


ORACLES["op7_temperature_mixing"] = rf"""
WITH RECURSIVE c AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
  md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS MATERIALIZED (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM c GROUP BY source HAVING sum(n_tokens) > 0),
x AS (SELECT max(tokens) AS most, min(tokens) AS least, count(*) AS k FROM s),
p AS (SELECT list(ln(tokens) - ln(most)) AS l, any_value(k) AS k FROM s, x),
bis AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, ln(list_sum(list_transform(l, lambda v: exp((lo + hi) / 2 * v))))
      - (lo + hi) / 2 * list_sum(list_transform(l, lambda v: exp((lo + hi) / 2 * v) * v)) / list_sum(list_transform(l, lambda v: exp((lo + hi) / 2 * v)))
      >= {mixing.TARGET_ENTROPY} * ln(k) AS ok FROM bis, p WHERE i < 40)),
t AS (SELECT CASE WHEN most = least THEN 1.0 ELSE greatest(0.0, 1 - ln({mixing.REPETITION_LIMIT}) / ln(most / least),
  (SELECT CASE WHEN ln(list_sum(list_transform(l, lambda v: exp(v)))) - list_sum(list_transform(l, lambda v: exp(v) * v)) / list_sum(list_transform(l, lambda v: exp(v)))
     >= {mixing.TARGET_ENTROPY} * ln(k) THEN 1.0 ELSE (SELECT max(lo) FROM bis) END FROM p)) END AS t, most FROM x),
plan AS (SELECT source, tokens, floor(tokens ** t * most ** (1 - t) / tokens + 1e-9)::BIGINT AS epochs, tokens ** t * most ** (1 - t) AS granted FROM s, t),
part AS (SELECT c.*, coalesce(epochs, 1) AS epochs, coalesce(granted - epochs * tokens, 0) AS rest,
  sum(n_tokens) OVER (PARTITION BY c.source ORDER BY key) - n_tokens AS before FROM c LEFT JOIN plan ON c.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, source, n_tokens, e AS epoch, substr(md5('{mixing.SEED}:' || e || ':' || coalesce(doc_id::VARCHAR, '')), 1, {mixing.BLOCK_DIGITS}) AS block
FROM part, unnest(range(0, epochs + (before < rest)::INT)) AS u(e)"""


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(scan(spark, sf_dir, "documents"))


_D = lm_score.DISCOUNT
#: crc32 of a doc_id, from the table of the eight-fold shift of the polynomial; DuckDB has no crc32 of its own.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
  lambda crc, b: xor(crc >> 8, list_reduce(list_prepend(xor(crc, b) & 255, list_transform(range(0, 8), lambda j: j::BIGINT)),
    lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""
ORACLES["op8_lm_score"] = rf"""
WITH t AS MATERIALIZED (SELECT doc_id, xor({_CRC}, 4294967295::BIGINT) % 5 = 1 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS w FROM documents),
tok AS MATERIALIZED (SELECT doc_id, held_out, w[i] AS w, CASE WHEN i = 1 THEN ' begin' ELSE w[i - 1] END AS h FROM t, unnest(range(1, len(w) + 1)) AS u(i)),
u AS MATERIALIZED (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
a AS (SELECT sum(c)::BIGINT AS n, count(*) AS v, sum(c) FILTER (w = ' end') AS texts FROM u),
arc AS MATERIALIZED (SELECT h, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY h, w HAVING count(*) >= {lm_score.ARC_LEAST}),
est AS MATERIALIZED (SELECT arc.h, arc.w, (arc.c - {_D}) / coalesce(hu.c, texts) AS p, (wu.c + 0.5) / (n + 0.5 * (v + 1)) AS q
  FROM arc JOIN u wu ON wu.w = arc.w LEFT JOIN u hu ON hu.w = arc.h, a),
fail AS (SELECT h, log10(greatest(1 - sum(p), 1e-12) / greatest(1 - sum(q), 1e-12)) AS f FROM est GROUP BY h)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(u.c) AS n_known, any_value(n) AS train_tokens,
  round(sum(log10((coalesce(u.c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 9) AS base_score,
  round(sum(coalesce(log10(e.p), coalesce(f, 0) + log10((coalesce(u.c, 0) + 0.5) / (n + 0.5 * (v + 1))))), 9) AS score
FROM tok LEFT JOIN u USING (w) LEFT JOIN est e ON e.h = tok.h AND e.w = tok.w LEFT JOIN fail ON fail.h = tok.h, a GROUP BY doc_id"""


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_classifier.quality_scores(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels"))


@query
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(scan(spark, sf_dir, "embeddings"))


_FINITE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
ORACLES["op11_embedding_near_dedup"] = rf"""
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= {vector_dedup.LIKE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT e.vec_id, coalesce(n, 0) AS n_links, m AS component_id, e.vec_id = m AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = e.vec_id
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)"""


@query
def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(scan(spark, sf_dir, "embeddings"))


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """Each round is a table of assignments and one of codebooks."""
    near = """near{k} AS MATERIALIZED (SELECT vec_id, part, c, entry, d FROM (SELECT vec_id, p.part, p.c, entry,
  list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - book.c[i]) * (p.c[i] - book.c[i])))::BIGINT AS d
  FROM p JOIN book{k} book USING (part)) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""
    book = """book{k} AS MATERIALIZED (SELECT part, entry, coalesce(m, o.c) AS c FROM book{j} o LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS m FROM (
  SELECT part, entry, i, floor(sum(c[i])::DOUBLE / count(*))::BIGINT AS v FROM near{j}, unnest(range(1, len(c) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL) USING (part, entry))"""
    steps = [near.format(k=0)]
    for k in range(1, rounds + 1):
        steps += [book.format(k=k, j=k - 1), near.format(k=k)]
    steps = ",\n".join(steps)
    return rf"""
WITH q AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({scale} * x)::BIGINT) AS c FROM embeddings WHERE embedding IS NOT NULL AND {_FINITE}),
p AS MATERIALIZED (SELECT vec_id, part, c[part * (len(c) // {parts}) + 1:(part + 1) * (len(c) // {parts})] AS c FROM q, unnest(range(0, {parts})) AS u(part)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, c FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}),
{steps},
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS s FROM book{rounds}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded JOIN q USING (vec_id), digest"""


ORACLES["op12_vector_code_compression"] = _codes_sql()


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "benchmark"))


_B = importance.BUCKETS
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BYTES = "list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)"
_WORD_CRC = _CRC[_CRC.index("lambda crc"):]
ORACLES["op13_importance_resampling"] = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
h AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), {_WORD_CRC}, 4294967295::BIGINT) % {_B} AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN h USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN h USING (w) GROUP BY bucket),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::BIGINT AS s_all, coalesce((SELECT sum(t) FROM t), 0)::BIGINT AS t_all),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + {_B}))::DOUBLE / ((coalesce(s, 0) + 1) * (t_all + {_B}))::DOUBLE))::BIGINT AS g
  FROM (SELECT DISTINCT bucket FROM h) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), a),
w AS (SELECT r, sum(n * g)::BIGINT AS weight FROM dw JOIN h USING (w) JOIN gain USING (bucket) GROUP BY r),
x AS MATERIALIZED (SELECT r, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((
  ('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS fit FROM x WHERE n_features >= {importance.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, rank FROM x LEFT JOIN (SELECT r, rank FROM o WHERE rank <= fit * {importance.PERCENT} // 100) USING (r)"""
