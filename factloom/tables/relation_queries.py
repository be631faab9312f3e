"""Join, aggregation, ranking and graph operators over the business tables.

The operators are the same functions the code queries use; here a symbol is a part, a use site is a line
item, a package is a nation, a diagnostic is an error event and a file is a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import diff, graph, ranking, workflows
from factloom.session import scan, spread
from factloom.sources import files as src
from factloom.streaming import incremental
from factloom.tables.registry import query

c = F.col


def part_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references to parts: package of the use is the customer's nation, of the symbol the supplier's."""
    li = scan(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    o = scan(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_custkey")
    cu = scan(spark, sf_dir, "customer").select(c("c_custkey").alias("o_custkey"), c("c_nationkey").alias("use_nation"))
    su = scan(spark, sf_dir, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("own_nation"))
    return li.join(o, "l_orderkey").join(cu, "o_custkey").join(su, "l_suppkey").select(
        c("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey", c("use_nation").alias("package"), "own_nation")


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, rank FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rank FROM lineitem) WHERE rank <= 5""")
def first_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five references per symbol by position (T-1, SRT-6, SRT-7); groups are cut to five before the shuffle."""
    li = scan(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    out = ranking.top_per_key(li, ["l_partkey"], [c("l_orderkey"), c("l_linenumber"), c("l_suppkey")], 5)
    return out.withColumn("rank", c("rank").cast("long"))


@query("""
SELECT l_partkey AS p_partkey, count(*) FILTER (c_nationkey = s_nationkey) AS same_package, count(*) FILTER (c_nationkey <> s_nationkey) AS cross_package
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def refs_by_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-package and cross-package counts per symbol (JN-11)."""
    return graph.references_by_package(part_refs(spark, sf_dir), c("own_nation"), ["p_partkey"])


@query("""
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 3 <> o_custkey % 3)""")
def unused_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols without a use in another package (JN-12): orders are symbols, their line items uses."""
    own = scan(spark, sf_dir, "orders").select("o_orderkey", (c("o_custkey") % 3).alias("package"))
    uses = scan(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"), (c("l_suppkey") % 3).alias("package"))
    return graph.unused_exports(own, uses, ["o_orderkey"]).select("o_orderkey")


@query("""
WITH w AS (SELECT DISTINCT user_id * 7 AS p_partkey FROM events), n AS (SELECT l_partkey, count(*) AS refs FROM lineitem GROUP BY 1)
SELECT w.p_partkey, p_name, coalesce(refs, 0) AS refs, p_name IS NOT NULL AS found FROM w LEFT JOIN part USING (p_partkey) LEFT JOIN n ON l_partkey = w.p_partkey""")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many lookups at once; names that do not exist stay in the result (T-15, AGG-15)."""
    wanted = scan(spark, sf_dir, "events").select((c("user_id") * 7).alias("p_partkey")).distinct()
    counts = scan(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("refs"))
    out = graph.batch_lookup(wanted, scan(spark, sf_dir, "part").select("p_partkey", "p_name"), counts, "p_partkey")
    return out.withColumn("found", c("p_name").isNotNull())


@query("""
SELECT p_partkey, refs, CASE WHEN refs > 10 THEN 'high' WHEN refs > 3 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT p_partkey, count(l_partkey) AS refs FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)""")
def risk_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference counts and risk per symbol (AGG-7). Counted before the join."""
    counts = scan(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("refs"))
    out = scan(spark, sf_dir, "part").select("p_partkey").join(counts, "p_partkey", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    return out.withColumn("risk", diff.risk_bucket(c("refs")))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(n, 0) BETWEEN o_custkey % 4 AND o_custkey % 4 + 3 AS compatible,
 CASE WHEN coalesce(n, 0) < o_custkey % 4 THEN 'Too few args: ' || coalesce(n, 0) || ' passed, ' || o_custkey % 4 || ' required'
      WHEN coalesce(n, 0) > o_custkey % 4 + 3 THEN 'Too many args: ' || n || ' passed, max ' || (o_custkey % 4 + 3) END AS issue
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def arity_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument counts against arity ranges (JN-15): lines per order against bounds from its customer."""
    n = scan(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("callee")).agg(F.count(F.lit(1)).alias("n"))
    o = scan(spark, sf_dir, "orders").select(c("o_orderkey").alias("callee"), (c("o_custkey") % 4).alias("min_args"), (c("o_custkey") % 4 + 3).alias("max_args"))
    calls = o.select("callee").join(n, "callee", "left").select("callee", F.coalesce("n", F.lit(0)).alias("arg_count"))
    return diff.call_compatibility(calls, o).select(c("callee").alias("o_orderkey"), c("arg_count").alias("n"), "compatible", "issue")


_TYPES = "['click', 'error', 'purchase', 'signup', 'view']"


@query(f"""
WITH h AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS handled FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_filter({_TYPES}, lambda t: NOT list_contains(handled, t)), ',') AS missing, len(handled) = 5 OR list_contains(handled, 'view') AS is_exhaustive FROM h""")
def handled_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types each user has, against the full set (JN-16, ARR-1)."""
    ev = scan(spark, sf_dir, "events")
    members = ev.agg(F.array_sort(F.collect_set("event_type")).alias("members")).withColumn("enum", F.lit("event"))  # one value per type
    sw = ev.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("handled")).withColumn("enum", F.lit("event")).withColumn(
        "has_default", F.array_contains("handled", "view"))
    return diff.exhaustiveness(members, sw).select("user_id", F.array_join("missing", ",").alias("missing"), "is_exhaustive")


@query("""
WITH d AS (SELECT user_id AS file, (epoch(ts)::BIGINT // 600)::INT AS line, event_id AS col, CAST(floor(value) AS INT) % 7 AS code FROM events WHERE event_type = 'error'),
t AS (SELECT event_id AS target, user_id AS file, (epoch(ts)::BIGINT // 600)::INT AS line, CASE WHEN event_id % 5 = 0 THEN 3 END AS code FROM events WHERE event_type = 'purchase'),
j AS (SELECT target, CASE WHEN t.code = d.code THEN 0 WHEN t.line = d.line THEN 1 WHEN abs(t.line - d.line) <= 2 THEN 2 ELSE 3 END AS tier,
   CASE WHEN t.code = d.code OR abs(t.line - d.line) > 2 THEN 0 ELSE abs(t.line - d.line) END AS away, d.line, d.col, d.code FROM t JOIN d USING (file)),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tier, away, line, col) AS rn FROM j)
SELECT target, tier::BIGINT AS tier, line::BIGINT AS line, col, code::VARCHAR AS code FROM r WHERE rn = 1""")
def nearest_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest error of the same user for every purchase (JN-13, JN-14): equi-joins on pre-reduced errors."""
    ev = scan(spark, sf_dir, "events").withColumn("line", F.floor(F.unix_timestamp("ts") / 600).cast("int"))
    diags = ev.filter(c("event_type") == "error").select(
        c("user_id").alias("file"), "line", c("event_id").alias("col"), F.lit(1).alias("severity"),
        (F.floor("value").cast("int") % 7).cast("string").alias("code"), F.lit("").alias("message"))
    targets = ev.filter(c("event_type") == "purchase").select(
        c("event_id").alias("target"), c("user_id").alias("file"), "line", F.when(c("event_id") % 5 == 0, "3").alias("code"))
    return workflows.pick_diagnostic(targets, diags).select(
        "target", c("tier").cast("long").alias("tier"), c("line").cast("long").alias("line"), "col", "code")


@query("""
SELECT a.role AS caller, b.role AS callee, count(*) AS calls FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY 1, 2""")
def call_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hop caller and callee counts (T-8): each turn calls the next."""
    t = scan(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    nxt = t.select("conv_id", (c("turn") - 1).alias("turn"), c("role").alias("callee"))
    edges = t.withColumnRenamed("role", "caller").join(nxt, ["conv_id", "turn"])
    return edges.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"))


def _owner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scan(spark, sf_dir, "orders").select(F.concat(F.lit("o"), c("o_orderkey")).alias("src"), F.concat(F.lit("c"), c("o_custkey")).alias("dst"))
    cu = scan(spark, sf_dir, "customer").select(F.concat(F.lit("c"), c("c_custkey")).alias("src"), F.concat(F.lit("n"), c("c_nationkey")).alias("dst"))
    n = scan(spark, sf_dir, "nation").select(F.concat(F.lit("n"), c("n_nationkey")).alias("src"), F.concat(F.lit("r"), c("n_regionkey")).alias("dst"))
    return o.unionByName(cu).unionByName(n)


@query("""
SELECT 'o' || o_orderkey AS seed, x.node, x.depth::BIGINT AS depth FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey,
 LATERAL (VALUES ('o' || o_orderkey, 0), ('c' || o_custkey, 1), ('n' || n_nationkey, 2), ('r' || n_regionkey, 3)) x(node, depth)""")
def ownership_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first walk from every order up to depth three (T-16)."""
    seeds = scan(spark, sf_dir, "orders").select(F.concat(F.lit("o"), c("o_orderkey")).alias("seed")).withColumn("node", c("seed"))
    return graph.walk(_owner_edges(spark, sf_dir), seeds, 3).withColumn("depth", c("depth").cast("long"))


@query("""
WITH n AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1), o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT 'c' || c_custkey AS seed, 3 AS nodes, 2 AS max_depth, coalesce(o.n, 0) AS direct_refs, customers AS transitive_refs,
 CASE WHEN coalesce(o.n, 0) + customers > 20 THEN 'HIGH' WHEN coalesce(o.n, 0) + customers >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM customer JOIN n USING (c_nationkey) LEFT JOIN o ON o_custkey = c_custkey""")
def impact_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by depth class for every customer, walking up to region level (T-16, AGG-9)."""
    edges = _owner_edges(spark, sf_dir)
    seeds = scan(spark, sf_dir, "customer").select(F.concat(F.lit("c"), c("c_custkey")).alias("seed")).withColumn("node", c("seed"))
    counts = edges.filter(~F.startswith("dst", F.lit("r"))).groupBy(c("dst").alias("node")).agg(F.count(F.lit(1)).alias("refs")).withColumn("is_alias", F.lit(False))
    out = graph.impact_trace(edges, seeds, counts, 3)
    return out.select("seed", c("nodes").cast("int").alias("nodes"), c("max_depth").cast("int").alias("max_depth"), "direct_refs", "transitive_refs", "severity")


@query("""
WITH RECURSIVE i AS (SELECT source, doc_id, ceil(length(text) / 3.0)::BIGINT AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT source, doc_id, rn, cost, cost <= 5000 AS taken, CASE WHEN cost <= 5000 THEN cost ELSE 0 END AS used FROM i WHERE rn = 1
 UNION ALL SELECT i.source, i.doc_id, i.rn, i.cost, f.used + i.cost <= 5000, f.used + CASE WHEN f.used + i.cost <= 5000 THEN i.cost ELSE 0 END FROM f JOIN i ON i.source = f.source AND i.rn = f.rn + 1)
SELECT source, doc_id, cost, taken FROM f""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit token budget per source in document order (WIN-4): rounds of prefix sums, no group in one task."""
    items = spread(scan(spark, sf_dir, "documents").select("source", "doc_id", "text")).select("source", "doc_id", text.token_estimate("text").alias("cost"))
    return graph.first_fit(items, ["source"], "doc_id", "cost", 5000)


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several retrievers over documents, labels and pages."""
    d = scan(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    row = lambda df, s, kind, score: df.select(
        F.lit("declaration").alias("candidate_type"), c("source").alias("file"), c("doc_id").cast("int").alias("line"), F.lit(0).alias("col"), c("lang").alias("symbol"),
        F.lit(None).cast("string").alias("matched"), c("lang").alias("name"), F.lit(kind).alias("kind"), F.lit(s).alias("src"), score.cast("long").alias("score"),
        F.array(F.lit(f"from-{s}")).alias("evidence"), F.array(F.lit(s)).alias("sources"))
    parts = [row(d, "behavior", "function", c("n_chars") % 20), row(d.filter(c("lang").isin("en", "de")), "identifier", "usage", c("n_chars") % 13),
             row(d.filter(c("n_chars") > 800), "doc", "doc", c("n_chars") % 11), row(d.filter(c("lang") == "fr"), "config", "config", c("n_chars") % 7),
             row(d.filter(c("n_chars") < 1500), "route", "function", c("n_chars") % 5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_MERGED = """
WITH m AS (SELECT doc_id, source, lang, (n_chars % 20 + CASE WHEN lang IN ('en', 'de') THEN n_chars % 13 + 3 ELSE 0 END
  + CASE WHEN n_chars > 800 THEN floor((n_chars % 11) * 0.5 + 0.5) + 2 ELSE 0 END + CASE WHEN n_chars < 1500 THEN n_chars % 5 + 3 ELSE 0 END)::BIGINT AS score,
  1 + (lang IN ('en', 'de'))::INT + (n_chars > 800)::INT + (lang = 'fr')::INT + (n_chars < 1500)::INT AS n_sources FROM documents)
"""


@query(_MERGED + "SELECT doc_id, score, n_sources::BIGINT AS n_sources FROM m")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive merge of all retrievers' rows per place (SET-1, JN-8)."""
    m = ranking.merge_candidates(_cands(spark, sf_dir))
    return m.select(c("line").cast("long").alias("doc_id"), "score", F.size("sources").cast("long").alias("n_sources"))


@query(_MERGED + """, k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY source, doc_id // 3, lang) AS n FROM m WINDOW w AS (PARTITION BY source, doc_id // 3, lang ORDER BY score DESC, doc_id))
SELECT source, doc_id // 3 * 3 AS bucket, lang, max(score + 2 * (n - i + CASE WHEN i > 1 THEN 1 ELSE 0 END))::BIGINT AS score, count(*) AS folded FROM k GROUP BY 1, 2, 3""")
def coalesce_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one symbol in a three-line bucket folded into one (SET-2)."""
    out = ranking.coalesce_candidates(ranking.merge_candidates(_cands(spark, sf_dir)))
    return out.select(c("file").alias("source"), (F.floor(c("line") / 3) * 3).cast("long").alias("bucket"), c("name").alias("lang"), "score", "folded")


@query(_MERGED + """SELECT doc_id, score + CASE WHEN n_sources >= 3 THEN 3 ELSE 0 END - pen AS score FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 10 WHEN 2 THEN 4 ELSE 0 END AS pen FROM m)
WHERE score + CASE WHEN n_sources >= 3 THEN 3 ELSE 0 END - pen > 0""")
def rank_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path penalties, multi-source bonus and the positive-score filter (Q-12, FLT-16, FLT-17)."""
    m = ranking.merge_candidates(_cands(spark, sf_dir))
    folder = F.element_at(F.array(F.lit("src/a.test.ts"), F.lit("generated/a.ts"), F.lit("demo/a.ts"), F.lit("src/a.ts")), c("line") % 4 + 1)
    return ranking.rank_candidates(m.withColumn("file", F.concat(F.lit("lib/"), "file", F.lit("/"), folder))).select(c("line").cast("long").alias("doc_id"), "score")


@query(_MERGED + """, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM m)
SELECT source, doc_id, score, CASE WHEN n_sources > 1 THEN 'high' ELSE 'medium' END AS confidence FROM t WHERE rank = 1""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of the best row per source (Q-13)."""
    top = ranking.top_per_key(ranking.merge_candidates(_cands(spark, sf_dir)), ["file"], [F.desc("score"), c("line")], 1)
    return top.select(c("file").alias("source"), c("line").cast("long").alias("doc_id"), "score", ranking.confidence(
        F.lit(1), c("score"), c("sources"), c("evidence"), F.lit("medium")).alias("confidence"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'removed' WHEN doc_id % 10 = 1 THEN 'modified' ELSE 'added' END AS status FROM
 (SELECT doc_id FROM documents WHERE doc_id % 10 IN (0, 1) UNION ALL SELECT doc_id + 10000000 + 5 - doc_id % 10 FROM documents WHERE doc_id % 10 = 2)""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and modified documents between two snapshots by content hash (SRC-17, JN-18)."""
    base = scan(spark, sf_dir, "documents").select(c("doc_id").alias("path"), "text")
    head = base.filter(c("path") % 10 != 0).withColumn("text", F.when(c("path") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(c("text")))
    new = base.filter(c("path") % 10 == 2).withColumn("path", c("path") + 10000000 + 5 - c("path") % 10)
    return src.changed_files(base, head.unionByName(new)).select(c("path").alias("doc_id"), "status")


@query("""
SELECT doc_id, length(CASE WHEN toxic = 1 THEN text || 'xy' ELSE text END) AS n, l.doc_id IS NOT NULL AND CASE WHEN toxic = 1 THEN true ELSE false END AS dirty
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def overlay_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsaved buffers over stored text (JN-17, SVC-6)."""
    d = scan(spark, sf_dir, "documents").select(c("doc_id").alias("path"), "text")
    lab = scan(spark, sf_dir, "labels").select(c("doc_id").alias("path"), "toxic")
    buffers = d.join(lab, "path").select("path", F.when(c("toxic") == 1, F.concat("text", F.lit("xy"))).otherwise(c("text")).alias("text"))
    return src.with_overlay(d, buffers).select(c("path").alias("doc_id"), F.length("text").cast("long").alias("n"), "dirty")


@query("""
SELECT doc_id, max(rn)::BIGINT AS last_line, string_agg(k, ',' ORDER BY k) AS kinds FROM (SELECT doc_id, unnest(['function', 'class']) AS k, unnest([n_chars % 100, n_chars % 50]) AS rn FROM documents) GROUP BY 1""")
def kinds_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts folded per file with a sorted listing (AGG-6, AGG-13)."""
    d = scan(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(
        F.struct(F.lit("function").alias("k"), (c("n_chars") % 100).alias("rn")), F.struct(F.lit("class").alias("k"), (c("n_chars") % 50).alias("rn")))).alias("s"))
    return d.groupBy("doc_id").agg(F.max("s.rn").alias("last_line"), F.array_join(F.array_sort(F.collect_set("s.k")), ",").alias("kinds"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts)::TIMESTAMP AS ts, count(*) AS versions FROM events GROUP BY 1""")
def incremental_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row per key, the state an incremental index keeps (STM-1, STM-3); combined map-side."""
    ev = scan(spark, sf_dir, "events")
    out = incremental.latest_per_key(ev, ["user_id"], F.struct("ts", "event_id"), ["event_type", "ts"])
    return out.select("user_id", "event_type", "ts", "versions")


@query("""
WITH t AS (SELECT event_id, ['string', 'string | number', 'number', 'boolean', 'string|null|number'][event_id % 5 + 1] AS a, ['string', 'number | string', 'string'][event_id % 3 + 1] AS b FROM events),
p AS (SELECT *, list_transform(string_split(a, '|'), lambda x: trim(x)) AS pa, list_transform(string_split(b, '|'), lambda x: trim(x)) AS pb FROM t),
s AS (SELECT *, len(list_filter(pa, lambda x: NOT list_contains(pb, x))) = 0 AS a_in_b, len(list_filter(pb, lambda x: NOT list_contains(pa, x))) = 0 AS b_in_a FROM p)
SELECT event_id, CASE WHEN a_in_b AND b_in_a THEN 'equivalent' WHEN b_in_a THEN 'narrowing' WHEN a_in_b THEN 'widening' ELSE 'incompatible' END AS change FROM s""")
def type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union type changes (D-5)."""
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (c("event_id") % n + 1).cast("int"))
    return scan(spark, sf_dir, "events").select("event_id", diff.type_change(
        pick(["string", "string | number", "number", "boolean", "string|null|number"], 5), pick(["string", "number | string", "string"], 3)).alias("change"))


@query("""
WITH h AS (SELECT event_id, user_id AS file, floor(value * 10)::BIGINT % 400 + 1 AS s, floor(value * 10)::BIGINT % 400 + 1 + event_id % 4 AS e FROM events WHERE event_type = 'click'),
r AS (SELECT user_id AS file, 'big' AS name, 1 AS s, 300 AS e FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT user_id, 'mid', 50, 150 FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT user_id, 'small', 100, 110 FROM (SELECT DISTINCT user_id FROM events)),
l AS (SELECT file, s AS start_line, unnest(range(s, e + 1)) AS l FROM h),
j AS (SELECT l.file, start_line, l, name, row_number() OVER (PARTITION BY l.file, start_line, l ORDER BY r.e - r.s) AS rn FROM l JOIN r ON l.file = r.file AND l BETWEEN r.s AND r.e)
SELECT DISTINCT file, start_line, name FROM j WHERE rn = 1""")
def hunk_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Innermost range of every changed line (JN-9): bucketed interval join."""
    ev = scan(spark, sf_dir, "events")
    start = (F.floor(c("value") * 10).cast("long") % 400 + 1).cast("int")
    hunks = ev.filter(c("event_type") == "click").select(c("user_id").alias("file"), start.alias("start_line"), (start + (c("event_id") % 4).cast("int")).alias("end_line"))
    ranges = ev.select(c("user_id").alias("file")).distinct().select("file", F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit("function").alias("kind"), F.lit(s).alias("line"), F.lit(e).alias("end_line")) for n, s, e in (("big", 1, 300), ("mid", 50, 150), ("small", 100, 110))])))
    return diff.hunk_symbols(hunks, ranges).select("file", c("start_line").cast("long").alias("start_line"), "name").distinct()
