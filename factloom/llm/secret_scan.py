"""Secret scans with corpus-wide ownership frequency.

Each text is searched once for three base kinds and for other long mixed strings. The candidates' hashes are aggregated over
the whole corpus by distinct repositories and owners: a value that MANY_OWNERS owners or more have is a widely copied example;
a value of fewer owners looks live. Long mixed strings of the second sort are added to the base spans; base spans all stay.
Every aggregate over a value combines on the map side first, so that a value in a third of all rows is no hot group.

Here the owner is the source of a document and a repository is a source and a language. Spans are of whole matches, in code
points, the end exclusive. Defined cases: a null or empty text has no spans and the digest of the empty string; a null owner
counts as one owner, a null language as one language; rows that repeat an id are searched each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import chunks
from factloom.session import stored

KINDS = ["assign", "access", "hex", "mixed"]
MANY_OWNERS = 3
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_DIGIT = re.compile(r"[0-9]")
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())])


def _value(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, place of the kind, end, hash of the value) of the base spans and of other long mixed strings, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), _value(m[2])) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), _value(m[0])) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _DIGIT.search(text):
        found += [(m.start(), 2, m.end(), _value(m[0])) for m in _HEX.finditer(text)]
        taken = sorted((s, e) for s, _, e, _ in found)
        at = 0
        for m in _MIXED.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            clear = all(s >= m.end() or e <= m.start() for s, e in taken[at:at + 3])
            if clear and all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]")):
                found.append((m.start(), 3, m.end(), _value(m[0])))
    elif _HEX.search(text):
        found += [(m.start(), 2, m.end(), _value(m[0])) for m in _HEX.finditer(text)]
    return sorted(found)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", part_col: str = "lang") -> DataFrame:
    """doc_id, owner, repository, spans: the candidates of each row; one pass, no shuffle. A table without one of the columns has one owner or one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            spans = [[dict(zip(("start", "kind", "end", "value"), s, strict=True)) for s in candidates(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(spans, pa.list_(_SPAN))],
                                             ["doc_id", "owner", "repository", "spans"])

    column = lambda name: F.coalesce(docs[name].cast("string"), F.lit("")) if name in docs.columns else F.lit("")
    owner = column(owner_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), owner.alias("owner"),
                       F.concat_ws("/", owner, column(part_col)).alias("repository"))
    return rows.mapInArrow(run, "doc_id long, owner string, repository string, spans array<struct<start: long, kind: int, end: long, value: long>>")


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories: how many distinct ones have the value anywhere in the corpus."""
    seen = found.select(F.explode("spans.value").alias("value"), "owner", "repository").distinct()
    by_owner = seen.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def _listed(spans, kinds: int | None = None):
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"] < kinds)
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def scan_secrets(docs: DataFrame, many_owners: int = MANY_OWNERS, **columns: str) -> DataFrame:
    """doc_id, counts by base kind, base_sha256, spans (base and added), n_live and live_spans (not widely copied) of each row."""
    found = stored(findings(docs, **columns).withColumn("row", F.monotonically_increasing_id()), "findings")
    verdicts = ownership(found).select("value", (F.col("owners") < many_owners).alias("live"))
    marked = found.select("row", F.explode("spans").alias("span")).withColumn("value", F.col("span.value")).join(verdicts, "value").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("span.start", "span.kind", "span.end", "live"))).alias("marked"))
    rows = found.select("row", "doc_id").join(marked, "row", "left").withColumn(
        "marked", F.coalesce("marked", F.array().cast("array<struct<start: bigint, kind: int, end: bigint, live: boolean>>")))
    kept = F.filter("marked", lambda s: (s["kind"] < 3) | s["live"])
    count = {f"n_{k}": F.size(F.filter("marked", _of_kind(i))).cast("long") for i, k in enumerate(KINDS[:3])}
    live = F.filter("marked", lambda s: s["live"])
    return rows.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(_listed(F.col("marked"), 3), 256).alias("base_sha256"),
                       _listed(kept).alias("spans"), F.size(live).cast("long").alias("n_live"), _listed(live).alias("live_spans"))


def redacted(text: str, examples: set[int]) -> str:
    """The text with each span that is no widely copied example replaced by its kind in brackets; overlapping spans go together."""
    out, at = [], 0
    for start, kind, end, value in candidates(text):
        if value in examples or end <= at:
            continue
        out += [text[at:start], f"[{KINDS[kind]}]"] if start >= at else []
        at = end
    return "".join([*out, text[at:]])


def redact_live(docs: DataFrame, many_owners: int = MANY_OWNERS, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", **columns: str) -> DataFrame:
    """The rows with live-looking secrets replaced in the text and its size adjusted; all columns stay, other rows unchanged."""
    found = stored(findings(docs, id_col, text_col, **columns), "findings")
    common = ownership(found).filter(F.col("owners") >= many_owners).select("value")
    examples = found.select("doc_id", F.explode("spans.value").alias("value")).join(common, "value", "left_semi").groupBy(
        F.col("doc_id").alias("_id")).agg(F.collect_set("value").alias("_examples"))
    names = docs.columns
    text_at, size_at = names.index(text_col), names.index(size_col) if size_col in names else -1
    packed = docs.select(docs[id_col].cast("long").alias("key"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, f"c{text_at}"):
            columns = batch.columns[:-1]
            texts = batch.column(text_at).to_pylist()
            known = batch.column(batch.num_columns - 1).to_pylist()
            new = [t if t is None else redacted(t, set(k or ())) for t, k in zip(texts, known, strict=True)]
            changed = np.array([a != b for a, b in zip(texts, new, strict=True)], bool)
            if changed.any():
                columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
                if size_at >= 0:
                    sizes = [len(t) if c else s for t, c, s in zip(new, changed, batch.column(size_at).to_pylist(), strict=True)]
                    columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = packed.join(examples, F.col("key").eqNullSafe(F.col("_id")), "left").select("row.*", "_examples")
    return joined.mapInArrow(run, docs.schema)
