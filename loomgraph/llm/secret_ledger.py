"""Secret scans with an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its content.
The ledger, a table in a shared folder, holds the findings of each (blob, rule
version) pair scanned before.  Only pairs that it lacks are scanned, one text
for each blob, and appended; findings are then joined back to every path and
version that has the blob.

Base kinds: ``assign`` (a key word, a separator and a value of 6 or more),
``access`` (AKIA and capitals or digits, 20 or more together) and ``hex`` (24
or more lower-case hex digits); the other kinds are additions.  Spans are code
points, end exclusive, leftmost without overlap within a kind.

A ledger may hold a pair twice, if two writers scanned it at once; it counts
once.  The rule version is a digest of the patterns.

Edge cases: a null content is empty and has no spans.  Repeated rows share a
blob and each return.  A null path is a path.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, drop_stash, exists, small_batches, stash

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Further kinds, after the base ones: a literal that must be there, and the pattern.  Runs are
#: possessive and start where no such run is before, so that no text is read over and over.
MORE = (
    ("pem", b"-----BEGIN ", re.compile(rb"-----BEGIN (?:[A-Z]++ )*?PRIVATE KEY-----")),
    ("jwt", b"eyJ", re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")),
    ("github", b"gh", re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}+")),
    ("slack", b"xox", re.compile(rb"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}+")),
    ("userinfo", b"://", re.compile(rb"://[^\x00-\x20/@:]++:[^\x00-\x20/@]++@")),
)
KINDS = (*BASE, *(kind for kind, _, _ in MORE))
_SCHEME, _NOT_FIRST = b"abcdefghijklmnopqrstuvwxyz0123456789+.-", b"0123456789+.-"
#: The rules by what they say: a changed pattern is a new version by itself.
RULE_VERSION = hashlib.sha256(b"\0".join([*(p.pattern for p in (_ASSIGN, _ACCESS, _HEX)), *(p.pattern for *_, p in MORE), _SCHEME])).hexdigest()[:16]


def _with_scheme(content: bytes, found: Iterable[re.Match]) -> Iterator[tuple[int, int]]:
    """Spans from the scheme before ``://``, which is looked for backwards, as far as the last span."""
    last = 0
    for m in found:
        before = content[last : m.start()]
        scheme = before[len(before.rstrip(_SCHEME)) :].lstrip(_NOT_FIRST)
        last = m.end()
        if scheme:
            yield m.start() - len(scheme), last


def _in_points(content: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte places as code points, counted once from left to right."""
    at, points, place = 0, 0, {}
    for x in sorted({x for a, _, b in found for x in (a, b)}):
        points += len(content[at:x].decode())
        place[x], at = points, x
    return [(place[a], k, place[b]) for a, k, b in found]


def scan(content: bytes) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) of each span, sorted; code points."""
    found = []
    low = content.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(content) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in content:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(content)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(content)]
    for k, (kind, literal, pattern) in enumerate(MORE, len(BASE)):
        if literal in content:
            spans = pattern.finditer(content)
            found += [(a, k, b) for a, b in (_with_scheme(content, spans) if kind == "userinfo" else map(re.Match.span, spans))]
    found.sort()
    return found if content.isascii() else _in_points(content, found)


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_LEDGER = f"blob string, rule_version string, spans {_SPANS}"


def _scan_rows(rule_version: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t)] for t in as_bytes(batch["content"])]
            yield pa.RecordBatch.from_arrays([batch["blob"], pa.array([rule_version] * batch.num_rows, pa.string()), pa.array(spans, kind)], ["blob", "rule_version", "spans"])

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty if there is none yet.  Two writers may both have added a pair."""
    return spark.read.schema(_LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], _LEDGER)


def _spans_of(spark: SparkSession, path: str, rule_version: str) -> DataFrame:
    """blob, spans of the blobs with findings, each once."""
    return read_ledger(spark, path).where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])


def update(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans what the ledger lacks and appends it; gives path, version, blob of each row.

    ``versions``: path, version, content.  Contents move once, only those of
    one row for each unseen blob are scanned, and where no blob is unseen none
    moves at all."""
    spark = versions.sparkSession
    content = F.coalesce(F.col("content"), F.lit(""))
    named = versions.select("path", "version", "content", F.sha2(content, 256).alias("blob"))
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    # one row for each blob: the least hash of path and version, so that only keys are gathered
    row = F.xxhash64("path", "version", "blob")
    unseen = stash(named.groupBy("blob").agg(F.min(row).alias("row")).join(seen, "blob", "left_anti"), "unseen")
    if not unseen.isEmpty() or not exists(spark, ledger):
        chosen = named.withColumn("row", row).join(unseen, ["blob", "row"], "left_semi").select("blob", "content")
        small_batches(spark)
        chosen.mapInArrow(_scan_rows(rule_version), _LEDGER).dropDuplicates(["blob"]).write.mode("append").parquet(ledger)
    drop_stash(unseen)
    return named.select("path", "version", "blob")


def findings(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """path, version, blob, spans of every row; ``spans`` may be empty."""
    rows = update(versions, ledger, rule_version)
    # written, so that Spark can split a blob that very many rows have
    found = stash(_spans_of(versions.sparkSession, ledger, rule_version), "spans")
    return rows.join(found, "blob", "left").select("path", "version", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def masked(content: str, spans: list, mark: str = "[SECRET]") -> str:
    """``content`` with the union of the spans replaced."""
    out, at, end = [], 0, -1
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if a >= end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(content[at:a])
            end = b
        end = max(end, b)
    return "".join([*out, mark, content[end:]]) if spans else content


def mask(docs: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """``docs`` with all spans in ``text`` masked and ``n_chars`` counted anew.

    Only texts that have spans go through Python."""
    update(docs.select(F.col("doc_id").alias("path"), F.lit(0).alias("version"), F.col("text").alias("content")), ledger, rule_version)
    found = stash(_spans_of(docs.sparkSession, ledger, rule_version), "spans")

    @F.pandas_udf("string")
    def masked_text(text, spans):
        return text.combine(spans, lambda t, s: None if s is None else masked(t, list(s)))

    joined = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")).join(found, "blob", "left")
    part = masked_text(F.when(F.col("spans").isNotNull(), F.col("row.text")), F.col("spans"))
    joined = joined.select("row", "spans", F.coalesce(part, "row.text").alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return joined.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
