"""Personal data: patterns, and the terms that give it away.

Base kinds are found by pattern: ``email``, ``ip``, ``card`` (Luhn) and ``phone``.
Each value found is a protected entity.  How strongly a term reveals an entity is
estimated from all documents: with p as shares of documents, the pointwise mutual
information log(p(term, entity) / (p(term) p(entity))) over the information of
the entity, -log p(entity), is 1 for a term that never occurs without it and 0 for
one that occurs as if there were no entity.  In documents that hold the entity,
terms of its surroundings at ``generalise`` or more become their class (a name, a
number, a word), at ``remove`` or more they go.

1. Words within ``reach`` of an entity are counted with it, in how many documents.
   Pairs in fewer than ``least`` documents are no evidence.
2. The documents that hold the terms of the pairs left are counted, in slices of
   the terms that are broadcast and bounded by ``most``.
3. Terms that reveal an entity are looked up around it, again in bounded slices.

Spans are code points, end exclusive, leftmost and without overlap within a base
kind.  The added kinds ``generalise`` and ``remove`` follow the base kinds.

Edge cases: a null text is empty and has no spans.  Repeated rows and copies are
documents of their own each, in the counts as well.  A null id is an id.  Further
columns are ignored, or kept by ``sanitised``.  No rows, no spans.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import small_batches, stash, with_small

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalise", "remove")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive and from the start of a run on, so that no run is read over and over
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"\w+")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    """From each @ back over what may stand before it, not into the last one found."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at - (len(before := text[max(end, text.rfind("@", 0, at) + 1) : at]) - len(before.rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each base kind, in order."""
    emails = list(_emails(text))
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))] if text.count(".") >= 3 else []
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NO_DIGIT.sub("", m.group())) <= 19 and _luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return [emails, ips, cards, phones]


def _entity(text: str, kind: int, span: Span) -> str:
    value = text[span[0] : span[1]]
    return f"{BASE[kind]}:{value.lower() if kind < 2 else _NO_DIGIT.sub('', value)}"


def surroundings(text: str, found: list[list[Span]], reach: int) -> Iterator[tuple[str, list[tuple[str, Span]]]]:
    """Each entity, and the terms (in lower case) with their spans among the
    ``reach`` words on each side of it that belong to no entity."""
    if not any(found):
        return
    words = [m.span() for m in _TERM.finditer(text)]
    taken = sorted(s for kind in found for s in kind)
    starts = [a for a, _ in taken]
    longest = max(b - a for a, b in taken)

    def free(word: Span) -> bool:
        k = bisect.bisect_left(starts, word[1]) - 1
        while k >= 0 and taken[k][0] > word[0] - longest:
            if taken[k][1] > word[0]:
                return False
            k -= 1
        return True

    firsts = [a for a, _ in words]
    for kind, spans in enumerate(found):
        for a, b in spans:
            left, right = bisect.bisect_left(firsts, a), bisect.bisect_left(firsts, b)
            near = [w for w in words[max(0, left - reach) : left] + words[right : right + reach] if free(w)]
            yield _entity(text, kind, (a, b)), [(text[x:y].lower(), (x, y)) for x, y in near]


def _pairs(reach: int):
    """entity, term, n: in how many documents; a null term counts the entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"].to_pylist():
                seen = set()
                for entity, near in surroundings(text or "", base_spans(text or ""), reach):
                    seen.add((entity, None))
                    seen.update((entity, term) for term, _ in near)
                counts.update(seen)
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["entity", "term", "n"])

    return run


def _holding(terms):
    """term, n: in how many documents it is, of broadcast ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"].to_pylist():
                counts.update(terms.value.intersection(_TERM.findall((text or "").lower())))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])

    return run


def _slices(rows: DataFrame, key: str, most: int) -> list[DataFrame]:
    """``rows`` in as few parts as keep each at ``most`` or so, by a hash of ``key``."""
    n = math.ceil(rows.count() / most)
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) if n > 1 else rows for k in range(n)]


def disclosures(texts: DataFrame, reach: int, least: int, floor: float, most: int) -> DataFrame:
    """entity, term, share of the pairs whose share of the entity's information
    is ``floor`` or more; a written table."""
    spark = texts.sparkSession
    counts = texts.mapInArrow(_pairs(reach), "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n"))
    counts = stash(counts.where(F.col("n") >= least), "pairs")
    joint, alone = counts.where("term is not null"), counts.where("term is null").select("entity", F.col("n").alias("n_entity"))
    terms = joint.select("term").distinct()
    held = None
    for part in _slices(terms, "term", most):
        few = spark.sparkContext.broadcast(frozenset(r.term for r in part.toLocalIterator()))
        now = texts.mapInArrow(_holding(few), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
        held = now if held is None else held.union(now)
    if held is None:
        return stash(spark.createDataFrame([], "entity string, term string, share double"), "disclosures")
    total = F.lit(float(texts.count()))
    known = with_small(joint, alone, "entity").join(held, "term")
    # every document that has the entity has no information to give away
    share = F.when(F.col("n_entity") < total, F.log(F.col("n") * total / (F.col("n_term") * F.col("n_entity"))) / F.log(total / F.col("n_entity"))).otherwise(F.lit(0.0))
    return stash(known.select("entity", "term", share.alias("share")).where(F.col("share") >= floor), "disclosures")


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def _found(reach: int, remove: float, revealing, first: bool, more: list[str]):
    """Base spans, and the terms that ``revealing`` (broadcast: entity, term to share) has around them."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def spans(text: str, before: Iterable[dict]) -> list[dict]:
        base, share = base_spans(text), {}
        out = [{"kind": BASE[k], "start": a, "end": b} for k, spans in enumerate(base) for a, b in spans]
        for s in before:
            if s["kind"] not in BASE:
                share[s["start"], s["end"]] = s["kind"] == "remove"
        for entity, near in surroundings(text, base, reach) if revealing else ():
            for term, span in near:
                if (now := revealing.value.get((entity, term))) is not None:
                    share[span] = share.get(span, False) or now >= remove
        return out + sorted(({"kind": "remove" if gone else "generalise", "start": a, "end": b} for (a, b), gone in share.items()), key=lambda s: (s["kind"], s["start"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [()] * batch.num_rows if first else batch["_spans"].to_pylist()
            found = [spans(t or "", b) for t, b in zip(batch["text"].to_pylist(), before)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in more), pa.array(found, kind)], [*more, "_spans"])

    return run


def spans(docs: DataFrame, reach: int = 8, least: int = 3, generalise: float = 0.6, remove: float = 0.9, most: int = 1_000_000) -> DataFrame:
    """row (all columns), text, _spans of every row: kind, start, end, by kind as in ``KINDS``, then by start."""
    spark = docs.sparkSession
    small_batches(spark)
    revealing = disclosures(docs.select("text"), reach, least, generalise, most)
    rows = docs.select(F.struct("*").alias("row"), "text")
    parts = _slices(revealing, "entity", most)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, _spans {_SPANS}"
    for k, part in enumerate(parts or [None]):
        pairs = spark.sparkContext.broadcast({(r.entity, r.term): r.share for r in part.toLocalIterator()}) if part is not None else None
        rows = rows.mapInArrow(_found(reach, remove, pairs, k == 0, ["row", "text"]), schema)
        rows = stash(rows, "spans") if k + 1 < len(parts) else rows
    return rows


def _class(term: str) -> str:
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[WORD]"


def masked(text: str, found: list[dict]) -> str:
    """Entities as their kind, terms as their class or gone; what overlaps goes with what starts first."""
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        a, b = s["start"], s["end"]
        if a >= at:
            word = "" if s["kind"] == "remove" else _class(text[a:b]) if s["kind"] == "generalise" else f"[{s['kind'].upper()}]"
            out += (text[at:a], word)
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with personal data and revealing terms out of ``text``; all other columns as they are."""

    @F.pandas_udf("string")
    def clean(text, found):
        return text.combine(found, lambda t, s: t if t is None or not len(s) else masked(t, list(s)))

    rows = spans(docs, **settings)
    return rows.select(*((clean("text", "_spans").alias("text") if c == "text" else F.col("row")[c].alias(c)) for c in docs.columns))
