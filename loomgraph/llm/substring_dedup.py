"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 8-word grams in a window of 20 words, the
one with the least hash (the last of equals).  Equal windows choose equal
anchors at equal places, so documents that share a window meet at its anchor.
All windows that chose one anchor make a *seat*: the anchor, extended both ways
as far as its windows reach.  Seats of one anchor are joined: those whose
extension is equal on both sides match the earliest of them whole, and where
extensions differ each step of the extension (a window) is joined by itself, so
that a passage is followed to its exact ends.  Matches on one diagonal (the
same earlier document at the same shift) are then merged to maximal repeats.

Matches rest on hashes of words by two independent polynomials: a window has
128 bits, a seat 64 of its anchor and 87 of its extension.

No key holds more than a few rows of an Arrow batch: equal seats of a batch
leave one row, the others are settled there; an anchor with many different
extensions in a batch leaves one row that says so, and its seats go on to the
windows under keys of their own.

Edge cases: a null or empty text has no words and keeps an empty text.  A null
id sorts after all ids.  Rows with equal id and text are one document given
twice: neither makes the other a repeat.  Rows with equal id and different
texts are separate documents, told apart by their MD5.  Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import LAST_ID, SpanHashes, WordHashes, as_bytes, mixed, small_batches, with_small

GRAM = 8
_hashes = WordHashes(seed=20)
#: A place packs 23 bits of a second hash of the extension, 32 of the first window, 8 of the further windows.
_START_BITS, _MORE_BITS = 32, 8
_CHECK_AT = _START_BITS + _MORE_BITS
_OTHER = np.uint64(0x2545F4914F6CDD1D)
#: Different extensions of an anchor that one batch sends to its key.
FEW = 4


def seats(words: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, extent hash and place of each seat.

    Over 256 windows of one anchor are several seats, with a hash of their own each."""
    none = np.empty(0, np.uint64)
    n = len(words) - length + 1
    if n < 1:
        return none, none, none.view(np.int64)
    gram = min(GRAM, length)
    span = SpanHashes(words)
    grams, reach = span.windows(gram), length - gram + 1
    back = sliding_window_view(grams, reach)[:, ::-1].argmin(axis=1)
    anchor = np.arange(n) + reach - 1 - back
    # equal windows have their anchor at the same distance, so seats cut by it still meet
    part = (anchor - np.arange(n)) >> _MORE_BITS
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
    last = np.concatenate((first[1:], [n])) - 1
    anchor, part = anchor[first], part[first].astype(np.uint64)
    key = np.where(part > 0, mixed(grams[anchor] ^ mixed(part)), grams[anchor])
    shape = ((anchor - first) * 256 + (last - first)).astype(np.uint64)
    extent = mixed(span.spans(first, last + length) + shape)
    check = SpanHashes(mixed(words ^ _OTHER)).spans(first, last + length) >> np.uint64(41)
    return key, extent, (check.astype(np.int64) << _CHECK_AT) | (first << _MORE_BITS) | (last - first)


def windows(words: np.ndarray, length: int, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Both hashes and the place of single windows."""
    return SpanHashes(words).windows(length)[starts], SpanHashes(mixed(words ^ _OTHER)).windows(length)[starts], starts << _MORE_BITS


def _start(place: np.ndarray) -> np.ndarray:
    return (place >> _MORE_BITS) & ((1 << _START_BITS) - 1)


def _starts(place: np.ndarray) -> np.ndarray:
    """Every window of the seats."""
    more = place & ((1 << _MORE_BITS) - 1)
    return np.repeat(_start(place), more + 1) + np.arange(int(more.sum()) + len(more)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)


#: ``note``: 0, or -1 for an anchor with many extensions; a row settled in its batch has the
#: first equal one's start plus 1 there, and its document as ``extent``.
_FOUND = "key long, extent long, doc long, tag binary, place long, note long"


def _settled(parts: list[tuple], batch: pa.RecordBatch, few: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of a batch for the join.  Of equal ones of different places the
    first stays, the others know it as theirs and get scattered keys, as do
    those of an anchor with over ``few`` extensions, for which one row stays."""
    if not parts:
        return
    row = np.repeat([k for k, *_ in parts], [len(p[1]) for p in parts])
    key, extent, place = (np.concatenate([p[n] for p in parts]) for n in (1, 2, 3))
    doc = np.asarray(batch["doc"])
    tags = batch["tag"].to_pylist()
    ranked = {x: n for n, x in enumerate(sorted(set(zip(doc.tolist(), tags))))}
    rank = np.array([ranked[x] for x in zip(doc.tolist(), tags)])[row]
    check = place >> _CHECK_AT
    order = np.lexsort((place, rank, check, extent, key))
    row, key, extent, place, rank, check = (x[order] for x in (row, key, extent, place, rank, check))
    at = np.arange(len(key))
    same = np.concatenate(([False], (key[1:] == key[:-1]) & (extent[1:] == extent[:-1]) & (check[1:] == check[:-1])))
    head = np.maximum.accumulate(np.where(same, 0, at))
    given_twice = np.concatenate(([False], same[1:] & (rank[1:] == rank[:-1]) & (place[1:] == place[:-1])))
    late = same & ((rank != rank[head]) | (place != place[head]))
    hot = np.zeros(len(key), bool)
    if few is not None:
        group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
        hot = (np.bincount(group, ~same) > few)[group] & ~late
    marked = np.unique(key[hot])
    scattered = np.where(late | hot, mixed(doc[row].astype(np.uint64) ^ mixed(place.view(np.uint64)) ^ mixed(rank.astype(np.uint64))), key)
    stay = ~given_twice
    of_doc, of_start, late = doc[row[head[stay]]], _start(place[head[stay]]), late[stay]
    none, rows = len(marked), pa.array(row[stay])
    extent = np.where(late, of_doc, extent[stay].view(np.int64))
    note = np.where(late, of_start + 1, np.where(hot[stay], -1, 0))
    columns = {
        "key": pa.array(np.concatenate((scattered[stay], marked)).view(np.int64)),
        "extent": pa.array(np.concatenate((extent, np.zeros(none, np.int64)))),
        "doc": pa.concat_arrays([batch["doc"].take(rows), pa.nulls(none, pa.int64())]),
        "tag": pa.concat_arrays([batch["tag"].take(rows), pa.nulls(none, pa.binary())]),
        "place": pa.concat_arrays([pa.array(place[stay]), pa.nulls(none, pa.int64())]),
        "note": pa.array(np.concatenate((note, np.full(none, -1)))),
    }
    yield pa.RecordBatch.from_pydict(columns)


def _seat_rows(length: int):
    def run(batches):
        for batch in batches:
            parts = []
            for k, text in enumerate(as_bytes(batch["text"])):
                found = seats(_hashes.of(text.split()), length)
                if len(found[0]):
                    parts.append((k, *found))
            yield from _settled(parts, batch, FEW)

    return run


def _list_values(column: pa.Array, name: str) -> np.ndarray:
    return np.asarray(column.flatten().field(name).fill_null(-1))


def _list_sizes(column: pa.Array) -> np.ndarray:
    return np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)


def _window_rows(length: int):
    def run(batches):
        for batch in batches:
            cut = np.cumsum(_list_sizes(batch["found"]))[:-1]
            place, settled = (_list_values(batch["found"], n) for n in ("place", "of_start"))
            parts = []
            for k, (text, p, s) in enumerate(zip(as_bytes(batch["text"]), np.split(place, cut), np.split(settled, cut))):
                if (s < 0).any():
                    parts.append((k, *windows(_hashes.of(text.split()), length, _starts(p[s < 0]))))
            yield from _settled(parts, batch, None)

    return run


def maximal(start: np.ndarray, end: np.ndarray, of: np.ndarray, of_start: np.ndarray) -> list[dict]:
    """Matches that touch or overlap on a diagonal, merged."""
    order = np.lexsort((start, of_start - start, of))
    start, end, of, of_start = start[order], end[order], of[order], of_start[order]
    shift, reach = of_start - start, np.zeros(len(start), np.int64)
    turn = np.concatenate(([True], (of[1:] != of[:-1]) | (shift[1:] != shift[:-1])))
    # on one diagonal starts ascend; ends are lifted so that a running maximum restarts at each diagonal
    lift = np.cumsum(turn) * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = turn | np.concatenate(([True], start[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(start)])) - 1
    found = zip(start[at].tolist(), reach[last].tolist(), of[at].tolist(), of_start[at].tolist())
    return [{"start": a, "end": b, "of": None if d == LAST_ID else d, "of_start": s} for a, b, d, s in sorted(found)]


def _ranges(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return out


_REPEATS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("of", pa.int64()), ("of_start", pa.int64())]))


def _kept_rows(length: int):
    def run(batches):
        for batch in batches:
            cuts, values = [], []
            for name in ("found", "windows"):
                cuts.append(np.cumsum(_list_sizes(batch[name]))[:-1])
                values.append(np.stack([_list_values(batch[name], n) for n in ("place", "of_doc", "of_start")]))
            n_words, n_removed, kept, repeats = [], [], [], []
            for text, *found in zip(as_bytes(batch["text"]), *(np.split(v, c, axis=1) for v, c in zip(values, cuts))):
                words, spans = text.split(), []
                place, of, of_start = np.concatenate(found, axis=1)
                if (known := of_start >= 0).any():
                    first = _start(place[known])
                    spans = maximal(first, first + (place[known] & ((1 << _MORE_BITS) - 1)) + length, of[known], of_start[known])
                left, at = [], 0
                for a, b in _ranges(spans):
                    left += words[at:a]
                    at = b
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                repeats.append(spans)
            columns = [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(repeats, _REPEATS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "repeats"])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, doc, tag, text.  Only rows without an id of their own have a tag, their MD5."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again"))
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    rows = with_small(docs.select("doc_id", "text"), again, "doc_id")
    tag = F.when(F.col("doc_id").isNull(), F.concat(F.lit(b"\1"), digest)).when(F.col("again"), F.concat(F.lit(b"\0"), digest)).otherwise(F.lit(b""))
    # never null, so that both joins of the texts can share one shuffle
    return rows.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(tag, F.lit(b"")).alias("tag"), "text")


def _judged(found: DataFrame) -> DataFrame:
    """``found`` with the earliest equal row as ``of_doc`` and ``of_start``, null for that one itself."""
    check = F.shiftright("place", _CHECK_AT)
    equal = Window.partitionBy("key", "extent", check).orderBy("doc", "tag", "place")
    start = F.shiftright(F.col("place").bitwiseAND(F.lit((1 << _CHECK_AT) - 1)), _MORE_BITS)
    ranked = found.repartition("key").withColumns({"_again": F.rank().over(equal) > 1, "_doc": F.first("doc").over(equal), "_start": F.first(start).over(equal)})
    of = lambda here, there: F.when(F.col("note") > 0, here).when(F.col("_again"), F.col(there))
    return ranked.withColumns({"of_doc": of(F.col("extent"), "_doc"), "of_start": of(F.col("note") - 1, "_start")}).drop("_again", "_doc", "_start")


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words joined by one space),
    repeats (maximal repeats as word ranges, with the earlier document and
    place): words in a window of ``length`` words that also starts earlier, in
    a smaller doc_id or in the same document."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = _numbered(docs)
    found = text.select("doc", "tag", "text").mapInArrow(_seat_rows(length), _FOUND)
    of_key = Window.partitionBy("key")
    differ = (F.min("extent").over(of_key) != F.max("extent").over(of_key)) | (F.min("note").over(of_key) < 0)
    judged = _judged(found).withColumn("open", differ).where("place is not null and (of_start is not null or open)")
    listed = F.collect_set(F.struct("place", "of_doc", "of_start"))
    seat_list = judged.groupBy("doc", "tag").agg(listed.alias("found"))
    steps = text.join(seat_list, ["doc", "tag"]).select("doc_id", "doc", "tag", "text", "found").mapInArrow(_window_rows(length), _FOUND)
    window_list = _judged(steps).where("of_start is not null").groupBy("doc", "tag").agg(listed.alias("windows"))
    return (
        text.join(seat_list, ["doc", "tag"], "left")
        .join(window_list, ["doc", "tag"], "left")
        .select("doc_id", "text", "found", "windows")
        .mapInArrow(_kept_rows(length), f"doc_id {id_type}, n_words long, n_removed long, kept string, repeats array<struct<start:long,end:long,of:long,of_start:long>>")
    )
