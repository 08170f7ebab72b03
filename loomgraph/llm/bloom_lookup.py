"""Document fingerprints by invertible Bloom lookup sketches.

A document's paragraphs (lines, cut further after words whose hash is a
multiple of ``CUT``, so that a cut depends on nearby words only, and at last
after ``LONGEST`` words) are hashed to 64-bit digests; a repeated paragraph
counts by its occurrence.  Each digest goes into one cell of each of three
tables; a cell keeps a count, the XOR of its digests and the XOR of their
checks.  The fingerprint is such a sketch, wide enough for differences of about
half of the document.

Subtracting the cells of two fingerprints (the wider one folded to the width
of the other) leaves their differing digests, and peeling cells that hold one
digest recovers them.  Peeling fails if there are too many; the sketches of
both are then made anew with twice the cells, until it succeeds.  The likeness
of two versions is the number of common digests over that of all (two without
digests: 1).

Edge cases: a null text is empty and has the empty sketch.  A null id sorts
after all ids, like the greatest long; rows with equal ids sort by a hash of their texts.  The only
row follows itself.  Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LAST_ID, SpanHashes, WordHashes, mixed, small_batches

TABLES, CUT, LONGEST = 3, 4, 16
#: Cells of each table of the least fingerprint.
LEAST = 8
#: Bytes of texts in a range of ids.
RANGE_BYTES = 1 << 26
_SALTS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]
_hashes = WordHashes(seed=8)


def paragraphs(text: bytes) -> np.ndarray:
    """Digests of the paragraphs, in order."""
    lines = [line.split() for line in text.split(b"\n")]
    words = _hashes.of([w for line in lines for w in line])
    if not len(words):
        return words
    closes = words % np.uint64(CUT) == 0
    closes[np.cumsum([len(line) for line in lines if line]) - 1] = True
    ends = np.flatnonzero(closes) + 1
    starts = np.concatenate(([0], ends[:-1]))
    parts = -(-(ends - starts) // LONGEST)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(starts, parts) + nth * LONGEST
    return SpanHashes(words).spans(starts, np.minimum(starts + LONGEST, np.repeat(ends, parts)))


class Digests:
    """The digests of many texts, flat: those of text i are ``keys[at[i]:at[i + 1]]``."""

    def __init__(self, texts: list[bytes]):
        found = [paragraphs(t) for t in texts]
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        keys = np.concatenate(found) if found else np.empty(0, np.uint64)
        of = np.repeat(np.arange(len(found)), self.sizes)
        order = np.lexsort((keys, of))
        same = np.concatenate(([False], (keys[order][1:] == keys[order][:-1]) & (of[order][1:] == of[order][:-1]))) if len(keys) else np.empty(0, bool)
        place = np.arange(len(keys))
        times = np.zeros(len(keys), np.uint64)
        times[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(np.uint64)
        self.keys = mixed(keys + times * _SALTS[0])

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the texts, and for each the position in ``which``."""
        sizes = self.sizes[which]
        row = np.repeat(np.arange(len(which)), sizes)
        start = np.repeat(self.at[which] - (np.cumsum(sizes) - sizes), sizes)
        return self.keys[start + np.arange(len(row))], row


class Cells:
    """Sketches of many texts, each ``TABLES`` tables of ``width`` cells."""

    def __init__(self, rows: int, width: int):
        self.rows, self.width = rows, width
        shape = rows * TABLES * width
        self.count, self.key, self.check = np.zeros(shape, np.int64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)

    def add(self, keys: np.ndarray, row: np.ndarray, sign: np.ndarray | int) -> None:
        check = self.checks(keys)
        for t, salt in enumerate(_SALTS):
            cell = (row * TABLES + t) * self.width + (mixed(keys ^ salt) % np.uint64(self.width)).astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.key, cell, keys)
            np.bitwise_xor.at(self.check, cell, check)

    @staticmethod
    def checks(keys: np.ndarray) -> np.ndarray:
        return mixed(keys + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered keys, their rows and signs, and which rows came out empty."""
        out = []
        while True:
            pure = np.flatnonzero((np.abs(self.count) == 1))
            pure = pure[self.check[pure] == self.checks(self.key[pure])]
            if not len(pure):
                break
            row, keys, sign = pure // (TABLES * self.width), self.key[pure], self.count[pure]
            order = np.lexsort((keys, row))
            row, keys, sign = row[order], keys[order], sign[order]
            first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])))
            row, keys, sign = row[first], keys[first], sign[first]
            self.add(keys, row, -sign)
            out.append((keys, row, sign))
        keys, row, sign = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        left = ((self.count != 0) | (self.key != 0)).reshape(self.rows, -1).any(axis=1)
        return keys, row, sign, ~left

    def strings(self) -> list[str]:
        """Each sketch as text: count, key and check of each cell, in base64."""
        cells = np.zeros((self.rows, TABLES * self.width), _CELL)
        for name in _CELL.names:
            cells[name] = getattr(self, name).reshape(self.rows, -1)
        return [base64.b64encode(x.tobytes()).decode() for x in cells]

    @classmethod
    def of_string(cls, fingerprint: str) -> Cells:
        cells = np.frombuffer(base64.b64decode(fingerprint), _CELL)
        out = cls(1, len(cells) // TABLES)
        for name in _CELL.names:
            getattr(out, name)[:] = cells[name]
        return out

    def folded(self, width: int) -> Cells:
        """The same sketches at a width that divides theirs."""
        out = Cells(self.rows, width)
        for name, add in (("count", np.add), ("key", np.bitwise_xor), ("check", np.bitwise_xor)):
            setattr(out, name, add.reduce(getattr(self, name).reshape(self.rows, TABLES, -1, width), axis=2).reshape(-1))
        return out


_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])


def subtract(fingerprint: str, other: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests that only the one and only the other has, from two
    fingerprints alone; None if they are too small for what differs."""
    a, b = Cells.of_string(fingerprint), Cells.of_string(other)
    width = min(a.width, b.width)
    a, b = a.folded(width), b.folded(width)
    a.count -= b.count
    a.key ^= b.key
    a.check ^= b.check
    keys, _, sign, done = a.peel()
    return (keys[sign > 0], keys[sign < 0]) if done[0] else None


def widths(sizes: np.ndarray) -> np.ndarray:
    """Cells of each table for so many digests: a quarter of them, as a power of two."""
    return np.maximum(LEAST, 2 ** np.ceil(np.log2(np.maximum(sizes, 4) / 4)).astype(np.int64))


def sketches(digests: Digests, which: np.ndarray) -> list[str]:
    out = np.empty(len(which), object)
    wide = widths(digests.sizes[which])
    for width in np.unique(wide):
        mine = np.flatnonzero(wide == width)
        cells = Cells(len(mine), int(width))
        cells.add(*digests.of(which[mine]), 1)
        out[mine] = cells.strings()
    return out.tolist()


def differences(digests: Digests, left: np.ndarray, right: np.ndarray, most_cells: int = 1 << 17) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The digests that only the left and only the right text of each pair has,
    as peeled from the difference of their sketches: at first at the width of
    the smaller fingerprint, to which the other folds, then wider."""
    only: tuple[list, list] = ([np.empty(0, np.uint64)] * len(left), [np.empty(0, np.uint64)] * len(left))
    gap = np.abs(digests.sizes[left] - digests.sizes[right])
    # widths that can't hold even the difference in number are passed over
    need = np.maximum(np.minimum(widths(digests.sizes[left]), widths(digests.sizes[right])), 2 ** np.ceil(np.log2(np.maximum(gap, 1) / 2 + 1)).astype(np.int64))
    pending, width = np.arange(len(left)), LEAST
    while len(pending):
        ready, failed = pending[need[pending] <= width], [pending[need[pending] > width]]
        step = max(1, most_cells // (TABLES * width))
        for at in range(0, len(ready), step):
            part = ready[at : at + step]
            cells = Cells(len(part), width)
            cells.add(*digests.of(left[part]), 1)
            cells.add(*digests.of(right[part]), -1)
            keys, row, sign, done = cells.peel()
            found = np.stack([np.bincount(row[sign > 0], minlength=len(part)), np.bincount(row[sign < 0], minlength=len(part))])
            done &= found[0] - found[1] == digests.sizes[left[part]] - digests.sizes[right[part]]
            order = np.lexsort((keys, row))
            keys, row, sign = keys[order], row[order], sign[order]
            for side, of_side in zip(only, (sign > 0, sign < 0)):
                pieces = np.split(keys[of_side], np.searchsorted(row[of_side], np.arange(1, len(part))))
                for k in np.flatnonzero(done):
                    side[part[k]] = pieces[k]
            failed.append(part[~done])
        pending, width = np.sort(np.concatenate(failed)), width * 2
    return only


def likeness(digests: Digests, left: np.ndarray, only: tuple[list, list]) -> np.ndarray:
    a, b = (np.fromiter(map(len, side), np.int64, len(left)) for side in only)
    common = digests.sizes[left] - a
    union = common + a + b
    return np.where(union == 0, 1.0, common / np.maximum(union, 1))


def edited(text: str, following: str, share: int = 4) -> str:
    """The last ``1 / share`` of the code points replaced by the first ones of another text."""
    n = len(text) // share
    return text[: len(text) - n] + following[:n]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        rows = held + list(zip(*(batch[c].to_pylist() for c in ("bucket", "part", "doc_id", "text"))))
        yield from _compared([(b, p, i, t or "") for b, p, i, t in rows], batch.schema.field("doc_id").type)
        held = rows[-1:]


def _compared(rows: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    own = [k for k in range(len(rows) - 1) if rows[k][1] == 0]
    if not own:
        return
    texts = [r[3] for r in rows]
    changed = [edited(texts[k], texts[k + 1]) for k in own]
    raw = [t.encode() for t in texts]
    raw_changed = [t.encode() for t in changed]
    digests = Digests(raw + raw_changed)
    at = np.array(own)
    new = len(rows) + np.arange(len(own))
    gone_come = differences(digests, at, new)
    as_lists = lambda side: pa.array([x.view(np.int64) for x in side], pa.list_(pa.int64()))
    columns = {
        "doc_id": pa.array([rows[k][2] for k in own], id_type),
        "n_chars": pa.array([len(texts[k]) for k in own], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in raw_changed]),
        "fingerprint": pa.array(sketches(digests, at)),
        "edited_fingerprint": pa.array(sketches(digests, new)),
        "near_edited": pa.array(likeness(digests, at, gone_come)),
        "near_next": pa.array(likeness(digests, at, differences(digests, at, at + 1))),
        "gone": as_lists(gone_come[0]),
        "come": as_lists(gone_come[1]),
    }
    yield pa.RecordBatch.from_pydict(columns)


def _ranges(docs: DataFrame) -> Callable[[Column, Column], Column]:
    """Numbers the range of a row from its ``key`` and ``hash``.

    As many ranges as the bytes of the texts ask for, cut at approximate
    percentiles of the ids.  An id that is several percentiles at once is cut
    further by the hash."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    found = docs.agg(F.percentile_approx("key", [k / count for k in range(1, count)] or [0.5], 20 * count)).first()[0]
    cuts = np.array(sorted(found or [0]), np.int64)

    @F.pandas_udf("int")
    def number(key: pd.Series, hashed: pd.Series) -> pd.Series:
        before, until = (np.searchsorted(cuts, key.to_numpy(), side).astype(np.int64) for side in ("left", "right"))
        share = ((hashed.to_numpy().view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64)
        equal = until - before
        return pd.Series(before + np.where(equal > 0, 1 + (share * equal >> 32), 0))

    return number


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, gone, come: each text against an edit that borrows
    from the next document by id, and against that document; ``gone`` and
    ``come`` are the digests that only the text and only the edit has.

    Documents are dealt into ranges of ids; the first document of a range also
    goes to the range before it, and the first of all to the last, so that each
    meets its next one after a single shuffle.  What the driver learns is a cut
    and a first row for each range.
    """
    small_batches(docs.sparkSession, 400)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("key"), F.xxhash64("text").alias("hash"))
    rows = rows.withColumn("b", _ranges(rows)("key", "hash"))
    firsts = rows.groupBy("b").agg(F.min(F.struct("key", "hash")).alias("first")).select("b", "first.*").orderBy("b").collect()
    names = [r.b for r in firsts] or [0]
    # where the first row of each range goes as well: to the range before, in a circle
    also = docs.sparkSession.createDataFrame([(r.b, r.key, r.hash, names[k - 1]) for k, r in enumerate(firsts)], "b int, key long, hash long, other int")
    whole = [F.col("b").alias("bucket"), F.lit(0).alias("part"), "key", "hash", "doc_id", "text"]
    extra = rows.join(F.broadcast(also), ["b", "key", "hash"])
    # the first of all ends the last range, which it follows by no key
    ends = extra.select(F.col("other").alias("bucket"), F.when(F.col("other") >= F.col("b"), 2).otherwise(1).alias("part"), "key", "hash", "doc_id", "text")
    dealt = rows.select(*whole).unionByName(ends).repartitionById(max(names) + 1, F.col("bucket"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (
        dealt.sortWithinPartitions("bucket", "part", "key", "hash")
        .select("bucket", "part", "doc_id", "text")
        .mapInArrow(_rows, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, gone array<long>, come array<long>")
    )
