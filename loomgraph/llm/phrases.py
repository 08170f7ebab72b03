"""Collocations: phrases that occur more often than their parts would make them.

1. Words are counted by language.  Those with ``least`` occurrences or more get
   dense 32-bit ids, one for each (language, word), so that an id says its
   language as well.  A phrase with a rarer word is rarer still, so texts are cut
   there, as they are between pieces.
2. From each place the next ``longest`` ids, zeros from the first cut on, are
   packed into one binary key, of as many bytes an id as the dictionary needs.  Keys of a batch are radix
   sorted and run-length counted before they leave it.
3. Keys are dealt out by range and radix sorted once more.  Equal prefixes then
   lie together, so one sorted run counts the phrases of every length: the runs
   of the first two ids are the pairs, and so on.  A range may end within a run,
   so the runs at both ends go on with what they have, and partial counts are
   summed by phrase.
4. Phrases meet the counts of their parts by equi-joins on the binary keys.

A dictionary of at most ``most`` words is broadcast, which bounds it.  A larger
one meets the words by a join, salted for frequent words; results are the same.

Edge cases: a null text is empty; a null language is ``und``.  Repeated rows
count each.  Ids and further columns are ignored.  No rows, no phrases.  Words
of any length are words; a text is one unit of work.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, drop_stash, small_batches, stash, with_small

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Separators as line ends and tabs as spaces, in lower case; or all of them as spaces.
_PIECES = bytes.maketrans(_UPPER + SEPARATORS + b"\t", _LOWER + b"\n" * len(SEPARATORS) + b" ")
_WORDS = bytes.maketrans(_UPPER + SEPARATORS, _LOWER + b" " * len(SEPARATORS))
#: Rows that a task sorts at once, and rows that a range has on average.
CHUNK, RANGE = 3 << 20, 1 << 20
#: Rows of a batch that a task gives.
_GIVEN = 1 << 17
_SALTS = 16


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n; a null word has the number of all words."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), as_bytes(batch["text"])):
            found.setdefault(lang, Counter()).update(text.translate(_WORDS).split())
        for lang, counts in found.items():
            words = [None, *counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts.total(), *counts.values()], pa.int64())], ["lang", "word", "n"]
            )


def dictionary(texts: DataFrame, least: int) -> DataFrame:
    """id (bytes, of equal lengths), lang, word, n, total of each word with
    ``least`` occurrences in its language, which has ``total``; a written table."""
    counts = texts.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stash(counts.where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = counts.where("word is null").select("lang", F.col("n").alias("total"))
    frequent = with_small(counts.where("word is not null"), totals, "lang").withColumn("row", F.monotonically_increasing_id())
    frequent = stash(frequent, "frequent")
    # dense: the place in its partition after all rows of the partitions before
    part = F.shiftright("row", 33)
    parts = frequent.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = parts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    numbered = with_small(frequent.withColumn("part", part), before, "part")
    place = F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    width = max(1, math.ceil(frequent.count().bit_length() / 8))
    out = stash(numbered.select(F.unhex(F.lpad(F.hex(place), 2 * width, "0")).alias("id"), "lang", "word", "n", "total"), "dictionary")
    drop_stash(counts, frequent)
    return out


def windows(ids: np.ndarray, longest: int) -> np.ndarray:
    """``longest`` ids from each place that has two at least, zeros from the first zero on."""
    view = sliding_window_view(np.concatenate((ids, np.zeros(longest - 1, ids.dtype))), longest)
    rows = view[(view[:, 0] > 0) & (view[:, 1] > 0)].copy() if len(ids) else np.zeros((0, longest), ids.dtype)
    rows[~np.logical_and.accumulate(rows > 0, axis=1)] = 0
    return rows


def radix_order(rows: np.ndarray) -> np.ndarray:
    """The stable order of rows of ids, from the last 16 bits to the first."""
    order = np.arange(len(rows))
    for column in reversed(range(rows.shape[1])):
        for shift in (0, 16):
            digit = (rows[:, column] >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of sorted ``rows`` once, and the sum of its ``n``."""
    if not len(rows):
        return rows, n
    starts = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
    return rows[starts], np.add.reduceat(n, starts)


def _packed(rows: np.ndarray, n: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """key, n: the last ``width`` bytes of each id."""
    size = rows.shape[1] * width
    for at in range(0, len(rows), _GIVEN):
        part = rows[at : at + _GIVEN].astype(">u4").view(np.uint8).reshape(-1, rows.shape[1], 4)[:, :, 4 - width :]
        ends = np.arange(0, (len(part) + 1) * size, size, dtype=np.int32)
        keys = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(part))])
        yield pa.RecordBatch.from_arrays([keys, pa.array(n[at : at + _GIVEN].astype(np.int64))], ["key", "n"])


def _unpacked(keys: pa.Array, longest: int, width: int) -> np.ndarray:
    data = np.frombuffer(keys.buffers()[2], np.uint8, len(keys) * longest * width, keys.offset * longest * width)
    out = np.zeros((len(keys), longest, 4), np.uint8)
    out[:, :, 4 - width :] = data.reshape(-1, longest, width)
    return out.view(">u4").reshape(-1, longest).astype(np.uint32)


def _sorted_runs(parts: list[np.ndarray], longest: int, width: int) -> Iterator[pa.RecordBatch]:
    rows = np.concatenate(parts) if parts else np.zeros((0, longest), np.uint32)
    rows = rows[radix_order(rows)]
    yield from _packed(*runs(rows, np.ones(len(rows), np.int64)), width)


def _keys_of(ids: Iterable[np.ndarray], longest: int, width: int) -> Iterator[pa.RecordBatch]:
    """Counted keys of streams of ids, a bounded number at once."""
    parts, size = [], 0
    for some in ids:
        parts.append(windows(some, longest))
        size += len(parts[-1])
        if size >= CHUNK:
            yield from _sorted_runs(parts, longest, width)
            parts, size = [], 0
    yield from _sorted_runs(parts, longest, width)


def _encoded(words, longest: int, width: int):
    """``words``: a broadcast list of (lang, word, id)."""

    def run(batches):
        by_lang: dict[str, dict[bytes, int]] = {}
        for lang, word, number in words.value:
            by_lang.setdefault(lang, {b"": -1})[word] = number

        def ids():
            none = {b"": -1}
            for batch in batches:
                found = []
                for lang, text in zip(batch["lang"].to_pylist(), as_bytes(batch["text"])):
                    of = text.translate(_PIECES).replace(b"\n", b" \n ").split(b" ")
                    found += map(by_lang.get(lang, none).get, of, repeat(0))
                    found.append(0)
                    if len(found) > CHUNK:
                        yield _kept(found)
                        found = []
                yield _kept(found)

        return _keys_of(ids(), longest, width)

    return run


def _kept(found: list[int]) -> np.ndarray:
    ids = np.array(found, np.int64)
    return ids[ids >= 0].astype(np.uint32)


def _exploded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, lang, place, word; a place is left free between pieces."""
    for batch in batches:
        for row, lang, text in zip(batch["row"].to_pylist(), batch["lang"].to_pylist(), as_bytes(batch["text"])):
            pieces = [p.split() for p in text.translate(_PIECES).split(b"\n")]
            words = [w for p in pieces for w in p]
            places = [k + gap for gap, (at, p) in enumerate(zip(np.cumsum([0, *map(len, pieces)]).tolist(), pieces)) for k in range(at, at + len(p))]
            for at in range(0, len(words), _GIVEN):
                some = words[at : at + _GIVEN]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(some), pa.int64()), pa.array([lang] * len(some), pa.string()), pa.array(places[at : at + _GIVEN], pa.int64()), pa.array(some, pa.binary()).cast(pa.string())], ["row", "lang", "place", "word"]
                )


def _joined(longest: int, width: int):
    """Keys of the (place, id) of the frequent words of each text."""

    def ids(batches):
        for batch in batches:
            for found in batch["found"].to_pylist():
                places = np.array([f["place"] for f in found], np.int64)
                cut = np.zeros(int(places[-1] - places[0]) + 2, np.uint32)
                cut[places - places[0]] = [int.from_bytes(f["id"], "big") for f in found]
                yield cut

    return lambda batches: _keys_of(ids(batches), longest, width)


def _keys(texts: DataFrame, words: DataFrame, longest: int, width: int, most: int) -> DataFrame:
    schema = "key binary, n long"
    if words.limit(most + 1).count() <= most:
        few = [(r.lang, r.word.encode(), int.from_bytes(r.id, "big")) for r in words.select("lang", "word", "id").toLocalIterator()]
        return texts.mapInArrow(_encoded(texts.sparkSession.sparkContext.broadcast(few), longest, width), schema)
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    every = rows.mapInArrow(_exploded, "row long, lang string, place long, word string").withColumn("salt", F.pmod("place", F.lit(_SALTS)))
    salted = words.select("lang", "word", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("salt"))
    found = every.join(salted, ["lang", "word", "salt"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("found"))
    return found.select("found").mapInArrow(_joined(longest, width), schema)


def _prefix_runs(least: int, longest: int, width: int):
    """Counts of all prefixes of two ids or more.  Where a task has its whole
    range at once, runs within it are whole, and those under ``least`` go."""

    def counted(parts, whole):
        rows = np.concatenate([p for p, _ in parts])
        n = np.concatenate([x for _, x in parts])
        order = radix_order(rows)
        rows, n = rows[order], n[order]
        for size in range(2, longest + 1):
            there = rows[:, size - 1] > 0
            prefix, sums = runs(rows[there, :size], n[there])
            if whole and len(prefix):
                ends = (prefix == rows[0, :size]).all(axis=1) | (prefix == rows[-1, :size]).all(axis=1)
                prefix, sums = prefix[ends | (sums >= least)], sums[ends | (sums >= least)]
            yield from _packed(prefix, sums, width)

    def run(batches):
        parts, size, whole = [], 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if size and size + batch.num_rows > CHUNK:
                whole = False
                yield from counted(parts, whole)
                parts, size = [], 0
            parts.append((_unpacked(batch["key"], longest, width), batch["n"].to_numpy(zero_copy_only=False)))
            size += batch.num_rows
        if parts:
            yield from counted(parts, whole)

    return run


def phrases(texts: DataFrame, words: DataFrame, least: int, longest: int, most: int, width: int) -> DataFrame:
    """key, n of each phrase of 2 to ``longest`` words with ``least`` occurrences; a written table."""
    keys = _keys(texts, words, longest, width, most)
    # there are at most as many keys as frequent words occur; the ranges are sampled, so keys are made twice but not kept
    at_most = words.agg(F.sum("n")).first()[0] or 0
    ranged = keys.repartitionByRange(max(1, math.ceil(at_most / RANGE)), "key")
    sums = ranged.mapInArrow(_prefix_runs(least, longest, width), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return stash(sums.where(F.col("n") >= least), "phrases")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, most: int = 1_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each
    language by the score of their weakest cut, floor(1000 * a * n / (l * r)).

    Phrases inside a longer one that has ``share`` percent of their occurrences
    or more are left out.  Arithmetic is in decimals of 38 digits."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = dictionary(texts, least)
    width = len((words.select("id").first() or [b"0"])[0])
    found = phrases(texts, words, least, longest, most, width)
    size = F.expr(f"int(length(key) / {width})")
    piece = lambda at, n: F.substring(F.col("key"), at * width + 1, n * width)

    # inside a longer phrase: all its shorter runs, by the greatest count
    shorter = F.expr(f"flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), s -> substring(key, s * {width} + 1, m * {width}))))")
    within = found.withColumn("size", size).where("size > 2").select(F.explode(shorter).alias("key"), F.col("n").alias("longer"))
    within = within.groupBy("key").agg(F.max("longer").alias("longer"))
    kept = stash(found.join(within, "key", "left").where("longer is null or 100 * longer < " + f"{share} * n").select("key", "n"), "kept")

    parts = found.select("key", "n").union(words.select(F.col("id").alias("key"), "n"))
    left, right = parts.select(F.col("key").alias("left"), F.col("n").alias("l")), parts.select(F.col("key").alias("right"), F.col("n").alias("r"))
    heads = words.select(F.col("id").alias("head"), "lang", "total")
    cuts = with_small(kept.withColumn("head", piece(F.lit(0), F.lit(1))), heads, "head").withColumn("size", size)
    cuts = cuts.select("key", "lang", "size", F.col("n").alias("a"), F.col("total").alias("n"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", piece(F.lit(0), F.col("k"))).withColumn("right", piece(F.col("k"), F.col("size") - F.col("k")))
    cuts = cuts.join(left, "left").join(right, "right")
    score = F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("key", "lang", "a", "n").agg(weakest).select("key", "lang", "a", "n", "cut.l", "cut.r", "cut.score")

    spelled = kept.select("key", F.posexplode(F.expr(f"transform(sequence(0, int(length(key) / {width}) - 1), s -> substring(key, s * {width} + 1, {width}))")).alias("at", "id"))
    spelled = with_small(spelled, words.select("id", "word"), "id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    scored = scored.join(spelled.select("key", F.array_join("w.word", " ").alias("phrase")), "key")

    # the first of each share of a language, and then of them all
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("key"), F.lit(64))
    few = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
