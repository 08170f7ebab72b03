"""SimHash near-duplicates with pivot distance tables.

Equal fingerprints are one class.  Each distinct fingerprint gets, once, its
row of the pivot table: the Hamming distances to ``references`` reference
fingerprints.  The row travels with it and decides which pairs are verified: by
the triangle inequality a pair with a coordinate that differs by more than
``distance`` is discarded unseen, and only the survivors' bits are compared.
With 32 pivots about one pair of strangers in ten million survives.

So that not all pairs need to meet, fingerprints are dealt by an equi-join that
misses no link: 64 bits are cut into ``distance + 2`` blocks, and two
fingerprints with at most ``distance`` differing bits agree on at least two of
them, so each is dealt once for each pair of blocks.  Where a pair of values
has over ``MOST`` fingerprints, these are dealt again by the bits left over,
cut into ``distance + 1`` blocks of which linked ones share at least one.  A
group emits a forest of its links, never all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LAST_ID, as_bytes, small_batches, stash
from loomgraph.llm.components import components

_BITS = 64
#: Pivots, and fingerprints of a group before it is dealt again.
REFERENCES, MOST = 32, 20_000
#: Groups of at most so many fingerprints are compared together, larger ones row by row.
_SMALL = 32


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the hashes of the shingles of
    words; a shorter text is one shingle, and a text without words gives 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: -shingle + 1 or None], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    counts = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, fp (a signed long) of each row; null text as empty."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x, shingle, seed) for x in as_bytes(batch["text"])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {id_type}, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << _BITS) if x >> (_BITS - 1) else x


def _blocks(places: list[int], count: int) -> list[int]:
    """Masks of ``count`` nearly equal blocks of the bits ``places``."""
    edges = np.linspace(0, len(places), count + 1).round().astype(int).tolist()
    return [sum(1 << p for p in places[a:b]) for a, b in zip(edges, edges[1:])]


def block_masks(distance: int) -> list[int]:
    """Masks of each pair of ``distance + 2`` blocks of all bits."""
    return [x | y for x, y in combinations(_blocks(list(range(_BITS)), distance + 2), 2)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Masks of ``mask`` and one of ``distance + 1`` blocks of the other bits."""
    return [mask | x for x in _blocks([b for b in range(_BITS) if not mask >> b & 1], distance + 1)]


def pivots(count: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64, endpoint=False)


def pivot_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """A row of distances for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def with_pivots(distinct: DataFrame, count: int = REFERENCES) -> DataFrame:
    """``fp`` and ``distances``, its row of the pivot table as bytes."""

    def run(batches):
        references = pivots(count)
        for batch in batches:
            table = pivot_table(np.asarray(batch["fp"]).view(np.uint64), references)
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array([row.tobytes() for row in table], pa.binary())], ["fp", "distances"])

    return distinct.select("fp").mapInArrow(run, "fp long, distances binary")


def survivors(table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Places of the pairs whose rows of the table differ by at most ``distance`` in every coordinate."""
    left = np.arange(len(i))
    for column in table.T:
        left = left[np.abs(column[i[left]] - column[j[left]]) <= distance]
    return left


class _Groups:
    """Verified links within runs of rows of one group."""

    def __init__(self, distance: int):
        self.distance = distance

    def linked(self, fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs differ in at most ``distance`` bits."""
        left = survivors(table, i, j, self.distance)
        return left[np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= self.distance]

    def small(self, fp: np.ndarray, table: np.ndarray, run: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, step = [], 1
        at = np.flatnonzero(run[1:] == run[:-1])
        while len(at):
            found = at[self.linked(fp, table, at, at + step)]
            out.append((fp[found], fp[found + step]))
            step += 1
            at = at[at + step < len(fp)]
            at = at[run[at] == run[at + step]]
        return out

    def large(self, fp: np.ndarray, table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ends as soon as all hang together."""
        label, parts, out = np.arange(len(fp)), len(fp), []
        for k in range(len(fp) - 1):
            if parts == 1:
                break
            open_ = k + 1 + np.flatnonzero(label[k + 1 :] != label[k])
            found = open_[self.linked(fp, table, np.full(len(open_), k), open_)]
            if len(found):
                _, first = np.unique(label[found], return_index=True)
                found = found[first]
                out.append((np.full(len(found), fp[k]), fp[found]))
                label[np.isin(label, label[found])] = label[k]
                parts -= len(found)
        return out

    def links(self, fp: np.ndarray, table: np.ndarray, run: np.ndarray):
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        size = np.diff(np.concatenate((first, [len(run)])))
        of = np.repeat(size, size)
        if (few := (of > 1) & (of <= _SMALL)).any():
            yield from self.small(fp[few], table[few], run[few])
        for a, n in zip(first[size > _SMALL], size[size > _SMALL]):
            yield from self.large(fp[a : a + n], table[a : a + n])


def _link_rows(distance: int, count: int):
    def run(batches):
        groups, held = _Groups(distance), []
        for batch in batches:
            key = np.stack([np.asarray(batch[c]) for c in ("mask", "block")])
            distances = np.frombuffer(b"".join(batch["distances"].to_pylist()), np.int8).reshape(-1, count)
            if not key.shape[1]:
                continue
            part = (key, np.asarray(batch["fp"]).view(np.uint64), distances)
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and (held[-1][0][:, -1] != key[:, 0]).any():
                yield from _links(groups, held)
                held = []
            if len(ends):
                cut = ends[-1]
                yield from _links(groups, [*held, tuple(x[..., :cut] if x.ndim < 2 or x is key else x[:cut] for x in part)])
                held = [tuple(x[..., cut:] if x.ndim < 2 or x is key else x[cut:] for x in part)]
            else:
                held.append(part)
        yield from _links(groups, held)

    return run


def _links(groups: _Groups, held: list[tuple]):
    if held:
        key, fp, table = np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        new = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))
        found = list(groups.links(fp, table, np.cumsum(new)))
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _dealt(rows: DataFrame, masks: Column) -> DataFrame:
    dealt = rows.select("fp", "distances", F.explode(masks).alias("mask"))
    return dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("block"), "fp", "distances")


def links(distinct: DataFrame, distance: int = 4, references: int = REFERENCES, most: int = MOST) -> DataFrame:
    """(a, b): links that connect all fingerprints (distinct ``fp``) within ``distance`` bits."""
    table = stash(with_pivots(distinct, references), "pivots")
    masks = block_masks(distance)
    dealt = _dealt(table, F.array(*(F.lit(_signed(m)) for m in masks)))
    full = dealt.groupBy("mask", "block").agg(F.count("*").alias("n")).where(F.col("n") > most).select("mask", "block")
    full = stash(full, "full")
    if not full.isEmpty():
        # such groups number at most 15 for each ``most`` fingerprints, so Spark may broadcast them
        finer = F.create_map(*(x for m in masks for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(k)) for k in finer_masks(m, distance))))))
        again = dealt.join(full, ["mask", "block"], "left_semi").withColumn("_finer", F.element_at(finer, F.col("mask")))
        dealt = dealt.join(full, ["mask", "block"], "left_anti").unionByName(_dealt(again, F.col("_finer")))
    return dealt.repartition("mask", "block").sortWithinPartitions("mask", "block").mapInArrow(_link_rows(distance, references), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, references: int = REFERENCES) -> DataFrame:
    """doc_id, text_hash, fp, root (the first of its component: ``last``,
    whether it has no id, doc_id and fp) and component_id (its doc_id, the least
    of the component) of each row.

    Texts without words have fingerprint 0 and are linked like any other.  A
    null id is never the least; a component with null ids only has a null id.
    Repeated rows each return.  Further columns are ignored.
    """
    found = stash(fingerprints(docs, shingle, seed), "fingerprints")
    # a class goes by its least document, so the least of a component names it and nothing is gathered by component
    first = F.struct(F.col("least").isNull().alias("last"), F.col("least").alias("doc_id"), "fp").alias("first")
    classes = stash(found.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", first), "classes")
    named = lambda end: classes.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first"))
    pairs = links(classes.select("fp"), distance, references).join(named("a"), "a").join(named("b"), "b")
    roots = components(pairs.select(F.col("a_first").alias("a"), F.col("b_first").alias("b")))
    rooted = classes.join(roots.select(F.col("node.fp").alias("fp"), "root"), "fp", "left")
    rooted = stash(rooted.select("fp", F.coalesce("root", "first").alias("root")), "roots")
    return found.join(rooted, "fp").select("doc_id", "text_hash", "fp", "root", F.col("root.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component:
    the least doc_id, null last, then a hash of the text; one of repeated rows."""
    key = lambda c: (F.col(c).isNull().alias("last"), F.coalesce(F.col(c).cast("long"), F.lit(LAST_ID)).alias("key"))
    found = near_duplicates(docs, **options).select("root", *key("doc_id"), F.col("text_hash").alias("hash"))
    keys = ["last", "key", "hash"]
    first = found.groupBy("root").agg(F.min(F.struct(*keys)).alias("m")).select("m.*")
    keyed = docs.select(F.struct("*").alias("row"), *key("doc_id"), F.xxhash64("text").alias("hash"))
    return keyed.join(stash(first, "first"), keys, "left_semi").dropDuplicates(keys).select("row.*")
