"""Aligning the tokens of two tokenizers, by joins.

Both tokenizers read a document; their tokens become rows (``posexplode``), the
byte lengths of tokens summed by a window say where each ends, and an equi-join
on document and end finds the *cuts*, where tokens of both end.  The running
count of cuts numbers the groups of tokens between them, and each cut links the
two tokens that end there.  How often a pair of ids is linked in all documents
is counted by pair and joined back.

The first tokenizer is a byte-level BPE (a ``tokenizers`` file) and reads a space
before the text; the second is a ``sentencepiece`` model, which adds it.  Special
tokens are never made from their strings.  Texts move once, by a key of their
row; joins and windows then find their rows where they are.

A linked pair ends in equal bytes, so the shorter token is a suffix of the
longer: the vocabularies bound the table of pairs (``most_pairs``), and it is
broadcast only below that bound and ``MOST_PAIRS``.

Edge cases: a text that is null or empty, or that a tokenizer does not give
back byte for byte, has no tokens, and zeros.  Repeated rows, equal ids and null
ids are documents of their own each.  Further columns are ignored.  The rows of
a document are one window, which its length bounds.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from loomgraph.llm.common import small_batches, stash

#: Pairs of ids that are broadcast at most.
MOST_PAIRS = 4_000_000
#: How the byte-level tokenizer cuts a text before it merges.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these, what is a letter may differ between versions of Unicode.
_YOUNG = re.compile("[^\x00-ɏ‐-‧€]")
#: A word that a space may follow without a change of its tokens.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧€]+(?<!\s)")
#: Words that are read at once.
_AT_ONCE = 1000


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as itself and other bytes as characters from 256 on."""
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Ids of a space and a text; where the file's merges are in the order of its ids, by the faster library."""

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of, vocab = _byte_of(), model["vocab"]
        self.bytes = {i: bytes(of[c] for c in token) for token, i in vocab.items() if all(c in of for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        ranks = {self.bytes[i]: i for token, i in vocab.items() if token not in special and i in self.bytes}
        ordered = all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges))
        self.fast = tiktoken.Encoding("byte level", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def ids(self, text: str) -> list[int]:
        if self.fast and not _YOUNG.search(text):
            return self.fast.encode_ordinary(" " + text)
        return self.slow.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """Ids of a text by a model that adds a space."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = lambda i: bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
        self.bytes = {i: spelled(i) for i in range(self.model.get_piece_size())}

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    """Settings of the session for a while."""
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Both:
    """Ids of texts by two readers, none where either's bytes are not a space and the text.

    No token goes on from a word into the space behind it, so each different
    word of a batch is read once, in a line with others.  A text with a word for
    which this is not certain (white space at its end, no character at all, a
    young one) or is not given back is read by itself."""

    def __init__(self, byte_level: ByteLevel, pieces: Pieces):
        self.readers = byte_level, pieces
        self.lengths = [_lengths(r) for r in self.readers]
        self.apart = byte_level.fast and not any(b" " in b.lstrip(b" ") for b in pieces.bytes.values())

    def of(self, text: str) -> list[list[int]] | None:
        """Ids of both if they give back a space and the text."""
        both, whole = [r.ids(text) for r in self.readers], b" " + text.encode()
        return both if all(b"".join(map(r.bytes.__getitem__, of)) == whole for r, of in zip(self.readers, both)) else None

    def words(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Whether each word is certain; by reader, how many ids each has, and all ids."""
        certain, counts, ids = np.zeros(len(words), bool), [np.zeros(len(words), np.int64) for _ in self.readers], [[], []]
        plain = [k for k, w in enumerate(words) if _PLAIN.fullmatch(w)]
        for first in range(0, len(plain), _AT_ONCE):
            some = plain[first : first + _AT_ONCE]
            line = self.of(" ".join(map(words.__getitem__, some)))
            if line:
                ends = np.cumsum([len(words[k].encode()) + 1 for k in some])
                certain[some] = True
                for side, of in enumerate(line):
                    at = np.searchsorted(np.cumsum(self.lengths[side][of]), ends) + 1
                    counts[side][some] = np.diff(at, prepend=0)
                    ids[side].append(np.array(of, np.int32))
            else:
                for k in some:
                    if one := self.of(words[k]):
                        certain[k] = True
                        for side, of in enumerate(one):
                            counts[side][k] = len(of)
                            ids[side].append(np.array(of, np.int32))
        return certain, counts, [np.concatenate([*x, np.empty(0, np.int32)]) for x in ids]

    def texts(self, texts: pa.Array) -> list[list]:
        """Ids of each text by the first and by the second."""
        none, words = [[], []], pc.split_pattern(texts.fill_null(""), " ")
        if not self.apart:
            return [self.of(t) or none if t else none for t in texts.to_pylist()]
        of, bounds = words.flatten().dictionary_encode(), words.offsets.to_numpy()
        seat = of.indices.to_numpy()
        certain, counts, ids = self.words(of.dictionary.to_pylist())
        doubts = np.concatenate(([0], np.cumsum(~certain[seat])))[bounds]
        sides = []
        for n, all_ids in zip(counts, ids):
            sizes = n[seat]
            sides.append((all_ids[_runs((np.cumsum(n) - n)[seat], sizes)], np.concatenate(([0], np.cumsum(sizes)))[bounds].tolist()))
        out = []
        for k, doubt in enumerate((np.diff(doubts) > 0).tolist()):
            if doubt:
                text = texts[k].as_py()
                out.append(self.of(text) or none if text else none)
            else:
                out.append([found[at[k] : at[k + 1]] for found, at in sides])
        return out


@cache
def _both(byte_level: str, pieces: str) -> Both:
    return Both(_reader(ByteLevel, byte_level), _reader(Pieces, pieces))


def _lengths(reader: ByteLevel | Pieces) -> np.ndarray:
    """Bytes of each id's token."""
    found = np.zeros(max(reader.bytes) + 1, np.int32)
    found[list(reader.bytes)] = list(map(len, reader.bytes.values()))
    return found


@cache
def _reader(kind: type, path: str) -> ByteLevel | Pieces:
    return kind(path)


def _narrow(byte_level: str, pieces: str) -> bool:
    """Whether ids fit 16 bits."""
    return max(*_reader(ByteLevel, byte_level).bytes, *_reader(Pieces, pieces).bytes) < 1 << 16


def _tokenized(byte_level: str, pieces: str, narrow: bool):
    """Ids of both, one after the other, and how many are the first's; none where
    either's bytes are not a space and the text."""
    kind = T.ShortType() if narrow else T.IntegerType()

    @F.arrow_udf(T.StructType([T.StructField("n_a", T.IntegerType()), T.StructField("tokens", T.ArrayType(kind))]))
    def ids(texts: pa.Array) -> pa.Array:
        kind = np.uint16 if narrow else np.int32
        both = _both(byte_level, pieces).texts(texts)
        sizes, found = [len(a) for a, _ in both], [np.concatenate((a, b)).astype(kind) for a, b in both]
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        ids = np.concatenate([*found, np.empty(0, np.uint16 if narrow else np.int32)])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(ids.view(np.int16) if narrow else ids))], ["n_a", "tokens"])

    # evaluated once, before the texts' ids move
    return ids.asNondeterministic()


def held_tokens(docs: DataFrame, byte_level: str, pieces: str, task_bytes: int) -> DataFrame:
    """key, doc_id, n_a, tokens dealt by key, those of ``task_bytes`` of text or so in each part."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", _tokenized(byte_level, pieces, _narrow(byte_level, pieces))("text").alias("t"))
    rows = rows.select("key", "doc_id", "t.n_a", "t.tokens")
    # in order already, so that the windows have little to sort
    return rows.repartition(max(1, math.ceil(size / task_bytes)), "key").sortWithinPartitions("key")


def _tokens(held: DataFrame, kind: type, path: str, side: str, narrow: bool) -> DataFrame:
    """key, end, place and id of each token; the last one of a document, or else a
    row without a token, has its doc_id and all its ids.

    Both sides read all columns, so that they share one shuffle."""
    spark = held.sparkSession
    # bounded by the vocabulary
    lengths = F.broadcast(spark.createDataFrame([(i, len(b)) for i, b in _reader(kind, path).bytes.items()], f"{side} int, length int"))
    whole = lambda c: c.cast("int").bitwiseAND(F.lit(0xFFFF)) if narrow else c
    n_a, place = F.col("n_a"), F.col(f"{side}_place")
    own = F.slice("tokens", F.lit(1), n_a) if side == "a" else F.slice("tokens", n_a + 1, F.size("tokens") - n_a)
    rows = held.select("key", "doc_id", own.alias("all")).select("key", "doc_id", "all", F.posexplode_outer("all").alias(f"{side}_place", "id"))
    last = place.isNull() | (place == F.size("all") - 1)
    rows = rows.select("key", place, whole(F.col("id")).alias(side), F.when(last, F.struct("doc_id", "all")).alias(f"{side}_last"))
    rows = rows.join(lengths, side, "left")
    end = F.sum("length").over(Window.partitionBy("key").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("key", end.alias("end"), place, side, f"{side}_last")


def cuts(held: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """key, ``group`` (from 1), ``end`` (bytes), ``a``, ``b`` (the linked ids), ``a_place``,
    ``b_place`` (theirs, from 0) of each place where tokens of both end, in order
    within a key; ``a_last``, ``b_last`` (doc_id, all ids) in a document's last,
    which is always a cut.  A document without tokens has one row without places."""
    narrow = _narrow(byte_level, pieces)
    a, b = _tokens(held, ByteLevel, byte_level, "a", narrow), _tokens(held, Pieces, pieces, "b", narrow)
    # the parts are bounded, and a hash join keeps the order that the next window needs
    both = a.join(b.hint("shuffle_hash"), ["key", "end"], "left").where("b_place is not null or a_place is null")
    return both.withColumn("group", F.row_number().over(Window.partitionBy("key").orderBy("a_place")))


def grouped(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> bytes:
    """Groups as text, from the ids of both and the last token of each group:
    ids with commas, the two sides with a bar, groups with semicolons."""
    n = np.arange(len(a_last))
    size_a, size_b = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    group_a, group_b = np.repeat(n, size_a), np.repeat(n, size_b)
    seat_a = np.arange(len(a)) + (b_last - size_b + 1)[group_a]
    seat_b = np.arange(len(b)) + (a_last + 1)[group_b]
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[seat_a], ids[seat_b] = a, b
    marks[seat_a[a_last]], marks[seat_b[b_last]] = ord("|"), ord(";")
    digits = _digits(int(ids.max()).bit_length())
    text = np.concatenate((digits[ids], marks[:, None]), axis=1).ravel()
    return text[text > 0][:-1].tobytes()


@cache
def _digits(bits: int) -> np.ndarray:
    """The digits of all numbers of so many bits, zeros after them."""
    names = np.array([str(k).encode() for k in range(1 << bits)])
    return names.view(np.uint8).reshape(len(names), -1)


def _documents(narrow: bool):
    """A row for each key, from its cuts in order; the row with ``all_a`` is its last."""

    def ids(col: pa.ListArray, at: int) -> np.ndarray:
        found = col.values.to_numpy(zero_copy_only=False)[col.offsets[at].as_py() : col.offsets[at + 1].as_py()]
        return (found.view(np.uint16) if narrow else found).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            places = [batch[c].to_numpy(zero_copy_only=False) for c in ("a_place", "b_place")]
            every_a, every_b, out, start = batch["all_a"], batch["all_b"], [], 0
            for at in np.flatnonzero(every_a.is_valid().to_numpy(zero_copy_only=False)).tolist():
                held.append(tuple(x[start : at + 1] for x in places))
                start = at + 1
                a = ids(every_a, at)
                if len(a):
                    b = ids(every_b, at)
                    a_last, b_last = (np.concatenate(x) for x in zip(*held))
                    pairs, times = np.unique((a[a_last] << 32) | b[b_last], return_counts=True)
                    out.append((at, len(a), len(b), batch["group"][at].as_py(), grouped(a, b, a_last, b_last), pairs, times))
                else:
                    out.append((at, 0, 0, 0, None, np.empty(0, np.int64), np.empty(0, np.int64)))
                held = []
            held.append(tuple(x[start:].copy() for x in places))
            if out:
                at, n_a, n_b, n_groups, groups, pairs, times = zip(*out)
                each = pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times).astype(np.int64))], ["pair", "times"])
                ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                rows = batch.select(["key", "doc_id"]).take(pa.array(at))
                columns = [*rows.columns, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(groups, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(ends, each)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs"])

    return run


def aligned(docs: DataFrame, byte_level: str, pieces: str, task_bytes: int = 4 << 20) -> DataFrame:
    """key, doc_id, n_a, n_b, n_groups, groups (text) and pairs of every row:
    ``pairs`` has each linked pair once, as one number, and how many ``times``."""
    found = cuts(held_tokens(docs, byte_level, pieces, task_bytes), byte_level, pieces)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = found.select("key", F.coalesce("a_last.doc_id", "b_last.doc_id").alias("doc_id"), "group", zero("a_place"), zero("b_place"), F.col("a_last.all").alias("all_a"), F.col("b_last.all").alias("all_b"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_documents(_narrow(byte_level, pieces)), f"key long, doc_id {kind}, n_a long, n_b long, n_groups long, groups string, pairs array<struct<pair:long,times:long>>")


def most_pairs(byte_level: str, pieces: str) -> int:
    """Pairs of tokens of which one ends with the other: no other pair is ever linked."""
    a, b = list(_reader(ByteLevel, byte_level).bytes.values()), list(_reader(Pieces, pieces).bytes.values())
    suffixes = lambda longer, shorter, least: sum(shorter.get(t[k:], 0) for t in longer for k in range(least, len(t)))
    return suffixes(a, Counter(b), 0) + suffixes(b, Counter(a), 1)


def linked(docs: DataFrame, byte_level: str, pieces: str, task_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    digest = F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256")
    # rows dealt by document alone meet by document and end where they are; batches are bounded by
    # rows, as Spark weighs a batch anew at each row where it bounds their bytes
    small_batches(docs.sparkSession)
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1)}
    with _set(docs.sparkSession, settings):
        rows = stash(aligned(docs, byte_level, pieces, task_bytes).select("key", "doc_id", "n_a", "n_b", "n_groups", digest, "pairs"), "aligned")
    counts = stash(rows.select(F.inline("pairs")).groupBy("pair").agg(F.sum("times").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    # one row for each piece: bounded by the vocabulary
    counts = counts.withColumn("b", b).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    if most_pairs(byte_level, pieces) <= MOST_PAIRS:
        counts = F.broadcast(counts)
    every = rows.select("key", F.inline("pairs")).join(counts, "pair")
    sums = every.groupBy("key").agg(F.sum("times").alias("n_links"), F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.join(sums, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")


def tokenizers_of(spark: SparkSession, byte_level: str, pieces: str) -> DataFrame:
    """side, id, bytes of all tokens of both."""
    rows = [(s, i, b) for s, kind, path in (("a", ByteLevel, byte_level), ("b", Pieces, pieces)) for i, b in _reader(kind, path).bytes.items()]
    return spark.createDataFrame(rows, "side string, id int, bytes binary")
