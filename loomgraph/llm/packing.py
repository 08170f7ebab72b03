"""Best-fit packing by large-item matching.

Documents are tokenized and ended, and only those longer than a sequence are
cut.  Pieces are dealt by hash into groups of about ``GROUP`` pieces, and each
group is packed by itself: pieces over a third of the capacity are matched
greedily, longest first, each with the longest other one that still fits, so
at most two of them share a sequence; then the smaller ones, longest first, go
where they leave the least gap.  A group wastes a sequence or two, whatever
the size of the input, and no task holds more than a group.

Edge cases: a null or empty text is the end token alone.  Repeated rows are
packed each.  Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_bytes, small_batches, stash

GROUP = 16_384
#: Letters that stay one pre-token and lower one by one; other words go through the whole tokenizer.
_PLAIN = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")


def _byte_characters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordTokens(dict):
    """Ids by word, for the tokenizers of ``word_bpe`` kind: they lower case,
    drop white space and so treat words apart.  Words of plain letters go to
    the merges directly, a stop at a word's end is a token of its own."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.characters = Tokenizer.from_file(path), most, _byte_characters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if word[-1] in b".," and word[-2:-1].isalnum():
            value = self[word[:-1]] + self[word[-1:]]
        elif _PLAIN.fullmatch(text := word.decode()):
            stands = text.lower().encode().decode("latin-1").translate(self.characters)
            value = np.array([t.id for t in self.tokenizer.model.tokenize(stands)], "<u4").tobytes()
        else:
            value = self.whole(text)
        self[word] = value
        return value

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a whole text.  ASCII letters are lowered
        at once, but where the text may name a special token."""
        if b"<|" in text:
            return b"".join(map(self.__getitem__, text.split()))
        return b"".join(map(self.__getitem__, text.lower().split()))


_tokens: dict[str, WordTokens] = {}

_PIECE = "piece int, start long, length long, ids_crc32 long, salt long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt and, if asked, ids of each piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        if tokenizer_path not in _tokens:
            _tokens[tokenizer_path] = WordTokens(tokenizer_path)
        words, serial = _tokens[tokenizer_path], 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"])):
                ids = words.of(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    serial += 1
                    row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), zlib.crc32(f"{doc_id} {k} {serial}".encode()), part)
                    for column, value in zip(out, row):
                        column.append(value)
            arrays = [pa.array(out[0], batch["doc_id"].type), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:6])]
            if with_ids:
                flat = np.frombuffer(b"".join(out[6]), "<u4").astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(out[3]))).astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "salt", *["ids"] * with_ids])

    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {_PIECE}" + ", ids array<int>" * with_ids)


class _Gaps:
    """Open sequences by what is left of them; finds the least gap that fits."""

    def __init__(self, capacity: int):
        self.by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, gap: int, sequence: int) -> None:
        self.by_gap[gap].append(sequence)
        self.mask |= 1 << gap

    def take(self, length: int) -> tuple[int, int] | None:
        above = self.mask >> length
        if not above:
            return None
        gap = length + (above & -above).bit_length() - 1
        found = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            self.mask ^= 1 << gap
        return gap, found


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece of one group."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    gaps, used = _Gaps(capacity), 0
    large = [i for i in order if 3 * sizes[i] > capacity]
    waiting = large[::-1]  # shortest first
    short = [sizes[i] for i in waiting]
    while waiting:
        first = waiting.pop()
        left = capacity - short.pop()
        sequence[first], used = used, used + 1
        if k := bisect_right(short, left):
            second = waiting.pop(k - 1)
            sequence[second], offset[second] = sequence[first], sizes[first]
            left -= short.pop(k - 1)
        gaps.put(left, int(sequence[first]))
    for i in order[len(large) :]:
        gap, at = gaps.take(sizes[i]) or (capacity, used)
        used += at == used
        sequence[i], offset[i] = at, capacity - gap
        gaps.put(gap - sizes[i], at)
    return sequence, offset


def pack(found: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """``sequence_id`` and ``offset`` beside the columns of ``found`` (``pieces()``
    written to a table, so that its salts stand)."""
    groups = max(1, -(-found.count() // group))
    names = [c for c in found.columns if c != "salt"]

    def run(table: pa.Table) -> pa.Table:
        sequence, offset = best_fit(np.asarray(table["length"]), capacity)
        table = table.append_column("sequence_id", pa.array(sequence + (np.asarray(table["grp"]).astype(np.int64) << 32)))
        return table.append_column("offset", pa.array(offset)).select([*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {t}" for c, t in found.dtypes if c != "salt")
    return found.withColumn("grp", F.col("salt") % groups).groupBy("grp").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return pack(stash(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of each sequence, from ``pack()`` over pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
