"""Helpers that the operators share: tables, the shared folder, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.storage import delete_at_exit, drop_stash, exists, shared_dir, stash

__all__ = ["LAST_ID", "WORD_PATTERN", "SpanHashes", "WordHashes", "as_bytes", "delete_at_exit", "drop_stash", "exists", "held_out", "mixed", "shared_dir", "small_batches", "stash", "table", "with_small"]

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Documents without an id sort after all others.
LAST_ID = 9223372036854775807

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that are broadcast at most.
MOST_BROADCAST = 100_000


def with_small(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined to ``few``, which is mostly empty or small: it is
    broadcast only if it is counted to have at most ``MOST_BROADCAST`` rows."""
    n = few.limit(MOST_BROADCAST + 1).count()
    return rows.join(F.broadcast(few) if n <= MOST_BROADCAST else few, key, "left")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what one Arrow batch of long texts holds in a Python worker: lowers
    the session's setting if it is above.  Spark reads it when a query runs, so
    it stays lowered."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now > rows or now <= 0:
        spark.conf.set(name, str(rows))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0 (a null id is never held out)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """XXH64 by word, computed once a worker; forgotten when it grows large."""

    def __init__(self, seed: int, most: int = 1_000_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHashes:
    """Hashes of any run of words from prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C13
    INVERSE = pow(BASE, -1, 1 << 64)
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n:
            size = max(n, 1 << 14)
            for name, base in (("_up", cls.BASE), ("_down", cls.INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls._up[:n], cls._down[:n]

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, self.down = self._powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])
