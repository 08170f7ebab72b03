"""The exact sliding-window rate limiter, on batches and on streams.

A hit is refused if ``most`` accepted hits of its key fall in the window
before it; refused hits are not recorded.  So a decision depends on earlier
decisions, which no window function expresses: each key keeps the times of its
accepted hits, ``most`` at most.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECONDS, MOST = 60, 60


class Limiter:
    """Accepted times of one key, in microseconds."""

    def __init__(self, most: int, seconds: int, times: list[int] | None = None):
        self.most, self.span, self.times = most, seconds * 1_000_000, deque(times or [])

    def hit(self, at: int) -> bool:
        while self.times and self.times[0] <= at - self.span:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(at)
        return True


def limited(events: DataFrame, most: int = MOST, seconds: int = SECONDS) -> DataFrame:
    """``events`` (key, at as microseconds, event_id) with ``accepted``.

    Rows arrive sorted by key and time and pass through in batches, so a hot
    key streams through one task with ``most`` times in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limiter = object(), Limiter(most, seconds)
        for batch in batches:
            accepted = []
            for k, at in zip(batch["key"], batch["at"]):
                if k != key:
                    key, limiter = k, Limiter(most, seconds)
                accepted.append(limiter.hit(at))
            yield batch.assign(accepted=accepted)

    dealt = events.select("key", "at", "event_id").repartition("key").sortWithinPartitions("key", "at", "event_id")
    return dealt.mapInPandas(run, "key long, at long, event_id long, accepted boolean")


class LimitProcessor(StatefulProcessor):
    """The limiter for ``transformWithStateInPandas`` on a stream grouped by key.

    With ``expires`` (event time) a key is forgotten once its window is past."""

    def __init__(self, most: int = MOST, seconds: int = SECONDS, expires: bool = False):
        self.most, self.seconds, self.expires = most, seconds, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at long")

    def _end(self, at: int) -> int:
        """The millisecond from which an accepted hit no longer counts."""
        return at // 1000 + self.seconds * 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limiter = Limiter(self.most, self.seconds, [t[0] for t in self.times.get()] if self.times.exists() else [])
        hits = pd.concat(list(rows)).sort_values(["at", "event_id"])
        hits["accepted"] = [limiter.hit(int(t)) for t in hits["at"]]
        self.times.put([(int(t),) for t in limiter.times])
        if self.expires and limiter.times:
            self.handle.registerTimer(self._end(limiter.times[-1]))
        yield hits[["key", "at", "event_id", "accepted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # a later hit has a later timer
        if self.times.exists() and max(self._end(t[0]) for t in self.times.get()) <= expiredTimerInfo.getExpiryTimeInMs():
            self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, most: int = MOST, seconds: int = SECONDS, late: str | None = None) -> DataFrame:
    """``limited`` for a streaming DataFrame; needs the RocksDB state store.

    Hits of a key are decided in the order of their times within a batch, and
    batches as they come.  ``late`` ("10 minutes") bounds the state: the
    watermark follows the hits so far behind, hits behind it are dropped by
    Spark, and keys whose window lies behind it are forgotten."""
    hits = events.select("key", "at", "event_id")
    if late:
        hits = hits.withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)
    return hits.groupBy("key").transformWithStateInPandas(
        LimitProcessor(most, seconds, bool(late)), "key long, at long, event_id long, accepted boolean", "Append", "EventTime" if late else "None"
    )
