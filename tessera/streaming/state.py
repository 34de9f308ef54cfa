"""Keyed state over event streams: recently used lists that expire, and a sliding limit, one key at a time.

They need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``),
which keeps state off the heap and restores it from checkpoints when an executor is lost.
State is bounded: a list by its cap, a window by its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RecentlyUsed(StatefulProcessor):
    """Per key the ``cap`` items touched last, newest first; a key silent for ``ttl`` seconds of event time starts anew.

    Rows of one batch are taken in order of time, then item; rows with a null time or item are left out.
    """

    def __init__(self, key: str, item: str, ts: str, cap: int = 50, ttl: int = 86_400):
        self.key, self.item, self.ts, self.cap, self.ttl = key, item, ts, cap, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", "items array<string>, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).dropna(subset=[self.ts, self.item]).sort_values([self.ts, self.item])
        held = self.state.get() if self.state.exists() else None
        items, last = (list(held[0]), held[1]) if held else ([], None)
        for item, at in zip(new[self.item].astype(str), new[self.ts].astype("datetime64[us]").astype("int64") / 1e6):
            if last is not None and at - last > self.ttl:
                items = []
            items = [item, *(i for i in items if i != item)][: self.cap]
            last = at if last is None else max(at, last)
        if last is not None:
            self.state.update((items, float(last)))
        yield pd.DataFrame({self.key: [key[0]], "items": [items]})

    def close(self) -> None:
        pass


class SlidingLimit(StatefulProcessor):
    """Per event whether its key has had ``limit`` accepted events within the ``seconds`` before it; refused ones do not count."""

    def __init__(self, key: str, ts: str, limit: int = 30, seconds: int = 60):
        self.key, self.ts, self.limit, self.seconds = key, ts, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("accepted", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).dropna(subset=[self.ts]).sort_values(self.ts)
        times, refused = list(self.state.get()[0]) if self.state.exists() else [], []
        for at in new[self.ts].astype("datetime64[us]").astype("int64") / 1e6:
            times = [t for t in times if t > at - self.seconds]
            refused.append(len(times) >= self.limit)
            if not refused[-1]:
                times.append(float(at))
        self.state.update((times,))
        yield pd.DataFrame({self.key: [key[0]] * len(new), self.ts: new[self.ts], "refused": refused})

    def close(self) -> None:
        pass


def recently_used(events: DataFrame, key: str, item: str, ts: str, key_type: str, cap: int = 50, ttl: int = 86_400) -> DataFrame:
    """(key, items): a stream of each key's list after every batch that touches it."""
    return events.select(key, item, ts).groupBy(key).transformWithStateInPandas(RecentlyUsed(key, item, ts, cap, ttl), f"{key} {key_type}, items array<string>", "Update", "None")


def sliding_limit(events: DataFrame, key: str, ts: str, key_type: str, limit: int = 30, seconds: int = 60) -> DataFrame:
    """(key, ts, refused): a stream of decisions, one per event."""
    return events.select(key, ts).groupBy(key).transformWithStateInPandas(SlidingLimit(key, ts, limit, seconds), f"{key} {key_type}, {ts} timestamp, refused boolean", "Append", "None")
