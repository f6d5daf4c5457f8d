"""Materialised moments, and waiting for changes."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versioned import snapshot_at


class SliceCache:
    """The most recently used snapshots, cached by their exact moment and prefix."""

    def __init__(self, records: DataFrame, entries: int = 100):
        self.records, self.entries = records, entries
        self._held: OrderedDict[tuple, DataFrame] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, ts, prefix: str | None = None) -> DataFrame:
        at = (ts, prefix)
        if at in self._held:
            self.hits += 1
            self._held.move_to_end(at)
            return self._held[at]
        self.misses += 1
        self._held[at] = snapshot_at(self.records, ts, prefix).persist()
        if len(self._held) > self.entries:
            self._held.popitem(last=False)[1].unpersist()
        return self._held[at]

    def invalidate(self) -> None:
        while self._held:
            self._held.popitem()[1].unpersist()

    def stats(self) -> dict:
        return {"entries": len(self._held), "hits": self.hits, "misses": self.misses}


def until(read: Callable[[], DataFrame], key: str, predicate: Column, timeout: float = 30.0, poll: float = 0.1):
    """The first version of ``key`` that satisfies ``predicate``, looked for until ``timeout`` seconds have passed."""
    end = time.monotonic() + timeout
    while True:
        rows = read().filter((F.col("key") == key) & predicate).orderBy("sequence").take(1)
        if rows or time.monotonic() >= end:
            return rows[0] if rows else None
        time.sleep(poll)


def until_changed(read: Callable[[], DataFrame], key: str, since, timeout: float = 30.0, poll: float = 0.1):
    """The first version of ``key`` written after a moment."""
    return until(read, key, F.col("ts") > F.lit(since), timeout, poll)
