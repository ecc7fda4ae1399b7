"""Incremental library sync: a stream of versioned changes folded into the latest item of each key, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key long, version long, payload string, status string"
#: What a streaming query over ``latest_items`` needs to be set in its session: states with timers live in this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LatestItem(StatefulProcessor):
    """The change of the highest version of a key.

    A deletion is remembered by its version, so that a late older change can't undo it, until the version watermark passes it. A
    change behind the watermark of a key that nothing is known of may be older than a deletion that has been forgotten: it asks for
    a full read of its key instead of being believed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "version long, payload string, deleted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        held = self.item.get() if self.item.exists() else None
        best, lost = held, -1
        for frame in rows:
            for version, op, payload in frame[["version", "op", "payload"]].itertuples(index=False):
                if best is None and version < passed and op != "full":
                    lost = max(lost, int(version))
                elif best is None or version > best[0]:
                    best = (int(version), None if op == "delete" else payload, op == "delete")
        if best is not None and best != held:
            self.item.update(best)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if best[2]:
                self.handle.registerTimer(max(best[0], passed) * 1000 + 1)
            yield self._row(key, best[0], best[1], "deleted" if best[2] else "live")
        elif best is None and lost >= 0:
            yield self._row(key, lost, None, "resync")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.item.exists() and self.item.get()[2]:
            self.item.clear()
        return iter([])

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, version: int, payload: str | None, status: str) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "version": [version], "payload": pd.Series([payload], dtype="object"), "status": [status]})


def latest_items(changes: DataFrame, keep: int = 0) -> DataFrame:
    """changes(key, version, library, op, payload), a stream with op put, delete or full (what a full read of a key found) -> an update
    for each key that changed: live, deleted, or resync where its state can't be told without a full read.

    ``library`` is the library's version when the change was read. It is the stream's clock: the watermark is the highest one seen
    less ``keep``, and deletions before it leave the state. So the state holds the live items and the deletions of the last
    ``keep`` versions. A change may be older than the watermark; it is the reading of it that is not.
    """
    timed = changes.withColumn("at", F.timestamp_seconds("library")).withWatermark("at", f"{keep} seconds")
    return timed.groupBy("key").transformWithStateInPandas(LatestItem(), OUT, "Update", "EventTime")
