"""Entries with a time to live as the state of a stream.

Each key holds its newest entry and a timer for the moment at which it grows
too old.  Time is that of the entries (the watermark), so a run gives the same
rows whenever it is made, and a stream that starts again goes on from its
checkpoint.  What is held is the living entries, not all that ever came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

OUT = "key string, value string, stored_at timestamp, event string"
STATE = "value string, stored_ms long"
#: The only store of state that has timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiring(StatefulProcessor):
    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for batch in rows:
            ms = batch["stored_at"].astype("datetime64[ms]").astype("int64")
            for at, value in zip(ms.tolist(), batch["value"]):
                if newest is None or (at, value or "") > (newest[1], newest[0] or ""):
                    newest = (value, at)
        held = self.entry.get() if self.entry.exists() else None
        if held is None or newest[1] >= held[1]:
            if held is not None:
                self.handle.deleteTimer(held[1] + self.ttl)
            self.entry.update(newest)
            self.handle.registerTimer(newest[1] + self.ttl)
            yield self._row(key, *newest, "stored")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            held = self.entry.get()
            self.entry.clear()
            yield self._row(key, *held, "expired")

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, value, ms: int, event: str) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "value": [value], "stored_at": [pd.Timestamp(ms, unit="ms")], "event": [event]})


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def expiring(entries: DataFrame, ttl_seconds: float, late: str = "0 seconds") -> DataFrame:
    """The events of a stream of entries (key, value, stored_at): stored, for an
    entry that is its key's newest, and expired, once the stream's time is past
    its time to live.  Older entries of a key are passed over."""
    use_timers(entries.sparkSession)
    grouped = entries.select("key", "value", "stored_at").withWatermark("stored_at", late).groupBy("key")
    return grouped.transformWithStateInPandas(Expiring(ttl_seconds), outputStructType=StructType.fromDDL(OUT), outputMode="Update", timeMode="EventTime")
