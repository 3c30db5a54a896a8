"""Expiry of items by event time: one timer for each item, set anew by each of its updates.

A stream of updates (id, kind, updated_at) keeps for each id the time of its last update. Each kind lives for its own
time; when the watermark passes an item's end, its timer puts out the expiry and its state goes. An update after that, or one
that comes while the watermark still lags behind the item's end, starts the item anew. Updates that are not after the
watermark are late and are left out. State is what is alive, so it does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EXPIRED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("started_at", T.TimestampType()),
    T.StructField("last_at", T.TimestampType()), T.StructField("updates", T.LongType()), T.StructField("expired_at", T.TimestampType()),
])
#: Timers need the state store that keeps them sorted.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def moment(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class Expiry(StatefulProcessor):
    """Times are kept in milliseconds, as timers are."""

    def __init__(self, ttl_ms: dict[str, int]):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alive", "kind string, first long, last long, updates long")

    def ended(self, key, value) -> Row:
        kind, first, last, updates = value
        return Row(id=key[0], kind=kind, started_at=moment(first), last_at=moment(last), updates=updates, expired_at=moment(last + self.ttl_ms[kind]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        value = tuple(self.state.get()) if self.state.exists() else None
        before = value and value[2] + self.ttl_ms[value[0]]
        for ms, kind in sorted((r.ms, r.kind) for r in rows):
            if value is not None and ms >= value[2] + self.ttl_ms[value[0]]:
                yield self.ended(key, value)
                value = None
            value = (kind, ms, ms, 1) if value is None else (value[0], min(value[1], ms), max(value[2], ms), value[3] + 1)
        if value is None:
            return
        self.state.update(value)
        end = value[2] + self.ttl_ms[value[0]]
        if end != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            value = tuple(self.state.get())
            if value[2] + self.ttl_ms[value[0]] <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield self.ended(key, value)

    def close(self) -> None:
        pass


def expired_items(updates: DataFrame, ttl_ms: dict[str, int], delay: str) -> DataFrame:
    """A stream of the items whose time has passed. Items of kinds without a time to live do not expire.

    Millisecond parts of updated_at count, smaller ones are cut off. The session needs ``STATE_STORE``.
    """
    kinds = F.col("kind").isin(*ttl_ms)
    rows = updates.filter(kinds & F.col("updated_at").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), "kind", "updated_at", F.unix_millis("updated_at").alias("ms"))
    timed = rows.withWatermark("updated_at", delay)
    return timed.groupBy("id").transformWithState(statefulProcessor=Expiry(ttl_ms), outputStructType=EXPIRED, outputMode="Append", timeMode="EventTime")
