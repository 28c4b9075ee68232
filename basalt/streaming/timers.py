"""Timers as a stream: requests come in, notifications go out when their time has passed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

OUTPUT = StructType([StructField("notification_id", LongType()), StructField("owner_name", StringType()), StructField("content", StringType()), StructField("fire_at_ms", LongType())])
#: The timers of one bucket, each field a list in the same order.
STATE = StructType([StructField(f.name, ArrayType(f.dataType)) for f in OUTPUT])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Timers(StatefulProcessor):
    """The timers of one bucket of ids: a request sets one, a cancel of its owner clears it, its time delivers it once.

    Spark is asked to come back at the earliest time only; all that are due by then are delivered at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", STATE)

    def _read(self) -> dict:
        """By id: owner, content and time."""
        held = self.pending.get()
        return {i: (owner, content, at) for i, owner, content, at in zip(*held)} if held else {}

    def _write(self, timers: dict) -> None:
        if timers:
            owners, contents, times = map(list, zip(*timers.values()))
            self.pending.update((list(timers), owners, contents, times))
        else:
            self.pending.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("ts", kind="stable")
        ids = asked["notification_id"].tolist() if key[0] >= 0 else [None] * len(asked)
        timers, changed = self._read(), False
        first = _earliest(timers)
        for i, kind, owner, content, at in zip(ids, *(asked[c].tolist() for c in ("kind", "owner_name", "content", "fire_at_ms"))):
            held = timers.get(i)
            if kind == "schedule" and held is None:
                timers[i], changed = (owner, content, int(at)), True
            elif kind == "cancel" and held is not None and held[0] == owner:
                del timers[i]
                changed = True
        if changed:
            self._write(timers)
            self._wake(first, _earliest(timers))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timers, now = self._read(), timerValues.getCurrentWatermarkInMs()
        due = [(i, *t) for i, t in timers.items() if t[2] <= now]
        left = {i: t for i, t in timers.items() if t[2] > now}
        self._write(left)
        self._wake(None, _earliest(left))
        if due:
            yield pd.DataFrame(due, columns=OUTPUT.names)

    def _wake(self, before: int | None, at: int | None) -> None:
        """Spark comes back when the watermark is above the time that is set: a timer is due as soon as it is reached."""
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before - 1)
            if at is not None:
                self.handle.registerTimer(at - 1)

    def close(self) -> None:
        pass


def _earliest(timers: dict) -> int | None:
    return min((t[2] for t in timers.values()), default=None)


def deliveries(requests: DataFrame, delay: str = "0 seconds", buckets: int = 2048) -> DataFrame:
    """notification_id, owner_name, content and fire_at_ms of timers whose time the stream's watermark has reached.

    Requests: notification_id, kind (schedule, cancel), owner_name, content, fire_at and ts (timestamps).
    The session needs the RocksDB state store; the timers are kept there, dealt to ``buckets`` by notification_id.
    A batch reads and writes the buckets that it has requests for or that have timers due, each as a whole,
    so a task holds one bucket's timers at a time. The number of buckets stays as it is for a checkpoint's life.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # Requests without an id have a bucket of their own, since numbers beside nulls would come as floats.
    bucket = F.when(F.col("notification_id").isNull(), -1).otherwise(F.pmod(F.hash("notification_id"), F.lit(buckets)))
    rows = requests.withWatermark("ts", delay).select(bucket.alias("bucket"), "notification_id", "kind", "owner_name", "content", F.unix_millis("fire_at").alias("fire_at_ms"), "ts")
    return rows.groupBy("bucket").transformWithStateInPandas(_Timers(), OUTPUT, "Append", "EventTime")


def with_presence(delivered: DataFrame, roster: DataFrame) -> DataFrame:
    """Deliveries with whether the owner is present: a join of the stream with the roster of the moment."""
    return delivered.join(roster.select(F.col("name").alias("owner_name"), F.lit(True).alias("present")).distinct(), "owner_name", "left").fillna({"present": False})
