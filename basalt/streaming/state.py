"""What is kept between micro-batches, and read by others without the stream: caches, the last word on each id, and gaps of sequence numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from basalt.operators.cache import CAPACITY, NEGATIVE
from basalt.streaming.timers import ROCKS

_KEY = StructType([StructField("key", StringType())])
#: An entry: its value (null for a failure), until when a failure holds, and when the entry was used last.
_ENTRY = StructType([StructField("value", StringType()), StructField("failed", BooleanType()), StructField("until", DoubleType()), StructField("used", LongType())])
_ASKED = StructType([StructField("ord", LongType())])
ANSWERS = StructType([StructField("owner", StringType()), StructField("key", StringType()), StructField("ord", LongType()), StructField("event", StringType()), StructField("answer", StringType()), StructField("value", StringType())])
#: Sequence numbers of one segment are kept together.
SEGMENT = 1 << 20


def _rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Cache(StatefulProcessor):
    """One owner's cache: its entries, the keys that work is under way for, and nothing else."""

    def __init__(self, capacity: int | None, negative: float) -> None:
        self.capacity, self.negative = capacity, negative

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", _KEY, _ENTRY)
        self.flying = handle.getMapState("flying", _KEY, _ASKED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("ord", kind="stable")
        # The batch's work is done on copies: no more than ``capacity`` entries, and a key in flight for each request that is not answered.
        entries = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        flying = {k[0]: v[0] for k, v in self.flying.iterator()}
        before, asked = dict(entries), dict(flying)
        told = [(e.key, int(e.ord), e.event, *self._step(e, entries, flying)) for e in events.itertuples()]
        for state, now, was, made in ((self.entries, entries, before, tuple), (self.flying, flying, asked, lambda v: (v,))):
            for k in was.keys() - now.keys():
                state.removeKey((k,))
            for k, v in now.items():
                if was.get(k) != v:
                    state.updateValue((k,), made(v))
        yield pd.DataFrame({"owner": [key[0]] * len(told), **{f.name: [r[i] for r in told] for i, f in enumerate(ANSWERS.fields[1:])}}).astype({"ord": "int64"})

    def _step(self, e, entries: dict, flying: dict) -> tuple[str, str | None]:
        """What the event is answered with, and the value if it asks for one."""
        held = entries.get(e.key)
        known = held is not None and (not held[1] or held[2] > e.t)
        if e.event in ("deliver", "fail"):
            flying.pop(e.key, None)
            failed = e.event == "fail"
            entries[e.key] = (None if failed else e.value, failed, float(e.t) + self.negative if failed else 0.0, int(e.ord))
            if self.capacity is not None and len(entries) > self.capacity:
                del entries[min(entries, key=lambda k: entries[k][3])]
            return "kept", None
        if held is not None:
            entries[e.key] = (*held[:3], int(e.ord))
        if e.event == "get":
            return ("found", held[0]) if known and not held[1] else ("none", None)
        if e.key in flying or known:
            return ("in flight" if e.key in flying else "known"), None
        flying[e.key] = int(e.ord)
        return "started", None

    def close(self) -> None:
        pass


def cached(events: DataFrame, capacity: int | None = CAPACITY, negative: float = NEGATIVE) -> DataFrame:
    """owner, key, ord, event, answer and value for each event of a stream (owner, key, event, value, t in seconds, ord).

    A request is ``started`` if nothing is in flight for its key and no value or remembered failure is
    held; a get is ``found`` with the value, or ``none``. Deliveries and failures are ``kept``; beyond
    ``capacity`` the entry goes that was used longest ago. A failure is forgotten after ``negative``
    seconds of the events' own time. An owner's events come in the order of ord from batch to batch.
    One owner's cache is one key of the state, bounded by the capacity; owners are spread over the partitions.
    """
    _rocks(events.sparkSession)
    kinds = "cast(owner as string) as owner, cast(key as string) as key, event, cast(value as string) as value, cast(t as double) as t, cast(ord as long) as ord"
    rows = events.selectExpr(*kinds.split(", "))
    return rows.groupBy("owner").transformWithStateInPandas(_Cache(capacity, negative), ANSWERS, "Append", "None")


def kept_entries(spark: SparkSession, checkpoint: str, now: float) -> DataFrame:
    """owner, key, value and state (value, failed) of the entries that a stream of ``cached`` holds at ``now``, read from its state."""
    rows = spark.read.format("statestore").option("stateVarName", "entries").load(checkpoint)
    e = F.col("user_map_value")
    live = rows.select(F.col("key")["owner"].alias("owner"), F.col("user_map_key")["key"].alias("key"), e["value"].alias("value"), e["failed"].alias("failed"), e["until"].alias("until"))
    return live.filter((~F.col("failed")) | (F.col("until") > now)).select("owner", "key", "value", F.when(F.col("failed"), "failed").otherwise("value").alias("state"))


def keys_in_flight(spark: SparkSession, checkpoint: str) -> DataFrame:
    """owner and key of what a stream of ``cached`` waits for."""
    rows = spark.read.format("statestore").option("stateVarName", "flying").load(checkpoint)
    return rows.select(F.col("key")["owner"].alias("owner"), F.col("user_map_key")["key"].alias("key"))


def folded(events: DataFrame) -> DataFrame:
    """tool_id, kind, ref_id and the last word (seq, gone) on each, as a stream of what changed; the fold itself is the stream's state."""
    return events.groupBy("tool_id", "kind", "ref_id").agg(F.max(F.struct("seq", (F.col("op") == "removed").alias("gone"))).alias("last"))


def run(changes: DataFrame, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Runs a stateful stream over what there is, for its state alone."""
    _rocks(changes.sparkSession)
    return changes.writeStream.format("noop").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def present(spark: SparkSession, checkpoint: str) -> DataFrame:
    """tool_id, kind and ref_id of what is there by the state of a stream of ``folded``: a late joiner reads no event."""
    rows = spark.read.format("statestore").load(checkpoint)
    last = F.col(f"value.`{rows.schema['value'].dataType.names[0]}`")
    return rows.filter(~last["gone"]).select("key.tool_id", "key.kind", "key.ref_id")


class _Ranges(StatefulProcessor):
    """The sequence numbers met in one segment of a tool, as ranges: first number to last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = StructType([StructField("seq", LongType())])
        self.ranges = handle.getMapState("ranges", number, number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Numbers of eight bytes in arrays all along: a segment's worth of Python numbers would be many times as large.
        held = np.fromiter((x for k, v in self.ranges.iterator() for x in (k[0], v[0])), np.int64).reshape(-1, 2)
        new = np.unique(np.concatenate([np.unique(frame["seq"].to_numpy(np.int64)) for frame in rows]))
        both = np.concatenate([held, np.column_stack([new, new])])
        both = both[np.argsort(both[:, 0], kind="stable")]
        last = np.maximum.accumulate(both[:, 1])
        begins = np.flatnonzero(np.append(True, both[1:, 0] > last[:-1] + 1))
        now = np.column_stack([both[begins, 0], last[np.append(begins[1:], len(both)) - 1]])
        for a in np.setdiff1d(held[:, 0], now[:, 0], assume_unique=True):
            self.ranges.removeKey((int(a),))
        same = np.zeros(len(now), bool)
        if len(held):
            held = held[np.argsort(held[:, 0])]
            at = np.minimum(np.searchsorted(held[:, 0], now[:, 0]), len(held) - 1)
            same = (held[at] == now).all(1)
        for a, b in now[~same]:
            self.ranges.updateValue((int(a),), (int(b),))
        yield pd.DataFrame({"tool_id": [key[0]], "ranges": [len(now)]}).astype({"ranges": "int64"})

    def close(self) -> None:
        pass


def met(events: DataFrame) -> DataFrame:
    """A stream that keeps which sequence numbers (tool_id, seq) were met, in any order and as often as they come, as ranges in its state."""
    _rocks(events.sparkSession)
    rows = events.select("tool_id", F.col("seq").cast("long").alias("seq")).withColumn("segment", F.expr(f"seq div {SEGMENT}"))
    out = StructType([StructField("tool_id", StringType()), StructField("ranges", LongType())])
    return rows.groupBy("tool_id", "segment").transformWithStateInPandas(_Ranges(), out, "Append", "None")


def gaps_met(spark: SparkSession, checkpoint: str) -> DataFrame:
    """tool_id and seq of numbers whose predecessor a stream of ``met`` has not seen. As many ranges are read as there are gaps and segments."""
    rows = spark.read.format("statestore").option("stateVarName", "ranges").load(checkpoint)
    ranges = rows.select("key.tool_id", F.col("user_map_key")["seq"].alias("seq"), F.col("user_map_value")["seq"].alias("last"))
    before = F.lag("last").over(Window.partitionBy("tool_id").orderBy("seq"))
    return ranges.withColumn("before", before).filter((F.col("seq") > 1) & (F.coalesce("before", F.lit(-1)) < F.col("seq") - 1)).select("tool_id", "seq")
