"""Timers: notification_id, owner_id, owner_name, content, created_at, fire_at; and a roster of present names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.numbering import placed

#: Seconds that a due timer waits for an absent owner.
GRACE = 300


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, with their fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def due(fire_at: Column, now: Column) -> Column:
    """Whether a timer's time has come."""
    return fire_at <= now


def cut_off(now: Column, seconds_: int) -> Column:
    """The moment that many seconds ago: what is older is stale."""
    return now - F.make_dt_interval(secs=F.lit(seconds_))


def marked_line(show_owner: bool) -> Column:
    """A timer's content, in a list of all owners with the owner's name before it."""
    return F.concat(F.lit("@"), "owner_name", F.lit(" "), "content") if show_owner else F.col("content")


def decide(timers: DataFrame, roster: DataFrame | None, now: Column, grace: int = GRACE) -> DataFrame:
    """Timers with decision: waiting (not due), delivered, postponed (owner absent) or dropped (absent for ``grace``).

    Owners are found by name. Without a roster every due timer is delivered.
    """
    come = due(F.col("fire_at"), now)
    if roster is None:
        return timers.withColumn("decision", F.when(come, "delivered").otherwise("waiting"))
    present = roster.select(F.col("name").alias("owner_name"), F.lit(True).alias("present")).distinct()
    late = seconds(now, F.col("fire_at")) >= grace
    decision = F.when(~come, "waiting").when(F.col("present"), "delivered").when(late, "dropped").otherwise("postponed")
    return timers.join(present, "owner_name", "left").withColumn("decision", decision).drop("present")


def remaining(decided: DataFrame) -> DataFrame:
    """The timers that stay in the table after a tick."""
    return decided.filter(F.col("decision").isin("waiting", "postponed")).drop("decision")


def schedule(timers: DataFrame, requests: DataFrame) -> DataFrame:
    """Timers and the requests (owner_id, owner_name, content, created_at, delay seconds, ord) numbered after them."""
    base = timers.agg(F.coalesce(F.max("notification_id"), F.lit(0)).alias("base"))
    new = placed(requests, "ord", name="n").crossJoin(F.broadcast(base))
    fire = F.col("created_at") + F.make_dt_interval(secs=F.col("delay"))
    return timers.unionByName(new.select((F.col("base") + F.col("n")).alias("notification_id"), "owner_id", "owner_name", "content", "created_at", fire.alias("fire_at")))


def cancel(timers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Timers left, and requests (notification_id, owner_id) that name no timer of that owner."""
    keys = ["notification_id", "owner_id"]
    return timers.join(requests, keys, "left_anti"), requests.join(timers, keys, "left_anti")


def listing(timers: DataFrame, now: Column, owner_id: str | None = None) -> DataFrame:
    """notification_id, line and seconds_left (whole, half to even, none below 0), of one owner or of all with their names."""
    own = timers if owner_id is None else timers.filter(F.col("owner_id") == owner_id)
    left = F.greatest(F.lit(0).cast("long"), F.bround(seconds(F.col("fire_at"), now), 0).cast("long"))
    line = F.col("content") if owner_id is not None else F.concat("owner_name", F.lit(": "), "content")
    return own.select("notification_id", line.alias("line"), left.alias("seconds_left")).orderBy("notification_id")
