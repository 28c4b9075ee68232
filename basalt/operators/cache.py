"""A keyed cache replayed from its events: key, event (request, deliver, fail, get), value, t (seconds), ord."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a failure is remembered, and entries that are kept.
NEGATIVE, CAPACITY = 60.0, 128


def contents(events: DataFrame, now: float, capacity: int | None = CAPACITY, negative: float = NEGATIVE) -> DataFrame:
    """key, value, state (value, failed) of the entries that are kept at ``now``: the most recently used ones.

    A delivery or failure makes an entry, later ones replace it; requests and reads count as uses of
    it. A failure is forgotten after ``negative`` seconds; until it is replaced or pushed out, it takes a place.
    Without a capacity, nothing is pushed out.
    """
    made = events.filter(F.col("event").isin("deliver", "fail")).groupBy("key").agg(F.max_by(F.struct("event", "value", "t"), "ord").alias("last"), F.min("ord").alias("since"))
    used = events.join(made.select("key", "since"), "key").filter("ord >= since").groupBy("key").agg(F.max("ord").alias("used"))
    kept = made
    if capacity is not None:
        kept = made.join(used, "key").withColumn("place", F.row_number().over(Window.orderBy(F.desc("used")))).filter(F.col("place") <= capacity)
    live = kept.filter((F.col("last.event") == "deliver") | (F.col("last.t") + negative > now))
    return live.select("key", "last.value", F.when(F.col("last.event") == "deliver", "value").otherwise("failed").alias("state"))


def in_flight(events: DataFrame) -> DataFrame:
    """key of requests that nothing has answered since; a second request of such a key starts nothing."""
    when = lambda *kinds: F.max(F.when(F.col("event").isin(*kinds), F.col("ord")))
    last = events.groupBy("key").agg(when("request").alias("asked"), when("deliver", "fail").alias("told"))
    return last.filter("asked is not null and (told is null or asked > told)").select("key")


def started(events: DataFrame, negative: float = NEGATIVE) -> DataFrame:
    """key, ord and t of the requests that start work: nothing in flight, no value, no failure that is still remembered."""
    w = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    told = F.last(F.when(F.col("event").isin("deliver", "fail"), F.struct("event", "t", "ord")), True).over(w)
    asked = F.last(F.when(F.col("event") == "request", F.col("ord")), True).over(w)
    rows = events.withColumn("told", told).withColumn("asked", asked).filter("event = 'request'")
    flying = F.col("asked").isNotNull() & (F.col("told").isNull() | (F.col("asked") > F.col("told.ord")))
    known = F.col("told").isNotNull() & ((F.col("told.event") == "deliver") | (F.col("told.t") + negative > F.col("t")))
    return rows.filter(~flying & ~known).select("key", "ord", "t")
