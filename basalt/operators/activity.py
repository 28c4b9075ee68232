"""Who is busy with what, from an event log: kind (received, processed, sent), message_id, agent_id, name,
role, is_user_proxy, ts, text, ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def excluded(caller: str) -> Column:
    """Events of the caller, of tools (names that begin with #), and of a person's proxy."""
    return (F.col("agent_id") == caller) | F.col("name").startswith("#") | F.coalesce("is_user_proxy", F.lit(False))


def open_events(log: DataFrame, caller: str, now: Column, stale_seconds: int = 300) -> DataFrame:
    """Received messages that nobody has processed, no older than the limit; without a time they don't count."""
    done = log.filter("kind = 'processed'").select("message_id")
    received = log.filter((F.col("kind") == "received") & ~excluded(caller) & (F.col("ts") >= now - F.make_dt_interval(secs=F.lit(stale_seconds))))
    return received.join(done, "message_id", "left_anti")


def busy(log: DataFrame, caller: str, now: Column, stale_seconds: int = 300) -> DataFrame:
    """One row per busy agent: its oldest open message, since when, whether it has several (suspect), and that message's last sent text.

    Of equal times the first logged counts; a message without a text shows its kind in brackets.
    """
    oldest = F.min(F.struct("ts", "ord", "message_id", "name", "role")).alias("first")
    rows = open_events(log, caller, now, stale_seconds).groupBy("agent_id").agg(oldest, (F.count("*") > 1).alias("suspect"))
    rows = rows.select("agent_id", "first.name", "first.role", "first.message_id", F.col("first.ts").alias("started_at"), "suspect")
    sent = log.filter("kind = 'sent'").groupBy("message_id").agg(F.max_by("text", "ord").alias("text"))
    return rows.join(sent, "message_id", "left").withColumn("text", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit("<message>")))


def latest_texts(messages: DataFrame, key: str, ord: str, text: str = "text") -> DataFrame:
    """``key`` and text: the last text of each key."""
    return messages.groupBy(key).agg(F.max_by(text, ord).alias("text"))


def unanswered(log: DataFrame) -> DataFrame:
    """The received messages of a log that nobody has processed, of whatever age."""
    return log.filter("kind = 'received'").join(log.filter("kind = 'processed'").select("message_id"), "message_id", "left_anti")


def message_text(content: Column | str, type: Column | str) -> Column:
    """A message's text, or its type in brackets where it has none."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(col(content), F.lit("")), F.concat(F.lit("<"), col(type), F.lit(">")))


def clipped(text: Column | str, most: int) -> Column:
    """At most ``most`` characters, the last being an ellipsis if something was cut; nothing for 0 or less."""
    text = F.col(text) if isinstance(text, str) else text
    if most <= 0:
        return F.lit("")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def with_summaries(rows: DataFrame, summaries: DataFrame, most: int = 80) -> DataFrame:
    """Rows (message_id, text) with a summary where one is known (message_id, value), else a clipped text, and pending."""
    known = summaries.select("message_id", "value")
    joined = rows.join(known, "message_id", "left")
    return joined.withColumn("shown", F.coalesce("value", clipped("text", most))).withColumn("pending", F.col("value").isNull()).drop("value")


def pending(rows: DataFrame) -> DataFrame:
    """One row: how many wait for a summary."""
    return rows.agg(F.count_if("pending").alias("pending"))
