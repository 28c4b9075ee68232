"""Mailboxes: owner, msg_id, ord, kind, type, sender, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.numbering import placed, placed_within

#: What a message of a type is called; any other goes by its own name.
TYPES = {"UserMessage": "message", "ResultMessage": "result", "NotificationMessage": "notification"}


def cancels(kind: Column | str = "kind", content: Column | str = "content") -> Column:
    """A cancel message, or a text whose first word is /stop."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    first = F.regexp_extract(F.coalesce(content, F.lit("")), r"^\s*(\S+)", 1)
    return (kind == "cancel") | (first == "/stop")


def read(mailbox: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """The owner's messages with their numbers, cancels left out, and the mailbox without what was read."""
    own = (F.col("owner") == owner) & ~cancels()
    taken = placed(mailbox.filter(own), "ord", name="number")
    return taken, mailbox.filter(~F.coalesce(own, F.lit(False)))


def numbered(messages: DataFrame) -> DataFrame:
    """Messages of all owners with their numbers within their mailbox."""
    return placed_within(messages, ["owner"], "ord")


def sender_name(sender: Column | str = "sender") -> Column:
    return F.coalesce(F.nullif(F.col(sender) if isinstance(sender, str) else sender, F.lit("")), F.lit("unknown"))


def article(word: Column) -> Column:
    return F.when(F.lower(F.substring(word, 1, 1)).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def heading(type: Column | str = "type", sender: Column | str = "sender") -> Column:
    """What was received, and from whom."""
    type = F.col(type) if isinstance(type, str) else type
    name = F.lit(None).cast("string")
    for k, v in TYPES.items():
        name = F.when(type == k, v).otherwise(name)
    name = F.coalesce(name, type)
    return F.concat(F.lit("You received "), article(name), F.lit(" "), name, F.lit(" from "), sender_name(sender))


def rendered(messages: DataFrame, per_part: int = 1000) -> DataFrame:
    """owner, part and text: each owner's numbered messages in order, as texts of ``per_part`` messages, so that a full mailbox is many rows."""
    line = F.concat(F.col("number").cast("string"), F.lit(". "), heading(), F.lit(": "), F.coalesce("content", F.lit("")))
    part = F.floor((F.col("number") - 1) / per_part).cast("long").alias("part")
    lines = messages.groupBy("owner", part).agg(F.sort_array(F.collect_list(F.struct("number", line.alias("line")))).alias("l"))
    return lines.select("owner", "part", F.array_join(F.col("l.line"), "\n").alias("text"))
