"""Rosters, roles, skills and names: rows that are looked up, listed and kept unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.numbering import placed, placed_within
from basalt.operators.snapshots import skills

#: Numbers that are tried as one row.
CHUNK = 4096


def roster(members: DataFrame, me: str) -> DataFrame:
    """name, role and is_self of members; tools (names that begin with #) are left out."""
    return members.filter(~F.startswith("name", F.lit("#"))).select("name", "role", (F.col("name") == me).alias("is_self"))


def roles(catalogue: DataFrame) -> DataFrame:
    """role and a line of text for each role of a catalogue (role, description, skills)."""
    line = F.concat("role", F.lit(": "), "description", F.lit(" (Skills: "), skills("skills"), F.lit(")"))
    return catalogue.select("role", line.alias("line"))


def menu(entries: DataFrame) -> DataFrame:
    """name and line of each entry; bodies are not read."""
    return entries.select("name", F.concat("name", F.lit(" — "), "description").alias("line"))


def lookup(entries: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of the wanted names, and the names that there are none of."""
    return entries.join(wanted.select("name"), "name", "left_semi"), wanted.join(entries.select("name"), "name", "left_anti")


def duplicates(entries: DataFrame, name: str = "name") -> DataFrame:
    """Names that occur more than once, with how often."""
    return entries.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def merged(first: DataFrame, second: DataFrame, key: str = "ref_id") -> DataFrame:
    """key and ord: the distinct keys of two lists (key, ord), those of the first before the second's, each at its first place."""
    both = first.select(key, F.lit(0).alias("list"), "ord").unionByName(second.select(key, F.lit(1).alias("list"), "ord"))
    firsts = both.groupBy(key).agg(F.min(F.struct("list", "ord")).alias("at"))
    return placed(firsts, "at", name="place").select(key, F.col("place").alias("ord"))


def new_names(requests: DataFrame, taken: DataFrame, first: int = 100) -> DataFrame:
    """Requests (role, ord) with a name of @role and a number that no taken row (role, name) has: the smallest free ones from ``first`` on, in order.

    Per role as many numbers are tried as there are requests and taken names, so one is always free.
    They are made ``CHUNK`` to a row, and numbered by ranges, since one role may have any share of the rows.
    """
    asked = placed_within(requests, ["role"], "ord", name="i")
    sizes = asked.groupBy("role").agg(F.count("*").alias("n"))
    counts = sizes.join(taken.groupBy("role").agg(F.count("*").alias("k")), "role", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    last = F.lit(first - 1) + F.col("n") + F.col("k")
    chunks = counts.select("role", last.alias("last"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") + F.col("k") - 1) / CHUNK))).alias("chunk"))
    start = F.lit(first) + F.col("chunk") * CHUNK
    chunks = chunks.repartition("role", "chunk").select("role", F.sequence(start, F.least(start + CHUNK - 1, "last")).alias("numbers"))
    tries = chunks.select("role", F.explode("numbers").alias("number"))
    tries = tries.withColumn("name", F.concat(F.lit("@"), "role", F.col("number").cast("string")))
    # Sorted and merged: a caller's list may be made by explode, which Spark takes for as small as what it reads, and so are the numbers.
    free = tries.join(taken.select("name").hint("merge"), "name", "left_anti")
    free = placed_within(free, ["role"], "number", name="i")
    return asked.join(free.select("role", "i", "name").hint("merge"), ["role", "i"]).drop("i")


def described(functions: DataFrame, extra: DataFrame) -> DataFrame:
    """Functions (name, description) with further instructions (name, text) after their descriptions."""
    more = extra.groupBy("name").agg(F.max("text").alias("text"))
    text = F.concat_ws("\n\n", "description", "text")
    return functions.join(more, "name", "left").select("name", text.alias("description"))


def type_name(type: Column | str) -> Column:
    """What a parameter of a Spark type is called in a description: integer, number, boolean, array, object or string."""
    t = F.col(type) if isinstance(type, str) else type
    out = F.lit("string")
    for pattern, name in ((r"^(map|struct)", "object"), (r"^array", "array"), (r"^boolean", "boolean"), (r"^(float|double|decimal)", "number"), (r"^(tinyint|smallint|int|bigint)", "integer")):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out
