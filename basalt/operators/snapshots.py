"""Differences of two snapshots of a board, a graph, a roster or a catalogue of roles, and numbered update blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("status", "owner", "description", "output")


def board_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, kind (new, removed, or the field that moved), old and new of tasks in two snapshots.

    A change of the creator alone is told by no field. A full outer join on id, then one row a change.
    """
    a = before.select("id", F.struct(*FIELDS).alias("a"))
    b = after.select("id", F.struct(*FIELDS).alias("b"))
    change = lambda kind, old, new: F.struct(F.lit(kind).alias("kind"), old.alias("old"), new.alias("new"))
    none = F.lit(None).cast("string")
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    moved = [F.when(~text("a", c).eqNullSafe(text("b", c)), change(c, text("a", c), text("b", c))) for c in FIELDS]
    told = F.when(F.col("a").isNull(), F.array(change("new", none, text("b", "status")))).when(F.col("b").isNull(), F.array(change("removed", text("a", "status"), none)))
    rows = a.join(b, "id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return rows.select("id", F.explode(F.coalesce(told, F.array_compact(F.array(*moved)))).alias("c")).select("id", "c.kind", "c.old", "c.new")


def set_changes(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """The keys and change: added or removed; each key once."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    added = b.join(a, list(keys), "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, list(keys), "left_anti").withColumn("change", F.lit("removed")))


def multiset_changes(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """The keys, n and change: how many more rows (added) or fewer (removed) have them in the second table."""
    count = lambda df: df.groupBy(*keys).agg(F.count("*").alias("n_"))
    more = count(after).withColumnRenamed("n_", "new_").join(count(before).withColumnRenamed("n_", "old_"), list(keys), "full_outer").fillna(0, ["new_", "old_"])
    n = F.col("new_") - F.col("old_")
    return more.filter(n != 0).select(*keys, F.abs(n).alias("n"), F.when(n > 0, "added").otherwise("removed").alias("change"))


def role_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """role and change (added, removed, described anew) of catalogues with role, description and skills (array)."""
    a = before.select("role", F.struct("description", "skills").alias("a"))
    b = after.select("role", F.struct("description", "skills").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("described anew")
    return a.join(b, "role", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("role", change.alias("change"))


def signed(n: Column | str) -> Column:
    """With a plus sign if positive."""
    n = F.col(n) if isinstance(n, str) else n
    return F.concat(F.when(n > 0, "+").otherwise(""), n.cast("string"))


def count_movement(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """label, n and moved (signed) if the number of rows changed; else no row."""
    sides = before.agg(F.count("*").alias("old")).crossJoin(after.agg(F.count("*").alias("n")))  # one row each
    return sides.filter("old <> n").select(F.lit(label).alias("label"), "n", signed(F.col("n") - F.col("old")).alias("moved"))


def task_line(df: DataFrame) -> Column:
    """One line of text for a task: id, status, description, output if any, owner and creator."""
    output = F.when(F.coalesce("output", F.lit("")) != "", F.concat(F.lit(" — Output: "), "output")).otherwise("")
    owner = F.coalesce(F.nullif(F.col("owner"), F.lit("")), F.lit("unassigned"))
    return F.concat(F.lit("- ID "), F.col("id").cast("string"), F.lit(" ["), "status", F.lit("] "), "description", output, F.lit(" (Owner: "), owner, F.lit(", Creator: "), F.coalesce("creator", F.lit("")), F.lit(")"))


def skills(column: Column | str) -> Column:
    return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise("none")


def due_updates(sections: DataFrame, baselines: DataFrame) -> DataFrame:
    """provider, number and mode (full or delta) for the providers whose state differs from its baseline.

    Sections and baselines: provider, kind, state (text); baselines also number. A provider without a
    baseline, or of another kind than it, is shown in full; an equal one is not shown.
    """
    b = baselines.select("provider", F.col("kind").alias("b_kind"), F.col("state").alias("b_state"), "number")
    joined = sections.join(b, "provider", "left")
    full = F.col("b_kind").isNull() | (F.col("b_kind") != F.col("kind"))
    shown = joined.filter(full | (F.col("state") != F.col("b_state")))
    return shown.select("provider", F.when(full, "full").otherwise("delta").alias("mode"), (F.coalesce("number", F.lit(0)) + 1).cast("long").alias("number"))


def advanced(sections: DataFrame, baselines: DataFrame) -> DataFrame:
    """The baselines after an update: every section's state, numbered one higher where it was shown."""
    shown = due_updates(sections, baselines).select("provider", F.col("number").alias("next"))
    old = baselines.select("provider", "number")
    return sections.join(shown, "provider", "left").join(old, "provider", "left").select("provider", "kind", "state", F.coalesce("next", "number").alias("number"))


def highest_number(history: DataFrame, text: str = "text", marker: str = "update #") -> DataFrame:
    """One row: the largest number after the marker in any text, 0 if there is none."""
    found = history.select(F.explode(F.regexp_extract_all(text, F.lit(f"\\Q{marker}\\E(\\d{{1,18}})"), F.lit(1))).alias("n"))
    return found.agg(F.coalesce(F.max(F.col("n").cast("long")), F.lit(0)).alias("number"))
