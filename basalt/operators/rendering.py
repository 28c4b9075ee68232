"""Texts of snapshots for a reader: a board, a graph, a roster, a catalogue of roles, and numbered blocks of updates.

A text is rows of parts, each of a bounded number of lines; sentences are rows. The wording is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions.numbering import placed
from basalt.operators.ranking import board_view
from basalt.operators.snapshots import skills, task_line

#: What is shown of nothing: fixed texts.
NO_TASKS, NO_GRAPH = "No current team planning.", "Knowledge graph is empty."
BOARD_HINT = "\nUse get_planning_task(id) for exact ID lookup or search_planning(...) to filter tasks."
GRAPH_HINT = "\nUse the get_graph tool to explore the full graph or subgraphs."
ROSTER_HEAD, ROLES_HEAD = "**Here is the team member list by name (and role):**", "**Here is the available team role list (for hiring):**"


#: Lines of one part of a text.
LINES = 1000


def text_parts(items: DataFrame, before: dict[int, str], between: dict[int, str], lines: int = LINES) -> DataFrame:
    """part (from 0) and text: a text in parts of at most ``lines`` items, which give the whole one after another.

    Items: section, n, s (their order within the section, a number and a text) and line. ``before`` is what stands before a
    section's first item, ``between`` before its others. No rows for no items.
    """
    rows = placed(items.select("section", "n", "s", "line"), "section", "n", "s")
    firsts = rows.groupBy("section").agg(F.min("place").alias("first"))  # a few sections
    told = lambda signs: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (signs or {-1: ""}).items() for x in kv)), F.col("section")), F.lit(""))
    piece = F.concat(F.when(F.col("place") == F.col("first"), told(before)).otherwise(told(between)), "line")
    rows = rows.join(F.broadcast(firsts), "section").select(F.expr(f"(place - 1) div {lines}").alias("part"), F.struct("place", piece.alias("piece")).alias("p"))
    return rows.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["piece"]), "").alias("text"))  # ``lines`` of a part


def items(rows: DataFrame, section: int, line: Column | str, n: Column | int = 0, s: Column | str = "") -> DataFrame:
    """Rows as items of one section of ``text_parts``."""
    whole = lambda x, kind: (F.lit(x) if isinstance(x, (int, str)) else x).cast(kind)
    return rows.select(F.lit(section).alias("section"), whole(n, "long").alias("n"), whole(s, "string").alias("s"), (F.lit(line) if isinstance(line, str) else line).alias("line"))


def _owners(tasks: DataFrame, section: int) -> DataFrame:
    owner = F.coalesce(F.nullif(F.col("owner"), F.lit("")), F.lit("unassigned"))
    counts = tasks.groupBy(owner.alias("owner")).agg(F.count("*").alias("tasks"))
    return items(counts, section, F.concat("owner", F.lit(": "), F.col("tasks").cast("string")), (F.col("owner") == "unassigned").cast("int"), F.col("owner"))


def owner_counts(tasks: DataFrame, lines: int = LINES) -> DataFrame:
    """part and text: tasks by owner, named ones in order, those without one last."""
    return text_parts(_owners(tasks, 0), {}, {0: " | "}, lines)


def counts_map(tasks: DataFrame, key: str, of: str) -> DataFrame:
    """``key`` and counts, a map from each value of ``of`` (few of them) to how many rows have it."""
    counts = tasks.groupBy(key, F.coalesce(F.nullif(F.col(of), F.lit("")), F.lit("unassigned")).alias("of_")).agg(F.count("*").alias("n_"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("of_", "n_")))).alias("counts"))


def board_text(tasks: DataFrame, me: str, own_only: bool = True, lines: int = LINES) -> DataFrame:
    """part and text: the whole board as one agent sees it."""
    seen = board_view(tasks, me, tasks.columns) if own_only else tasks
    total = tasks.agg(F.count("*").alias("n"))  # one row, as is what is made of it
    some = total.filter("n > 0")
    head = items(total, 0, F.when(F.col("n") == 0, NO_TASKS).otherwise(F.concat(F.lit("**Team planning:** "), F.col("n").cast("string"), F.when(F.col("n") == 1, " task total").otherwise(" tasks total"))))
    if own_only:
        own = seen.agg(F.count("*").alias("own"))
        said = F.when(F.col("own") == 0, f"No tasks assigned to or created by {me} yet.").otherwise(f"**Your tasks** (owner or creator: {me}):")
        title = items(some.crossJoin(own), 2, said)  # one row each
    else:
        title = items(some, 2, "**All tasks:**")
    whole = head.unionByName(_owners(tasks, 1)).unionByName(title).unionByName(items(seen, 3, task_line(seen), F.col("ord"))).unionByName(items(some, 4, BOARD_HINT))
    return text_parts(whole, {1: "\nOwners: ", 2: "\n\n", 3: "\n", 4: "\n"}, {1: " | ", 3: "\n"}, lines)


def graph_text(entities: DataFrame, relations: DataFrame, schema: bool = True, roots: bool = True, lines: int = LINES) -> DataFrame:
    """part and text: how large a graph is, and if asked its types and its roots."""
    total = entities.agg(F.count("*").alias("n")).crossJoin(relations.agg(F.count("*").alias("m")))  # one row each
    some = total.filter("n > 0")
    said = F.concat(F.lit("**Knowledge Graph Summary:**\n"), F.format_string("Entities: %d | Relations: %d", "n", "m"))
    whole = items(total, 0, F.when(F.col("n") == 0, NO_GRAPH).otherwise(said))
    if schema:
        for section, rows, kind in ((1, entities, "entity_type"), (2, relations, "relation_type")):
            whole = whole.unionByName(items(rows.filter(F.col(kind).isNotNull()).select(kind).distinct(), section, F.col(kind), s=F.col(kind)))
    if roots:
        line = F.concat(F.lit("- "), "name", F.lit(" ("), "entity_type", F.lit("): "), "description")
        whole = whole.unionByName(items(entities.filter("is_root"), 3, line, F.col("ord")))
    whole = whole.unionByName(items(some, 4, GRAPH_HINT))
    return text_parts(whole, {1: "\nEntity types: ", 2: "\nRelation types: ", 3: "\nRoot entities:\n", 4: "\n"}, {1: ", ", 2: ", ", 3: "\n"}, lines)


def roster_text(members: DataFrame, lines: int = LINES) -> DataFrame:
    """part and text: the members (name, role, is_self, ord) in order; no rows without any."""
    line = F.concat("name", F.lit(" (role: "), "role", F.lit(")"), F.when(F.col("is_self"), " - [you]").otherwise(""))
    return text_parts(items(members, 0, line, F.col("ord")), {0: f"{ROSTER_HEAD}\n"}, {0: "\n"}, lines)


def roles_text(catalogue: DataFrame, lines: int = LINES) -> DataFrame:
    """part and text: the roles (role, description, skills, ord) in order; no rows without any."""
    line = F.concat("role", F.lit(": "), "description", F.lit(" (Skills: "), skills("skills"), F.lit(")"))
    return text_parts(items(catalogue, 0, line, F.col("ord")), {0: f"{ROLES_HEAD}\n"}, {0: "\n"}, lines)


def moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, place and sentence: one row for each field of a task that moved between two snapshots."""
    fields = ("status", "owner", "description", "output")
    a, b = before.select("id", F.struct(*fields).alias("a")), after.select("id", F.struct(*fields).alias("b"))
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    owner = lambda side: F.coalesce(F.nullif(text(side, "owner"), F.lit("")), F.lit("unassigned"))
    task = F.concat(F.lit("ID "), F.col("id").cast("string"))
    told = (
        F.concat(task, F.lit(" ["), text("a", "status"), F.lit("] → ["), text("b", "status"), F.lit("] (Owner: "), owner("b"), F.lit(").")),
        F.concat(task, F.lit(" owner: "), owner("a"), F.lit(" → "), owner("b"), F.lit(".")),
        F.concat(task, F.lit(" description: "), text("b", "description"), F.lit(".")),
        F.when(text("b", "output") == "", F.concat(task, F.lit(" output cleared."))).otherwise(F.concat(task, F.lit(" output: "), text("b", "output"), F.lit("."))),
    )
    said = [F.when(text("a", c) != text("b", c), F.struct(F.lit(i).alias("place"), s.alias("sentence"))) for i, (c, s) in enumerate(zip(fields, told))]
    return a.join(b, "id").select("id", F.explode(F.array_compact(F.array(*said))).alias("c")).select("id", "c.place", "c.sentence")


def block(number: Column | str, sections: Column | str, full: Column | str) -> Column:
    """A numbered update: a marker line that says whether it is the whole state or a change, then the sections (an array), blank lines between."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    said = F.when(col(full), "current state.").otherwise("state has changed since the last update.")
    marker = F.concat(F.lit("**Context update "), col(number).cast("string"), F.lit("** — "), said)
    return F.array_join(F.concat(F.array(marker), col(sections)), "\n\n")


def user_texts(messages: DataFrame) -> DataFrame:
    """message_id, part, item and text: what users wrote, out of messages with nested parts.

    Messages: message_id, kind (request, response), parts (array of kind, content, items), where a
    prompt has a text as its content or else items (array of kind, text). Only texts of user prompts in
    requests count, not tool returns, system prompts or what the model said.
    """
    parts = messages.filter("kind = 'request'").select("message_id", F.posexplode("parts").alias("part", "p")).filter("p.kind = 'user'")
    whole = parts.filter("p.content is not null").select("message_id", "part", F.lit(0).alias("item"), F.col("p.content").alias("text"))
    items = parts.filter("p.content is null").select("message_id", "part", F.posexplode("p.items").alias("item", "i")).filter("i.kind = 'text'")
    return whole.unionByName(items.select("message_id", "part", "item", F.col("i.text").alias("text")))
