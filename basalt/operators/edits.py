"""Edits and patches of text files, set-wise: edits (edit_id, path, old, new, ord) and unified diffs (patch_id, text)."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.text import let, lines

#: Likeness from which on a window counts as found.
ALIKE = 0.85
HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _line_place(content: Column, wanted: Column) -> Column:
    """The first line (from 1) of a text at which the wanted ones stand, or null: lines are parted and framed by line feeds, so one search finds them."""
    framed = lambda x: F.concat(F.lit("\n"), x, F.lit("\n"))
    upto = lambda text: F.substring(text, F.lit(1), F.instr(text, framed(wanted)))
    line = lambda head: F.nullif(F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))), F.lit(0))
    return let(framed(content), lambda text: let(upto(text), line))


def _likeness(window: Column, wanted: Column) -> Column:
    """Twice the lines in matching runs, by all lines of both."""

    def run(windows: pa.Array, wanteds: pa.Array) -> pa.Array:
        return pa.array([difflib.SequenceMatcher(None, x, w, autojunk=False).ratio() for x, w in zip(windows.to_pylist(), wanteds.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double")(window, wanted)


def most_alike(rows: DataFrame) -> DataFrame:
    """edit_id and line: where the window most like the wanted lines begins, the first of such; only windows that are alike enough.

    Rows: edit_id (each once), l (the file's lines) and w (the lines wanted). A window has as many lines
    as are wanted. Its lines that are wanted anywhere bound its likeness from above, so only windows with
    enough of them go on, as rows of their own, and are compared in order. A file with too few such
    lines in all has no such window.
    """

    def alike_enough(row: Column) -> Column:
        l, w, n = row["l"], row["w"], F.size(row["w"])
        enough = lambda hit: lambda i: F.aggregate(F.slice(hit, i, n), F.lit(0), lambda s, h: s + h) >= F.lit(ALIKE) * n
        window = lambda i: F.struct(i.alias("line"), F.slice(l, i, n).alias("window"))
        starts = lambda hit: F.when(F.size(F.filter(hit, lambda h: h > 0)) >= F.lit(ALIKE) * n, F.transform(F.filter(F.sequence(F.lit(1), F.size(l) - n + 1), enough(hit)), window))
        return F.when((n > 0) & (F.size(l) >= n), let(F.transform(l, lambda t: F.array_contains(w, t).cast("int")), starts))

    windows = rows.select("edit_id", "w", F.explode(let(F.struct("l", "w"), alike_enough)).alias("s")).select("edit_id", "s.line", "s.window", "w")
    like = windows.select("edit_id", "line", _likeness(F.col("window"), F.col("w")).alias("like")).filter(F.col("like") >= ALIKE)
    return like.groupBy("edit_id").agg(F.max_by("line", F.struct("like", -F.col("line"))).alias("line"))


def located(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Edits with content, start, length (in characters) and strategy; start is null where nothing is found.

    In turn: the exact text; its lines without outer blanks; runs of blanks as one; without common
    indentation; without blank lines around; with \\n, \\t and \\" undone; the most similar window of
    lines. All but the exact ones find whole lines. edit_id tells edits apart. An edit without a text to
    look for finds nothing.
    """
    rows = edits.join(files.select("path", "content"), "path", "left")
    c, old = F.col("content"), F.col("old")
    # Of whole texts, each read once: within a line there are no blanks but these.
    squeezed = lambda x: F.regexp_replace(F.array_join(x, "\n"), "[ \\t]+", " ")
    stripped = lambda x: F.regexp_replace(F.array_join(x, "\n"), "(?dm)^[ \\t]+|(?<![ \\t])[ \\t]++$", "")
    bare, undone = F.regexp_replace(old, "^\\n+|\\n+$", ""), F.replace(F.replace(F.replace(old, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    indent = F.array_min(F.transform(F.filter(lines(old), lambda t: F.trim(t) != ""), lambda t: F.length(F.regexp_extract(t, "^[ \\t]*", 0))))
    dedented = let(F.coalesce(indent, F.lit(0)), lambda n: F.transform(lines(old), lambda t: F.when(F.trim(t) == "", F.lit("")).otherwise(F.substr(t, n + 1))))
    at = lambda text: F.nullif(F.instr(c, text), F.lit(0))
    spot = lambda start, length, name: F.when(start.isNotNull(), F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), F.lit(name).alias("strategy")))

    def by_line(l: Column, w: Column, line: Column, name: str) -> Column:
        joined = F.array_join(l, "\n") == F.regexp_replace(c, "\\n$", "")
        before = F.aggregate(F.slice(l, F.lit(1), F.coalesce(line, F.lit(1)) - 1), F.lit(0), lambda s, t: s + F.length(t) + 1)
        size = F.aggregate(F.slice(l, F.coalesce(line, F.lit(1)), F.size(w)), F.lit(0), lambda s, t: s + F.length(t) + 1)
        return F.when(line.isNotNull() & joined, let(before, lambda b: spot(b + 1, F.least(size, F.length(c) - b), name)))

    def plain(row: Column) -> Column:
        l, w = row["l"], row["w"]
        by_lines = lambda kind, name: F.when((F.size(w) > 0) & (F.size(l) >= F.size(w)), let(_line_place(kind(l), kind(w)), lambda line: by_line(l, w, line, name)))
        return F.coalesce(
            by_lines(stripped, "line_trimmed"),
            by_lines(squeezed, "whitespace_normalised"),
            F.when(F.coalesce(indent, F.lit(0)) > 0, let(F.array_join(dedented, "\n"), lambda d: spot(at(d), F.length(d), "dedented"))),
            F.when(bare != old, spot(at(bare), F.length(bare), "trimmed_boundary")),
            F.when(undone != old, spot(at(undone), F.length(undone), "escape_normalised")),
        )

    split = F.struct(lines(c).alias("l"), lines(old).alias("w"))
    rows = rows.withColumn("p", F.coalesce(spot(at(old), F.length(old), "exact"), let(split, plain)))
    fuzzy = most_alike(rows.filter("p is null and content is not null").select("edit_id", lines(c).alias("l"), lines(old).alias("w")))
    rows = rows.join(fuzzy.withColumnRenamed("line", "fuzzy"), "edit_id", "left")
    found = F.coalesce(F.col("p"), F.when(F.col("fuzzy").isNotNull(), let(split, lambda row: by_line(row["l"], row["w"], F.col("fuzzy"), "fuzzy"))))
    return rows.withColumn("m", F.when(old.isNotNull(), found)).select(*edits.columns, "content", "m.start", "m.length", "m.strategy")


def by_line_count(content: Column, old: Column, normal: Column, start: Column) -> Column:
    """Where a match that began at ``start`` (from 1) of a normalised text stands in the original: a struct of start and length.

    As many whole lines as ``old`` has, after as many lines as there are before the match; null where
    the original has no such line, or nothing matched.
    """
    ends = F.regexp_extract_all(content, F.lit("[^\\n]*\\n|[^\\n]+"), F.lit(0))
    before = F.size(F.split(F.substring(normal, F.lit(1), start - 1), "\n", -1)) - 1
    size = lambda part: F.aggregate(part, F.lit(0), lambda s, t: s + F.length(t))
    first = size(F.slice(ends, F.lit(1), before))
    length = size(F.slice(ends, before + 1, F.size(lines(old))))
    return F.when((start > 0) & (before < F.size(ends)), F.struct((first + 1).alias("start"), length.alias("length")))


def edited(edits: DataFrame, files: DataFrame, all_places: bool = False) -> DataFrame:
    """edit_id, path, strategy and content after each edit alone; content is null where nothing was found.

    With ``all_places`` every exact place is replaced; the new text is not searched again.
    """
    rows = located(edits, files)
    one = F.concat(F.substring("content", F.lit(1), F.col("start") - 1), F.col("new"), F.substr(F.col("content"), F.col("start") + F.col("length")))
    text = F.when(F.col("strategy") == "exact", F.replace("content", "old", "new")).otherwise(one) if all_places else one
    return rows.select("edit_id", "path", "strategy", text.alias("content"))


def edited_in_order(edits: DataFrame, files: DataFrame) -> DataFrame:
    """path, content and applied (how many edits) after exact edits of each file in their order, up to the first that finds nothing.

    The edits of one file are one batch's, so their list is short; the content is folded over it.
    """
    steps = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "old", "new"))).alias("steps"))
    fold = """aggregate(steps, struct(content as content, 0 as applied, true as going), (s, e) -> if(s.going and instr(s.content, e.old) > 0,
        struct(concat(substring(s.content, 1, instr(s.content, e.old) - 1), e.new, substr(s.content, instr(s.content, e.old) + length(e.old))) as content, s.applied + 1 as applied, true as going),
        struct(s.content as content, s.applied as applied, false as going)))"""
    rows = files.join(steps, "path").withColumn("f", F.expr(fold))
    return rows.select("path", "f.content", "f.applied")


def diff(before: Column | str, after: Column | str, path: Column | str) -> Column:
    """A unified diff of two texts."""

    def run(a: pa.Array, b: pa.Array, p: pa.Array) -> pa.Array:
        out = ["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), f"a/{n}", f"b/{n}", lineterm="")) for x, y, n in zip(a.to_pylist(), b.to_pylist(), p.to_pylist())]
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(before, after, path)


def parsed(patches: DataFrame) -> DataFrame:
    """patch_id, path, hunk, old_start, old_count, new_count, pos and line: the lines of all hunks of unified diffs.

    A file begins at its +++ line (at the --- line for a deleted one), a hunk at its @@ line; running
    counts over a patch's lines give each line its file and hunk.
    """
    w = Window.partitionBy("patch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = patches.select("patch_id", F.posexplode(lines("text")).alias("pos", "line"))
    named = lambda prefix: F.regexp_replace(F.trim(F.substr(F.col("line"), F.lit(5))), f"^{prefix}/", "")
    is_file, is_old, is_hunk = F.startswith("line", F.lit("+++ ")), F.startswith("line", F.lit("--- ")), F.col("line").rlike(HEADER)
    rows = rows.withColumn("was", F.last(F.when(is_old, named("a")), True).over(w)).withColumn("now", F.last(F.when(is_file, named("b")), True).over(w))
    rows = rows.withColumn("file", F.sum(is_file.cast("int")).over(w)).withColumn("hunk", F.sum(is_hunk.cast("int")).over(w)).withColumn("header", F.last(F.when(is_hunk, F.col("line")), True).over(w))
    count = lambda i: F.coalesce(F.nullif(F.regexp_extract("header", HEADER, i), F.lit("")), F.lit("1")).cast("int")
    body = rows.filter(~is_file & ~is_old & (F.col("file") > 0) & F.col("header").isNotNull())
    path = F.when(F.col("now") == "/dev/null", F.col("was")).otherwise(F.col("now"))
    return body.select(
        "patch_id", path.alias("path"), (F.col("now") == "/dev/null").alias("deletes"), "hunk", count(1).alias("old_start"), count(2).alias("old_count"), count(4).alias("new_count"), "pos", "line"
    )


def patched(patches: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files after the patches, and per patch and path what was done: created, updated, deleted or missing.

    Hunks name lines of the old file, so all are applied at once: old lines that no hunk covers stay,
    and a hunk's context and added lines stand at its start. Context is not verified. A new text ends
    with one line feed. A path is patched by one patch of a batch, the first by patch_id; others are refused.
    """
    hunks = parsed(patches)
    whole = hunks.groupBy("patch_id", "path").agg(F.max("deletes").alias("deletes"), F.min(F.startswith("line", F.lit("+")) | F.startswith("line", F.lit("@@"))).alias("adds"))
    there = files.select("path", F.lit(True).alias("there"))
    done = F.when(F.col("deletes"), F.when(F.col("there"), "deleted").otherwise("missing")).when(F.col("adds"), "created").when(F.col("there"), "updated").otherwise("missing")
    firsts = whole.groupBy("path").agg(F.min("patch_id").alias("first"))
    told = F.when(F.col("patch_id") > F.col("first"), "refused").otherwise(done)
    report = whole.join(there, "path", "left").join(firsts, "path").select("patch_id", "path", told.alias("done"))
    targets = report.filter("done in ('created', 'updated')")
    own = hunks.filter("not deletes").join(targets.select("patch_id", "path", "done"), ["patch_id", "path"])
    kept = own.filter(F.col("line").rlike("^[+ ]")).select("path", (F.col("old_start") + F.when(F.col("old_count") == 0, 1).otherwise(0)).alias("at"), F.lit(0).alias("old"), "pos", F.substr(F.col("line"), F.lit(2)).alias("text"))
    covered = own.filter("done = 'updated' and old_count > 0").select("path", F.explode(F.sequence(F.col("old_start"), F.col("old_start") + F.col("old_count") - 1)).alias("at")).distinct()
    old = files.join(targets.filter("done = 'updated'").select("path"), "path", "left_semi").select("path", F.posexplode(lines("content")).alias("i", "text"))
    old = old.select("path", (F.col("i") + 1).alias("at"), F.lit(1).alias("old"), F.lit(0).alias("pos"), "text").join(covered, ["path", "at"], "left_anti")
    texts = kept.unionByName(old.select(*kept.columns)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "old", "pos", "text"))).alias("l"))
    made = texts.select("path", F.concat(F.array_join("l.text", "\n"), F.lit("\n")).alias("content"))
    made = made.withColumn("size", F.octet_length("content").cast("long")).join(files.select("path", "mtime"), "path", "left")
    gone = report.filter("done = 'deleted'").select("path").unionByName(targets.select("path"))
    return files.join(gone, "path", "left_anti").unionByName(made.select(*files.columns)), report
