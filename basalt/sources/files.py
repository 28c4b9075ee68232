"""A tree of text files as a table: path, content, size, mtime; and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.numbering import placed
from basalt.functions.text import glob_expression, glob_regex, line_ending, lines, with_endings

#: Longest line shown by a search, and most lines.
LINE, RESULTS = 500, 100
#: Suffixes of documents whose text can be read, and of images with their media types: fixed values.
DOCUMENTS = ("docx", "pdf", "pptx", "xlsx")
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The files below a folder, with their bytes as text and their paths relative to it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace("path", "^[a-z]+:/*", "/")
    top = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return rows.select(F.substr(base, F.lit(len(top) + 1)).alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def normal_path(path: Column | str) -> Column:
    """A relative path without dots, or null if it leads out of the root."""
    path = F.col(path) if isinstance(path, str) else path
    step = lambda s, p: F.when(
        p.isin("", "."), s
    ).when(p != "..", F.concat(s, F.array(p))).when(F.size(s) > 0, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.lit(None).cast("array<string>"))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.startswith(path, F.lit("/")), F.lit(None).cast("string")).otherwise(F.array_join(parts, "/"))


def write_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files with new ones (path, content, mtime) in place of those of their paths; an old file's kind of line end is kept."""
    old = files.select("path", F.col("content").alias("was"))
    text = F.when(F.col("was").isNull(), F.col("content")).otherwise(with_endings("content", line_ending("was")))
    made = new.join(old, "path", "left").select("path", text.alias("content"), "mtime").withColumn("size", F.octet_length("content").cast("long"))
    return files.join(new.select("path"), "path", "left_anti").unionByName(made.select(*files.columns))


def seed_files(files: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files and those seeds whose paths are not there yet."""
    return files.unionByName(seeds.join(files.select("path"), "path", "left_anti").select(*files.columns))


def delete_files(files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files left, and the paths that were not there."""
    return files.join(paths, "path", "left_anti"), paths.join(files.select("path"), "path", "left_anti")


def make_dirs(dirs: DataFrame, paths: DataFrame) -> DataFrame:
    """Folders (path) and those asked for, each once; one that is there stays as it is."""
    return dirs.unionByName(paths.select("path").distinct().join(dirs.select("path"), "path", "left_anti"))


def deleted_or_missing(files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files left, and per path asked for whether it was deleted or not found."""
    left, none = delete_files(files, paths)
    gone = paths.select("path").distinct().join(files.select("path"), "path", "left_semi")
    return left, gone.withColumn("done", F.lit("deleted")).unionByName(none.select("path").distinct().withColumn("done", F.lit("not found")))


def list_dir(files: DataFrame, folder: str = "") -> DataFrame:
    """name, is_dir, size and place of what is in a folder: folders first (size 0), then files, each by name."""
    prefix = f"{folder.strip('/')}/" if folder.strip("/") else ""
    rest = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    inside = files.filter(F.startswith("path", F.lit(prefix))).select(F.split(rest, "/").alias("p"), "size")
    is_dir = F.size("p") > 1
    rows = inside.groupBy(F.element_at("p", 1).alias("name"), is_dir.alias("is_dir")).agg(F.max("size").alias("size"))
    rows = rows.withColumn("size", F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("size")).cast("long"))
    return placed(rows, F.desc("is_dir"), "name")


def tree(files: DataFrame, depth: int = 0) -> DataFrame:
    """path, level, is_dir and is_last (of its folder) of every entry down to ``depth`` levels, 0 being all."""
    parts = files.select(F.split("path", "/").alias("p"))
    n = F.posexplode(F.sequence(F.lit(1), F.size("p"))).alias("i", "n")
    entries = parts.select("p", n).select(F.array_join(F.slice("p", F.lit(1), F.col("n")), "/").alias("path"), F.col("n").alias("level"), (F.col("n") < F.size("p")).alias("is_dir")).distinct()
    shown = entries.filter(F.col("level") <= depth) if depth else entries
    parent = F.regexp_replace("path", "[^/]+$", "")
    order = Window.partitionBy("parent").orderBy(F.asc("is_dir"), F.desc("path"))
    return shown.withColumn("parent", parent).withColumn("is_last", F.row_number().over(order) == 1).drop("parent")


def glob(files: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """path, mtime and total of the files that match, newest first; ``total`` counts also those beyond ``most``."""
    found = files.filter(F.col("path").rlike(glob_regex(pattern))).select("path", "mtime").distinct()
    counted = found.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row
    return counted.orderBy(F.desc("mtime"), "path").limit(most) if most else counted


def grep(files: DataFrame, pattern: str, include: str = "", most: int | None = RESULTS, line: int = LINE, per_file: int | None = None) -> DataFrame:
    """path, lineno and text of the lines that match, newest file first, lines cut to ``line`` characters.

    ``most`` counts over all files, ``per_file`` within each.
    """
    if include:
        files = files.filter(F.col("path").rlike(glob_regex(include if "/" in include else f"**/{include}")))
    # The whole text is looked at first, which spares the splitting of texts without a match.
    rows = files.filter(F.col("content").rlike(f"(?m){pattern}")).select("path", "mtime", F.posexplode(lines("content")).alias("i", "text")).filter(F.col("text").rlike(pattern))
    found = rows.select("path", "mtime", (F.col("i") + 1).alias("lineno"), F.substring("text", 1, line).alias("text"))
    if per_file:
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("lineno"))).filter(F.col("n") <= per_file).drop("n")
    if most:
        found = found.orderBy(F.desc("mtime"), "path", "lineno").limit(most)
    return found.select("path", "lineno", "text")


def window(files: DataFrame, offset: int = 1, limit: int = 2000) -> DataFrame:
    """path, lineno, text and total lines: the lines from ``offset`` on, ``limit`` at most."""
    own = files.select("path", lines("content").alias("l"))
    part = F.slice("l", F.lit(offset), F.lit(limit))
    rows = own.select("path", F.size("l").alias("total"), F.posexplode(part).alias("i", "text"))
    return rows.select("path", (F.col("i") + offset).alias("lineno"), "text", "total")


def numbered_lines(files: DataFrame, offset: int = 1, limit: int = 2000) -> DataFrame:
    """path, lineno and line: as ``window``, each line with its number, in six places, before it."""
    rows = window(files, offset, limit)
    return rows.select("path", "lineno", F.concat(F.rpad(F.col("lineno").cast("string"), 6, " "), "text").alias("line"))


def media_references(prompts: DataFrame, files: DataFrame) -> DataFrame:
    """prompt_id, pos, i, kind, value and path: the parts of prompts (prompt_id, text) in order.

    ``!!pattern`` or ``!!"pattern with spaces"`` stands for the images that the pattern matches, by path;
    if there are none, for a hint at each document that it does, else for an error. Text between
    references, and after the last, is a part as it is. Patterns are joined with files by suffix.
    """
    token = '!!"[^"]+"|!!\\S+'
    texts = F.split("text", token, -1)
    refs = F.regexp_extract_all("text", F.lit(token), F.lit(0))
    parts = prompts.select("prompt_id", F.posexplode(texts).alias("n", "t"), refs.alias("refs"))
    plain = parts.filter("t <> '' or n = size(refs)").select("prompt_id", (F.col("n") * 2).alias("pos"), F.lit("").alias("i"), F.lit("text").alias("kind"), F.col("t").alias("value"), F.lit(None).cast("string").alias("path"))
    asked = prompts.select("prompt_id", F.posexplode(refs).alias("n", "ref"))
    asked = asked.select("prompt_id", (F.col("n") * 2 + 1).alias("pos"), F.regexp_replace("ref", '^!!"?|"$', "").alias("pattern"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin(*IMAGES), "image").when(suffix.isin(*DOCUMENTS), "document")
    known = files.select("path", kind.alias("kind"), suffix.alias("suffix")).filter("kind is not null")
    # A pattern meets the files of its last name, if that has no sign of a glob; else those below its first folders that have none;
    # else, as all that is left, those of its suffix, or of every known one.
    low, name = F.lower("pattern"), F.element_at(F.split(F.lower("pattern"), "/"), -1)
    folders, own = F.regexp_extract(low, r"^((?:[^/*?]+/)*)", 1), F.regexp_extract(low, r"\.([^./*?]+)$", 1)
    every = F.array(*(F.lit(f"suffix {x}") for x in (*IMAGES, *DOCUMENTS)))
    keys = F.when(~name.rlike("[*?]"), F.array(F.concat(F.lit("name "), name))).when(folders != "", F.array(F.concat(F.lit("below "), folders)))
    keys = keys.when(own != "", F.array(F.concat(F.lit("suffix "), own))).otherwise(every)
    wanted = asked.select("pattern").distinct().withColumn("key", F.explode(keys))
    steps = F.split(F.lower("path"), "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: n > 0), lambda n: F.concat(F.lit("below "), F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/")))
    there = F.concat(F.array(F.concat(F.lit("name "), F.element_at(steps, -1)), F.concat(F.lit("suffix "), "suffix")), above)
    # Only keys that are asked for are joined with patterns.
    keyed = known.select("path", "kind", F.explode(there).alias("key"))
    found = keyed.join(wanted, "key").filter(F.rlike("path", glob_expression("pattern"))).drop("key")
    images = found.filter("kind = 'image'").select("pattern", F.lit(True).alias("has_image")).distinct()
    matched = asked.join(found, "pattern", "left").join(images, "pattern", "left").filter("kind is null or kind = 'image' or has_image is null")
    name = F.element_at(F.split("path", "/"), -1)
    value = F.when(F.col("kind") == "image", F.col("path")).when(F.col("kind") == "document", F.concat(F.lit("!!"), name, F.lit("[=> Use workspace_read tool]")))
    value = F.coalesce(value, F.concat(F.lit("!!"), "pattern", F.lit("[Error: no image found in the workspace]")))
    shown = matched.select("prompt_id", "pos", F.coalesce("path", F.lit("")).alias("i"), F.coalesce("kind", F.lit("error")).alias("kind"), value.alias("value"), "path")
    return plain.unionByName(shown)


def media_type(path: Column | str = "path") -> Column:
    """Of an image, by its suffix; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in IMAGES.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def resource_bytes(kind: Column | str = "kind", content: Column | str = "content") -> Column:
    """The bytes of a configured resource: images come in base 64, texts as they are."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind == "image", F.unbase64(content)).otherwise(F.encode(content, "UTF-8"))
