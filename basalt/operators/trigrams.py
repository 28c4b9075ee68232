"""An index of three-letter sequences over texts, so that a search by pattern or keyword reads few of them.

The index is a folder: texts in blocks, and for each sequence and block the numbers of the block's texts
that hold it. A pattern is taken apart into the sequences that each match must hold; texts that hold
them are read and searched by the pattern itself, so the index leaves out texts, never matches.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources import files

#: A block ends after so many bytes of text or so many texts.
BLOCK_BYTES, BLOCK_TEXTS = 16 << 20, 4096
#: Files of the index that a sequence is looked for in: one of so many.
SLOTS = 64
#: A block's lists are made in so many passes.
PASSES = 8
#: Strings that a part of a pattern may stand for before it counts as anything, and sequences that a search asks for.
STRINGS, ASKED = 16, 24
ROWS = "kind string, slot int, block string, doc int, path string, mtime timestamp, content string, gram long, docs array<int>"


def build(texts: DataFrame, path: str) -> None:
    """Indexes texts (path, content, mtime) into a new folder; null contents hold nothing and are left out.

    Each task cuts its texts into blocks and turns each block into lists by sequence, so no single
    sequence of a text is shuffled. Sequences are of the lower-cased text, within a line.
    """
    _append(texts, path, "error")


def extend(texts: DataFrame, path: str) -> None:
    """Adds further texts (of paths that the index does not have) as blocks of their own."""
    _append(texts, path, "append")


def _append(texts: DataFrame, path: str, mode: str) -> None:
    run = uuid.uuid4().hex[:12]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for i, lowered in enumerate(part.column(3).to_pylist()):
                    held.append((part.slice(i, 1), grams_of(lowered)))
                    size += len(lowered)
                    if size >= BLOCK_BYTES or len(held) >= BLOCK_TEXTS:
                        yield from _block(f"{run}-{task}-{made}", held)
                        made, held, size = made + 1, [], 0
        if held:
            yield from _block(f"{run}-{task}-{made}", held)

    rows = texts.filter("path is not null and content is not null").select("path", "content", F.col("mtime").cast("timestamp").alias("mtime"), F.lower("content").alias("lowered"))
    found = rows.mapInArrow(blocks, ROWS)
    found.write.mode(mode).option("parquet.block.size", BLOCK_BYTES).partitionBy("kind", "slot").parquet(path)


def grams_of(lowered: str) -> np.ndarray:
    """The distinct sequences of three letters of one line, each as one number."""
    codes = np.frombuffer(lowered.encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    return np.unique(((a << 42) | (b << 21) | c)[(a != 10) & (b != 10) & (c != 10)])


def gram(letters: str) -> int:
    a, b, c = map(ord, letters)
    return a << 42 | b << 21 | c


def _block(name: str, held: list) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its texts, and its lists."""
    texts = pa.Table.from_batches([t for t, _ in held]).combine_chunks()
    n = len(held)
    none = lambda k, t: pa.nulls(k, t)
    stamp = pa.timestamp("us", "UTC")
    names = ["kind", "slot", "block", "doc", "path", "mtime", "content", "gram", "docs"]
    own = [pa.array(["text"] * n), pa.array(np.zeros(n, np.int32)), pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), *(texts.column(c).combine_chunks() for c in ("path", "mtime", "content"))]
    own[5] = own[5].cast(stamp)
    yield pa.record_batch([*own, none(n, pa.int64()), none(n, pa.list_(pa.int32()))], names=names)
    for k in range(PASSES):
        # One class of sequences after another, so that only its copies are there beside what is held.
        own = [g[g % PASSES == k] for _, g in held]
        yield from _lists(name, np.concatenate(own), np.repeat(np.arange(n, dtype=np.int32), [len(g) for g in own]))


def _lists(name: str, flat: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The list of each sequence, from pairs of a sequence and a text's number in the order of these."""
    none = lambda k, t: pa.nulls(k, t)
    stamp, names = pa.timestamp("us", "UTC"), ["kind", "slot", "block", "doc", "path", "mtime", "content", "gram", "docs"]
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    del order
    starts = np.flatnonzero(np.diff(flat, prepend=-1))
    ends, k = np.append(starts[1:], len(flat)), len(starts)
    for at in range(0, k, 8192):
        to = min(k, at + 8192)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts[at:to], ends[to - 1]).astype(np.int32) - np.int32(starts[at])), pa.array(doc[starts[at] : ends[to - 1]]))
        grams = flat[starts[at:to]]
        m = to - at
        filler = [none(m, pa.int32()), none(m, pa.string()), none(m, stamp), none(m, pa.string())]
        yield pa.record_batch([pa.array(["list"] * m), pa.array((grams % SLOTS).astype(np.int32)), pa.array([name] * m), *filler, pa.array(grams), lists], names=names)


# What a pattern needs. A condition is a sequence's number, ("and", ...) or ("or", ...) of conditions, or None for anything.

Condition = int | tuple | None


def all_of(conditions: Iterable[Condition]) -> Condition:
    some = list(dict.fromkeys(c for c in conditions if c is not None))
    return ("and", *some) if len(some) > 1 else some[0] if some else None


def any_of(conditions: Iterable[Condition]) -> Condition:
    some = list(dict.fromkeys(conditions))
    if not some or None in some or len(some) > STRINGS:
        return None
    return ("or", *some) if len(some) > 1 else some[0]


def of_string(text: str) -> Condition:
    """All sequences of a literal; letters whose lower case hangs on what is around them, or of which there are several, part it."""
    runs = re.split("[^\\x00-\\x7f]+" if any(c.lower() != c.upper() and not c.isascii() for c in text) else "\n", text.lower())
    return all_of(gram(run[i : i + 3]) for run in runs for i in range(len(run) - 2) if "\n" not in run[i : i + 3])


def of_pattern(pattern: str) -> Condition:
    """What a line must hold to match; None where the pattern says nothing, or has parts that are not understood for certain."""
    import re._parser as parser

    escapes = re.findall(r"\\(.)", pattern, re.S)
    if any(e.isalnum() and e not in "dwsbDWSBntr" for e in escapes) or re.search(r"&&|\[[^\]]*\[|\(\?[a-z]*[^imsa-z:=!<)-]|\(\?[a-z-]*[^ims:=!<)P-]", pattern):
        return None
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    strings, condition = _read(list(tree), parser)
    return condition if strings is None else all_of([condition, any_of(map(of_string, sorted(strings)))])


def _read(items: list, parser) -> tuple[set[str] | None, Condition]:
    """For a sequence of items: the strings that it may stand for, if they are few, and what holds besides."""
    known: set[str] | None = {""}
    closed: list[Condition] = []
    for at, item in enumerate(items):
        strings, condition = _item(item, parser)
        closed.append(condition)
        if strings is not None and known is not None and len(known) * len(strings) <= STRINGS:
            known = {a + b for a, b in product(known, strings)}
            continue
        # A part that may be anything, or too much, ends the run of letters before it; the whole is no set of strings any more.
        if known is not None:
            closed.append(any_of(map(of_string, sorted(known))))
        rest, more = _read(items[at + 1 :], parser)
        closed += [more, None if strings is None else any_of(map(of_string, sorted(strings))), None if rest is None else any_of(map(of_string, sorted(rest)))]
        return None, all_of(closed)
    return known, all_of(closed)


def _item(item: tuple, parser) -> tuple[set[str] | None, Condition]:
    op, value = item
    name = str(op)
    if name == "LITERAL":
        return {chr(value)}, None
    if name == "AT" or name.startswith("ASSERT"):
        return {""}, None
    if name == "IN":
        return _letters(value), None
    if name == "SUBPATTERN":
        return _read(list(value[3]), parser)
    if name == "ATOMIC_GROUP":
        return _read(list(value), parser)
    if name == "BRANCH":
        each = [_read(list(b), parser) for b in value[1]]
        if all(s is not None and c is None for s, c in each) and sum(len(s) for s, _ in each) <= STRINGS:
            return set().union(*(s for s, _ in each)), None
        return None, any_of(all_of([c, None if s is None else any_of(map(of_string, sorted(s)))]) for s, c in each)
    if name.endswith("REPEAT"):
        least, most, inner = value
        strings, condition = _read(list(inner), parser)
        if least == 0:
            return ({""} | strings if most == 1 and strings is not None and condition is None else None), None
        if least == most == 1:
            return strings, condition
        return None, all_of([condition, None if strings is None else any_of(map(of_string, sorted(strings)))])
    return None, None  # any letter, a group met before, and whatever else there is


def _letters(members: list) -> set[str] | None:
    found: set[str] = set()
    for op, value in members:
        if str(op) == "LITERAL":
            found.add(chr(value))
        elif str(op) == "RANGE" and value[1] - value[0] < STRINGS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return {c.lower() for c in found} if len(found) <= STRINGS else None


def asked_for(condition: Condition) -> list[int]:
    """The sequences that a condition names."""
    if isinstance(condition, tuple):
        return list(dict.fromkeys(g for c in condition[1:] for g in asked_for(c)))
    return [] if condition is None else [condition]


def smaller(condition: Condition, room: int = ASKED) -> Condition:
    """A condition of at most ``room`` sequences that holds wherever the given one does: some that it joins by "and" go."""
    if len(asked_for(condition)) <= room:
        return condition
    if condition[0] == "or":
        return any_of(smaller(c, room // (len(condition) - 1)) for c in condition[1:]) if room >= len(condition) - 1 else None
    kept: list[Condition] = []
    for c in sorted(condition[1:], key=lambda c: len(asked_for(c))):
        left = room - len(asked_for(all_of(kept)))
        if left > 0:
            kept.append(smaller(c, left))
    return all_of(kept)


def candidates(spark: SparkSession, path: str, condition: Condition) -> DataFrame | None:
    """block and docs (numbers) of the texts that hold what the condition asks for; None if it asks for nothing.

    Of each block only the lists of the sequences asked for are read, and meet in one row.
    """
    condition = smaller(condition)
    grams = asked_for(condition)
    if not grams:
        return None
    lists = spark.read.schema(ROWS).parquet(path).filter((F.col("kind") == "list") & F.col("slot").isin(sorted({g % SLOTS for g in grams})) & F.col("gram").isin(grams))
    none = F.array().cast("array<int>")
    held = lists.groupBy("block").agg(*(F.coalesce(F.max(F.when(F.col("gram") == g, F.col("docs"))), none).alias(f"g{g}") for g in grams))

    def docs(c: Condition) -> Column:
        if isinstance(c, int):
            return F.col(f"g{c}")
        join: Callable = F.array_intersect if c[0] == "and" else F.array_union
        out = docs(c[1])
        for more in c[2:]:
            out = join(out, docs(more))
        return out

    return held.select("block", docs(condition).alias("docs")).filter("size(docs) > 0")


def texts_of(spark: SparkSession, path: str, condition: Condition, most_blocks: int = 1000) -> DataFrame:
    """path, content and mtime of the texts that may match: those of ``candidates``, or all.

    If the candidates stand in few blocks, the other blocks' texts are left out by the files' statistics.
    """
    texts = spark.read.schema(ROWS).parquet(path).filter("kind = 'text'").select("block", "doc", "path", "content", "mtime")
    found = candidates(spark, path, condition)
    if found is None:
        return texts.drop("block", "doc")
    found = found.select("block", F.explode("docs").alias("doc"))
    blocks = [r["block"] for r in found.select("block").distinct().limit(most_blocks + 1).collect()]
    if len(blocks) <= most_blocks:
        texts = texts.filter(F.col("block").isin(blocks))
    return texts.join(found, ["block", "doc"], "left_semi").drop("block", "doc")


def grep(spark: SparkSession, path: str, pattern: str, include: str = "", most: int | None = files.RESULTS, line: int = files.LINE, per_file: int | None = None) -> DataFrame:
    """path, lineno and text of the lines that match, as ``files.grep`` over all texts gives them."""
    return files.grep(texts_of(spark, path, of_pattern(pattern)), pattern, include, most, line, per_file)


def holding(spark: SparkSession, path: str, words: str) -> DataFrame:
    """path, content and mtime of the texts that hold ``words`` in any case."""
    own = [of_string(part) for part in words.split("\n")]
    return texts_of(spark, path, all_of(own)).filter(F.contains(F.lower("content"), F.lower(F.lit(words))))
