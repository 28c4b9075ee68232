"""Near duplicates by SimHash: links of fingerprints found on a grid of segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut, held, joined_evenly, numbered, numbered_texts, parts, unused
from basalt.llm.components import components

#: Every second bit, from the lowest: x - ((x >> 1) & LOW_BITS) holds, for each segment of two bits of
#: a half fingerprint x, how many of them are set, in that segment's two bits.
LOW_BITS = 0x55555555


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``width`` words, A-Z lower-cased, joined by one space; shorter texts: of all words."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :] or ends[-1:])]


def fingerprints_of(texts_: list[bytes | None], width: int = 3, at_once: int = 1 << 17) -> np.ndarray:
    """Bit i is 1 if more than half of a text's shingle hashes have it; zero for no word.

    Bits are spread out and added for ``at_once`` hashes at a time, however long a text is.
    """
    hashes = [np.array(shingle_hashes(x or b"", width), np.uint64) for x in texts_]
    lens = np.array([len(h) for h in hashes], np.int64)
    flat, doc = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.repeat(np.arange(len(hashes)), lens)
    sums = np.zeros((len(hashes), 64), np.int64)
    for at in range(0, len(flat), at_once):
        bits = np.unpackbits(flat[at : at + at_once].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = doc[at : at + at_once]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > lens[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, row: str | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and row_id of every row; a null text counts as empty."""
    rows = numbered_texts(df, doc_id, text, row).select("row_id", "doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("simhash",), object)  # nothing to keep, but what other operators left goes
        for batch in parts(batches, 2, 128):
            fp = fingerprints_of(batch.column(2).to_pylist(), width).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp)], names=["row_id", "doc_id", "fp"])

    return rows.mapInArrow(run, f"row_id long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def segment_counts(x: str) -> str:
    """SQL for the bit counts of a half fingerprint's segments of two bits, as one number of 64 bits: those that begin at even bits, and those at odd ones."""
    counts = lambda y: f"({y} - (shiftright({y}, 1) & {LOW_BITS}L))"
    return f"({counts(x)} | shiftleft({counts(f'shiftright({x}, 1)')}, 32))"


def linked(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Pairs a < b of fingerprints (column fp, each once) that differ in at most ``most`` (3 or fewer) bits.

    Each half of a fingerprint is a point of bit counts in 32 dimensions, one for each two neighbouring
    bits, so a bit that differs moves the point by one in at most two of them: half the Manhattan
    distance of two points is a lower bound of the bits that differ. If these are 3 or fewer, they are
    at most one in one of the halves. In each half a point stands in the grid cell of its counts and
    visits the cells that it would have with one bit changed; points that meet in a cell are verified
    on all 64 bits. Segments overlap, since counts of separate ones let a thousand times as many
    unlike points meet. An empty table gives no pairs; null fingerprints none.
    """
    if most > 3:
        raise ValueError("two halves find pairs of at most 3 differing bits")
    # A fingerprint makes 66 visits, so their partitions are not to be put together by its own small size.
    # By a hash of fp, since a repartition by what the rows are grouped by already is planned away.
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    halves = "explode(array(struct(0 as half, fp & 4294967295L as x), struct(1 as half, shiftrightunsigned(fp, 32) as x))) as c"
    points = distinct.selectExpr("fp", halves)
    around = f"transform(sequence(0, 31), i -> {segment_counts('(c.x ^ shiftleft(1L, i))')})"
    visits = points.selectExpr("fp as a", "c.half as half", f"explode(concat(array({segment_counts('c.x')}), {around})) as cell")
    homes = points.selectExpr("fp as b", "c.half as home_half", f"{segment_counts('c.x')} as home")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    met = (F.col("cell") == F.col("home")) & (F.col("half") == F.col("home_half")) & (F.col("a") < F.col("b"))
    # Sorted and merged: Spark takes what explode makes for as small as what it reads, and would send the homes through the driver.
    return visits.join(homes.hint("merge"), met & close).select("a", "b").distinct()


def near_groups(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, most: int = 3, row: str | None = None
) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id, row_id and group_id.

    Rows of one fingerprint are taken together first, so copies are not expanded into pairs; distinct
    fingerprints that differ in at most ``most`` bits are linked, and component_id is the smallest
    doc_id that a row reaches over links. A null or empty text has fingerprint zero and is linked like
    any other; null doc_ids are passed over for component_id, which is null if there is no other.
    An empty table gives no rows; repeated rows stay. Other columns are not read. row_id is the row's
    place in the input, or the column ``row`` if that is given.
    """
    rows = cut(fingerprints(df, doc_id, text, width, row))
    # What is read more than once is stored, so that the driver never holds the plan of one step within that of the next.
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    reached = cut(components(linked(distinct.select("fp"), most)))
    joined = reached.join(distinct, reached.node == distinct.fp).groupBy(F.col("root").alias("of_root")).agg(F.min("least").alias("component"), F.count("*").alias("members"))
    joined = cut(joined)
    moved = joined_evenly(reached, joined, F.col("root"), F.col("of_root"), F.col("root") == F.col("of_root"), "members", "node").select("node", "root", "component")
    groups = distinct.join(moved, distinct.fp == moved.node, "left").select(
        F.col("fp").alias("of"), F.coalesce("root", "fp").alias("group_id"), F.expr("if(node is null, least, component)").alias("component_id"), "size"
    )
    groups = cut(groups)
    found = joined_evenly(rows, groups, F.col("fp"), F.col("of"), F.col("fp") == F.col("of"), "size", "row_id")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "row_id", "group_id")


def near_distinct(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``df``, with all their columns, one of each group: the smallest doc_id, and of its repeated rows the first.

    ``df`` is computed once: its rows are stored with their places and found again by these. Null and
    empty texts are one group; a null doc_id stays only where its group has no other. An empty table
    gives no rows. Columns may have any names.
    """
    row = unused(df, "near_row")
    rows = numbered(df, row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
    kept = near_groups(rows, doc_id, text, width, most, row).groupBy("group_id").agg(first).select(F.col("first.row_id").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
