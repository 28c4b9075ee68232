"""Exact duplicates by recipes of content-defined chunks, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import SPACES, cut, joined_evenly, numbered, numbered_texts, unused

#: A chunk ends after one letter of each class, no sooner than MIN and no later than MAX characters.
BOUNDARY = "[ehinort0-4\\u00E0-\\u00E9\\u0400-\\u0437\\u4E00-\\u6FFF][bcdfgkmpuvwy5-9\\u00EA-\\u00FF\\u0438-\\u04FF\\u7000-\\u9FFF][adelsz.,]"
MIN, MAX = 768, 6000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def chunks(text: Column, least: int = MIN, most: int = MAX) -> Column:
    """The text in order, cut where its own letters say so: equal texts are cut alike."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?{BOUNDARY}|.{{1,{most}}}"), F.lit(0))


def exact_groups(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN, most: int = MAX, hashed=F.xxhash64, row: str | None = None
) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256, and row_id.

    Texts are equal when identical without ASCII white space; a null text counts as empty. Every
    distinct chunk text gets one identifier: its 64-bit hash, with a number beside it where different
    chunk texts share a hash (looked for in the dictionary of distinct chunks, so that identifiers are
    equal exactly when the chunk texts are). Documents are then compared by their ordered lists of
    identifiers; whole texts are not moved, and a chunk leaves its task once however often it occurs.

    Of equal texts the row with the most code points stays, then the smallest doc_id; a null doc_id
    comes last; of repeated rows one stays. Ties among them go by row_id (the row's place in the
    input, or the column ``row`` if that is given). An empty table gives no rows. Other columns of
    ``df`` are not read.
    """
    rows = numbered_texts(df, doc_id, text, row)
    cuts = rows.select("row_id", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"), normalised(F.col("text")).alias("norm"))
    cuts = cuts.select("*", chunks(F.col("norm"), least, most).alias("pieces"))

    occurs = cuts.select("row_id", F.posexplode("pieces").alias("pos", "piece")).select("row_id", "pos", "piece", hashed("piece").alias("h"))
    known = occurs.select("h", "piece").distinct()  # the dictionary: each distinct chunk once
    shared = known.groupBy("h").count().filter("count > 1").select("h")
    shared = cut(shared)

    if shared.isEmpty():
        digests = _digests(cuts, hashed).withColumn("marks", F.lit(None).cast("array<struct<pos:int,rank:int>>"))
    else:
        cuts = cut(cuts)  # one numbering of the rows for both sides of the join below
        occurs = cuts.select("row_id", F.posexplode("pieces").alias("pos", "piece")).select("row_id", "pos", "piece", hashed("piece").alias("h"))
        ranks = known.join(shared, "h").withColumn("rank", F.expr("row_number() over (partition by h order by piece)"))
        marks = occurs.join(shared, "h").join(ranks, ["h", "piece"]).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("marks"))
        digests = _digests(cuts, hashed).join(marks, "row_id", "left")
    digests = cut(digests)

    # Bitwise not turns the order of integers round, the smallest one's too.
    best = F.struct("size", F.bitwise_not("doc_id").alias("id_down"), F.bitwise_not("row_id").alias("row_down"))
    groups = digests.groupBy("recipe", "marks").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
    groups = groups.select(
        F.col("recipe").alias("g_recipe"), F.col("marks").alias("g_marks"), "group_size", F.bitwise_not("best.id_down").alias("keep_id"), F.bitwise_not("best.row_down").alias("keep_row")
    )
    groups = cut(groups)
    same = (F.col("recipe") == F.col("g_recipe")) & F.col("marks").eqNullSafe(F.col("g_marks"))
    by, to = F.xxhash64("recipe", "marks"), F.xxhash64("g_recipe", "g_marks")
    return joined_evenly(digests, groups, by, to, same, "group_size", "row_id").select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "row_id"
    )


def _digests(cuts: DataFrame, hashed) -> DataFrame:
    return cuts.select(
        "row_id", "doc_id", "size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.transform("pieces", lambda c: hashed(c)).alias("recipe")
    )


def exact_distinct(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: of equal texts the longest, then the smallest doc_id.

    ``df`` is computed once: its rows are stored with their places and found again by these. Null texts
    equal empty ones; of repeated rows the first stays; a null doc_id stays only where its group has no
    other. An empty table gives no rows. Columns may have any names.
    """
    row = unused(df, "exact_row")
    rows = numbered(df, row)
    kept = exact_groups(rows, doc_id, text, row=row).filter("kept").select(F.col("row_id").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
