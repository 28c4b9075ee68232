"""Keyword search, and the two ways of ranking keyword and vector hits together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.numbering import placed

#: What a keyword hit scores, and what it adds to a vector hit of the same row.
KEYWORD, BOTH = 1.0, 0.5


def matches(query: str, *columns: str) -> Column:
    """Case-insensitive substring of any column; the empty query matches every row, a null column none."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
    return found


def keyword_hits(entities: DataFrame, relations: DataFrame | None, query: str, k: int | None) -> DataFrame:
    """kind, ref_id, ord and score of the first k rows that match: entities in their order, then relations in theirs.

    Without a k, all that match, in no order.

    Entities are searched by name, description and entity_type, relations by relation_type,
    description, from_entity and to_entity.
    """
    found = entities.filter(matches(query, "name", "description", "entity_type")).select(F.lit("entity").alias("kind"), "ref_id", "ord")
    if relations is not None:
        more = relations.filter(matches(query, "relation_type", "description", "from_entity", "to_entity"))
        found = found.unionByName(more.select(F.lit("relation").alias("kind"), "ref_id", "ord"))
    found = found if k is None else found.orderBy("kind", "ord").limit(k)
    return found.withColumn("score", F.lit(KEYWORD))


def positive(vector_hits: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """The k best vector hits (ref_id, score, rank), and only then those at the threshold or above."""
    return vector_hits.filter(F.col("rank") <= k).filter(F.col("score") >= threshold)


def hybrid_graph(vector_hits: DataFrame, keyword: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """ref_id, score and place of the k best of both lists.

    Keyword only: 1. Vector only: its cosine. Both: the cosine and 0.5. The threshold holds after
    that; without any vector hit it does not, and the first k keyword hits are the answer. Equal scores
    keep vector hits first, in their order, then keyword hits in theirs.
    """
    v = vector_hits.select("ref_id", F.col("score").alias("cos"), F.col("rank").alias("v_rank"))
    w = keyword.select("ref_id", F.struct("kind", "ord").alias("w_rank"))
    any_vector = v.limit(1).agg((F.count("*") > 0).alias("any_vector"))  # one row
    score = F.when(F.col("cos").isNull(), KEYWORD).when(F.col("w_rank").isNull(), F.col("cos")).otherwise(F.col("cos") + BOTH)
    merged = v.join(w, "ref_id", "full_outer").crossJoin(F.broadcast(any_vector)).withColumn("score", score)
    kept = merged.filter((F.col("score") >= threshold) | ~F.col("any_vector"))
    order = (F.desc("score"), F.asc_nulls_last("v_rank"), F.asc("w_rank"))
    return kept.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("ref_id", "score", "place")


def hybrid_board(tasks: DataFrame, query: str, vector_hits: DataFrame | None, k: int, threshold: float) -> DataFrame:
    """Tasks (with id and description) that match by keyword, by vector or both: their columns, score and found_by.

    Keyword: 1. Vector: cosine, for the k best hits at the threshold or above. Both: the larger. There
    is no limit at the end. Tasks that share an id share its score.
    """
    words = tasks.filter(matches(query, "description")).select("id").distinct().withColumn("w", F.lit(KEYWORD))
    if vector_hits is None:
        return tasks.join(words, "id").withColumn("score", F.col("w")).withColumn("found_by", F.lit("keyword")).drop("w")
    hits = positive(vector_hits, k, threshold).select(F.col("ref_id").alias("id"), F.col("score").alias("cos"))
    scored = words.join(hits, "id", "full_outer").select(
        "id",
        F.greatest("w", "cos").alias("score"),
        F.when(F.col("cos").isNull(), "keyword").when(F.col("w").isNull(), "semantic").otherwise("hybrid").alias("found_by"),
    )
    return tasks.join(scored, "id")


def resolve(hits: DataFrame, entries: DataFrame, on: str = "ref_id") -> DataFrame:
    """Hits with the row that they point at; hits that point at nothing are left out."""
    return hits.join(entries, on)


def filtered(tasks: DataFrame, status: str | None = None, owner: str | None = None, creator: str | None = None) -> DataFrame:
    """All given conditions at once; the empty owner means tasks without one."""
    for column, value in (("status", status), ("owner", owner), ("creator", creator)):
        if value is not None:
            tasks = tasks.filter(F.coalesce(F.col(column), F.lit("")) == value)
    return tasks


def breakdown(tasks: DataFrame, none: str = "unassigned") -> DataFrame:
    """owner, n and place: tasks by owner over the whole board, those without an owner last."""
    owner = F.coalesce(F.nullif(F.col("owner"), F.lit("")), F.lit(none))
    counts = tasks.groupBy(owner.alias("owner")).agg(F.count("*").alias("n"))
    return placed(counts, F.col("owner") == none, "owner")


def board_view(tasks: DataFrame, me: str, columns: Sequence[str] = ("id", "status", "owner", "description")) -> DataFrame:
    """What one agent sees: own tasks, and owned tasks that they created."""
    owned = F.coalesce(F.col("owner"), F.lit("")) != ""
    return tasks.filter((F.col("owner") == me) | (owned & (F.col("creator") == me))).select(*columns)


def first_by_id(tasks: DataFrame, id: int) -> DataFrame:
    """The first row with an id."""
    return tasks.filter(F.col("id") == id).orderBy("ord").limit(1)
