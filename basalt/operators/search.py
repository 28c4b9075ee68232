"""Search of a graph by keyword, by vector or by both, with what is around the hits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.lineage import cut, stored
from basalt.operators import graph, ranking


@dataclass
class Found:
    #: kind, ref_id, label, score and place, best first.
    hits: DataFrame
    #: name, rank and place of entities one hop from a hit; relations at a hit; pair_id, nodes and edges; None if not asked for.
    neighbours: DataFrame | None = None
    edges: DataFrame | None = None
    paths: DataFrame | None = None


def search_graph(
    entities: DataFrame,
    relations: DataFrame,
    query: str,
    mode: str = "keyword",
    k: int = 10,
    threshold: float = 0.0,
    vector_hits: DataFrame | None = None,
    neighbours: bool = False,
    edges: bool = False,
    paths: bool = False,
) -> Found:
    """The ``k`` best hits among entities and relations, and what is around the entities hit.

    ``keyword`` finds text in either, entities first; ``vector`` takes the hits given (ref_id, score,
    rank) at the threshold or above, none if none are given; ``hybrid`` merges both, and is keyword
    search without vector hits. Hits that point at nothing are left out.
    """
    if mode not in ("keyword", "vector", "hybrid"):
        raise ValueError(f"not a mode: {mode!r}")
    words = ranking.keyword_hits(entities, relations, query, k)
    if mode == "keyword" or (mode == "hybrid" and vector_hits is None):
        found = words.withColumn("place", F.row_number().over(Window.orderBy("kind", "ord"))).select("ref_id", "score", "place")  # k rows
    elif vector_hits is None:
        found = words.limit(0).select("ref_id", "score", F.lit(0).alias("place"))
    elif mode == "vector":
        found = ranking.positive(vector_hits, k, threshold).select("ref_id", "score", F.col("rank").alias("place"))
    else:
        found = ranking.hybrid_graph(ranking.positive(vector_hits, k), words, k, threshold)
    # k hits at most: what they point at is looked for where the graph lies, and what is around them is read from one stored copy.
    found = cut(found)
    if neighbours or edges or paths:
        relations = stored(relations)
    own = F.broadcast(found.select("ref_id").distinct())
    at_hits = (t.join(own, "ref_id", "left_semi") for t in (entities, relations))
    hits = graph.resolve_refs(found, *at_hits).select("kind", "ref_id", "label", "score", F.col("place").cast("long").alias("place"))
    near = hits.filter("kind = 'entity'").select(F.col("label").alias("name"), F.col("place").alias("rank"))
    return Found(
        hits,
        graph.neighbours(entities, relations, near) if neighbours else None,
        graph.touching(relations, near.select("name")) if edges else None,
        graph.shortest_paths(entities, relations, graph.top_pairs(near)) if paths else None,
    )
