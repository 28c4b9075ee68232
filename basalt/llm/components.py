"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut, joined_evenly


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per linked node: node and root, the smallest node that it reaches.

    Large stars and small stars in turn (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014): each round links every larger neighbour to the smallest one, until nothing changes.
    Neighbours are counted and compared before they are shuffled, and those of a node with more than a
    thousandth of all links are joined in parts; each round is cut off by a checkpoint.
    Null ends and links of a node to itself are left out; no links give no rows.
    """
    hi, lo = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    edges = cut(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi, lo).distinct())
    state = _state(edges)
    while state[0]:
        edges = cut(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _beside_least(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge with m, the smallest of the ends ``b`` of its ``a``."""
    least = cut(edges.groupBy(F.col(a).alias("of")).agg(F.min(b).alias("m"), F.count("*").alias("size")))
    return joined_evenly(edges, least, F.col(a), F.col("of"), F.col(a) == F.col("of"), "size", b).drop("of", "size")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _beside_least(both, "u", "v").filter("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    moved = _beside_least(edges, "a", "b").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(edges.groupBy("a").agg(F.min("b").alias("b"))).distinct()
