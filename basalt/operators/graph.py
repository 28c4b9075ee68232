"""Traversal of property graphs: entities (name, entity_type, is_root, ref_id, ord) and relations
(ref_id, from_entity, to_entity, relation_type, ord)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.numbering import placed
from basalt.functions.lineage import cut, stored


#: Rows of a frontier up to which it is sent to the tasks that hold the edges; a larger one is joined by a shuffle.
FEW = 100_000


def both_ways(relations: DataFrame, types: Sequence[str] = ()) -> DataFrame:
    """a, b, ord and edge (ref_id) of each edge in either direction, of the given types or all; the relations are read once."""
    edges = relations.filter(F.col("relation_type").isin(*types)) if types else relations
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    ways = F.when(F.col("from_entity") == F.col("to_entity"), F.array(way("from_entity", "to_entity"))).otherwise(F.array(way("from_entity", "to_entity"), way("to_entity", "from_entity")))
    return edges.select(F.explode(ways).alias("w"), "ord", F.col("ref_id").alias("edge")).select("w.a", "w.b", "ord", "edge")


def _from(edges: DataFrame, frontier: DataFrame, n: int) -> DataFrame:
    """The edges that begin at a frontier (name and whatever else) of n rows."""
    front = frontier.withColumnRenamed("name", "a")
    return edges.join(F.broadcast(front) if n <= FEW else front, "a")


def reach(entities: DataFrame, relations: DataFrame, start: DataFrame, depth: int, types: Sequence[str] = (), blocked: DataFrame | None = None) -> DataFrame:
    """name and hops of all entities within ``depth`` undirected hops of ``start`` (column name).

    Unknown starts are left out. ``blocked`` names count as visited, are part of the result with no
    hops (null), and are not walked through. Each hop is one join of the last level with the relations as they are; only the new
    level is written. An edge leads at most one level back, so a new level is compared with the last two.
    """
    level = start.select("name").distinct().join(entities.select("name").distinct(), "name", "left_semi")
    level = cut(level) if depth else level
    levels = [level.withColumn("hops", F.lit(0))]
    walls = None
    if blocked is not None:
        walls = blocked.select("name").distinct()
        levels.append(walls.join(level, "name", "left_anti").withColumn("hops", F.lit(None).cast("int")))
    edges, n, before = both_ways(relations, types), level.count() if depth else 0, None
    for hop in range(1, depth + 1):
        if not n:
            break
        found = _from(edges, level, n).select(F.col("b").alias("name")).distinct()
        for known in (level, before, walls):
            if known is not None:
                found = found.join(known, "name", "left_anti")
        before, level = level, cut(found)
        n = level.count()
        levels.append(level.withColumn("hops", F.lit(hop)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def induced(relations: DataFrame, names: DataFrame) -> DataFrame:
    """All relations, of whatever type, with both ends among ``names``."""
    near = names.select(F.col("name").alias("from_entity")).distinct()
    far = names.select(F.col("name").alias("to_entity")).distinct()
    return relations.join(near, "from_entity", "left_semi").join(far, "to_entity", "left_semi")


def subgraph(entities: DataFrame, relations: DataFrame, start: DataFrame | None = None, depth: int | None = None, types: Sequence[str] = (), roots_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities and relations around ``start``; around the roots (depth 0 unless given) if asked; or the whole graph."""
    if roots_only:
        start, depth = entities.filter("is_root").select("name"), depth or 0
    if start is None:
        return entities, relations
    seen = reach(entities, relations, start, 1 if depth is None else depth, types)
    return entities.join(seen.select("name"), "name", "left_semi"), induced(relations, seen)


def waypoints(entities: DataFrame, relations: DataFrame, start: str, path: Sequence[tuple[str, str]], depth: int = 1, types: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A directed walk by steps (relation_type, to_entity), then what is around its end; empty if a step is missing.

    The walk's other entities are visited already: they block the way back, are part of the result, and
    so are the edges among them.
    """
    spark = entities.sparkSession
    names = [start, *(to for _, to in path)]
    steps = spark.createDataFrame([(i, names[i], t, to) for i, (t, to) in enumerate(path)], "step int, from_entity string, relation_type string, to_entity string")
    first = Window.partitionBy("step").orderBy("ord")
    walked = relations.join(F.broadcast(steps), ["from_entity", "relation_type", "to_entity"])  # as many rows as the caller wrote steps
    walked = walked.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    on_path = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    complete = entities.join(on_path, "name", "left_semi").select("name").distinct().count() == len(dict.fromkeys(names)) and walked.count() == len(path)
    if not complete:
        return entities.limit(0), relations.limit(0)
    end = on_path.filter(F.col("name") == names[-1])
    seen = reach(entities, relations, end, depth, types, on_path.filter(F.col("name") != names[-1]))
    edges = induced(relations, seen).unionByName(walked.select(*relations.columns)).dropDuplicates(["ref_id"])
    return entities.join(seen.select("name"), "name", "left_semi"), edges


def shortest_paths(entities: DataFrame, relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, nodes and edges (ref_ids) of one shortest undirected path of each pair (pair_id, source, target), however long.

    Both ends of all pairs are searched level by level, the side with the smaller level first; levels
    hold names alone. Where two levels meet, the way back through them tells which names are on a
    shortest path, and the path is then walked from its source: at each step by the edge that
    comes first. Pairs without a path, or with an unknown end, have no row.
    """
    names = entities.select("name").distinct()
    known = pairs.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi").select("pair_id", "source", "target")
    known = cut(known.dropDuplicates(["pair_id"]))
    single = known.select("pair_id", F.array("source").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    found = [single.join(known.filter("source = target"), "pair_id", "left_semi")]
    edges = stored(relations.select("ref_id", "from_entity", "to_entity", "relation_type", "ord"))  # read at every level
    edges = both_ways(edges)
    open_ = known.filter("source <> target")
    sides = [[cut(open_.select("pair_id", F.col(end).alias("name")))] for end in ("source", "target")]
    sizes = [side[0].count() for side in sides]
    while all(sizes):
        turn = 0 if sizes[0] <= sizes[1] else 1
        own, other = sides[turn], sides[1 - turn]
        step = _from(edges, own[-1], sizes[turn]).select("pair_id", F.col("b").alias("name")).distinct().join(names, "name", "left_semi")
        for seen in own[-2:]:
            step = step.join(seen, ["pair_id", "name"], "left_anti")
        own.append(cut(step.select("pair_id", "name")))
        met = cut(own[-1].join(other[-1], ["pair_id", "name"], "left_semi"))
        ended = met.select("pair_id").distinct()
        n = met.count()
        if n:
            found.append(_walked(edges, known, _between(edges, *sides, met, n)))
            open_now = lambda level: level.join(ended, "pair_id", "left_anti")
            sides = [[open_now(level) for level in side[:-1]] + [cut(open_now(side[-1]))] for side in sides]
            sizes = [side[-1].count() for side in sides]
        else:
            sizes[turn] = own[-1].count()
            # A pair whose side has no further level has no path.
            if sizes[turn]:
                stuck = other[-1].select("pair_id").distinct().join(own[-1].select("pair_id"), "pair_id", "left_anti")
                other[-1] = cut(other[-1].join(stuck, "pair_id", "left_anti"))
                sizes[1 - turn] = other[-1].count()
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _between(edges: DataFrame, near: list[DataFrame], far: list[DataFrame], met: DataFrame, n: int) -> list[DataFrame]:
    """For pairs whose levels met: the names (pair_id, name) that are on a shortest path, from the first step's to the target."""
    ways = []
    for side in (near, far):
        marked, size, steps = met, n, []
        for level in reversed(side[:-1]):
            back = _from(edges, marked, size).select("pair_id", F.col("b").alias("name")).distinct()
            marked = cut(level.join(back, ["pair_id", "name"], "left_semi"))
            size = marked.count()
            steps.append(marked)
        ways.append(steps)
    return [*reversed(ways[0][:-1]), met, *ways[1]] if ways[0] else [met, *ways[1]]


def _walked(edges: DataFrame, known: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The paths through the levels, each step by the edge that comes first."""
    at = known.join(levels[-1].select("pair_id").distinct(), "pair_id", "left_semi").select("pair_id", F.col("source").alias("name"), F.array("source").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    at = cut(at)
    n = at.count()
    for level in levels:
        step = _from(edges, at, n).select("pair_id", F.col("b").alias("name"), "ord", "edge", "nodes", "edges").join(level, ["pair_id", "name"], "left_semi")
        first = step.groupBy("pair_id").agg(F.min_by(F.struct("name", "edge", "nodes", "edges"), F.struct("ord", "name")).alias("s"))
        at = cut(first.select("pair_id", "s.name", F.concat("s.nodes", F.array("s.name")).alias("nodes"), F.concat("s.edges", F.array(F.col("s.edge").cast("string"))).alias("edges")))
    return at.select("pair_id", "nodes", "edges")


def few(rows: DataFrame) -> DataFrame:
    """Rows that are sent to the tasks of the other side of a join where they are few (they are counted), else joined by a shuffle."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def neighbours(entities: DataFrame, relations: DataFrame, hits: DataFrame) -> DataFrame:
    """Entities one hop from any hit (name, rank) that are no hits, with the first hit's rank and place: first seen first."""
    hits = few(hits.select("name", "rank"))
    near = both_ways(relations).join(hits.select(F.col("name").alias("a"), "rank"), "a").groupBy(F.col("b").alias("name")).agg(F.min("rank").alias("rank"))
    fresh = near.join(hits.select("name"), "name", "left_anti").join(entities.select("name", "ord"), "name")
    return placed(fresh, "rank", "ord").select("name", "rank", "place")


def touching(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with either end among ``names``, each once: two semi-joins, since one with OR could not be hashed."""
    names = few(names.select("name").distinct())
    one, other = (names.select(F.col("name").alias(c)) for c in ("from_entity", "to_entity"))
    return relations.join(one, "from_entity", "left_semi").unionByName(relations.join(other, "to_entity", "left_semi")).dropDuplicates(["ref_id"])


def top_pairs(hits: DataFrame, top: int = 5, most: int = 10) -> DataFrame:
    """pair_id, source and target: pairs of the first ``top`` hits (name, rank), the first ``most`` of them."""
    best = hits.orderBy("rank").limit(top)
    a, b = (best.select(F.col("name").alias(n), F.col("rank").alias(r)) for n, r in (("source", "i"), ("target", "j")))
    pairs = a.join(F.broadcast(b), F.col("i") < F.col("j"))  # ``top`` rows at most on either side
    return pairs.orderBy("i", "j").limit(most).withColumn("pair_id", F.row_number().over(Window.orderBy("i", "j"))).select("pair_id", "source", "target")


def resolve_refs(refs: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """refs (ref_id) with kind and label: the entity of that id, else the relation; ids of neither are left out."""
    e = entities.select("ref_id", F.col("name").alias("entity"))
    r = relations.select("ref_id", F.concat_ws(" ", "from_entity", "relation_type", "to_entity").alias("relation"))
    found = refs.join(e, "ref_id", "left").join(r, "ref_id", "left").withColumn("label", F.coalesce("entity", "relation"))
    return found.filter("label is not null").withColumn("kind", F.when(F.col("entity").isNotNull(), "entity").otherwise("relation")).drop("entity", "relation")


def summary(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: entities, relations, and the sorted distinct types of both as text."""
    types = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    e = entities.agg(F.count("*").alias("entities"), types("entity_type").alias("entity_types"), F.sum(F.col("is_root").cast("int")).cast("long").alias("roots"))
    r = relations.agg(F.count("*").alias("relations"), types("relation_type").alias("relation_types"))
    return e.crossJoin(r)  # one row each


def roots(entities: DataFrame) -> DataFrame:
    return entities.filter("is_root").select("name", "entity_type").orderBy("name")
