"""Nearest neighbours by vantage-point trees, one per shard of the vectors; queries go only to shards that may hold an answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut, held, share

LEAF = 48
#: What is allowed for rounding where bounds are compared with distances.
MORE, LEAST = 1 + 1e-9, 1e-9
#: Queries that are searched for together.
TOGETHER = 1024


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a and of b, squares added in the order of the components."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += np.square(a[:, j, None] - b[None, :, j])
    return np.sqrt(total)


class Tree:
    """A vantage-point tree: a node's point, and the median distance to it that parts the others."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.points, self.leaf = ids[order], rows[order], points[order], leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # The vantage point is the one farthest from the first: points at the border part the rest best.
        far = rows[np.argmax(distances(self.points[rows[:1]], self.points[rows])[0])]
        rest = rows[rows != far]
        d = distances(self.points[[far]], self.points[rest])[0]
        radius = float(np.median(d))
        inside = d <= radius
        if len(rest) - inside.sum() < len(rest) // 8:  # copies of one vector, or many as far: no radius parts them
            return rows
        return far, radius, self._build(rest[inside]), self._build(rest[~inside])

    def nearest(self, query_rows: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids (n x k; infinity where there are fewer) of the nearest other rows, ties to the smaller id.

        A subtree is left out for a query if the triangle inequality puts it at more than the k-th best
        distance so far divided by ``factor``: 1 is exact, more is faster and may miss some. ``limit`` is
        a distance within which k rows for a query are known to be already.
        """
        # Points stand in the order of their ids and rows, so a point's place tells both, and the order of ties.
        best = np.full((len(queries), k), np.inf), np.full((len(queries), k), len(self.ids))
        every, limit = np.arange(len(queries)), np.full(len(queries), np.inf) if limit is None else limit
        self._descend(self.root, every, query_rows, queries, best)
        self._visit(self.root, every, np.zeros(len(queries)), query_rows, queries, best, factor, limit)
        return best[0], np.append(self.ids, 0)[best[1]]

    def _offer(self, rows: np.ndarray, q: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, best) -> None:
        if not len(q) or not len(rows):
            return
        for at in range(0, len(rows), 1024):
            part = rows[at : at + 1024]
            d, place = distances(queries[q], self.points[part]), np.broadcast_to(part, (len(q), len(part)))
            d = np.where(self.rows[place] == query_rows[q, None], np.inf, d)
            seen = (place[:, :, None] == best[1][q][:, None, :]).any(2)  # met on the way down already
            d = np.concatenate([best[0][q], np.where(seen, np.inf, d)], axis=1)
            place = np.concatenate([best[1][q], place], axis=1)
            order = np.lexsort((place, d), axis=1)[:, : best[0].shape[1]]
            best[0][q], best[1][q] = np.take_along_axis(d, order, 1), np.take_along_axis(place, order, 1)

    def _descend(self, node, q: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, best) -> None:
        """Each query goes to its own leaf only: a first bound on its k-th best distance."""
        if isinstance(node, np.ndarray):
            self._offer(node, q, query_rows, queries, best)
        elif len(q):
            d = distances(queries[q], self.points[[node[0]]])[:, 0]
            self._descend(node[2], q[d <= node[1]], query_rows, queries, best)
            self._descend(node[3], q[d > node[1]], query_rows, queries, best)

    def _visit(self, node, q: np.ndarray, bound: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, best, factor: float, limit: np.ndarray) -> None:
        near = bound * factor <= np.minimum(best[0][q, -1], limit[q]) * MORE + LEAST
        q, bound = q[near], bound[near]
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            self._offer(node, q, query_rows, queries, best)
            return
        far, radius, inside, outside = node
        self._offer(np.array([far]), q, query_rows, queries, best)
        d = distances(queries[q], self.points[[far]])[:, 0]
        self._visit(inside, q, np.maximum(bound, d - radius), query_rows, queries, best, factor, limit)
        self._visit(outside, q, np.maximum(bound, radius - d), query_rows, queries, best, factor, limit)


class Cells:
    """Parts of space around pivots: each vector is in the cell of its nearest pivot. For each cell the least and largest distance of its vectors to the pivot."""

    def __init__(self, pivots: list[np.ndarray]) -> None:
        self.pivots = {d: np.array([p for p in pivots if len(p) == d]) for d in {len(p) for p in pivots}}
        self.near: dict[int, np.ndarray] = {}
        self.far: dict[int, np.ndarray] = {}

    def of(self, dim: int) -> np.ndarray:
        """The pivots of one number of components; the origin if none was drawn."""
        return self.pivots.get(dim, np.zeros((1, dim)))

    def measured(self, rows: list) -> Cells:
        """``rows``: dim, cell, near and far of the cells that hold any vector; others are at infinity."""
        for dim in {r["dim"] for r in rows}:
            n = len(self.of(dim))
            self.near[dim], self.far[dim] = np.full(n, np.inf), np.full(n, -np.inf)
        for r in rows:
            self.near[r["dim"]][r["cell"]], self.far[r["dim"]][r["cell"]] = r["near"], r["far"]
        return self

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distance to the pivot."""
        d = distances(x, self.of(x.shape[1]))
        cell = d.argmin(1)
        return cell.astype(np.int32), d[np.arange(len(x)), cell]

    def beyond(self, x: np.ndarray, limit: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of ``x`` and a cell, not its own, that may hold vectors within the limit divided by ``factor``.

        A cell is out of reach by the triangle inequality on the ring that its vectors lie in, or because
        they are nearer to its pivot than to the row's own.
        """
        dim = x.shape[1]
        d = distances(x, self.of(dim))
        own = d.argmin(1)
        bound = np.maximum(np.maximum(d - self.far[dim], self.near[dim] - d), (d - d.min(1, keepdims=True)) / 2)
        reached = bound * factor <= limit[:, None] * MORE + LEAST
        reached[:, ~np.isfinite(self.near[dim])] = False
        reached[np.arange(len(x)), own] = False
        return np.nonzero(reached)


def nearest(
    df: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    factor: float = 1.0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    every: int = 100,
    shard_rows: int = 4096,
    most_cells: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of ``df`` for each query, by Euclidean distance in double precision.

    Queries are the rows of ``queries`` or else those of ``df`` whose id is divisible by ``every``; a
    query's own row of ``df`` is no candidate. Rows are dealt to cells around pivots, which are rows drawn by a hash
    of the id (about one for each ``shard_rows`` rows, ``most_cells`` at most), and cells to shards of
    about ``shard_rows`` by a hash. Each shard's tree is built once a search, in the task that the
    shard's rows come to, and queries pass through it. A query first searches the shards of its own cell;
    its k-th best distance there tells to which other cells it goes. ``factor`` 1 finds exactly the
    nearest ones; more leaves out cells and subtrees sooner. A task holds one shard and a batch of queries.

    A vector that is null, empty or zero, or holds a null, NaN or infinity takes no part, nor does a null
    id; vectors are compared with those of the same length only. Rows of one id are rows as any others: each is
    a candidate of the other, and if its id is divisible, a query with an answer of its own. Fewer than k
    candidates give fewer rows; an empty table gives none. Ties go to the smaller vec_id.
    """
    base = cut(_usable(df, vec_id, embedding))
    total = base.count()
    drawn = base.filter(share("row", "pivots", min(most_cells, -(-total // shard_rows)), total)).limit(2 * most_cells).select("vector").collect()
    cells = Cells([np.array(r["vector"]) for r in drawn])
    placed = cut(_placed(base, cells))
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.min("gap").alias("near"), F.max("gap").alias("far")).collect()  # one row a cell
    cells = cells.measured(sizes)
    spark = df.sparkSession
    parts = spark.createDataFrame([(r["dim"], r["cell"], -(-r["n"] // shard_rows)) for r in sizes], "dim int, cell int, parts long")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * shard_rows)))

    candidates = placed.join(F.broadcast(parts), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("row"), "parts").alias("part"), F.lit(0).alias("kind"), "row", "id", "vector", F.lit(0.0).alias("limit"))

    def found(asked: DataFrame) -> DataFrame:
        """query, query_id, vec_id and score of the k best in each shard for the rows asked (row, id, vector, dim, cell, limit)."""
        sent = asked.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        both = candidates.unionByName(sent.select("dim", "cell", "part", F.lit(1).alias("kind"), "row", "id", "vector", "limit"))
        dealt = both.repartition(tasks, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "kind")
        return dealt.mapInArrow(_searcher(k, factor), "query long, query_id long, vec_id long, score double")

    asked = _placed(_usable(queries, vec_id, embedding).withColumn("row", -1 - F.col("row")), cells) if queries is not None else placed.filter(F.col("id") % every == 0)
    asked = cut(asked.withColumn("limit", F.lit(float("inf"))))
    at_home = cut(found(asked))
    order = "row_number() over (partition by query order by score, vec_id)"
    limits = at_home.withColumn("rank", F.expr(order)).filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("limit"))
    known = asked.drop("limit").join(limits, "row", "left").fillna({"limit": float("inf")})

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, x in _by_length(batches):
            at, cell = cells.beyond(x, rows.column(3).to_numpy(), factor)
            yield pa.record_batch([c.take(pa.array(at)) for c in rows.columns] + [pa.array(cell.astype(np.int32))], names=["row", "id", "vector", "limit", "cell"])

    abroad = found(known.select("row", "id", "vector", "limit").mapInArrow(onward, "row long, id long, vector array<double>, limit double, cell int").withColumn("dim", F.size("vector")))
    ranked = at_home.unionByName(abroad).withColumn("rank", F.expr(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _placed(rows: DataFrame, cells: Cells) -> DataFrame:
    """row, id, vector, dim, cell and gap, the distance to the cell's pivot."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("vptree",), object)  # nothing to keep, but what other operators left goes
        for dim, part, x in _by_length(batches):
            cell, gap = cells.home(x)
            yield pa.record_batch([*part.columns, pa.array(np.full(len(x), dim, np.int32)), pa.array(cell), pa.array(gap)], names=["row", "id", "vector", "dim", "cell", "gap"])

    return rows.select("row", "id", "vector").mapInArrow(place, "row long, id long, vector array<double>, dim int, cell int, gap double")


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Rows whose vectors (the third column) have as many components, a bounded number at once, and those as a matrix."""
    for batch in batches:
        lens = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lens):
            rows = np.flatnonzero(lens == dim)
            for at in range(0, len(rows), TOGETHER):
                part = batch.take(pa.array(rows[at : at + TOGETHER]))
                yield int(dim), part, part.column(2).flatten().to_numpy().reshape(-1, int(dim))


def _searcher(k: int, factor: float):
    """Rows come shard by shard, first a shard's vectors, then the queries that pass through its tree."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, points, tree = None, [], [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()] if len(keys) else []
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if shard != (now := tuple(keys[a, :3].tolist())):
                    shard, ids, rows, points, tree = now, [], [], [], None
                for at in range(a, b, TOGETHER):
                    part = batch.slice(at, min(TOGETHER, b - at))
                    row, own, x = part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(6).flatten().to_numpy().reshape(-1, shard[0])
                    if keys[a, 3] == 0:
                        rows.append(row)
                        ids.append(own)
                        points.append(x)
                    elif ids:
                        if tree is None:
                            tree = Tree(np.concatenate(ids), np.concatenate(rows), np.concatenate(points))
                        d, near = tree.nearest(row, x, k, factor, part.column(7).to_numpy())
                        some = ~np.isinf(d)
                        asked = (pa.array(np.repeat(c, some.sum(1))) for c in (row, own))
                        yield pa.record_batch([*asked, pa.array(near[some]), pa.array(d[some])], names=["query", "query_id", "vec_id", "score"])

    return search


def _usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """row (the row's place), id, vector and dim of the rows that take part."""
    vector = F.col(embedding).cast("array<double>")
    sound = "id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), vector.alias("vector"))
    return rows.filter(sound).withColumn("dim", F.size("vector"))
