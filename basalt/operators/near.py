"""A stored index for near-vector search: cells around centres, quantised residuals, exact scores for what is left.

An index is a folder: ``model`` (centres and code books), ``rows`` (by version and cell) and ``changes``
(by version: the keys that a version adds or removes). A version is seen once its changes are written,
so a change is seen whole or not at all, and nothing is rebuilt for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.lineage import cut
from basalt.operators.vectors import FLOOR, _matrix

ROWS = "version int, cell int, ref_id string, code binary, vector array<double>"
CHANGES = "version int, ref_id string, removed boolean"
#: Centres of a code book: a code of one byte names them.
CODES = 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), FLOOR)


def _nearest(x: np.ndarray, centres: np.ndarray, k: int = 1, at_once: int = 4096) -> np.ndarray:
    """The numbers of the k nearest centres of each row, nearest first, ties to the smaller number."""
    own = (centres * centres).sum(1)
    found = [np.argsort(own - 2 * x[i : i + at_once] @ centres.T, axis=1, kind="stable")[:, :k] for i in range(0, len(x), at_once)]
    return np.concatenate(found) if found else np.zeros((0, k), int)


class Model:
    """Centres of the cells, and for each part of the components a code book of residuals."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]) -> None:
        self.centres, self.books = centres, books

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """One byte for each part of a row's residual."""
        return np.stack([_nearest(part, book)[:, 0] for part, book in zip(self._parts(x - self.centres[cell]), self.books)], axis=1).astype(np.uint8)

    def approximate(self, asked: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Dot products (queries x rows) with what the codes of one cell stand for: a table for each query and part, and sums of its entries."""
        total = np.repeat((asked @ self.centres[cell])[:, None], len(codes), axis=1)
        for k, (part, book) in enumerate(zip(self._parts(asked), self.books)):
            total += (part @ book.T)[:, codes[:, k]]
        return total

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("centre", 0, i, c.tolist()) for i, c in enumerate(self.centres)] + [("book", k, i, c.tolist()) for k, b in enumerate(self.books) for i, c in enumerate(b)]
        spark.createDataFrame(rows, "kind string, part int, i int, vector array<double>").write.parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        rows = sorted((r["kind"], r["part"], r["i"], r["vector"]) for r in spark.read.parquet(f"{path}/model").collect())  # cells and CODES rows a part
        books: dict[int, list] = {}
        for kind, part, _, v in rows:
            if kind == "book":
                books.setdefault(part, []).append(v)
        return Model(np.array([v for kind, _, _, v in rows if kind == "centre"]), [np.array(books[k]) for k in sorted(books)])


def build(vectors: DataFrame, path: str, cells: int | None = None, parts: int = 8, rounds: int = 4, sample: int = 20_000, most_cells: int = 65_536) -> None:
    """Writes a new index of rows (ref_id, vector) to ``path``.

    There are ``cells`` cells, or about the square root of the number of rows, ``most_cells`` at most.
    Their centres are rows drawn by a hash of the id, moved by ``rounds`` of k-means over all rows: each task sends a sum
    and a count for each cell. Code books, of ``parts`` parts, are fitted on about ``sample`` rows.
    All rows are indexed. Null vectors and ids and vectors of a dimension other than the most frequent one are left out;
    of rows with one id one stays. An empty table gives an index that finds nothing.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("ref_id").cast("string").alias("ref_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.filter("ref_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = cut(rows.groupBy("ref_id").agg(F.min("vector").alias("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        Model(np.zeros((1, 1)), [np.zeros((1, 1))]).save(spark, path)
        _write(spark, rows, path, 0, Model(np.zeros((1, 1)), [np.zeros((1, 1))]))
        return
    dim, n = sizes["dim"], sizes["count"]
    rows = rows.filter(F.size("vector") == dim)
    wanted = min(cells or max(1, round(n**0.5)), most_cells, n)
    drawn = rows.orderBy(F.xxhash64(F.lit("centre"), "ref_id"), "ref_id").limit(wanted).select("vector").collect()
    centres = np.unique(_unit(np.array([r["vector"] for r in drawn])), axis=0)
    for _ in range(rounds):
        centres = _moved(rows, centres)
    fitted = rows.orderBy(F.xxhash64(F.lit("book"), "ref_id"), "ref_id").limit(sample).select("vector").collect()
    x = _unit(np.array([r["vector"] for r in fitted]))
    residual = x - centres[_nearest(x, centres)[:, 0]]
    model = Model(centres, [_book(part) for part in np.array_split(residual, min(parts, dim), axis=1)])
    model.save(spark, path)
    _write(spark, rows, path, 0, model)


def _moved(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """One round of k-means: the mean of each cell's unit vectors; an empty cell's centre stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = _unit(_matrix(batch.column(0), centres.shape[1])[1])
            cell = _nearest(x, centres)[:, 0]
            np.add.at(total, cell, x)
            count += np.bincount(cell, minlength=len(centres))
        full = np.flatnonzero(count)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(count[full]), pa.array(list(total[full]), pa.list_(pa.float64()))], names=["cell", "n", "sum"])

    def added(table: pa.Table) -> pa.Table:  # a row from each task
        total = np.array(table.column("sum").to_pylist()).sum(0) / sum(table.column("n").to_pylist())
        return pa.table({"cell": table.column("cell")[:1], "centre": pa.array([total.tolist()], pa.list_(pa.float64()))})

    found = rows.select("vector").mapInArrow(sums, "cell int, n long, sum array<double>").groupBy("cell").applyInArrow(added, "cell int, centre array<double>").collect()  # one row a cell
    moved = centres.copy()
    for r in found:
        moved[r["cell"]] = r["centre"]
    return moved


def _book(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """CODES centres, or fewer, of one part of the residuals."""
    book = np.unique(x[: 4 * CODES], axis=0)
    book = book[:: max(1, len(book) // CODES)][:CODES]
    for _ in range(rounds):
        own = _nearest(x, book)[:, 0]
        count = np.bincount(own, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def _write(spark: SparkSession, rows: DataFrame, path: str, version: int, model: Model, removed: DataFrame | None = None) -> None:
    """Rows first, then the changes that make them seen."""
    dim = model.centres.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = _matrix(batch.column(1), dim)
            if len(x):
                x = _unit(x)
                cell = _nearest(x, model.centres)[:, 0]
                codes = [bytes(c) for c in model.codes(x, cell)]
                kept = batch.filter(pa.array(ok))
                yield pa.record_batch([pa.array(cell.astype(np.int32)), kept.column(0), pa.array(codes, pa.binary()), kept.column(1)], names=["cell", "ref_id", "code", "vector"])

    placed = rows.select("ref_id", "vector").mapInArrow(place, "cell int, ref_id string, code binary, vector array<double>")
    # A large cell is spread over several files, so that no task writes a whole one.
    placed.repartition("cell", F.pmod(F.xxhash64("ref_id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows/version={version}")
    changed = rows.select("ref_id", F.lit(False).alias("removed"))
    if removed is not None:
        changed = changed.unionByName(removed.select("ref_id", F.lit(True).alias("removed")))
    changed.write.mode("overwrite").parquet(f"{path}/changes/version={version}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose changes are written to the end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/changes")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in fs.listStatus(hadoop)]
    whole = [p for p in folders if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


def upsert(rows: DataFrame, path: str, removed: DataFrame | None = None) -> None:
    """Rows (ref_id, vector) take the place of earlier ones of their ids, and the ids of ``removed`` (ref_id) go; the cells stay as they are.

    Vectors of another dimension, and null ids and vectors, are refused as a whole.
    """
    spark = rows.sparkSession
    model, version = Model.load(spark, path), _versions(spark, path)[-1] + 1
    rows = cut(rows.select(F.col("ref_id").cast("string").alias("ref_id"), F.col("vector").cast("array<double>").alias("vector")))
    sound = F.coalesce(F.expr("ref_id is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))") & (F.size("vector") == model.centres.shape[1]), F.lit(False))
    if not rows.filter(~sound).isEmpty():
        raise ValueError("a row has no id or a vector that the index does not take")
    if removed is not None:
        removed = removed.select(F.col("ref_id").cast("string").alias("ref_id"))
    _write(spark, rows.groupBy("ref_id").agg(F.min("vector").alias("vector")), path, version, model, removed)


def live(spark: SparkSession, path: str) -> DataFrame:
    """The index's rows as they stand: each id once, in its last version, unless that removes it."""
    versions = _versions(spark, path)
    rows = spark.read.option("basePath", f"{path}/rows").schema(ROWS).parquet(*(f"{path}/rows/version={v}" for v in versions))
    if len(versions) == 1:
        return rows
    # The first version's own keys are no changes; those of later ones are as many as have changed since.
    later = spark.read.option("basePath", f"{path}/changes").schema(CHANGES).parquet(*(f"{path}/changes/version={v}" for v in versions[1:]))
    last = later.groupBy(F.col("ref_id").alias("of")).agg(F.max("version").alias("since"), F.max(F.struct("version", "removed"))["removed"].alias("gone"))
    stale = (F.col("ref_id") == F.col("of")) & ((F.col("version") < F.col("since")) | F.col("gone"))
    return rows.join(last, stale, "left_anti")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = 8, refine: int | None = 10, shard: int = 65_536, block: int = 2048) -> DataFrame:
    """query_id, ref_id, score and rank of the k rows of the largest cosine found for each query (query_id, vector).

    A query looks in the ``probes`` cells whose centres are nearest to it (None: in all). There, codes alone tell
    the ``refine`` times k best rows, whose vectors are then read for exact scores; with ``refine``
    None all rows of these cells are scored exactly, so that None and None is exact search. Ties go to
    the smaller ref_id. A cell's rows are dealt to shards and queries to blocks, so a group has a bounded
    number of both; only cells that a query probes are read. Null vectors and those of another dimension find nothing.
    """
    model = Model.load(spark, path)
    dim, n_cells = model.centres.shape[1], len(model.centres)
    reach = n_cells if probes is None else min(probes, n_cells)
    kind = dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = _matrix(batch.column(1), dim)
            at = np.repeat(np.flatnonzero(ok), reach)
            cell = _nearest(_unit(x), model.centres, reach).ravel()
            yield pa.record_batch([*(c.take(pa.array(at)) for c in batch.columns), pa.array(cell.astype(np.int32))], names=["query_id", "vector", "cell"])

    asked = cut(asked.mapInArrow(visits, f"query_id {kind}, vector array<double>, cell int"))
    probed = [r["cell"] for r in asked.select("cell").distinct().collect()]  # as many as there are cells at most
    rows = live(spark, path).filter(F.col("cell").isin(probed)) if len(probed) < n_cells else live(spark, path)
    blocks = max(1, -(-asked.select("query_id").distinct().count() // block))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    sizes = cut(sizes)  # one row a cell
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    left = rows.select("cell", "ref_id", "code" if refine else "vector").join(F.broadcast(sizes), "cell").withColumn("shard", dealt("ref_id", F.col("shards"))).drop("shards")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.join(F.broadcast(sizes), "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards").withColumn("block", dealt("query_id", F.lit(blocks)))
    best = k * refine if refine else k

    def scored(c: pa.Table, q: pa.Table) -> pa.Table:
        out: Sequence = ([], [], [])
        if c.num_rows and q.num_rows:
            refs = np.asarray(c.column("ref_id").to_pylist(), object)
            order = np.argsort(refs, kind="stable")
            y = _matrix(q.column("vector").combine_chunks(), dim)[1]
            if refine:
                codes = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(len(refs), -1)[order]
                scores = model.approximate(_unit(y), c.column("cell")[0].as_py(), codes)
            else:
                scores = exact(y, _matrix(c.column("vector").combine_chunks(), dim)[1][order])
            top = np.argsort(-scores, axis=1, kind="stable")[:, :best]
            ids = np.asarray(q.column("query_id").to_pylist(), object)
            out = np.repeat(ids, top.shape[1]), refs[order][top].ravel(), np.take_along_axis(scores, top, 1).ravel()
        return pa.table({"query_id": pa.array(out[0], q.schema.field("query_id").type), "ref_id": pa.array(out[1], pa.string()), "score": pa.array(out[2], pa.float64())})

    keys = ["cell", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scored, f"query_id {kind}, ref_id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    if not refine:
        return found

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(i), dim)[1] for i in (2, 3))
            score = (x * y).sum(1) / np.maximum(np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)), FLOOR)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "ref_id", "score"])

    whole = found.select("query_id", "ref_id").join(rows.select("ref_id", "vector"), "ref_id")
    both = whole.join(asked.select("query_id", F.col("vector").alias("asked")).dropDuplicates(["query_id"]), "query_id").select("query_id", "ref_id", "vector", "asked")
    return both.mapInArrow(again, f"query_id {kind}, ref_id string, score double").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the rows of y with those of x."""
    return y @ x.T / np.maximum(np.sqrt((y * y).sum(1))[:, None] * np.sqrt((x * x).sum(1)), FLOOR)
