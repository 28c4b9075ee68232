"""Named vector collections and exact cosine search.

A collection table has collection, ref_id, text, vector (array of numbers), norm and ord (insertion
order, which breaks ties). Tables are values: each change gives a new DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions.lineage import cut

#: The smallest denominator of a cosine: a zero vector scores 0.
FLOOR = 1e-10
SCHEMA = "collection string, ref_id string, text string, vector array<double>, norm double, ord long"


def norm(vector: Column | str) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of ``dim`` components without nulls, and those as a matrix."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    ok = lengths == dim
    flat = pa.array(column).filter(pa.array(ok)).flatten()
    if flat.null_count:
        rows = column.to_pylist()
        ok = np.array([r is not None and len(r) == dim and None not in r for r in rows])
        return ok, np.array([r for r, good in zip(rows, ok) if good], float).reshape(-1, dim)
    return ok, flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def cosine(vector: Column | str, query: Sequence[float]) -> Column:
    """Cosine with one query vector, a batch of rows at a time; null for another dimension."""
    q = np.asarray(query, float)
    size = float(np.sqrt(q @ q))

    def run(column: pa.Array) -> pa.Array:
        ok, rows = _matrix(column, len(q))
        out = np.full(len(column), np.nan)
        out[ok] = rows @ q / np.maximum(np.sqrt((rows * rows).sum(1)) * size, FLOOR)
        return pa.array(out, mask=~ok)

    return F.arrow_udf(run, "double")(vector)


def search(vectors: DataFrame, query: Sequence[float], k: int, vector: str = "vector", ref_id: str = "ref_id", ord: str = "ord") -> DataFrame:
    """The k best rows by cosine: ref_id, score and rank; ties in insertion order. Fewer rows if there are fewer."""
    scored = vectors.select(F.col(ref_id).alias("ref_id"), F.col(ord).alias("ord"), cosine(vector, query).alias("score")).filter("score is not null")
    top = scored.orderBy(F.desc("score"), "ord").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord"))).select("ref_id", "score", "rank")


def _best(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the places of its k largest scores, the largest first, of equal ones the earlier first."""
    if k >= scores.shape[1]:
        return list(np.argsort(-scores, axis=1, kind="stable"))
    at = scores.shape[1] - k
    least = np.partition(np.where(np.isnan(scores), -np.inf, scores), at, axis=1)[:, at]
    near = [np.flatnonzero(~(s < m)) for s, m in zip(scores, least)]  # what is no number is put last by the sort
    return [p[np.argsort(-s[p], kind="stable")][:k] for s, p in zip(scores, near)]


def search_all(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "vector", ref_id: str = "ref_id", block: int = 8192, shard: int = 32768, at_once: int = 1 << 22) -> DataFrame:
    """query_id, ref_id, score and rank of the k best rows for each query (columns query_id and vector).

    Vectors are dealt to shards and queries to blocks; each shard meets each block in a group of its
    own, of at most about ``shard`` vectors and ``block`` queries, and keeps the k best for each query
    before anything else is shuffled. Of a group's scores ``at_once`` are held at a time, whatever its
    size. Nothing comes to the driver. Ties go to the smaller ref_id.
    """
    rows = vectors.select(F.col(ref_id).alias("ref_id"), F.col(vector).cast("array<double>").alias("vector")).filter("vector is not null")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
    shards, blocks = max(1, -(-rows.count() // shard)), max(1, -(-asked.count() // block))
    kinds = dict(rows.dtypes) | dict(asked.dtypes)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", dealt("ref_id", shards)).withColumn("block", each(blocks)).groupBy("shard", "block")
    right = asked.withColumn("block", dealt("query_id", blocks)).withColumn("shard", each(shards)).groupBy("shard", "block")

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        out = []
        for dim in set(q.column("vector").combine_chunks().value_lengths().to_pylist()):
            (ok, x), (asks, y) = (_matrix(t.column("vector").combine_chunks(), dim) for t in (c, q))
            if len(x) and len(y):
                refs, ids = np.asarray(c.column("ref_id"))[ok], np.asarray(q.column("query_id"))[asks]
                order = np.argsort(refs, kind="stable")
                refs, x = refs[order], x[order]
                sizes, step = np.sqrt((x * x).sum(1)), max(1, at_once // len(x))
                for at in range(0, len(y), step):
                    part = y[at : at + step]
                    scores = part @ x.T / np.maximum(np.sqrt((part * part).sum(1))[:, None] * sizes, FLOOR)
                    best = _best(scores, k)
                    out.append((np.repeat(ids[at : at + step], [len(b) for b in best]), refs[np.concatenate(best)], np.concatenate([s[b] for s, b in zip(scores, best)])))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        fields = (("query_id", q.schema.field("query_id").type), ("ref_id", c.schema.field("ref_id").type), ("score", pa.float64()))
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(fields, columns)})

    found = left.cogroup(right).applyInArrow(run, f"query_id {kinds['query_id']}, ref_id {kinds['ref_id']}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def create_collection(collections: DataFrame, name: str, dimension: int, backend: str = "memory", tenant: str | None = None) -> DataFrame:
    """The registry (name, dimension, backend, tenant, status) with one more row, unless the name is there."""
    if dimension < 1:
        raise ValueError("dimension must be at least 1")
    new = collections.sparkSession.createDataFrame([(name, dimension, backend, tenant, "ready")], "name string, dimension int, backend string, tenant string, status string")
    return collections.unionByName(new.join(collections, "name", "left_anti"))


def add(vectors: DataFrame, entries: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (collection, ref_id, text, vector and, for their order, ord) upserted by (collection, ref_id), and those refused with a reason.

    An entry is refused if its collection is not registered or its vector has another dimension. Of
    several entries with one key the last by ord counts; new rows go after all present ones, in their
    order. Entries without the column ord are taken as they are stored, which only a table that is read
    the same way each time makes certain.
    """
    known = collections.select(F.col("name").alias("collection"), "dimension")
    place = F.col("ord").cast("long") if "ord" in entries.columns else F.monotonically_increasing_id()
    checked = entries.withColumn("place", place).join(known, "collection", "left").withColumn(
        "reason", F.when(F.col("dimension").isNull(), "unknown collection").when(F.size("vector") != F.col("dimension"), "wrong dimension")
    )
    good = checked.filter("reason is null")
    last = good.groupBy("collection", "ref_id").agg(F.max_by(F.struct("text", "vector"), "place").alias("e"), F.max("place").alias("place"))
    base = vectors.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("base"))
    vector = F.col("e.vector").cast("array<double>")
    # The one row with the next free place is all that is crossed with.
    fresh = last.crossJoin(F.broadcast(base)).select("collection", "ref_id", "e.text", vector.alias("vector"), norm(vector).alias("norm"), (F.col("base") + F.col("place")).alias("ord"))
    kept = vectors.join(fresh.select("collection", "ref_id"), ["collection", "ref_id"], "left_anti")
    return kept.unionByName(fresh), checked.filter("reason is not null").select("collection", "ref_id", "reason")


def remove(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the rows whose (collection, ref_id) is in ``keys``; unknown keys are ignored."""
    return vectors.join(keys, ["collection", "ref_id"], "left_anti")


def of_tenant(vectors: DataFrame, collections: DataFrame, tenant: str) -> DataFrame:
    """Rows of the collections of a tenant; a collection without one belongs to the default tenant given."""
    own = collections.filter(F.coalesce("tenant", F.lit(tenant)) == tenant).select(F.col("name").alias("collection"))
    return vectors.join(own, "collection", "left_semi")


def by_backend(vectors: DataFrame, collections: DataFrame, backend: str) -> DataFrame:
    """Rows whose collection is kept by a backend; an unregistered collection counts as in memory."""
    own = collections.select(F.col("name").alias("collection"), "backend")
    return vectors.join(own, "collection", "left").filter(F.coalesce("backend", F.lit("memory")) == backend).drop("backend")


def save(vectors: DataFrame, path: str) -> None:
    """Parquet, one folder a collection, so that a read of one collection prunes the others."""
    vectors.write.mode("overwrite").partitionBy("collection").parquet(path)


def load(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """What ``save`` wrote; an empty table if nothing is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.filter(F.col("collection") == collection) if collection else rows


def persist(vectors: DataFrame, path: str, changed: Sequence[str]) -> None:
    """Writes the named collections (of one batch of changes) again, each to its own folder of what ``save`` wrote; an emptied one keeps no rows."""
    for name in changed:
        rows = cut(vectors.filter(F.col("collection") == name).drop("collection"))  # may have been read from that folder
        rows.write.mode("overwrite").parquet(f"{path}/collection={name}")


def dumped(vectors: DataFrame) -> DataFrame:
    """collection, ref_id and state: each entry as one JSON text, from which ``restored`` makes the table again."""
    return vectors.select("collection", "ref_id", F.to_json(F.struct("ref_id", "text", "vector", "norm", "ord")).alias("state"))


def restored(dump: DataFrame) -> DataFrame:
    fields = "ref_id string, text string, vector array<double>, norm double, ord long"
    return dump.select("collection", F.from_json("state", fields).alias("e")).select("collection", "e.*")


def search_collection(vectors: DataFrame, statuses: DataFrame, collection: str, query: Sequence[float], k: int, available: bool = True) -> DataFrame:
    """The k best rows of a collection, each with the collection's status and how many rows wait to be indexed.

    Statuses: collection, status, pending, as of ``indexing_status``; without one a collection is ready.
    Nothing is changed. No rows if the backend is not available, or the query has another dimension.
    """
    own = vectors.filter(F.col("collection") == collection)
    hits = search(own if available else own.filter(F.lit(False)), query, k)
    status = statuses.filter(F.col("collection") == collection).groupBy("collection").agg(F.max("status").alias("status"), F.max("pending").alias("pending"))
    told = hits.withColumn("collection", F.lit(collection)).join(F.broadcast(status), "collection", "left")  # one row
    return told.fillna({"status": "ready", "pending": 0})


def embedding_requests(entries: DataFrame, collection: str = "collection") -> tuple[DataFrame, DataFrame]:
    """Entries that have no vector yet, and the events queued by them: collection, kind, n and ord."""
    waiting = entries.filter("vector is null and text is not null")
    return waiting, waiting.groupBy(collection).agg(F.count("*").alias("n"), F.max("ord").alias("ord")).select(F.col(collection).alias("collection"), F.lit("queued").alias("kind"), "n", "ord")


def answered(answers: DataFrame) -> DataFrame:
    """The events of answers (collection, ref_id, vector, ord): those with a vector are done, the others failed; collection, kind, n, ord."""
    kind = F.when(F.col("vector").isNotNull(), "done").otherwise("failed")
    return answers.groupBy("collection", kind.alias("kind")).agg(F.count("*").alias("n"), F.max("ord").alias("ord"))


def indexing_status(outcomes: DataFrame) -> DataFrame:
    """Per collection: pending and status, from events (collection, kind in queued, done, failed; n; ord).

    Each queued row waits until it is done or failed; the count does not go below zero. A failure with
    nothing done after it is an error; else the collection is ready when nothing waits.
    """
    sums = outcomes.groupBy("collection").agg(
        F.greatest(F.lit(0), F.sum(F.when(F.col("kind") == "queued", F.col("n")).otherwise(-F.col("n")))).alias("pending"),
        F.max_by("kind", "ord").alias("last"),
    )
    status = F.when(F.col("last") == "failed", "error").when(F.col("pending") > 0, "indexing").otherwise("ready")
    return sums.select("collection", F.col("pending").cast("long").alias("pending"), status.alias("status"))
