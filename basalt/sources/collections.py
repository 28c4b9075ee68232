"""Stored vector collections as a Spark data source: partitioned by collection, tenant and bucket, changed by whole commits.

A store is a folder with data files and one small file for each commit; readers see what commits name,
so a batch is visible as a whole or not at all. ``spark.read.format("collections")``,
``df.write.format("collections")`` and ``writeStream`` work alike; ``register`` makes the name known.
"""

from __future__ import annotations

import json
import posixpath
import re
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, EqualTo, Filter, In, InputPartition, IsNull, WriterCommitMessage

SCHEMA = "collection string, tenant string, ref_id string, text string, vector array<double>"
#: Rows of one collection and tenant are dealt to so many buckets by their ref_id.
BUCKETS = 8
#: Files that a task keeps open at once (of sorted rows, one); beyond it they are closed, and their keys go on in further ones. Each holds some megabytes.
OPEN = 64


class Store:
    """The files and commits under one path, which may be any that the Arrow file systems know."""

    def __init__(self, path: str) -> None:
        local = re.sub("^file:/*", "/", path)
        self.fs, self.root = (pfs.LocalFileSystem(), local) if local.startswith("/") else pfs.FileSystem.from_uri(path)

    def at(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def commits(self) -> list[dict]:
        """All commits in their order, without those that another one replaces."""
        found = self.fs.get_file_info(pfs.FileSelector(self.at("commits"), allow_not_found=True))
        read = [json.loads(self.fs.open_input_file(x.path).read()) for x in found if x.path.endswith(".json")]
        gone = {name for c in read for name in c.get("replaces", ())}
        return sorted((c for c in read if c["name"] not in gone), key=lambda c: (c["at"], c["name"]))

    def commit(self, kind: str, name: str | None = None, **what: object) -> bool:
        """Makes a change visible; False if a commit of that name is there already. The file appears under its name when it is whole."""
        name = name or uuid.uuid4().hex
        path = self.at("commits", f"{name}.json")
        if self.fs.get_file_info(path).type != pfs.FileType.NotFound:
            return False
        self.fs.create_dir(self.at("commits"))
        with self.fs.open_output_stream(f"{path}.part") as out:
            out.write(json.dumps({"name": name, "at": time.time_ns(), "kind": kind} | what).encode())
        self.fs.move(f"{path}.part", path)
        return True

    def registry(self) -> dict[str, dict]:
        """Dimension and tenants of each collection."""
        known: dict[str, dict] = {}
        for c in self.commits():
            if c["kind"] == "create":
                own = known.setdefault(c["collection"], {"dimension": c["dimension"], "tenants": []})
                own["tenants"] = sorted({*own["tenants"], *([c["tenant"]] if c["tenant"] else [])})
        return known


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to the session, and lets its filters reach it."""
    spark.dataSource.register(CollectionSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def create(path: str, collection: str, dimension: int, tenant: str | None = None) -> None:
    """Makes a collection, or a further tenant of it; one that is there stays as it is."""
    if dimension < 1:
        raise ValueError("dimension must be at least 1")
    store = Store(path)
    own = store.registry().get(collection)
    if own is None or tenant and tenant not in own["tenants"]:
        store.commit("create", collection=collection, dimension=own["dimension"] if own else dimension, tenant=tenant)


def add(entries: DataFrame, path: str) -> None:
    """Writes entries (collection, tenant, ref_id, text, vector) in one commit; they take the place of earlier ones of their key.

    Refused as a whole if a collection or tenant is unknown, a ref_id is null or a vector has another
    dimension. Rows of one key within the batch all stay.
    """
    _write(entries.select("collection", "tenant", "ref_id", "text", "vector"), path, "add")


def remove(keys: DataFrame, path: str) -> None:
    """Takes the entries of keys (collection, tenant, ref_id) away; unknown keys are passed over, unknown collections refused."""
    _write(keys.selectExpr("collection", "tenant", "ref_id", "'' as text", "cast(null as array<double>) as vector"), path, "remove")


def _write(rows: DataFrame, path: str, change: str) -> None:
    register(rows.sparkSession)
    _dealt(rows).write.format("collections").mode("append").option("path", path).option("change", change).option("sorted", "true").save()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of one file together and one file's after another's, so that a task has one file open at a time."""
    key = "collection", "tenant", pmod_crc("ref_id")
    return rows.repartition(*key).sortWithinPartitions(*key)


def pmod_crc(ref_id: str):
    from pyspark.sql import functions as F

    return F.crc32(F.col(ref_id)) % BUCKETS


def read(spark: SparkSession, path: str) -> DataFrame:
    return register(spark).read.format("collections").option("path", path).load()


def compact(spark: SparkSession, path: str) -> None:
    """Writes all live rows anew in one commit that replaces the earlier ones; their files are deleted by ``clean``."""
    names = [c["name"] for c in Store(path).commits() if c["kind"] != "create"]
    _dealt(read(spark, path)).write.format("collections").mode("append").option("path", path).option("sorted", "true").option("replaces", json.dumps(names)).save()


def clean(path: str) -> int:
    """Deletes data files that no commit names (of failed or replaced writes), and how many there were. Not while others write."""
    store = Store(path)
    named = {f["path"] for c in store.commits() for f in c.get("files", ())}
    found = [x.path for x in store.fs.get_file_info(pfs.FileSelector(store.at("data"), recursive=True, allow_not_found=True)) if x.type == pfs.FileType.File]
    old = [p for p in found if posixpath.relpath(p, store.root) not in named]
    for p in old:
        store.fs.delete_file(p)
    return len(old)


@dataclass
class Part(InputPartition):
    """A bucket of one collection and tenant: its files (commit kind, path), the newest first."""

    key: tuple
    files: list = field(default_factory=list)


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CollectionReader:
        return CollectionReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> CollectionWriter:
        if overwrite:
            raise ValueError("a store is appended to; mode('overwrite') is not known here")
        return CollectionWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> CollectionStreamWriter:
        return CollectionStreamWriter(self.options)


class CollectionReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on collection and tenant is decided by the files' keys; on ref_id it leaves buckets out and is tested again by Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNull)) and len(f.attribute) == 1 else None
            values = {None} if isinstance(f, IsNull) else set(f.value) if isinstance(f, In) else {f.value} if isinstance(f, EqualTo) else set()
            if name in ("collection", "tenant", "ref_id"):
                self.wanted[name] = values & self.wanted.get(name, values)
            if name not in ("collection", "tenant"):
                yield f

    def partitions(self) -> Sequence[Part]:
        parts: dict[tuple, Part] = {}
        buckets = {_bucket(x) for x in self.wanted["ref_id"] if x is not None} if "ref_id" in self.wanted else None
        for c in reversed(Store(self.path).commits()):
            for f in c.get("files", ()):
                key = f["collection"], f["tenant"], f["bucket"]
                if all(v in self.wanted.get(n, {v}) for n, v in zip(("collection", "tenant"), key)) and (buckets is None or f["bucket"] in buckets):
                    parts.setdefault(key, Part(key)).files.append((c["name"], c["kind"], f["path"]))
        return [p for p in parts.values() if any(kind == "add" for _, kind, _ in p.files)] or [Part((None, None, 0))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, gone = Store(self.path), pa.array([], pa.string())
        by_commit: dict[str, list] = {}
        for name, kind, path in partition.files:
            by_commit.setdefault(name, []).append((kind, path))
        for left, files in zip(range(len(by_commit) - 1, -1, -1), by_commit.values()):
            keys = []
            for kind, path in files:
                with store.fs.open_input_file(store.at(path)) as source:
                    for batch in pq.ParquetFile(source).iter_batches(batch_size=4096):
                        if left:  # nothing is older than the first commit
                            keys.append(batch.column("ref_id"))
                        if kind == "add":
                            live = batch.filter(pc.invert(pc.is_in(batch.column("ref_id"), value_set=gone)))
                            same = [pa.array([partition.key[i]] * live.num_rows, pa.string()) for i in (0, 1)]
                            yield pa.record_batch([*same, *(live.column(c) for c in ("ref_id", "text", "vector"))], names=["collection", "tenant", "ref_id", "text", "vector"])
            # What a commit adds or removes takes the place of all that earlier ones hold of these keys.
            gone = pa.concat_arrays([gone, *(k.cast(pa.string()) for k in keys)])


def _bucket(ref_id: str) -> int:
    return zlib.crc32(ref_id.encode()) % BUCKETS


@dataclass
class Written(WriterCommitMessage):
    files: list


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.change, self.replaces = options["path"], options.get("change", "add"), json.loads(options.get("replaces", "[]"))
        self.open = 1 if options.get("sorted") == "true" else OPEN
        if self.change not in ("add", "remove"):
            raise ValueError("change is 'add' or 'remove'")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, known, files = Store(self.path), None, []
        known = store.registry()
        opened: dict[tuple, pq.ParquetWriter] = {}
        try:
            for batch in iterator:
                batch = pa.record_batch([batch.column(c) for c in ("collection", "tenant", "ref_id", "text", "vector")], names=["collection", "tenant", "ref_id", "text", "vector"])
                self._check(batch, known)
                keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(_bucket, batch.column(2).to_pylist())))
                places: dict[tuple, list[int]] = {}
                for i, key in enumerate(keys):
                    places.setdefault(key, []).append(i)
                for key, own in places.items():
                    if key not in opened and len(opened) >= self.open:
                        self._close(opened)
                    rows = batch.take(pa.array(own)).select(["ref_id", "text", "vector"] if self.change == "add" else ["ref_id"])
                    if key not in opened:
                        name = posixpath.join("data", f"{uuid.uuid4().hex}.parquet")
                        store.fs.create_dir(store.at("data"))
                        opened[key] = pq.ParquetWriter(store.at(name), rows.schema, filesystem=store.fs, compression="zstd")
                        files.append({"collection": key[0], "tenant": key[1], "bucket": key[2], "path": name})
                    opened[key].write_batch(rows)
            self._close(opened)
        except BaseException:
            # Spark hands the messages of finished tasks to abort; what a failed task wrote only it can know.
            self._close(opened)
            self._delete(files)
            raise
        return Written(files)

    def _check(self, batch: pa.RecordBatch, known: dict[str, dict]) -> None:
        if batch.column(2).null_count:
            raise ValueError("an entry has no ref_id")
        for collection, tenant in set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            own = known.get(collection)
            if own is None or (tenant is not None or own["tenants"]) and tenant not in own["tenants"]:
                raise ValueError(f"Collection '{collection}' does not exist" if own is None else f"Collection '{collection}' has no tenant '{tenant}'")
        if self.change == "add":
            wanted = pa.array([known[c]["dimension"] for c in batch.column(0).to_pylist()])
            if not pc.all(pc.fill_null(pc.equal(pc.list_value_length(batch.column(4)), wanted), False)).as_py():
                raise ValueError("a vector has another dimension than its collection")

    @staticmethod
    def _close(opened: dict[tuple, pq.ParquetWriter]) -> None:
        for w in opened.values():
            w.close()
        opened.clear()

    def _delete(self, files: list[dict]) -> None:
        store = Store(self.path)
        for f in files:
            if store.fs.get_file_info(store.at(f["path"])).type != pfs.FileType.NotFound:
                store.fs.delete_file(store.at(f["path"]))

    def commit(self, messages: list[Written | None]) -> None:
        Store(self.path).commit(self.change, files=[f for m in messages if m for f in m.files], **({"replaces": self.replaces} if self.replaces else {}))

    def abort(self, messages: list[Written | None]) -> None:
        self._delete([f for m in messages if m for f in m.files])


class CollectionStreamWriter(CollectionWriter, DataSourceStreamArrowWriter):
    """The same for micro-batches. A batch's commit is named by the stream and the batch, so one that is run again is not seen twice."""

    def __init__(self, options: dict) -> None:
        CollectionWriter.__init__(self, options)
        self.stream = options["stream"]

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files = [f for m in messages if m for f in m.files]
        if not Store(self.path).commit(self.change, f"{self.stream}-{batchId:012d}", files=files):
            self._delete(files)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        CollectionWriter.abort(self, messages)
