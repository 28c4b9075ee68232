"""What the operators of this subpackage share: input columns, folds, and cutting of lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators define it.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Only the columns that an operator reads, so that other columns cannot clash with its own."""
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.col(c) for c in more))


def numbered_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """row_id, doc_id and text: row_id is the column ``row``, or without one the row's place."""
    place = F.col(row) if row else F.monotonically_increasing_id()
    return df.select(place.alias("row_id"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % k


def in_fold(doc_id: str, k: int, r: int) -> Column:
    """True in the fold r of k; a null id is in no fold."""
    return F.coalesce(fold(doc_id, k) == r, F.lit(False))


def share(doc_id: str, salt: str, wanted: int, of: int) -> Column:
    """True for about ``wanted`` of ``of`` rows, always the same ones: chosen by a hash of the id."""
    if wanted >= of:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(salt), F.col(doc_id)), F.lit(1 << 30)) < int(wanted / of * (1 << 30))


_held: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks, of one operator at a time: another key drops the rest.

    Workers run tasks of many stages, so what each stage remembers would add up. Every operator that
    runs Python calls this, also one that has nothing to keep.
    """
    if key not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[key] = make()
    return _held[key]


def slices(column: pa.Array, rows: int, size: int = 1 << 23) -> Iterator[pa.Array]:
    """A column of texts in order, ``rows`` texts and ``size`` bytes at most at once, or one longer text alone."""
    lens, at = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), 0
    while at < len(column):
        n = max(1, int(np.searchsorted(np.cumsum(lens[at : at + rows], dtype=np.int64), size, "right")))
        yield column.slice(at, n)
        at += n


def parts(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows in order, ``rows`` of them and ``size`` bytes of one column at most at once, or one row with a longer text alone."""
    for batch in batches:
        at = 0
        for part in slices(batch.column(column), rows, size):
            yield batch.slice(at, len(part))
            at += len(part)


def give_back() -> None:
    """Freed memory goes back to the system; the C library would keep it for this worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it, so that no column of ``df`` has it."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def joined_evenly(rows: DataFrame, groups: DataFrame, rows_on: Column, groups_on: Column, same: Column, size: str, row: str, most: int = 1000, ways: int = 64) -> DataFrame:
    """The equi-join ``same`` of rows with their groups (one row each), no large group in one task.

    ``size`` is the column of ``groups`` with the number of its rows, ``rows_on`` and ``groups_on`` are
    the same number (a hash of the key) on either side, ``row`` a column that differs between rows.
    Groups with more than one in ``most`` of all rows, so fewer than ``most`` of them, are named by their
    numbers in the plan; their rows are dealt to ``ways`` parts, to each of which the group is sent.
    Where there are none, it is a join like any other. ``groups`` are read twice, so they should be stored.
    """
    total = rows.count()
    hot = [r[0] for r in groups.filter(F.col(size) * most > total).select(groups_on.alias("hot")).distinct().collect()]  # fewer than ``most`` numbers
    if not hot:
        return rows.join(groups, same)
    part, parts = unused(rows, "part"), unused(groups, "to_part")
    own = rows.withColumn(part, F.when(rows_on.isin(hot), F.pmod(F.xxhash64(row), F.lit(ways))).otherwise(F.lit(0)))
    to = groups.withColumn(parts, F.explode(F.when(groups_on.isin(hot), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    return own.join(to, same & (F.col(part) == F.col(parts))).drop(part, parts)


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the cluster's shared checkpoint folder and goes on from there.

    The files survive lost executors; Spark removes them with the last plan that reads them, if
    spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that are an operator's output."""
    return f"{_checkpoint_folder(spark)}/{uuid.uuid4()}/{name}"


def numbered(df: DataFrame, row: str) -> DataFrame:
    """The rows with their places in the column ``row``, written as Parquet to the shared folder and read again.

    The places are stored beside the rows, so all that reads them sees the same ones, however ``df`` would
    be computed another time and however the files are dealt out to tasks.
    """
    path = shared_folder(df.sparkSession, "numbered")
    void = {c for c, kind in df.dtypes if kind == "void"}  # Parquet has no such type
    df.drop(*void).withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.select(*(F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns), row)


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master only, one of our own where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoints"))
    return sc.getCheckpointDir()
