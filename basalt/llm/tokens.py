"""Token ids in ORC files: sorted by document id, with row indexes and Bloom filters on it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import parts, texts
from basalt.llm.words import word_encoder

SCHEMA = "shard int, doc_id long, offset long, n_tokens int, ids array<int>"


def write_token_files(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int | None = None,
    shard_bytes: int = 256 << 20,
    stripe_bytes: int = 64 << 20,
    index_rows: int = 1000,
    false_positives: float = 0.01,
) -> None:
    """Encodes every whole text and writes the ids as ORC in ascending order of doc_id.

    Rows are dealt by ranges of doc_id to ``shards`` files (unless given, as many as the session's shuffle
    partitions, and so many more that a file has about ``shard_bytes`` of text) and sorted within them; ``shard`` numbers the files in that order, and ``offset`` is how
    many ids of the file come before the row. ORC writes the integers run-length encoded, in stripes
    that are read in parallel, with statistics for each ``index_rows`` rows and a Bloom filter on
    doc_id, so that a search by id reads few stripes. A null text has the end id only. A null doc_id
    comes first. Rows of one doc_id stand together, ordered by their texts' hash; repeated rows stay.
    An empty table gives files without rows. Other columns are not read.
    """
    rows = texts(df, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = shards
    if not n:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, before = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in parts(batches, 1, 1024, 1 << 22):
            flat, lens = encoder(batch.column(1))
            ends = np.cumsum(lens)
            flat, lens = np.insert(flat, ends, end_id), lens + 1
            ends = np.cumsum(lens)
            yield pa.record_batch(
                [
                    pa.array(np.full(len(lens), shard, np.int32)),
                    batch.column(0),
                    pa.array(before + ends - lens),
                    pa.array(lens.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)),
                ],
                names=["shard", "doc_id", "offset", "n_tokens", "ids"],
            )
            before += int(ends[-1]) if len(ends) else 0

    (
        dealt.select("doc_id", "text")
        .mapInArrow(encode, SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", index_rows)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", false_positives)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on doc_id reach the stripes' metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; of files without rows none."""
    sizes = files.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    # One row a file, so its size is bounded by the number of files that were asked for.
    bases = F.broadcast(sizes.select(F.col("shard").alias("of"), F.expr("coalesce(sum(size) over (order by shard rows between unbounded preceding and 1 preceding), 0L)").alias("base")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(ends, ends[1:])]
            yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(digest, "shard int, doc_id long, offset long, n_tokens int, ids_crc32 long")
    return rows.join(bases, F.col("shard") == F.col("of")).select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )
