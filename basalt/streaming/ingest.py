"""Streams into tables: texts that get their vectors batch by batch, change events that are folded, and handlers left open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basalt.sources.embed import Provider, embedded


def ingest(texts: DataFrame, provider: Provider, path: str, checkpoint: str) -> StreamingQuery:
    """Appends (collection, ref_id, text, vector, status) to Parquet; a batch written twice is written to the same place.

    Rows whose text could not be embedded have no vector and the status error, so that one failure
    costs no other row.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("vector", embedded("text", provider))
        rows = rows.withColumn("status", F.when(F.col("vector").isNull(), "error").otherwise("ready"))
        rows.select("collection", "ref_id", "text", "vector", "status").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """window and n: received messages per window of time that nothing processed within the allowed lateness.

    Events: kind, message_id, ts. A stream-stream outer join on message_id, bounded by the watermarks,
    keeps only what may still be answered.
    """
    received = events.filter("kind = 'received'").select("message_id", F.col("ts").alias("received_at")).withWatermark("received_at", late)
    processed = events.filter("kind = 'processed'").select(F.col("message_id").alias("done_id"), F.col("ts").alias("done_at")).withWatermark("done_at", late)
    on = F.expr(f"message_id = done_id and done_at >= received_at and done_at <= received_at + interval {late}")
    open_ = received.join(processed, on, "left_outer").filter("done_id is null")
    return open_.groupBy(F.window("received_at", window)).agg(F.count("*").alias("n"))


def latest(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last word on each (tool_id, kind, ref_id) of a stream of change events in Parquet, a folder a batch.

    A batch writes only the ids that it tells of, and one that runs again writes to the same folder;
    ``latest_words`` folds what is there.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        _last_words(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.withColumn("gone", F.col("op") == "removed").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_words(spark: SparkSession, path: str) -> DataFrame:
    """tool_id, kind, ref_id, seq and gone, as far as ``latest`` has come."""
    return _last_words(spark.read.parquet(path))


def _last_words(rows: DataFrame) -> DataFrame:
    word = F.max(F.struct("seq", "gone")).alias("last")
    return rows.groupBy("tool_id", "kind", "ref_id").agg(word).select("tool_id", "kind", "ref_id", "last.seq", "last.gone")
