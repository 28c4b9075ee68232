"""Streams that go on: a tick that outlives a failing batch, deliveries made once, sessions of activity, and updates against a kept baseline."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basalt.operators import snapshots


def supervised(start: Callable[[], StreamingQuery], restarts: int = 5, wait: float = 1.0) -> StreamingQuery:
    """Waits for a query, and starts it again from its checkpoint when a batch fails: that batch runs again, none is lost.

    ``restarts`` failures in a row without a finished batch between them are given up on, with the last
    one's error. The wait before a restart doubles from one to the next.
    """
    failures, done = 0, -1
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except StreamingQueryException:
            last = query.lastProgress
            reached = last["batchId"] if last else -1
            failures, done = (1, reached) if reached > done else (failures + 1, done)
            if failures > restarts:
                raise
            time.sleep(wait * 2 ** (failures - 1))


def ticking(delivered: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 second") -> Callable[[], StreamingQuery]:
    """Starts a stream that hands each tick's rows and number to ``deliver``; for ``supervised``. Without ``every`` it ends when all there is has been handed over.

    A tick that failed is handed over again with the same rows and number, so ``deliver`` writes by number.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return lambda: delivered.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A delivery into Parquet, a folder for each tick: one that is handed over twice is there once."""
    return lambda rows, tick: rows.write.mode("overwrite").parquet(f"{path}/tick={tick}")


def once(delivered: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """The first of the rows of one key that come within ``late`` of each other, however often they are sent."""
    return delivered.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def sessions(events: DataFrame, gap: str, late: str = "0 seconds") -> DataFrame:
    """agent_id, start, last, n and kinds (distinct, sorted) of each stretch of an agent's events (agent_id, kind, ts) without a pause of ``gap``.

    Of a table, all sessions; of a stream, those that the watermark has closed.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy("agent_id", F.session_window("ts", gap).alias("s")).agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return found.select("agent_id", F.col("s.start").alias("start"), "last", "n", "kinds")


class Baselines:
    """What each provider's readers have been shown, by version: a folder for each batch that was rendered.

    ``render`` takes the sections of a batch (provider, kind, state, ord), keeps the last of each provider
    and compares it with the newest version before the batch. The updates and the baseline
    that goes with them are written under the batch's number, the baseline last; a batch that
    runs again starts from the same earlier version and writes the same, so it is rendered once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        """Numbers of the batches that were rendered to the end."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = fs_path(f"{self.path}/baseline")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [f.getPath() for f in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(fs_path(p, "_SUCCESS")))

    def before(self, batch: int | None = None) -> DataFrame:
        """provider, kind, state and number as they stood before a batch, or now: each version holds what changed in it."""
        older = [v for v in self.versions() if batch is None or v < batch]
        if not older:
            return self.spark.createDataFrame([], "provider string, kind string, state string, number long")
        rows = self.spark.read.option("basePath", f"{self.path}/baseline").parquet(*(f"{self.path}/baseline/batch={v}" for v in older))
        last = F.max_by(F.struct("kind", "state", "number"), "batch").alias("last")
        return rows.groupBy("provider").agg(last).select("provider", "last.kind", "last.state", "last.number")

    def render(self, sections: DataFrame, batch: int) -> None:
        newest = sections.groupBy("provider").agg(F.max_by(F.struct("kind", "state"), "ord").alias("s")).select("provider", "s.kind", "s.state")
        due = snapshots.due_updates(newest, self.before(batch)).join(newest, "provider")
        due.select("provider", "mode", "number", "kind", "state").write.mode("overwrite").parquet(f"{self.path}/updates/batch={batch}")
        # From what was written, so that updates and baseline are of one computation.
        written = self.spark.read.parquet(f"{self.path}/updates/batch={batch}")
        written.select("provider", "kind", "state", "number").write.mode("overwrite").parquet(f"{self.path}/baseline/batch={batch}")

    def reset(self, providers: DataFrame, batch: int) -> None:
        """A batch of its own after which the providers (provider) are as if nothing had been shown of them, and counted from one again."""
        forgotten = providers.select("provider", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("state"), F.lit(0).cast("long").alias("number"))
        forgotten.limit(0).select("provider", F.col("state").alias("mode"), "number", "kind", "state").write.mode("overwrite").parquet(f"{self.path}/updates/batch={batch}")
        forgotten.distinct().write.mode("overwrite").parquet(f"{self.path}/baseline/batch={batch}")

    def updates(self) -> DataFrame:
        """provider, mode (full, delta), number, kind, state and batch of all that was rendered."""
        done = self.versions()
        if not done:
            return self.spark.createDataFrame([], "provider string, mode string, number long, kind string, state string, batch int")
        return self.spark.read.option("basePath", f"{self.path}/updates").parquet(*(f"{self.path}/updates/batch={v}" for v in done))
