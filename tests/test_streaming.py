import datetime

import pytest
from pyspark.sql import functions as F

from basalt.sources.embed import hashed_words
from basalt.streaming import ingest, timers

AT = datetime.datetime(2024, 1, 1)


def later(s):
    return AT + datetime.timedelta(seconds=s)


def test_ingest_writes_vectors_and_errors(spark, tmp_path):
    rows = spark.createDataFrame([("c", "1", "a b"), ("c", "2", None)], "collection string, ref_id string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, hashed_words(4), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["ref_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": "ready", "2": "error"}


def test_latest_word_of_each_id(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1, "added", "e", "a"), ("t", 2, "removed", "e", "a"), ("t", 2, "added", "e", "b")], "tool_id string, seq long, op string, kind string, ref_id string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.latest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r["ref_id"], r["gone"]) for r in ingest.latest_words(spark, str(tmp_path / "out")).collect()} == {("a", True), ("b", False)}


def test_timers_fire_once_and_cancels_hold(spark, tmp_path):
    first = [(1, "schedule", "ann", "one", later(10), later(0)), (2, "schedule", "bob", "two", later(10), later(0)), (3, "schedule", "cy", "three", later(500), later(0))]
    second = [(2, "cancel", "bob", "", later(0), later(1)), (1, "cancel", "bob", "", later(0), later(1))]
    third = [(9, "schedule", "dee", "nine", later(9999), later(60))]
    schema = "notification_id long, kind string, owner_name string, content string, fire_at timestamp, ts timestamp"
    for i, part in enumerate((first, second, third, [(10, "schedule", "dee", "ten", later(9999), later(61))])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = timers.deliveries(stream).writeStream.format("memory").queryName("delivered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert [tuple(r)[:3] for r in spark.table("delivered").collect()] == [(1, "ann", "one")]
    present = timers.with_presence(spark.table("delivered"), spark.createDataFrame([("ann",)], "name string"))
    assert present.first()["present"] is True


def test_open_counts_plan_is_a_bounded_join(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("received").alias("kind"), F.col("value").cast("string").alias("message_id"), F.col("timestamp").alias("ts"))
    assert ingest.open_counts(stream).isStreaming


def test_timers_at_the_watermark_and_many_in_one_state(spark, tmp_path):
    # Timers of three owners at the watermark's own time, before it and after it, over batches, in few states.
    schema = "notification_id long, kind string, owner_name string, content string, fire_at timestamp, ts timestamp"
    big = (1 << 53) + 1
    first = [(i, "schedule", f"o{i % 3}", "x", later(5 + i % 10), later(0)) for i in range(60)] + [(big, "schedule", "o", "y", later(3), later(0)), (None, "schedule", "o", "z", later(4), later(0)), (200, "schedule", "o", "next", later(6.501), later(0))]
    second = [(i, "cancel", f"o{i % 3}", "", None, later(6)) for i in range(0, 60, 4)] + [(i, "cancel", "no", "", None, later(6)) for i in range(60)]
    second += [(4, "schedule", "o1", "again", later(9), later(6.5)), (5, "schedule", "o1", "held", later(99), later(6.5))]
    third = [(100, "schedule", "o", "late", later(99), later(10))]
    for i, part in enumerate((first, second, third)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in"))
    cp = str(tmp_path / "cp")
    timers.deliveries(stream, buckets=4).writeStream.format("memory").queryName("many").outputMode("append").option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(180)
    got = [(r["notification_id"], r["owner_name"], r["content"]) for r in spark.table("many").collect()]
    # The first batch ends before any is due; at the second's end those up to 6.5, at the third's those up to 10 itself.
    want = [(i, f"o{i % 3}", "x") for i in range(60) if i % 10 <= 5 and i % 4] + [(4, "o1", "again"), (big, "o", "y"), (None, "o", "z"), (200, "o", "next")]
    assert sorted(got, key=str) == sorted(want, key=str)
    # Five states in all (one of requests without an id), not one for each timer.
    assert spark.read.format("statestore").option("stateVarName", "pending").load(cp).count() <= 5
