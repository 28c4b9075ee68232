"""Streams that go on: a tick that fails and is made good, deliveries made twice, sessions, and baselines over batches that run again."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from basalt.streaming import live

AT = datetime.datetime(2024, 1, 1)
ROWS = "notification_id long, at timestamp"


def later(minutes):
    return AT + datetime.timedelta(minutes=minutes)


def feed(spark, path, *batches, schema=ROWS):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema=ROWS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_failing_tick_is_handed_over_again(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    feed(spark, source, *([(i, later(i))] for i in range(4)))
    tries, put = [], live.to_folder(out)

    def deliver(rows, tick):
        tries.append(tick)
        put(rows, tick)
        if tick in (1, 2) and tries.count(tick) == 1:
            raise RuntimeError("after it was written, before it was noted")

    query = live.supervised(live.ticking(stream(spark, source), deliver, cp, None), wait=0.01)
    assert query.exception() is None
    assert tries == [0, 1, 1, 2, 2, 3]
    assert sorted(r["notification_id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    # A restart of the whole goes on behind what was done.
    feed(spark, source, [(9, later(9))])
    live.supervised(live.ticking(stream(spark, source), deliver, cp, None))
    assert tries[-1] == 4 and spark.read.parquet(out).count() == 5


def test_a_tick_that_fails_always_is_given_up_on(spark, tmp_path):
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    feed(spark, source, [(1, later(0))])
    tries = []

    def deliver(rows, tick):
        tries.append(tick)
        raise RuntimeError("always")

    with pytest.raises(StreamingQueryException, match="always"):
        live.supervised(live.ticking(stream(spark, source), deliver, cp, None), restarts=2, wait=0.01)
    assert tries == [0, 0, 0]


def test_a_stream_by_the_clock_goes_on(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    feed(spark, source, [(1, later(0))])
    query = live.ticking(stream(spark, source), live.to_folder(out), cp, "200 milliseconds")()
    try:
        query.processAllAvailable()
        feed(spark, source, [(2, later(1))])
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r["notification_id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_deliveries_made_twice_are_handed_on_once(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    feed(spark, source, [(1, later(0)), (1, later(3)), (2, later(1))], [(1, later(5)), (3, later(6))])
    live.supervised(live.ticking(live.once(stream(spark, source), "at", "30 minutes", "notification_id"), live.to_folder(out), cp, None))
    feed(spark, source, [(2, later(8))])  # after a restart
    live.supervised(live.ticking(live.once(stream(spark, source), "at", "30 minutes", "notification_id"), live.to_folder(out), cp, None))
    assert sorted(r["notification_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_sessions_of_a_stream_equal_those_of_its_table(spark, tmp_path):
    schema = "agent_id string, kind string, ts timestamp"
    rows = [("a", "view", later(0)), ("a", "click", later(4)), ("b", "view", later(5)), ("a", "view", later(20)), ("b", "view", later(9)), ("a", "view", later(29)), ("b", "click", later(60))]
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    feed(spark, source, rows[:3], rows[3:], [("z", "end", later(9999))], [("z", "end", later(9999))], schema=schema)
    live.supervised(live.ticking(live.sessions(stream(spark, source, schema), "10 minutes", "30 minutes"), live.to_folder(out), cp, None))
    table = live.sessions(spark.createDataFrame(rows, schema), "10 minutes")
    want = sorted(map(str, table.collect()))
    assert len(want) == 4
    assert sorted(map(str, spark.read.parquet(out).drop("tick").filter("agent_id <> 'z'").collect())) == want


SECTIONS = "provider string, kind string, state string, ord long"


def shown(kept):
    return sorted((r["batch"], r["provider"], r["mode"], r["state"], r["number"]) for r in kept.updates().collect())


def test_a_batch_that_runs_twice_renders_once(spark, tmp_path):
    kept = live.Baselines(spark, str(tmp_path / "b"))
    assert kept.updates().count() == 0
    batches = [[("p", "x", "one", 1), ("q", "x", "one", 1)], [("p", "x", "old", 1), ("p", "x", "two", 2), ("q", "x", "one", 1)], [("p", "y", "two", 1), ("r", "x", None, 1)]]
    frames = [spark.createDataFrame(b, SECTIONS) for b in batches]
    for i in (0, 1, 1, 0, 2, 2):
        kept.render(frames[i], i)
    want = [(0, "p", "full", "one", 1), (0, "q", "full", "one", 1), (1, "p", "delta", "two", 2), (2, "p", "full", "two", 3), (2, "r", "full", None, 1)]
    assert shown(kept) == want
    # Updates whose baseline was not written are not seen, and written again by the next try.
    frames[0].limit(0).select("provider", F.lit("full").alias("mode"), F.lit(9).cast("long").alias("number"), "kind", "state").write.parquet(str(tmp_path / "b" / "updates" / "batch=3"))
    assert shown(kept) == want
    kept.render(frames[1], 3)
    assert shown(kept)[len(want) :] == [(3, "p", "full", "two", 4)]
    kept.reset(frames[0].filter("provider = 'p'"), 4)
    kept.render(frames[1], 5)
    assert [r for r in shown(kept) if r[0] == 5] == [(5, "p", "full", "two", 1)]
    assert {(r["provider"], r["state"], r["number"]) for r in kept.before(2).collect()} == {("p", "two", 2), ("q", "one", 1)}


def test_baselines_as_the_sink_of_a_stream(spark, tmp_path):
    kept, source = live.Baselines(spark, str(tmp_path / "b")), str(tmp_path / "in")
    feed(spark, source, [("p", "x", "one", 1)], [("p", "x", "two", 2)], [("p", "x", "two", 3)], schema=SECTIONS)
    tries = []

    def render(rows, batch):
        kept.render(rows, batch)
        tries.append(batch)
        if tries == [0, 1]:
            raise RuntimeError("after it was rendered")

    live.supervised(live.ticking(stream(spark, source, SECTIONS), render, str(tmp_path / "cp"), None), wait=0.01)
    assert tries == [0, 1, 1, 2]
    assert shown(kept) == [(0, "p", "full", "one", 1), (1, "p", "delta", "two", 2)]
