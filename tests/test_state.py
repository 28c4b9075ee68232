"""State kept over a stream: the same for any split into batches and after a restart, and the same as the replay of the whole log."""

import random
import tracemalloc
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from basalt.operators import cache, mutate
from basalt.streaming import state

EVENTS = "owner string, key string, event string, value string, t double, ord long"
CHANGES = "tool_id string, seq long, op string, kind string, ref_id string"


def log(n, owners=2, keys=9, seed=1):
    rng = random.Random(seed)
    kinds = ["request", "get", "deliver", "fail"]
    return [(f"o{rng.randrange(owners)}", f"k{rng.randrange(keys)}", rng.choice(kinds), f"v{i}", float(i), i) for i in range(n)]


def plain(events, capacity, negative):
    """The cache as an ordered dictionary: answers by ord, entries and keys in flight."""
    answers, entries, flying = {}, {}, {}
    for owner, key, event, value, t, ord_ in events:
        own, fly = entries.setdefault(owner, OrderedDict()), flying.setdefault(owner, set())
        held = own.get(key)
        known = held is not None and (held[0] == "value" or held[2] > t)
        if event in ("deliver", "fail"):
            fly.discard(key)
            own[key] = ("value", value, 0) if event == "deliver" else ("failed", None, t + negative)
            own.move_to_end(key)
            if len(own) > capacity:
                own.popitem(last=False)
            answers[ord_] = ("kept", None)
            continue
        if held is not None:
            own.move_to_end(key)
        if event == "get":
            answers[ord_] = ("found", held[1]) if known and held[0] == "value" else ("none", None)
        elif key in fly or known:
            answers[ord_] = ("in flight" if key in fly else "known", None)
        else:
            fly.add(key)
            answers[ord_] = ("started", None)
    return answers, entries, flying


def feed(spark, path, rows, schema, batches):
    """Files of a stream's input, one for each batch, later ones newer."""
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = rows[i * size : (i + 1) * size]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("batches, restart", [(1, 1), (3, 1), (6, 4)])
def test_cache_in_any_batches(spark, tmp_path, batches, restart):
    events = log(150)
    answers, entries, flying = plain(events, 4, 20.0)
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    got = {}

    def collect(batch, epoch):
        got.update({r["ord"]: (r["answer"], r["value"]) for r in batch.collect()})

    cuts = [events[i * len(events) // restart : (i + 1) * len(events) // restart] for i in range(restart)]
    for part in cuts:
        feed(spark, source, part, EVENTS, max(1, batches // restart))
        q = state.cached(stream(spark, source, EVENTS), 4, 20.0).writeStream.foreachBatch(collect).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    assert got == answers
    held = {(r["owner"], r["key"]): (r["state"], r["value"]) for r in state.kept_entries(spark, cp, 150.0).collect()}
    assert held == {(o, k): v[:2] for o, own in entries.items() for k, v in own.items() if v[0] == "value" or v[2] > 150.0}
    assert {(r["owner"], r["key"]) for r in state.keys_in_flight(spark, cp).collect()} == {(o, k) for o, own in flying.items() for k in own}


def test_cache_equals_the_replay_of_its_log(spark, tmp_path):
    events = log(200, owners=1, seed=7)
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    feed(spark, source, events, EVENTS, 4)
    state.run(state.cached(stream(spark, source, EVENTS), None, 15.0), cp, "append").awaitTermination(300)
    whole = spark.createDataFrame(events, EVENTS)
    for now in (199.0, 207.0, 900.0):
        want = {tuple(r) for r in cache.contents(whole, now, None, 15.0).collect()}
        assert {tuple(r) for r in state.kept_entries(spark, cp, now).select("key", "value", "state").collect()} == {(k, None if s == "failed" else v, s) for k, v, s in want}


@pytest.mark.parametrize("batches", [1, 5])
def test_late_joiner_and_gaps_read_the_state_alone(spark, tmp_path, batches):
    rng = random.Random(batches)
    seqs = [s for s in range(1, 60) if s % 7 and s not in (20, 22)]
    rng.shuffle(seqs)
    rows = [(f"t{s % 2}", s, rng.choice(["added", "removed"]), rng.choice(["entity", "relation"]), f"r{s % 11}") for s in seqs]
    rows += rows[:5]  # delivered twice
    source, fold, met = (str(tmp_path / x) for x in ("in", "fold", "met"))
    for part in (rows[:30], rows[30:]):  # the second part after a restart
        feed(spark, source, part, CHANGES, batches)
        state.run(state.folded(stream(spark, source, CHANGES)), fold).awaitTermination(300)
        state.run(state.met(stream(spark, source, CHANGES)), met, "append").awaitTermination(300)
    whole = spark.createDataFrame(rows, CHANGES)
    assert sorted(map(tuple, state.present(spark, fold).collect())) == sorted(map(tuple, mutate.replay(whole).select("tool_id", "kind", "ref_id").collect()))
    assert sorted(map(tuple, state.gaps_met(spark, met).collect())) == sorted(map(tuple, mutate.gaps(whole).collect()))
    assert state.gaps_met(spark, met).count() < len(seqs)


def test_gaps_over_the_border_of_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SEGMENT", 10)
    rows = [("t", s, "added", "entity", "r") for s in (1, 2, 9, 10, 11, 19, 21, 40)]
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    feed(spark, source, rows, CHANGES, 2)
    state.run(state.met(stream(spark, source, CHANGES)), cp, "append").awaitTermination(300)
    assert sorted(r["seq"] for r in state.gaps_met(spark, cp).collect()) == [9, 19, 21, 40]
    assert state.gaps_met(spark, cp).filter(F.col("tool_id") != "t").count() == 0


class _Kept(dict):
    """A map of the state, without Spark."""

    def iterator(self):
        return iter([((k,), (v,)) for k, v in self.items()])

    def removeKey(self, key):
        del self[key[0]]

    def updateValue(self, key, value):
        self[key[0]] = value[0]


def test_a_segment_of_numbers_is_merged_in_little_memory():
    import numpy as np
    import pandas as pd

    merge = state._Ranges()
    merge.ranges = _Kept()
    numbers = np.arange(1 << 19, dtype=np.int64)
    frames = lambda own: (pd.DataFrame({"seq": own[at : at + 10_000]}) for at in range(0, len(own), 10_000))
    odd = numbers[numbers % 1000 > 0]
    tracemalloc.start()
    list(merge.handleInputRows(("t", 0), frames(np.random.default_rng(1).permutation(odd)), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert merge.ranges == {int(a): min(int(a) + 998, numbers[-1]) for a in numbers[1::1000]}
    assert peak < 40 << 20  # 78 MB and more as Python's own numbers
    list(merge.handleInputRows(("t", 0), frames(numbers[numbers % 1000 == 0]), None))
    assert merge.ranges == {0: numbers[-1]}
