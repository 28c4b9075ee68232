"""The stored collections: whole commits, pruned scans, replaced and removed entries, streams that run a batch again."""

import pytest
from pyspark.sql import functions as F

from basalt.sources import collections as cs


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    for name, tenant in (("a", "t1"), ("a", "t2"), ("b", None)):
        cs.create(path, name, 2, tenant)
    rows = [("a", "t1", f"r{i}", f"text {i}", [float(i), 1.0]) for i in range(40)] + [("a", "t2", f"r{i}", "other", [0.0, float(i)]) for i in range(5)] + [("b", None, "r1", None, [1.0, 1.0])]
    cs.add(spark.createDataFrame(rows, cs.SCHEMA), path)
    return path


def live(spark, path, where="true"):
    return sorted((r["collection"], r["tenant"] or "", r["ref_id"], r["text"] or "") for r in cs.read(spark, path).filter(where).collect())


def files_of(path):
    return [x for x in cs.Store(path).fs.get_file_info(cs.pfs.FileSelector(f"{path}/data", recursive=True)) if x.path.endswith(".parquet")]


def test_scan_by_tenant_and_collection(spark, store):
    assert len(live(spark, store)) == 46
    assert len(live(spark, store, "collection = 'a' and tenant = 't2'")) == 5
    assert live(spark, store, "tenant is null") == [("b", "", "r1", "")]
    assert live(spark, store, "ref_id = 'r3' and tenant in ('t1', 't9')") == [("a", "t1", "r3", "text 3")]
    assert live(spark, store, "collection = 'nowhere'") == []
    assert live(spark, store, "collection = 'a' and collection = 'b'") == []


def test_filters_reach_the_source(spark, store):
    reader = cs.CollectionReader(store)
    whole = len(reader.partitions())
    left = list(reader.pushFilters([cs.EqualTo(("tenant",), "t2"), cs.EqualTo(("collection",), "a"), cs.EqualTo(("ref_id",), "r3")]))
    assert [f.attribute for f in left] == [("ref_id",)]
    assert len(reader.partitions()) == 1 < whole
    plan = cs.read(spark, store).filter("tenant = 't2' and text = 'other'")
    explained = plan._jdf.queryExecution().executedPlan().toString()
    assert "tenant" not in explained[: explained.index("BatchScan")].replace("tenant#", "") or "Filter" in explained
    assert plan.rdd.getNumPartitions() < cs.read(spark, store).rdd.getNumPartitions()


def test_entries_are_replaced_and_removed(spark, store):
    cs.add(spark.createDataFrame([("a", "t1", "r3", "new", [9.0, 9.0])], cs.SCHEMA), store)
    cs.remove(spark.createDataFrame([("a", "t1", "r4"), ("a", "t1", "unknown"), ("a", "t2", "r3")], "collection string, tenant string, ref_id string"), store)
    cs.add(spark.createDataFrame([("a", "t2", "r3", "back", [1.0, 2.0])], cs.SCHEMA), store)
    rows = live(spark, store, "ref_id in ('r3', 'r4')")
    assert rows == [("a", "t1", "r3", "new"), ("a", "t2", "r3", "back"), ("a", "t2", "r4", "other")]
    before = live(spark, store)
    n = len(files_of(store))
    cs.compact(spark, store)
    assert live(spark, store) == before
    assert cs.clean(store) == n and live(spark, store) == before
    cs.remove(spark.createDataFrame([("b", None, "r1")], "collection string, tenant string, ref_id string"), store)
    assert live(spark, store, "collection = 'b'") == []


@pytest.mark.parametrize("bad, told", [(("x", None, "r", "", [1.0, 1.0]), "does not exist"), (("a", "t9", "r", "", [1.0, 1.0]), "no tenant"), (("a", None, "r", "", [1.0, 1.0]), "no tenant"), (("b", None, "r", "", [1.0]), "dimension"), (("b", None, "r", "", None), "dimension"), (("b", None, None, "", [1.0, 1.0]), "ref_id")])
def test_a_refused_row_refuses_its_batch(spark, store, bad, told):
    before, n = live(spark, store), len(files_of(store))
    good = [("a", "t1", f"new{i}", "", [1.0, 1.0]) for i in range(50)]
    with pytest.raises(Exception, match=told):
        cs.add(spark.createDataFrame([*good, bad], cs.SCHEMA), store)
    assert live(spark, store) == before
    assert len(files_of(store)) == n


def test_nothing_of_a_batch_is_seen_when_a_task_fails(spark, store):
    """One task fails after others have written; files of ended tasks are deleted by abort."""
    before, n = live(spark, store), len(files_of(store))

    def fails(batches):
        for batch in batches:
            yield batch
            if "new7" in batch.column("ref_id").to_pylist():
                raise RuntimeError("lost on purpose")

    rows = spark.createDataFrame([("a", "t1", f"new{i}", "", [1.0, 1.0]) for i in range(20)], cs.SCHEMA).repartition(4, "ref_id")
    with pytest.raises(Exception, match="lost on purpose"):
        cs.register(spark)
        rows.mapInArrow(fails, cs.SCHEMA).write.format("collections").mode("append").option("path", store).save()
    assert live(spark, store) == before
    assert len(files_of(store)) == n


def test_streamed_batches_are_seen_once(spark, store, tmp_path):
    source = str(tmp_path / "in")
    entry = lambda i: spark.createDataFrame([("b", None, f"s{i}", "streamed", [1.0, 2.0])], cs.SCHEMA)
    for i in range(3):
        entry(i).write.mode("append").parquet(source)
    cs.register(spark)

    def run():
        stream = spark.readStream.schema(cs.SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.writeStream.format("collections").option("path", store).option("stream", "in").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    entry(3).write.mode("append").parquet(source)
    run()
    assert [r[2] for r in live(spark, store, "text = 'streamed'")] == ["s0", "s1", "s2", "s3"]
    # The last batch once more, as after a failure between its commit and the stream's own note of it.
    writer = cs.CollectionStreamWriter({"path": store, "stream": "in"})
    last = max(int(c["name"].split("-")[1]) for c in cs.Store(store).commits() if c["name"].startswith("in-"))
    n = len(files_of(store))
    again = writer.write(iter([entry(3).toArrow().combine_chunks().to_batches()[0]]))
    writer.commit([again], last)
    assert [r[2] for r in live(spark, store, "text = 'streamed'")] == ["s0", "s1", "s2", "s3"]
    assert len(files_of(store)) == n


def test_empty_batches_and_stores(spark, tmp_path):
    path = str(tmp_path / "empty")
    assert cs.read(spark, path).count() == 0
    cs.create(path, "a", 1)
    cs.create(path, "a", 7)  # there already
    assert cs.Store(path).registry() == {"a": {"dimension": 1, "tenants": []}}
    cs.add(cs.read(spark, path), path)
    assert cs.read(spark, path).count() == 0
    with pytest.raises(ValueError):
        cs.create(path, "b", 0)
    with pytest.raises(Exception, match="overwrite"):
        spark.range(1).select(F.lit("a").alias("collection"), F.lit(None).cast("string").alias("tenant"), F.lit("x").alias("ref_id"), F.lit("").alias("text"), F.array(F.lit(1.0)).alias("vector")).write.format("collections").mode("overwrite").option("path", path).save()


def test_sorted_rows_are_written_with_one_file_open(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    cs.create(path, "c", 2, "a")
    cs.create(path, "c", 2, "b")
    rows = spark.range(400).selectExpr("'c' as collection", "if(id % 2 = 0, 'a', 'b') as tenant", "cast(id as string) as ref_id", "'x' as text", "array(1d, 2d) as vector")
    batches = cs._dealt(rows).coalesce(1).toArrow().to_batches(max_chunksize=64)
    open_now, most = set(), []

    class Counted(cs.pq.ParquetWriter):
        def __init__(self, *given, **how):
            super().__init__(*given, **how)
            open_now.add(self)
            most.append(len(open_now))

        def close(self):
            open_now.discard(self)
            super().close()

    monkeypatch.setattr(cs.pq, "ParquetWriter", Counted)
    keys = 2 * cs.BUCKETS
    written = cs.CollectionWriter({"path": path, "sorted": "true"}).write(iter(batches))
    assert max(most) == 1 and len(written.files) == keys and not open_now
    cs.add(rows, path)
    cs.remove(rows.filter("ref_id < 100"), path)
    changes = [c for c in cs.Store(path).commits() if c["kind"] != "create"]
    assert [len(c["files"]) for c in changes] == [keys, keys]
    assert {r["ref_id"] for r in cs.read(spark, path).collect()} == {str(i) for i in range(100, 400)}
