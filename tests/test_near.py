"""The stored index of near vectors: recall, exactness, changes, pruned files, rows that are easily got wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.operators import near


def clustered(n=3000, dim=16, centres=30, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return middle[rng.integers(0, centres, n)] + 0.3 * rng.normal(size=(n, dim))


def best(x, ids, q, k):
    score = (x @ q) / np.maximum(np.sqrt((x * x).sum(1)) * np.sqrt(q @ q), 1e-10)
    order = sorted(range(len(ids)), key=lambda i: (-round(score[i], 12), ids[i]))[:k]
    return [ids[i] for i in order]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = clustered()
    ids = [f"v{i:05}" for i in range(len(x))]
    vectors = spark.createDataFrame(list(zip(ids, x.tolist())), "ref_id string, vector array<double>").repartition(4, "ref_id")
    path = str(tmp_path_factory.mktemp("near") / "index")
    near.build(vectors, path, cells=40)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 3000, 60)], "query_id long, vector array<double>")
    return path, x, ids, asked


def recall(found, x, ids, k):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["ref_id"])
    return np.mean([len(got[q] & set(best(x, ids, x[q], k))) / k for q in range(0, 3000, 60)])


def test_recall_grows_with_probes_and_all_cells_are_exact(spark, index):
    path, x, ids, asked = index
    few, some = (recall(near.search(spark, path, asked, 10, p), x, ids, 10) for p in (1, 6))
    assert some >= 0.9 and few <= some
    found = near.search(spark, path, asked, 10, None, None).collect()
    for q in range(0, 3000, 60):
        assert [r["ref_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == best(x, ids, x[q], 10)


@pytest.mark.parametrize("shard, block", [(50, 7), (65_536, 2048)])
def test_shards_and_blocks_change_nothing(spark, index, shard, block):
    path, x, ids, asked = index
    want = {(r["query_id"], r["ref_id"], r["rank"]) for r in near.search(spark, path, asked, 5, 4, None).collect()}
    assert {(r["query_id"], r["ref_id"], r["rank"]) for r in near.search(spark, path, asked, 5, 4, None, shard, block).collect()} == want


def test_only_probed_cells_are_read(spark, index):
    path, x, ids, asked = index
    found = near.search(spark, path, asked.limit(1), 10, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan or "cell#" in plan and " IN (" in plan
    whole = near.live(spark, path)
    one = whole.filter(F.col("cell").isin(near._nearest(near._unit(x[:1]), near.Model.load(spark, path).centres, 2)[0].tolist()))
    assert len(one.inputFiles()) == len(whole.inputFiles())  # the files are listed, and left out when the scan is planned
    scan = one._jdf.queryExecution().executedPlan()
    one.count()
    assert "PartitionFilters" in scan.toString()


def test_changes_without_building_again(spark, index, tmp_path):
    path, x, ids, asked = index
    own = str(tmp_path / "changed")
    near.build(spark.createDataFrame(list(zip(ids[:500], x[:500].tolist())), "ref_id string, vector array<double>"), own, cells=9)
    y = x[:500].copy()
    y[10:20] = -y[10:20]
    near.upsert(spark.createDataFrame([(ids[i], y[i].tolist()) for i in range(10, 20)], "ref_id string, vector array<double>"), own, spark.createDataFrame([(ids[i],) for i in range(20, 40)], "ref_id string"))
    near.upsert(spark.createDataFrame([("new", x[700].tolist()), (ids[25], x[25].tolist())], "ref_id string, vector array<double>"), own)
    names = [*(ids[i] for i in range(500) if not 20 <= i < 40 or i == 25), "new"]
    z = np.array([*(y[i] for i in range(500) if not 20 <= i < 40 or i == 25), x[700]])
    assert sorted(r["ref_id"] for r in near.live(spark, own).collect()) == sorted(names)
    found = near.search(spark, own, spark.createDataFrame([(0, x[700].tolist()), (1, y[15].tolist()), (2, x[25].tolist())], "query_id long, vector array<double>"), 8, None, None).collect()
    for q, v in enumerate((x[700], y[15], x[25])):
        assert [r["ref_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == best(z, names, v, 8)


def test_a_version_without_its_changes_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(f"v{i}", [float(i + 1), 1.0]) for i in range(20)], "ref_id string, vector array<double>")
    near.build(rows, path)
    # As after a failure between the two writes of an upsert.
    lost = rows.select(F.lit(0).alias("cell"), F.concat(F.lit("lost"), "ref_id").alias("ref_id"), F.lit(b"\0\0").alias("code"), "vector")
    lost.write.partitionBy("cell").parquet(f"{path}/rows/version=1")
    assert near.live(spark, path).count() == 20
    near.upsert(rows.limit(1).select(F.lit("more").alias("ref_id"), "vector"), path)
    assert sorted(r["ref_id"] for r in near.live(spark, path).filter("ref_id not like 'v%'").collect()) == ["more"]


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    nan = float("nan")
    odd = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), (None, [1.0, 1.0]), ("n", None), ("x", [nan, 1.0]), ("y", [None, 1.0]), ("e", []), ("long", [1.0, 2.0, 3.0]), ("zero", [0.0, 0.0]), ("b", [0.0, 1.0])]
    path = str(tmp_path / "odd")
    near.build(spark.createDataFrame(odd, "ref_id string, vector array<double>").withColumn("cell", F.lit("clash")), path)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0])], "query_id long, vector array<double>")
    got = near.search(spark, path, asked, 10, None, None).collect()
    assert sorted((r["query_id"], r["ref_id"], round(r["score"], 9)) for r in got) == [(1, "a", 1.0), (1, "b", 0.0), (1, "zero", 0.0)]
    for bad in ([1.0], [1.0, nan], None):
        with pytest.raises(ValueError):
            near.upsert(spark.createDataFrame([("c", bad)], "ref_id string, vector array<double>"), path)
    none = str(tmp_path / "none")
    near.build(spark.createDataFrame([], "ref_id string, vector array<double>"), none)
    assert near.search(spark, none, asked, 10).count() == 0
