"""Stored tables that are merged into, pruned vector search and the graph of neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import keyed, neighbours, vectors


def folders(path):
    return {(g.name, p.name) for g in path.joinpath("data").iterdir() for p in g.iterdir() if "=" in p.name}


def test_a_merge_writes_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(2_000).select("id", (F.col("id") * 2).alias("v"))
    keyed.create(rows, path, "id", buckets=16)
    before = folders(tmp_path)
    changes = spark.createDataFrame([(5, 1, False, 1), (5, 2, False, 2), (7, None, True, 1), (90_000, 3, False, 1), (None, 4, False, 1), (123_456, 0, True, 1)], "id long, v long, gone boolean, at int")
    assert keyed.merge(spark, path, changes, deleted="gone", version="at") == 2
    touched = {r[0] for r in changes.where("id is not null").select(keyed.bucket_of("id", 16)).distinct().collect()}
    assert {p for g, p in folders(tmp_path) - before} <= {f"bucket={b}" for b in touched} and len(touched) < 5
    want = {i: i * 2 for i in range(2_000)} | {5: 2, 90_000: 3}
    want.pop(7)
    assert {r["id"]: r["v"] for r in keyed.read(spark, path).collect()} == want
    assert {r["id"]: r["v"] for r in keyed.read(spark, path, generation=1).collect()} == {i: i * 2 for i in range(2_000)}
    assert keyed.merge(spark, path, changes.where("false")) == 2
    assert keyed.clear(spark, path) == 3 and keyed.read(spark, path).count() == 0 and keyed.read(spark, path).columns == ["id", "v", "bucket"]
    keyed.merge(spark, path, spark.createDataFrame([(1, 1)], "id long, v long"))
    assert keyed.tidy(spark, path, keep=1) > 0
    assert [(r["id"], r["v"]) for r in keyed.read(spark, path).collect()] == [(1, 1)] and len(folders(tmp_path)) == 1


def test_a_failed_merge_leaves_the_last_generation(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    keyed.create(spark.range(100).select("id", F.lit(0).alias("v")), path, "id", buckets=4)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", fails)
        with pytest.raises(OSError):
            keyed.merge(spark, path, spark.createDataFrame([(1, 9)], "id long, v int"))
    assert keyed.generations(spark, path) == [1] and keyed.read(spark, path).agg(F.sum("v")).first()[0] == 0
    assert keyed.merge(spark, path, spark.createDataFrame([(1, 9)], "id long, v int")) == 3
    assert keyed.read(spark, path).agg(F.sum("v")).first()[0] == 9
    with pytest.raises(FileExistsError):
        keyed.create(spark.range(1), path, "id")


def clustered(n=3_000, size=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, size))
    return centres[rng.integers(0, 30, n)] + rng.normal(size=(n, size)) * 0.15


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_search_opens_only_probed_cells(spark, tmp_path):
    x = clustered()
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    vectors.build_index(df, str(tmp_path))
    cells = spark.read.parquet(f"{tmp_path}/cells").count()
    probes = spark.read.parquet(f"{tmp_path}/cells").first()["probes"]
    assert probes < cells / 4
    for some in (1, 5, cells):
        rows = vectors.probed(spark, str(tmp_path), set(range(some)))
        assert files_read(rows.select("vec_id")) <= some
    plan = vectors.probed(spark, str(tmp_path), {0}, {"label": [1, 2]}).select("vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(label, [1,2])]" in plan and "PartitionFilters: [isnotnull(cell" in plan
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for filters in (None, {"label": [1, 2]}):
        kept = df if filters is None else df.where("label in (1, 2)")
        true = {(r["query_id"], r["vec_id"]) for r in vectors.nearest_batch(kept, asked, 5).collect()}
        for limit in (64 << 20, 4_000):  # one chunk or many
            got = {(r["query_id"], r["vec_id"]) for r in vectors.search_index(spark, str(tmp_path), asked, 5, filters=filters, limit=limit).collect()}
            assert len(true & got) >= 0.9 * len(true)
    assert vectors.search_index(spark, str(tmp_path), asked.where("false"), 5).count() == 0


def test_an_index_is_kept_up(spark, tmp_path):
    x = clustered(600)
    df = spark.createDataFrame([(i, v.tolist(), "old") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    vectors.build_index(df, str(tmp_path))
    far = (-x[0]).tolist()
    changes = [(0, far, "moved", False, 1), (1, None, "gone", False, 1), (2, x[2].tolist(), "x", True, 1), (1_000, far, "new", False, 1), (1_000, far, "newer", False, 2)]
    vectors.merge_index(spark, str(tmp_path), spark.createDataFrame(changes, "vec_id long, embedding array<double>, label string, dead boolean, at int"), deleted="dead", version="at")
    rows = {r["vec_id"]: r["label"] for r in keyed.read(spark, f"{tmp_path}/rows").collect()}
    assert len(rows) == 599 and rows[0] == "moved" and rows[1_000] == "newer" and not {1, 2} & set(rows)
    asked = spark.createDataFrame([(-1, far)], "query_id long, query array<double>")
    assert [r["vec_id"] for r in vectors.search_index(spark, str(tmp_path), asked, 2).orderBy("place").collect()] == [0, 1_000]


def graph(spark, x, k=10, ids=None, **more):
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], "vec_id long, embedding array<float>")
    out = {}
    for r in neighbours.neighbour_graph(df, k, **more).orderBy("vec_id", "place").collect():
        out.setdefault(r["vec_id"], []).append((r["neighbour"], r["score"]))
    return out


def exact(x, i, k):
    d = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    s = d @ d[i]
    s[i] = -9
    return np.sort(s)[::-1][:k]


@pytest.mark.parametrize("shape", ["random", "clusters"])
def test_neighbour_graph_recall(spark, monkeypatch, shape):
    """Cells and parts are small, so most neighbours are found by descent; every row has its places."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    monkeypatch.setattr(neighbours, "PART", 90)
    monkeypatch.setattr(neighbours, "HELD", 5_000)
    x = (np.random.default_rng(3).normal(size=(1_500, 16)) if shape == "random" else clustered(1_500)).astype(np.float32).astype(float)
    got = graph(spark, x, pool=30)
    assert set(got) == set(range(1_500)) and all(len(v) == 10 for v in got.values())
    hit = sum(s >= least - 1e-9 for i in range(0, 1_500, 20) for least in [exact(x, i, 10)[-1]] for _, s in got[i])
    assert hit >= 0.9 * 75 * 10
    for i in range(0, 1_500, 300):
        assert all(abs(s - x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])) < 1e-9 and j != i for j, s in got[i])


def test_neighbour_graph_of_copies_and_odd_tables(spark):
    rng = random.Random(1)
    x = np.array([[1.0, 2.0]] * 40 + [[2.0, 1.0]] * 3 + [[0.0, 0.0]] * 2 + [[rng.gauss(0, 1), 1.0] for _ in range(5)])
    got = graph(spark, x, k=4)
    assert [j for j, _ in got[0]] == [1, 2, 3, 4] and [j for j, _ in got[2]] == [0, 1, 3, 4] and [j for j, _ in got[39]] == [0, 1, 2, 3]
    assert got[41][:2] == [(40, 1.0), (42, 1.0)] and all(s == 0 for _, s in got[43])
    for i in (40, 45, 49):
        assert np.allclose([s for _, s in got[i]], exact(x.astype(np.float32).astype(float), i, 4), atol=1e-6)
    assert graph(spark, x[:1]) == {}
    assert graph(spark, x[:2]) == {0: [(1, 1.0)], 1: [(0, 1.0)]}
    none = spark.createDataFrame([(1, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert neighbours.neighbour_graph(none).count() == 0
