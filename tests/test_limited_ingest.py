"""Ingest with state: repeats across batches, the limit of errors, restarts, and a batch that is run again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindrift.streaming import ingest, limited

SCHEMA = "id long, ts timestamp, source string, bad boolean, errors long, place int"


def records(n=300, seed=4):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(k, start + timedelta(minutes=k // 2), rng.choice(["a", "a", "a", "b", None]), rng.choice([True, False, False, None]), 7, 7) for k in range(n)]


def expected(rows, limit):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if seen.get(r[2], 0) < limit:
            out.append(r[0])
            seen[r[2]] = seen.get(r[2], 0) + bool(r[3])
    return sorted(out), {s for s, n in seen.items() if n >= limit}


def test_batches_with_repeats_and_restarts_equal_the_whole(spark, tmp_path):
    rows, root = records(), str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/in")
    stream = ingest.read_files(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema, files=100)
    run = lambda: limited.ingest(stream, f"{root}/out", "id", "ts", "source", F.col("bad"), f"{root}/checkpoint", limit=6).awaitTermination()
    for at in range(0, 300, 75):
        part = rows[at : at + 75] + rows[max(0, at - 30) : at] + rows[at : at + 5] + [(None, datetime(2024, 1, 1), "a", True, 1, 1)]
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(f"{root}/in")
        run()
    run()  # nothing has come
    want, over = expected(rows, 6)
    got = spark.read.parquet(f"{root}/out/rows")
    assert sorted(r["id"] for r in got.collect()) == want and 0 < len(want) < 300
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "counts").iterdir())
    assert {None if r["source"] == "\0" else r["source"] for r in limited.stopped(spark, f"{root}/out", last, 6).collect()} == over


@pytest.mark.parametrize("limit", [1, 3])
def test_one_batch_is_cut_at_the_limit(spark, limit):
    rows = records(60)
    before = spark.createDataFrame([("b", limit), ("z", 1)], "source string, errors long")
    kept, counts = limited.admitted(spark.createDataFrame(rows, SCHEMA), before, F.col("bad"), "source", "ts", "id", limit)
    want, _ = expected([r for r in rows if r[2] != "b"], limit)
    assert sorted(r["id"] for r in kept.collect()) == want
    assert kept.columns == ["id", "ts", "source", "bad", "errors", "place"]
    had = {"b": limit, "z": 1}
    for r in rows:
        if r[0] in want and r[3]:
            had[r[2] or "\0"] = had.get(r[2] or "\0", 0) + 1
    assert {r["source"]: r["errors"] for r in counts.collect()} == had and had["a"] == limit
