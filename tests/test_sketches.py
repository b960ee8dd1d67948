"""Sketches against exact figures, and merged in several orders and ways."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import quality, sketches

KINDS = "source string, day string, value double, who string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    odd = [None, float("nan"), 0.0, -0.0, 1e300, float("-inf"), 0.0004, -7.5]
    spread = [rng.choice([lambda: rng.lognormvariate(0, 4), lambda: -rng.random() * 1e6, lambda: rng.choice(odd)])() for _ in range(6_000)]
    return [(rng.choice(["a", "a", "b", None]), f"2024-01-0{1 + k % 5}", v, rng.choice([None, str(rng.randrange(3_000))])) for k, v in enumerate(spread)]


def test_quantiles_are_within_the_bound(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    got = sketches.quantiles(sketches.merge(sketches.sketch(df, ["source", "day"], ["value"], []), ["source"]), ["source"], {"low": 0.01, "middle": 0.5, "high": 0.97}).collect()
    assert len(got) == 3
    for r in got:
        values = sorted(v for s, _, v, _ in rows if s == r["source"] and v is not None and not math.isnan(v))
        assert r["filled"] == len(values)
        for name, q in (("low", 0.01), ("middle", 0.5), ("high", 0.97)):
            exact = min(max(values[math.ceil(q * len(values)) - 1], -9e15), 9e15)  # beyond, all share a bin
            assert abs(r[name] - exact) <= abs(exact) / 256 + 0.001


def test_distinct_counts_are_near(spark):
    df = spark.range(60_000).select(F.lit("x").alias("source"), F.when(F.col("id") % 10 > 0, F.col("id") % 40_000).alias("many"), (F.col("id") % 25).alias("few"), F.lit(None).cast("int").alias("none"))
    got = {r["field"]: r["distinct"] for r in sketches.distinct(sketches.sketch(df, ["source"], [], ["many", "few", "none"]), ["source"]).collect()}
    assert set(got) == {"many", "few"} and got["few"] == 25
    assert abs(got["many"] / 36_000 - 1) < 0.05  # three standard errors


def test_any_order_of_merging_gives_the_same(spark, rows):
    keys, got = ["source"], []
    whole = spark.createDataFrame(rows, KINDS)
    for parts in ([0, 1, 2], [2, 0, 1]):
        pieces = [sketches.sketch(whole.where(F.pmod(F.hash("who", "value"), F.lit(3)) == p), ["source", "day"], ["value"], ["who"]) for p in parts]
        got.append(sketches.merge(sketches.merge(pieces[0].unionByName(pieces[1]), keys).unionByName(sketches.merge(pieces[2], keys)), keys))
    got.append(sketches.sketch(whole, keys, ["value"], ["who"]))
    first, *others = (sorted(map(str, g.collect())) for g in got)
    assert all(o == first for o in others)


def test_report_reads_the_days_asked_for_and_days_are_replaced(spark, rows, tmp_path):
    folder, by = str(tmp_path / "kept"), ["source", "day"]
    df = spark.createDataFrame(rows, KINDS)
    for _ in range(2):  # a batch that is run again counts once
        sketches.keep(sketches.sketch(df, by, ["value"], ["who"]), folder)
    got = sketches.report(spark, folder, ["source"], {"middle": 0.5}, "2024-01-02", "2024-01-03")
    assert {(r["source"], r["records"]) for r in got.collect()} == {(s, sum(1 for x in rows if x[0] == s and x[1] in ("2024-01-02", "2024-01-03"))) for s in ("a", "b", None)}
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in scan
    fixed = [("a", "2024-01-02", 1.0, "z")]
    sketches.keep(sketches.sketch(spark.createDataFrame(fixed, KINDS), by, ["value"], ["who"]), folder)
    one = sketches.report(spark, folder, [], {"middle": 0.5}, "2024-01-02", "2024-01-02").collect()
    assert {(r["field"], r["records"], r["filled"], r["distinct"]) for r in one} == {("value", 1, 1, None), ("who", 1, None, 1)}
    assert sketches.report(spark, folder, ["source"], {"middle": 0.5}, "2030-01-01").count() == 0


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, None], [1.0, 1.0, 2.0, 9.0]])
def test_median_is_exact(spark, values):
    known = sorted(v for v in values if v is not None)
    n = len(known)
    want = (known[(n - 1) // 2] + known[n // 2]) / 2 if n else None
    assert quality.median(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()[0][0] == want
