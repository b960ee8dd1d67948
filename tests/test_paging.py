"""Pages by cursor against the sorted table."""

import random

import pytest

from spindrift.operators import paging


@pytest.mark.parametrize("by", [["-score", "id"], ["kind", "-score", "id"], ["score", "-id"]])
def test_walking_all_pages_gives_the_sorted_table(spark, tmp_path, by):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1.0, 2.5, 2.5, rng.random()]), rng.choice(["a", "b", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, kind string")
    paging.store(df, str(tmp_path), by, 8)
    want = [r["id"] for r in df.orderBy(*paging._order(by)).collect()]
    got, cursor, opened = [], None, []
    while True:
        opened.append(len(paging.parts_of(spark, str(tmp_path), by, 40, cursor)))
        page = paging.page(spark, str(tmp_path), by, 40, cursor).collect()
        if not page:
            break
        got += [r["id"] for r in page]
        cursor = paging.cursor_of(page, by)
    assert got == want
    assert max(opened) <= 3  # ranges of some 50 rows


def test_a_page_opens_its_ranges_alone(spark, tmp_path):
    df = spark.range(20_000)
    paging.store(df, str(tmp_path), ["id"], 20)
    rows = paging.page(spark, str(tmp_path), ["id"], 100, (15_000,))
    assert [r["id"] for r in rows.collect()] == list(range(15_001, 15_101))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [__part" in plan and "GreaterThan(id,15000)" in plan
    assert len(paging.parts_of(spark, str(tmp_path), ["id"], 100, (15_000,))) <= 2


def test_empty_table(spark, tmp_path):
    paging.store(spark.range(0), str(tmp_path), ["id"])
    assert paging.page(spark, str(tmp_path), ["id"], 5).collect() == []
