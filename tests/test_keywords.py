"""The keyword index against looking into every text."""

import random

from pyspark.sql import functions as F

from spindrift.operators import keywords
from spindrift.plans import catalogue

ODD = [(None, "Null KEY abc"), (7, None), (8, ""), (9, "a"), (10, "ab"), (10, "ab"), (11, "ÀB c"), (12, "日本語 text"), (13, "x" * 30_000 + "needle"), (14, "a\0b"), (15, "\U0001f600\U0001f601\U0001f602")]
TERMS = ["abc", "ab", "a", "A", "àb", "b c", "日本", "語", "needle", "zzz", "", None, "\U0001f601", "\U0001f600\U0001f601\U0001f602", "\0", "ing the", "g", ". "]


def corpus(n=600):
    rng = random.Random(8)
    words = ["thing", "the", "Ring", "of", "abc.", "Ab", "gg", "né"]
    return [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for k in range(n)]


def test_found_rows_equal_those_of_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keywords, "BLOCK", 50)
    rows = corpus() + ODD
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "id long, body string, no int, gram int").repartition(3)
    keywords.build(df, str(tmp_path), "id", "body")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    want = sorted(((t, i) for t in {t.lower() for t in TERMS if t} for i, text in rows if text and t in text.lower()), key=str)
    assert len({t for t, _ in want}) > 12
    for named, broadcast in ((10_000, 500_000), (0, 0)):
        monkeypatch.setattr(keywords, "NAMED", named)
        monkeypatch.setattr(keywords, "BROADCAST", broadcast)
        got = keywords.search(spark, str(tmp_path), terms, "id").select("term", "id").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert keywords.search(spark, str(tmp_path), terms.where("false"), "id").count() == 0
    blocks = spark.read.parquet(f"{tmp_path}/postings").groupBy("gram").agg(F.count("*").alias("n"), F.max("n").alias("most")).orderBy(F.desc("n")).first()
    assert blocks["n"] > 9 and blocks["most"] <= 50


def test_only_asked_postings_are_read(spark, tmp_path):
    keywords.build(spark.createDataFrame(corpus(), "id long, body string").coalesce(2), str(tmp_path), "id", "body")
    ranges = spark.createDataFrame([("abc", 1, g, g) for g in keywords.grams("abc")[:1].tolist()], "term string, need int, low long, high long")
    rows = keywords.postings(spark, str(tmp_path), ranges)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(gram," in plan or "PushedFilters: [In(gram," in plan or "PushedFilters: [Or(" in plan or "EqualTo(gram," in plan
    every = spark.read.parquet(f"{tmp_path}/postings")
    assert 0 < rows.count() <= every.agg(F.countDistinct("block")).first()[0]


def test_empty_table(spark, tmp_path):
    keywords.build(spark.createDataFrame([], "id long, body string"), str(tmp_path), "id", "body")
    assert keywords.search(spark, str(tmp_path), spark.createDataFrame([("abc",), ("a",)], "term string"), "id").count() == 0


def test_rows_are_those_of_the_scanning_search(spark, tmp_path):
    from spindrift.operators import filters

    items = catalogue.items(spark, "/root/testdata/sf0.001")
    keywords.build(items.select("media_id", F.concat_ws("\n", "title", "synopsis").alias("t")), str(tmp_path), "media_id", "t")
    for term in ("RING", "re", "d"):
        got = keywords.search(spark, str(tmp_path), spark.createDataFrame([(term,)], "term string"), "media_id").collect()
        assert sorted(r["media_id"] for r in got) == sorted(r["media_id"] for r in filters.keyword(items, term).collect())
