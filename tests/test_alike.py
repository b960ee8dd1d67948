"""Texts most like one, against weights of all terms, and what is moved for it."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import alike, content

SF = "/root/testdata/sf0.001"


def brute(df, item, n, key, text, longest):
    weights = content.tfidf(df, key, text, longest)
    mine = weights.where(F.col(key) == item).select("term", F.col("weight").alias("mine"))
    met = weights.where(F.col(key) != item).join(mine, "term").groupBy(key).agg(F.round(F.sum(F.col("weight") * F.col("mine")), 9).alias("score"))
    return [tuple(r) for r in met.orderBy(F.desc("score"), key).limit(n).collect()]


def found(df, item, n, key, text, longest):
    return [(k, round(s, 9)) for k, s in content.similar_texts(df, item, n, key, text, longest).collect()]


def moved(spark):
    """Bytes shuffled so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize(("words", "terms", "rows"), [(200_000, 200_000, 1_000), (50, 200_000, 100), (50, 3, 100)])
def test_equals_weights_of_all_terms(spark, monkeypatch, words, terms, rows):
    monkeypatch.setattr(alike, "WORDS", words)
    monkeypatch.setattr(alike, "TERMS", terms)
    monkeypatch.setattr(alike, "LONG_ROWS", rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs, 7, 40, "doc_id", F.col("text"), 2) == brute(docs, 7, 40, "doc_id", F.col("text"), 2)


def test_odd_rows(spark):
    rows = [(1, "Red fox runs home. Red fox"), (2, "red FOX runs"), (2, "home again, red"), (3, None), (4, ""), (None, "red fox"), (None, "fox home"), (5, "the of and"), (6, "red fox runs home red fox"), (7, "a fox"), (8, "sea weed"), (1, "runs home")]
    df = spark.createDataFrame(rows, "id int, text string")
    for item, n, longest in ((1, 20, 1), (1, 2, 2), (1, 20, 3), (6, 20, 2), (3, 20, 2), (5, 20, 2), (99, 20, 2)):
        assert found(df, item, n, "id", F.col("text"), longest) == brute(df, item, n, "id", F.col("text"), longest), (item, n)
    single = df.where("id > 2 or id is null and text = 'fox home'")
    assert found(single, 6, 20, "id", F.col("text"), 2) == brute(single, 6, 20, "id", F.col("text"), 2)
    assert found(df.limit(0), 1, 20, "id", F.col("text"), 2) == []


def test_equal_texts_come_by_key_and_few_terms_move(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id = 3").select(F.explode(F.sequence(F.lit(5_000), F.lit(5_049))), "text"))
    start = moved(spark)
    got = content.similar_texts(docs, 3, 20, "doc_id", F.col("text")).collect()
    end = moved(spark)
    same = [k for k, score in got if score == got[0]["score"]]
    assert len(same) == 20 and same == sorted(same) and set(same[2:]) <= set(range(5_000, 5_020))
    brute(docs, 3, 20, "doc_id", F.col("text"), 2)
    assert 4 * (end - start) < moved(spark) - end
