"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.operators import content
from spindrift.plans import catalogue, records  # noqa: F401  registers more queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = ([tuple(map(plain, r)) for r in rows] for rows in (df.select(*cols).collect(), cur.fetchall()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry_has_rows_and_names_match(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isfile("bench.py")


def test_tfidf_reads_documents_of_all_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = content.similar_texts(docs, docs.agg(F.min("doc_id")).first()[0], 10, "doc_id", F.col("text")).collect()
    got = catalogue.text_tfidf_ngrams(spark, SF).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(r["doc_id"], round(r["score"], 4)) for r in want]
