"""Exploratory statistics: missing values, counts, correlations, histograms, imputation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_and_distinct(df: DataFrame) -> DataFrame:
    """(field, missing, distinct) of every column in one pass."""
    wide = df.agg(*(f.alias(f"{n}{k}") for k, c in enumerate(df.columns) for n, f in (("m", F.count_if(F.col(c).isNull())), ("d", F.countDistinct(c)))))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"m{k}").alias("missing"), F.col(f"d{k}").alias("distinct")) for k, c in enumerate(df.columns)))
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def missing_rate(df: DataFrame, column: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.round(F.avg(F.col(column).isNull().cast("int")), 6).alias("missing_rate"), F.count("*").alias("records"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of each pair of columns, all in one aggregation."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{k}", 6).alias("r")) for k, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count), bins from 1; values outside go to the first or last."""
    bucket = F.least(F.greatest(F.floor((F.col(column) - low) / ((high - low) / bins)) + 1, F.lit(1)), F.lit(bins)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bin")).agg(F.count("*").alias("count"))


def by_month(df: DataFrame, at: str, kind: str) -> DataFrame:
    return df.groupBy(F.date_format(F.date_trunc("month", at), "yyyy-MM").alias("month"), kind).agg(F.count("*").alias("count"))


def top_counts(df: DataFrame, column: str, n: int = 30) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def mode_of(df: DataFrame, column: str) -> DataFrame:
    """One row, the most frequent value; of equally frequent ones the least."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), column).limit(1).select(F.col(column).alias("mode"))


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    return df.crossJoin(F.broadcast(mode_of(df, column))).withColumn(column, F.coalesce(column, "mode")).drop("mode")  # one row


def impute_normal(df: DataFrame, column: str, seed: int = 0) -> DataFrame:
    """Nulls as the absolute value of a normal draw with the column's mean and deviation."""
    moments = df.agg(F.avg(column).alias("_m"), F.stddev(column).alias("_s"))
    drawn = F.abs(F.randn(seed) * F.coalesce("_s", F.lit(0.0)) + F.col("_m"))
    return df.crossJoin(F.broadcast(moments)).withColumn(column, F.coalesce(F.col(column), drawn)).drop("_m", "_s")


def since(at: Column, year: int = 1980) -> Column:
    return F.year(at) >= year
