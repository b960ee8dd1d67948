"""Data quality: scores, completeness, duplicates and reports, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import valid_url

from .ranking import running

ALLOWED_TYPES = ("anime", "manga", "movie", "tv", "novel")
CORE = ("title", "synopsis", "genres", "score", "main_picture")


def quality_score(least_synopsis: int = 50) -> Column:
    """Of five marks: title, synopsis (half if short), score, genres, picture; a fifth each, two places."""
    text = F.col("synopsis")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    marks = (
        one(F.col("title").isNotNull() & (F.trim("title") != ""))
        + F.when(F.length(text) >= least_synopsis, 1.0).when(F.length(text) > 0, 0.5).otherwise(0.0)
        + one(F.col("score").isNotNull())
        + one(F.coalesce(F.size("genres") > 0, F.lit(False)))
        + one(F.col("main_picture").isNotNull())
    )
    return F.round(marks / 5, 2)


def completeness(df: DataFrame) -> DataFrame:
    """(field, filled, percent) of every column, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count(F.col(f"`{c}`")).alias(f"_c{k}") for k, c in enumerate(df.columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"_c{k}").alias("filled")) for k, c in enumerate(df.columns)))
    out = counts.select("_n", F.explode(rows).alias("x"))
    return out.select("x.field", "x.filled", F.round(100 * F.col("x.filled") / F.greatest("_n", F.lit(1)), 2).alias("percent"))


def core_completeness(df: DataFrame) -> DataFrame:
    """(field, percent, mark) of the core fields; a list counts if it has elements."""
    full = [F.when((F.size(c) > 0) if df.schema[c].dataType.typeName() == "array" else F.col(c).isNotNull(), 1.0).otherwise(0.0) for c in CORE if c in df.columns]
    names = [c for c in CORE if c in df.columns]
    wide = df.agg(*(F.avg(x).alias(n) for n, x in zip(names, full, strict=True)))
    rows = F.array(*(F.struct(F.lit(n).alias("field"), (100 * F.col(n)).alias("percent")) for n in names))
    out = wide.select(F.explode(rows).alias("x")).select("x.field", F.round("x.percent", 4).alias("percent"))
    return out.withColumn("mark", F.when(F.col("percent") >= 95, "good").when(F.col("percent") >= 80, "fair").otherwise("poor"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, count, percent) of a column's values; nulls are not counted. The sum is over the few counts, not the rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "count", F.round(100 * F.col("count") / F.col("total"), 4).alias("percent"))  # total is one row


def median(df: DataFrame, column: str) -> DataFrame:
    """(median), one row, exact: counts by value are summed up in order, by ranges, so no task has all values. Null without values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))  # one row
    placed = running(counts, [F.asc("v")], F.sum, "c", "upto").crossJoin(F.broadcast(total))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place), F.col("v")))

    return placed.agg(((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("median"))


def score_stats(df: DataFrame) -> DataFrame:
    main = df.agg(
        F.count("score").alias("scored"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg(F.length("synopsis")).alias("synopsis_length"),
    )
    return main.crossJoin(F.broadcast(median(df, "score")))  # each side is one row


def duplicate_members(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key occurs more than once, and how often."""
    return df.withColumn("copies", F.count("*").over(Window.partitionBy(key))).where("copies > 1")


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each value; null counts as a value."""
    return df.groupBy(key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))


def invalid_urls(df: DataFrame, column: str) -> DataFrame:
    return df.where(~valid_url(F.col(column)))


def low_quality(df: DataFrame, below: float = 0.6) -> DataFrame:
    return df.withColumn("quality_score", quality_score()).where(F.col("quality_score") < below)


def report(df: DataFrame, below: float = 0.6) -> DataFrame:
    """One row: records, mean quality, low-quality records, odd media types, scores out of range, duplicate ids."""
    q = quality_score()
    odd = F.array_sort(F.array_except(F.collect_set("media_type"), F.array(*map(F.lit, ALLOWED_TYPES))))
    main = df.agg(
        F.count("*").alias("records"), F.round(F.avg(q), 4).alias("mean_quality"), F.count_if(q < below).alias("low_quality"),
        F.array_join(odd, ",").alias("odd_types"), F.count_if(~F.col("score").between(0, 10)).alias("odd_scores"),
    )
    return main.crossJoin(F.broadcast(duplicate_count(df, "media_id")))  # each side is one row


def problems(required: tuple[str, ...] = ("media_id", "title", "media_type"), allowed: tuple[str, ...] = ALLOWED_TYPES) -> Column:
    """What a record lacks by the schema: its empty required fields, a type that isn't allowed, a score out of range."""
    found = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"no {c}")) for c in required]
    found.append(F.when(~F.col("media_type").isin(*allowed), F.lit("odd media_type")))
    found.append(F.when(~F.col("score").between(0, 10), F.lit("odd score")))
    return F.array_compact(F.array(*found))


def validate(df: DataFrame, required: tuple[str, ...] = ("media_id", "title", "media_type")) -> DataFrame:
    """(problem, records): how many records have each problem; a column that isn't there is one of all records."""
    lacking = [c for c in (*required, "score") if c not in df.columns]
    if lacking:
        return df.agg(F.count("*").alias("records")).select(F.explode(F.array(*(F.lit(f"no column {c}") for c in lacking))).alias("problem"), "records")
    return df.select(F.explode(problems(required)).alias("problem")).groupBy("problem").agg(F.count("*").alias("records"))
