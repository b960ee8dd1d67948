"""Orders, ranks and pages. Every order ends in the id, so equal rows have a place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.storage import cut


def running(df: DataFrame, order: list[Column], aggregate: Callable[[Column | str], Column], value: str, name: str, with_own: bool = True) -> DataFrame:
    """df with the aggregate (max, min or sum) of a column over the rows up to each in one order of all rows.

    Rows are dealt to ranges of the order. Each range is summed up by itself, and what comes before it is a table of a
    row a range, so no task sees more than a range. Without with_own a row's own value is left out."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    whole = ranged.groupBy("_range").agg(aggregate(value).alias("_whole"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("_range", aggregate("_whole").over(earlier).alias("_before"))
    near = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if with_own else -1)
    # an array's aggregate without its nulls: null if neither has a value
    both = F.filter(F.array(aggregate(value).over(near), F.col("_before")), lambda x: x.isNotNull())
    joined = ranged.join(F.broadcast(before), "_range").withColumn("_both", both)
    combine = {"max": F.array_max, "min": F.array_min}.get(aggregate.__name__, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0).cast(whole.schema["_whole"].dataType), lambda s, x: s + x)))
    return joined.withColumn(name, combine(F.col("_both"))).drop("_range", "_before", "_both")


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Descending rank, equal values sharing their mean; null for null.

    Ranks come from counts by value: the values are summed up in order, by ranges, and joined back."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    placed = running(counts, [F.desc("_v")], F.sum, "_c", "_upto")
    ranks = placed.select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, df[column] == ranks["_v"], "left").drop("_v")


def catalogue_order(df: DataFrame) -> list[Column]:
    """By the sum of ranks in score and in number of scores, then members, favorites and id."""
    return [F.asc_nulls_last("rank_sum"), F.desc_nulls_last("members"), F.desc_nulls_last("favorites"), F.asc("media_id")]


def rank_sum(df: DataFrame) -> DataFrame:
    ranked = average_rank(average_rank(df, "score", "score_rank"), "scored_by", "scored_by_rank")
    return ranked.withColumn("rank_sum", F.col("score_rank") + F.col("scored_by_rank"))


def trending(df: DataFrame, n: int = 20, media_type: str | None = None) -> DataFrame:
    """Highest score, then the lowest popularity rank."""
    if media_type:
        df = df.where(F.col("media_type") == media_type)
    return df.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("popularity"), F.asc("media_id")).limit(n)


def merge_order(df: DataFrame) -> DataFrame:
    """With merge_score: a tenth of the score and half the share of the highest popularity (vote count where it has none or 0)."""
    popular = F.coalesce(F.nullif(F.col("popularity"), F.lit(0)), F.col("vote_count"), F.lit(0))
    top = df.agg(F.max(popular).alias("_top"))  # one row, joined back: no window over all rows
    share = F.when(F.col("_top") > 0, popular / F.col("_top") * 0.5).otherwise(0.0)
    return df.crossJoin(F.broadcast(top)).withColumn("merge_score", F.coalesce(F.col("score"), F.lit(0)) / 10 + share).drop("_top")


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per(df: DataFrame, key: str | list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order))).where(F.col("place") <= k)


def frontier(df: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The rows whose id is above every id before them in time."""
    tops = running(df, [F.asc(at), F.asc(key)], F.max, key, "_top", with_own=False)
    return tops.where(F.col("_top").isNull() | (F.col(key) > F.col("_top"))).drop("_top")


def created_before(df: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """Each row with created_at_before: the time of the first frontier row whose id is at least its own.

    Ids come in order of creation, so an item was there when a later one was updated. Frontier rows' times grow with
    their ids, so the first one's is the least: a running minimum from the highest id down."""
    edge = frontier(df.select(key, at), key, at).select(F.col(key).alias("_key"), F.col(at).alias("_edge"))
    marked = df.join(edge, df[key] == edge["_key"], "left").drop("_key")
    return running(marked, [F.desc(key)], F.min, "_edge", "created_at_before").drop("_edge")
