"""Content similarity: TF-IDF as a relation of (id, term, weight), and scaled numbers beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import let

from . import alike
from .dedup import cut
from .vectors import min_max

_STOP: list[str] = []


def stop_words() -> list[str]:
    """Spark's English list."""
    if not _STOP:
        _STOP.extend(sorted(StopWordsRemover.loadDefaultStopWords("english")))
    return _STOP


def tokens(text: Column, longest: int = 1) -> Column:
    """Lower-cased words of two or more word characters that are no stop words, and their n-grams up to `longest`."""
    stop = F.split(F.lit(" ".join(stop_words())), " ")  # one literal once planned
    plain = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(\w\w+)"), F.lit(1)), lambda w: ~F.array_contains(stop, w))

    def grams(words: Column) -> Column:
        def of(n: int) -> Column:
            starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

        return reduce(F.concat, [of(n) for n in range(2, longest + 1)], words)

    return plain if longest == 1 else let(plain, grams)


def tfidf(df: DataFrame, key: str, text: Column, longest: int = 1) -> DataFrame:
    """(key, term, weight): count times ln((1 + n) / (1 + df)) + 1, each row's weights of unit length.

    One shuffle by (key, term), one by term for document frequencies, one back by key: term weights never become
    wide vectors, so vocabulary size doesn't matter to any one task."""
    terms = df.select(key, F.explode(tokens(text, longest)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    total = df.agg(F.count("*").alias("n"))  # one row
    frequency = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    frequency = frequency.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = terms.join(frequency, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("weight"))


def features(genres: Column, studios: Column) -> Column:
    return F.lower(F.concat_ws(" ", genres, studios))


def similar_items(df: DataFrame, item, n: int, key: str = "media_id", numbers: tuple[str, ...] = ("score", "episodes")) -> DataFrame:
    """(key, score): the n items most like one by genres, studios and scaled numbers, itself left out; none for an unknown id.

    The item's few terms meet the others' through a join on term; numbers are added as they are to both lengths."""
    weights = cut(tfidf(df, key, features(F.col("genres"), F.col("studios"))))  # read three times
    mine = weights.where(F.col(key) == item).select("term", F.col("weight").alias("mine"))
    text = weights.join(mine, "term").groupBy(key).agg(F.sum(F.col("weight") * F.col("mine")).alias("text"))
    lengths = weights.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("text_size"))
    scaled = min_max(df.select(key, *(F.col(c).cast("double").alias(c) for c in numbers)), list(numbers))
    own = scaled.where(F.col(key) == item).select(*(F.col(c).alias(f"_{c}") for c in numbers)).limit(1)
    size = sum((F.col(c) * F.col(c) for c in numbers[1:]), F.col(numbers[0]) * F.col(numbers[0]))
    dot = sum((F.col(c) * F.col(f"_{c}") for c in numbers[1:]), F.col(numbers[0]) * F.col(f"_{numbers[0]}"))
    rows = scaled.crossJoin(F.broadcast(own)).select(key, size.alias("size"), dot.alias("dot"))  # own is one row
    joined = rows.join(text, key, "left").join(lengths, key, "left")
    whole = joined.select(key, (F.coalesce("text", F.lit(0.0)) + F.col("dot")).alias("dot"), (F.coalesce("text_size", F.lit(0.0)) + F.col("size")).alias("size"))
    base = whole.where(F.col(key) == item).select(F.sqrt("size").alias("base"))
    product = F.sqrt("size") * F.col("base")
    scored = whole.where(F.col(key) != item).crossJoin(F.broadcast(base)).select(key, F.when(product > 0, F.col("dot") / product).otherwise(0.0).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(n)


def similar_texts(df: DataFrame, item, n: int, key: str, text: Column, longest: int = 2) -> DataFrame:
    """(key, score): the n rows whose (1..longest)-gram TF-IDF is most like one row's."""
    return alike.most_alike(df, item, n, key, text, longest, stop_words())
