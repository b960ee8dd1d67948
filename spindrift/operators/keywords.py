"""A keyword index: which texts contain a term, for a table of terms at once, without reading all texts.

Texts are stored in blocks of neighbouring rows. For each trigram of a block's texts (in lower case, with two ends after the
last letter) there is one posting row: the numbers of the block's texts that have it, each as the distance to the one before.
Posting rows are sorted by trigram, so a search opens the file parts that have its terms' trigrams. A term of three
letters or more is looked for where all its trigrams are, a shorter one where some trigram begins with it; what is found is
verified on the stored texts of those blocks alone. A hot trigram has a row a block, never a list of all texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.storage import cut
from spindrift.workers import tidy

#: Texts of a block at most, and characters of those that are held at once.
BLOCK, CHARS = 4_096, 4_000_000
#: Trigrams and blocks that are named to the file reader at most; more are only joined.
NAMED = 10_000
#: Found rows up to which they are sent to the texts; more meet the texts in a shuffle.
BROADCAST = 500_000
#: Bits of a code point.
_BITS = 21


def _codes(text: str) -> np.ndarray:
    return np.frombuffer((text + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def grams(text: str) -> np.ndarray:
    """The different trigrams of a text and its two ends, as numbers that sort as their letters do."""
    c = _codes(text)
    return np.unique((c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (no, text), no in order, to posting rows; a block is a run of texts of one task."""
    numbers, own, size = [], [], 0

    def flush() -> pa.RecordBatch:
        no = np.array(numbers, np.int64)
        of = np.repeat(np.arange(len(own)), [len(g) for g in own])
        all_ = np.concatenate(own)
        order = np.lexsort((of, all_))
        all_, of = all_[order], of[order]
        begins = np.flatnonzero(np.append(True, np.diff(all_) != 0))
        ends = np.append(begins[1:], len(all_))
        steps = np.diff(of, prepend=0)
        steps[begins] = of[begins]
        steps = steps.astype(np.uint16)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(all_[begins]),
                pa.array(np.full(len(begins), no[0])),
                pa.array((ends - begins).astype(np.int32)),
                pa.array([steps[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()),
            ],
            names=["gram", "block", "n", "steps"],
        )

    for batch in batches:
        for no, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            # a block's numbers have no gaps, so a place in the block tells the number
            if numbers and (no != numbers[-1] + 1 or len(numbers) == BLOCK or size > CHARS):
                yield flush()
                numbers, own, size = [], [], 0
            text = text.as_py()
            numbers.append(no)
            own.append(grams(text))
            size += len(text)
    if numbers:
        yield flush()


def build(df: DataFrame, path: str, key: str, text: str) -> None:
    """Writes an index of a table's texts: path/texts (no, key, text in lower case) and path/postings.

    Null texts are left out; a key may be repeated or null."""
    rows = cut(df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("text")))
    rows = rows.withColumn("no", F.monotonically_increasing_id())
    rows.select("no", "key", "text").write.mode("overwrite").parquet(f"{path}/texts")
    postings = cut(rows.select("no", "text").mapInArrow(tidy(_posted), "gram long, block long, n int, steps binary"), batch=1_000)
    postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/postings")


def _asked(term: pd.Series) -> pd.Series:
    """Ranges (low, high) of the trigrams of which a term needs every one; a short term needs one of its range."""
    out = []
    for t in term:
        c = _codes(t)[:-2]
        if len(c) >= 3:
            g = np.unique((c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:])
            out.append([(int(x), int(x)) for x in g])
        else:
            low = int(sum(int(x) << (2 - k) * _BITS for k, x in enumerate(c)))
            out.append([(low, low + (1 << (3 - len(c)) * _BITS) - 1)])
    return pd.Series(out)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows (block, term, need, low, steps), sorted by block and term, to places (block, term, no) in all of a term's
    `need` lists; the lists of one range are one."""
    at, lists, need = None, {}, 0

    def found() -> list[int]:
        if len(lists) < need:
            return []
        sets = sorted((np.unique(np.concatenate(x)) for x in lists.values()), key=len)
        out = sets[0]
        for x in sets[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return (out + at[0]).tolist()

    for batch in batches:
        terms, nos = [], []
        for block, term, n, low, steps in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if at != (block, term):
                if at:
                    own = found()
                    terms += [at[1]] * len(own)
                    nos += own
                at, lists, need = (block, term), {}, n
            lists.setdefault(low, []).append(np.cumsum(np.frombuffer(steps, np.uint16), dtype=np.int64))
        if terms:
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(nos, pa.int64())], names=["term", "no"])
    if at and (own := found()):
        yield pa.RecordBatch.from_arrays([pa.array([at[1]] * len(own), pa.string()), pa.array(own, pa.int64())], names=["term", "no"])


def postings(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """Posting rows of the ranges (term, need, low, high) of trigrams; up to NAMED of them are named to the file reader."""
    rows = spark.read.parquet(f"{path}/postings")
    some = ranges.select("low", "high").distinct().limit(NAMED + 1).collect()
    if len(some) <= NAMED:
        single = sorted(r["low"] for r in some if r["low"] == r["high"])
        wide = [(r["low"], r["high"]) for r in some if r["low"] != r["high"]]
        named = F.col("gram").isin(single) if single else F.lit(False)
        for low, high in wide:
            named = named | F.col("gram").between(low, high)
        rows = rows.where(named)
    exact = rows.join(ranges.where("low = high").select("term", "need", F.col("low").alias("gram")), "gram").withColumn("low", F.col("gram"))
    out = exact.select("block", "term", "need", "low", "steps")
    for size, bits in ((1, 2 * _BITS), (2, _BITS)):
        own = ranges.where(F.col("high") - F.col("low") == (1 << bits) - 1).select("term", "need", "low", F.shiftright("low", bits).alias("head"))
        out = out.unionByName(rows.withColumn("head", F.shiftright("gram", bits)).join(own, "head").select("block", "term", "need", "low", "steps"))
    return out


def search(spark: SparkSession, path: str, terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (term, key) of the texts that contain each of the terms (a column `term`), in any case.

    Terms that are alike in lower case are one; null and empty ones find nothing."""
    asked = F.pandas_udf(_asked, "array<struct<low:long,high:long>>")
    own = cut(terms.select(F.lower("term").alias("term")).where("term <> ''").distinct().withColumn("x", asked("term")))
    ranges = own.select("term", F.size("x").alias("need"), F.explode("x").alias("r")).select("term", "need", "r.low", "r.high")
    met = postings(spark, path, ranges).repartition("block", "term").sortWithinPartitions("block", "term", "low")
    found = cut(met.select("block", "term", "need", "low", "steps").mapInArrow(tidy(_met), "term string, no long"))
    texts = spark.read.parquet(f"{path}/texts")
    few = found.count() <= BROADCAST
    both = texts.join(F.broadcast(found) if few else found, "no")
    return both.where(F.contains(F.col("text"), F.col("term"))).select("term", F.col("key").alias(key))
