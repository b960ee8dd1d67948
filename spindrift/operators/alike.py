"""Texts most like one by TF-IDF of their n-grams, without moving all n-grams to their documents.

A text's score needs its length, and so how many texts have each of its terms, nearly all of them rare. Most texts are
out before that is known: an n-gram is in no more texts than any of its words, and in one at least, so the words' counts
bound each length from both sides. Only texts that may be among the best by these bounds have their terms counted, and
those exactly; no text is lost by it. Texts are read up to four times and stay where they are; what moves are words'
counts, the terms of the texts that are left, and these terms' counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.storage import cut
from spindrift.workers import tidy

#: Words whose counts all tasks have, terms that are counted without moving others, and rows that a worker is sent at once.
WORDS, TERMS, LONG_ROWS = 200_000, 200_000, 1_000
#: What rounding may take from a bound.
SLACK = 1e-9


def texts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, texts): a row a key, with the words of its texts; words are lower-cased, of two or more word characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\w\w+)"), F.lit(1))
    if df.groupBy(key).count().where("count > 1").isEmpty():  # texts stay where they are
        return df.select(key, F.array(words).alias("texts"))
    return df.select(key, words.alias("texts")).groupBy(key).agg(F.collect_list("texts").alias("texts"))


def _different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, and of each number its place among them."""
    coded = pa.array(x).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def grams(column: pa.ListArray, stop: pa.Array, longest: int) -> Iterator[tuple]:
    """For each length of n-grams from 1: a function to their names, the (row, gram, count) of each in a row, and of each
    gram its words but the last, as a gram of the length before, and that last word, as one of length 1."""
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy() for c in (column, column.flatten())]
    flat = column.flatten().flatten().dictionary_encode()
    text = np.repeat(np.arange(len(sizes[1])), sizes[1])
    row = np.repeat(np.repeat(np.arange(len(column)), sizes[0]), sizes[1])
    gone = pc.is_in(flat.dictionary, value_set=stop).to_numpy(zero_copy_only=False)
    stay = ~gone[flat.indices.to_numpy()]
    text, row = text[stay], row[stay]
    kept, code = _different(flat.indices.to_numpy()[stay].astype(np.int64))
    words = flat.dictionary.take(pa.array(kept))
    own, size, before, last = code, len(words), np.arange(len(words)), np.arange(len(words))

    def first(at: np.ndarray) -> pa.Array:
        return words.take(pa.array(at))

    name = first
    for n in range(1, longest + 1):
        if n > 1:
            starts = np.flatnonzero(text[: -(n - 1)] == text[n - 1 :])
            both, place = _different(own[starts] * max(1, len(words)) + code[starts + n - 1])
            before, last, size = both // max(1, len(words)), both % max(1, len(words)), len(both)
            own, where = place, starts

            def name(at: np.ndarray, shorter=name, before=before, last=last) -> pa.Array:
                return pc.binary_join_element_wise(shorter(before[at]), first(last[at]), " ")

        else:
            where = np.arange(len(own))
        met, place = _different(row[where] * max(1, size) + own)
        yield name, (met // max(1, size), met % max(1, size), np.bincount(place, minlength=len(met))), before, last
        if not len(where):
            return
        spread = np.full(len(text), 0)
        spread[where] = own
        own = spread


class _Places:
    """Of n-grams their places among some terms, else -1; only those whose words are all in the terms get names."""

    def __init__(self, terms: pa.Array):
        self.terms, self.words = terms, pa.array(sorted({w for t in terms.to_pylist() for w in t.split(" ")}), pa.string())

    def of(self, found: list[tuple]) -> Iterator[np.ndarray]:
        near = there = None
        for name, _, before, last in found:
            if near is None:
                near = there = pc.is_in(name(last), value_set=self.words).to_numpy(zero_copy_only=False)
            else:
                there = there[before] & near[last]
            at = np.flatnonzero(there)
            out = np.full(len(last), -1)
            out[at] = pc.fill_null(pc.index_in(name(at), value_set=self.terms), -1).to_numpy()
            yield out


def _looked_up(place: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
    return np.where(place >= 0, np.append(values, default)[place], default)


def _counting(terms: pa.Array | None, words: bool, stop: pa.Array, longest: int) -> Callable:
    """Of each batch: how many rows have a term, of those in `terms` (None: of all n-grams), and of all words if so."""

    places = None if terms is None else _Places(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(grams(batch.column(1), stop, longest))
            asked = [np.ones(len(x[-1]), bool) for x in found] if places is None else [p >= 0 for p in places.of(found)]
            for n, ((name, (_, gram, _), _, last), of) in enumerate(zip(found, asked, strict=True)):
                at = np.arange(len(last)) if words and not n else np.flatnonzero(of)
                df = np.bincount(gram, minlength=len(last))
                yield pa.RecordBatch.from_arrays([name(at), pa.array(df[at]), pa.array(of[at])], names=["term", "df", "asked"])

    return tidy(run)


def _terms(found: list[tuple], rows: np.ndarray) -> list[pa.Array]:
    """The different terms of some rows and their counts, as lists."""
    of, names, counts = [], [], []
    for name, (row, gram, count), *_ in found:
        at = np.isin(row, rows)
        of.append(row[at])
        names.append(name(gram[at]))
        counts.append(count[at])
    order = np.argsort(of := np.concatenate(of), kind="stable")
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(rows, of), minlength=len(rows)))]), pa.int32())
    return [pa.ListArray.from_arrays(ends, x.take(pa.array(order))) for x in (pa.concat_arrays(names), pa.array(np.concatenate(counts)))]


def _bounding(own: tuple, frequent: tuple, rare: float, most: float, n: int, stop: pa.Array, longest: int) -> Callable:
    """(key, low, high, terms, counts) of rows that share a term with `own` and may be among the n best of their task.

    own: terms, weights and idf; frequent: words and idf. Other words have an idf of `rare` at least, and no term of over `most`."""

    places = _Places(own[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0)
        for batch in batches:
            size = batch.num_rows
            found = list(grams(batch.column(1), stop, longest))
            dot, short, long = np.zeros(size), np.zeros(size), np.zeros(size)
            words = least = None
            for place, (name, (row, gram, count), before, last) in zip(places.of(found), found, strict=True):
                if words is None:
                    often = pc.fill_null(pc.index_in(name(last), value_set=frequent[0]), -1).to_numpy()
                    words = least = _looked_up(often, frequent[1], rare)
                    high = _looked_up(often, frequent[1], most)
                else:
                    least, high = np.maximum(least[before], words[last]), np.full(len(last), most)
                weight, idf = _looked_up(place, own[1], 0.0), _looked_up(place, own[2], 0.0)
                low, high = np.where(idf > 0, idf, least), np.where(idf > 0, idf, high)
                dot += np.bincount(row, count * idf[gram] * weight[gram], size)
                short += np.bincount(row, (count * low[gram]) ** 2, size)
                long += np.bincount(row, (count * high[gram]) ** 2, size)
            rows = np.flatnonzero(dot > 0)
            low, high = dot[rows] / np.sqrt(long[rows]), dot[rows] / np.sqrt(short[rows])
            best = -np.sort(-np.concatenate([best, low]))[:n]
            stay = high >= best[-1] * (1 - SLACK) if len(best) >= n else np.ones(len(rows), bool)
            if stay.any():
                columns = [batch.column(0).take(pa.array(rows[stay])), pa.array(low[stay]), pa.array(high[stay]), *_terms(found, rows[stay])]
                yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "low", "high", "terms", "counts"])

    return tidy(run)


def _listed(longest: int, stop: pa.Array) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, (_, gram, count), *_ in grams(batch.column(1), stop, longest):
                yield pa.RecordBatch.from_arrays([name(gram), pa.array(count)], names=["term", "tf"])

    return tidy(run)


def most_alike(df: DataFrame, item, n: int, key: str, text: Column, longest: int, stop_words: list[str]) -> DataFrame:
    """(key, score): the n rows, but for one, whose (1..longest)-gram TF-IDF is most like that one's; of equal ones the first keys.

    Rows of one key are one text with the n-grams of each. Rows without a common term are none of the n."""
    spark, kind, stop = df.sparkSession, df.schema[key].dataType.simpleString(), pa.array(stop_words, pa.string())
    none = spark.createDataFrame([], f"`{key}` {kind}, score double")
    rows = texts(df, key, text)
    mine = {r["term"]: r["tf"] for r in rows.where(F.col(key) == item).mapInArrow(_listed(longest, stop), "term string, tf long").collect()}  # one text's
    if not mine or n < 1:
        return none
    total = df.count()
    asked = pa.array(list(mine), pa.string())
    counted = rows.mapInArrow(_counting(asked, True, stop, longest), "term string, df long, asked boolean")
    counts = cut(counted.groupBy("term").agg(F.sum("df").alias("df"), F.max("asked").alias("asked")), LONG_ROWS)
    known = {r["term"]: r["df"] for r in counts.where("asked").collect()}

    def idf(df: np.ndarray) -> np.ndarray:
        return np.log((1 + total) / (1 + np.asarray(df, float))) + 1

    terms = list(mine)
    own_idf = idf([known[t] for t in terms])
    own = (asked, own_idf * np.array([mine[t] for t in terms], float), own_idf)
    words = counts.where(~F.col("term").contains(" "))
    sizes = {r["p"]: r["count"] for r in words.groupBy(F.floor(F.log2("df")).alias("p")).count().collect()}  # a row a power of two
    least = next(p for p in range(65) if sum(c for q, c in sizes.items() if q >= p) <= WORDS)
    frequent = words.where(F.col("df") >= F.lit(2**least)).select("term", "df").collect()  # WORDS rows at most
    listed = (pa.array([r["term"] for r in frequent], pa.string()), idf([r["df"] for r in frequent]))
    bounding = _bounding(own, listed, float(idf(max(1, 2**least - 1))), float(idf(1)), n, stop, longest)
    bounds = cut(rows.where(F.col(key) != item).mapInArrow(bounding, f"`{key}` {kind}, low double, high double, terms array<string>, counts array<long>"), LONG_ROWS)
    low = [r["low"] for r in bounds.orderBy(F.desc("low")).select("low").limit(n).collect()]
    left = bounds.where(F.col("high") >= (low[-1] * (1 - SLACK) if len(low) == n else 0.0))
    postings = left.select(key, F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(key, F.col("x.terms").alias("term"), F.col("x.counts").alias("tf"))
    wanted = postings.select("term").distinct().join(counts, "term", "left_anti")
    few = [r["term"] for r in wanted.limit(TERMS + 1).collect()]
    counts = counts.select("term", "df")
    if few:
        more = _counting(pa.array(few, pa.string()) if len(few) <= TERMS else None, False, stop, longest)
        found = rows.mapInArrow(more, "term string, df long, asked boolean").groupBy("term").agg(F.sum("df").alias("df"))
        counts = counts.union(cut(found.join(wanted, "term", "left_semi"), LONG_ROWS))
    base = float(np.sqrt(np.sum(own[1] ** 2)))
    weights = spark.createDataFrame(list(zip(terms, (own[1] / base).tolist(), strict=True)), "term string, mine double")
    raw = postings.join(counts, "term").join(F.broadcast(weights), "term", "left")  # one text's terms
    w = F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1)
    # summed up in order of terms: equal texts have equal scores
    of = raw.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", w.alias("w"), F.coalesce("mine", F.lit(0.0)).alias("mine")))).alias("x"))
    dot = F.aggregate("x", F.lit(0.0), lambda a, x: a + x["w"] * x["mine"])
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return of.select(key, (dot / length).alias("score")).orderBy(F.desc("score"), key).limit(n)
