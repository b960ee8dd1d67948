"""Deduplication of a catalogue: by id, by fuzzy title, and across sources.

The greedy rule (each record that is still there, in order, removes later ones that match it) is replayed exactly,
without a row for each pair: equal titles are one class, classes of like lengths meet in blocks, and the replay runs
on the matching pairs alone."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.similarity import least_title, subsequence_with, title_similarity_udf, weighted_similarity
from spindrift.functions.text import year_of
from spindrift.storage import cut

from .components import connected_components
from .filters import first_by

#: Sources, the most trusted first.
PRIORITY = ("mal", "tmdb", "mangadex")


def keep_first(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    return first_by(df, [key], [F.asc(ordinal)])


def union_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All Parquet tables that there are, columns by name; an error if there is none."""
    from spindrift.sources.readers import read_existing

    return read_existing(spark, paths)


#: Titles of a block at least and at most, and blocks that a level of lengths is rather dealt into than have larger ones.
BLOCK, MOST_BLOCK, BLOCKS = 4_096, 32_768, 8
#: Partitions that pairs of blocks are dealt to at most.
PARTITIONS = 2_000
#: Lots that kinds of titles are dealt to, and a number that no level of lengths reaches.
LOTS, LEVELS = 16, 100_000
#: Bins of characters that titles are told apart by, steps of their counts that are looked at, and bins of characters in subsequences.
BINS, STEPS, MARKS = 32, 192, 64
#: Bins of neighbouring characters.
COUPLES = 256
#: Titles held against so many others at once, marks of those aligned at once, and pairs that are held until they are aligned.
ROWS, OTHERS, AT_ONCE, MET = 256, 4_096, 1_000_000, 500_000
#: Longer titles are aligned one by one, as whole numbers of Python's.
LONG = 512
#: Stands for a year that isn't known.
UNKNOWN = -(2**31)
#: Stands for more years apart than any that has a percent of its own.
FAR = -1


class _Titles:
    """Titles in order of length, with what they are compared by."""

    def __init__(self, titles: list[str], ids: list) -> None:
        order = sorted(range(len(titles)), key=lambda k: len(titles[k]))
        self.titles, self.ids = [titles[k] for k in order], [ids[k] for k in order]
        self.sizes = np.array([len(t) for t in self.titles], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.frombuffer("".join(self.titles).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(len(titles)), self.sizes)
        self.counts = np.bincount((self.codes % BINS).astype(np.int64) * len(titles) + of, minlength=BINS * len(titles)).reshape(BINS, -1)
        self.many = int(np.searchsorted(self.sizes, LONG, "right"))  # titles that aren't long; the others come after them

    @cached_property
    def couples(self) -> np.ndarray:
        """Each long title's counts of neighbouring characters by hash."""
        out = np.empty((len(self.titles) - self.many, COUPLES), np.int32)
        for k in range(self.many, len(self.titles)):
            codes = self.codes[self.starts[k] : self.starts[k] + self.sizes[k]].astype(np.int64)
            out[k - self.many] = np.bincount(((codes[:-1] * 1_000_003 + codes[1:]) * 2_654_435_761 >> 15) % COUPLES, minlength=COUPLES)
        return out

    def reached(self) -> np.ndarray:
        """(bins, steps): how many titles have so many characters of a bin, one at least."""
        return np.stack([np.cumsum(np.bincount(c, minlength=int(self.counts.max(initial=0)) + 1)[::-1])[::-1][1:] for c in self.counts])

    def steps(self, taken: np.ndarray, share: float, mine: bool) -> np.ndarray:
        """Rows whose products with another's are the characters that both can have in common, less what must be.

        The steps taken of counts by bin count exactly, of all others half the sum of both sides', which is no less."""
        out = np.empty((len(self.titles), len(taken) + 2), np.float32)
        for k, (b, n) in enumerate(taken.tolist()):
            out[:, k] = self.counts[b] >= n
        out[:, -2] = (self.sizes - out[:, :-2].sum(axis=1)) / 2 - share * self.sizes / 2
        out[:, -1] = 1
        return out if mine else np.concatenate([out[:, :-2], out[:, :-3:-1]], axis=1)


def _taken(left: _Titles, right: _Titles) -> np.ndarray:
    """The (bin, count) that part titles most: what about half of them reach."""
    both = [x.reached() for x in (left, right)]
    n = max(x.shape[1] for x in both)
    total = sum(np.pad(x, ((0, 0), (0, n - x.shape[1]))) for x in both) / (len(left.titles) + len(right.titles))
    best = np.argsort(-(total * (1 - total)).ravel(), kind="stable")[:STEPS]
    return np.stack([best // n, best % n + 1], axis=1)


def _in_common(left: _Titles, right: _Titles, i: np.ndarray, j: np.ndarray, upto_i: np.ndarray, upto_j: np.ndarray) -> np.ndarray:
    """The longest common subsequences of the first characters of pairs, by bins of characters: never less than the real ones."""
    out = np.empty(len(i), np.int64)
    words = -(-upto_i // 64)
    order = np.lexsort((i, words))
    ends = np.searchsorted(words[order], np.arange(int(words.max(initial=0)) + 2), "right")
    at = 0
    while at < len(order):
        w = int(words[order[at]])
        some = order[at : min(int(ends[w]), at + max(1, AT_ONCE // (w * MARKS)))]
        at += len(some)
        some = some[np.argsort(-upto_j[some], kind="stable")]  # the longest come first
        mine, of = np.unique(i[some], return_inverse=True)
        long = np.minimum(left.sizes[mine], 64 * w)
        place = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        slot = (place // 32 * len(mine) + np.repeat(np.arange(len(mine)), long)) * MARKS + left.codes[np.repeat(left.starts[mine], long) + place] % MARKS
        bits = np.bincount(slot, weights=np.exp2(place % 32), minlength=2 * w * len(mine) * MARKS).astype(np.uint64).reshape(w, 2, -1)
        marks = bits[:, 0] | bits[:, 1] << np.uint64(32)
        row = np.full((w, len(some)), 2**64 - 1, np.uint64)
        starts, base = right.starts[j[some]], of * MARKS
        for p, n in enumerate(np.searchsorted(-upto_j[some], -np.arange(int(upto_j[some[0]]))).tolist()):
            slot = base[:n] + right.codes[starts[:n] + p] % MARKS
            carry = None
            for k in range(w):
                mark, now = marks[k][slot], row[k, :n]
                hit = now & mark
                total = now + hit
                if k + 1 < w:
                    over = total < now
                    if carry is not None:
                        total += carry
                        over |= total < carry
                elif carry is not None:
                    total += carry
                row[k, :n] = total | (now ^ hit)
                if k + 1 < w:
                    carry = over.astype(np.uint64)
        rest = upto_i[some]
        found = np.zeros(len(some), np.int64)
        for k in range(w):
            bits = np.clip(rest - 64 * k, 0, 64).astype(np.uint64)
            low = np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
            found += np.bitwise_count(~row[k] & low)
        out[some] = found
    return out


def _near(left: _Titles, right: _Titles, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether so many characters put in or taken out may part pairs of long titles, by counts of characters and of neighbouring ones.

    One that is put in or taken out changes a count of characters by one, and three of neighbouring ones at most."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), OTHERS):
        some = np.arange(at, min(at + OTHERS, len(i)))
        some = some[np.abs(left.counts[:, i[some]] - right.counts[:, j[some]]).sum(axis=0) <= most[some]]
        some = some[np.abs(left.couples[i[some] - left.many] - right.couples[j[some] - right.many]).sum(axis=1) <= 3 * most[some]]
        out[some] = True
    return out


def _alike(left: _Titles, right: _Titles, percent: int) -> Iterator[tuple[int, int, int]]:
    """(place, place, ratio) of the pairs that reach the percent; of one side with itself, each pair once.

    Titles with a common subsequence of the share needed have as many characters in common, which a product of matrices
    bounds. All but the last r characters of both have all but r of the subsequence in common, so about a half of each tells
    most of the rest apart; then whole ones are aligned, and what is left is measured."""
    share = (percent - 0.5) / 100
    wide = (2 - share) / share  # of lengths
    taken = _taken(left, right)
    a, b = left.steps(taken, share, True), right.steps(taken, share, False).T.copy()
    room = 0.01 + 1e-6 * (int(left.sizes[-1]) + int(right.sizes[-1]))  # products are of single precision
    found, held = [], 0
    for at in range(0, len(a), ROWS):
        sizes = left.sizes[at : at + ROWS]
        first = at if left is right else int(np.searchsorted(right.sizes, sizes[0] / wide - 1e-6))
        last = int(np.searchsorted(right.sizes, sizes[-1] * wide + 1e-6, "right"))
        for to in range(first, last, OTHERS):
            i, j = np.nonzero(a[at : at + ROWS] @ b[:, to : min(to + OTHERS, last)] > -room)
            i, j = i + at, j + to
            some = j > i if left is right else slice(None)
            found.append((i[some], j[some]))
            held += len(found[-1][0])
            if held >= MET:
                yield from _measured(left, right, found, percent)
                found, held = [], 0
    if held:
        yield from _measured(left, right, found, percent)


def _measured(left: _Titles, right: _Titles, found: list[tuple[np.ndarray, np.ndarray]], percent: int) -> Iterator[tuple[int, int, int]]:
    """Those of the found pairs, with their ratio, that reach the percent."""
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    n, m = left.sizes[i], right.sizes[j]
    least = np.ceil((percent - 0.5) / 100 * (n + m) / 2 - 1e-9).astype(np.int64)
    for part in (0.6, 1):
        upto = np.minimum(64 * np.maximum(1, np.rint(n / 128)), np.ceil(part * n)).astype(np.int64) if part < 1 else n
        r = np.minimum(n - upto, m)
        some = (n > LONG) & (m > LONG)
        short = np.flatnonzero(~some)
        if part < 1:
            long = np.flatnonzero(some)
            some[long] = _near(left, right, i[long], j[long], (n + m - 2 * least)[long])
        some[short] = _in_common(left, right, i[short], j[short], (n - r)[short], (m - r)[short]) + r[short] >= least[short]
        i, j, n, m, least = (x[some] for x in (i, j, n, m, least))
    order = np.argsort(i, kind="stable")
    of = None
    for x, y, size, other, enough in zip(*(z[order].tolist() for z in (i, j, n, m, least)), strict=True):
        one, two = left.titles[x], right.titles[y]
        if of != x:
            of, alike, half = x, subsequence_with(one), subsequence_with(one[: size // 2])
        r = min(size - size // 2, other)
        if min(size, other) > LONG and half(two[: other - r]) + r < enough:
            continue
        ratio = round(200 * alike(two) / (size + other))
        if ratio >= percent:
            yield x, y, ratio


def _met(needs: dict) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The titles of two blocks (side 0 and 1), or of one (side 0), to the pairs (a, b, ratio) between them that reach what they need."""

    def need(year: int, other: int) -> int:
        apart = None if UNKNOWN in (year, other) else abs(year - other)
        return needs[apart] if apart in needs else needs.get(FAR, 101)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["id" if "id" in part else "title"]
        sides: list[dict[tuple, _Titles]] = [{}, {}]
        for (side, *group), some in part.groupby(["side", "kind", "year"]):
            sides[side][tuple(group)] = _Titles(some["title"].tolist(), ids[some.index].tolist())
        own = part["level"].iloc[0] == part["other"].iloc[0] and part["p"].iloc[0] == part["q"].iloc[0]
        out: dict[str, list] = {"a": [], "b": [], "ratio": []}
        for (kind, year), left in sides[0].items():
            for (other, there), right in sides[0 if own else 1].items():
                percent = need(year, there) if kind == other and not (own and year > there) else 101
                for i, j, ratio in _alike(left, right, percent) if percent <= 100 else ():
                    ends = sorted((left.ids[i], right.ids[j]))
                    for c, x in zip(out, (*ends, ratio), strict=True):
                        out[c].append(x)
        return pd.DataFrame(out).astype({"a": ids.dtype, "b": ids.dtype, "ratio": "int32"})

    return run


def title_pairs(titles: DataFrame, needs: int | dict = 90) -> DataFrame:
    """titles (title), not null and not empty, to (a, b, ratio), a < b, of those whose ratio reaches the percent. No pair is lost.

    titles may have an id, which then stands for the title in pairs, a kind, of which both sides must be, and a year:
    needs then has the percent by years apart, by FAR for more and by None where one is unknown; over 100 is none.

    At a ratio of r (half a point less, for rounding) at most (1 - r)(|a| + |b|) insertions and deletions part two titles,
    so their lengths are within a factor. Titles are dealt to levels of lengths, each the factor wide, so only those of
    one level or of neighbouring ones can match, and a level to blocks; each two such blocks meet in one task. There pairs
    are told apart by length, by characters in common (a product of matrices), then by subsequences of halves and wholes, many
    pairs at once, and only what is left is measured. A task holds two blocks; a title goes to as many tasks as its level and
    the next have blocks. The number of comparisons grows with the square of titles alike in length, kind and year, each of some
    nanoseconds; no pair makes a row."""
    needs = needs if isinstance(needs, dict) else {None: needs}
    slack = (100 - min(needs.values()) + 0.5) / 100
    lot = F.pmod(F.xxhash64("kind"), F.lit(LOTS)).cast("int") * LEVELS
    level = F.floor(F.log(F.greatest(F.length("title"), F.lit(1))) / math.log((1 + slack) / (1 - slack) * 1.0001)).cast("int")
    given = set(titles.columns)
    kind, year = (F.col(c) if c in given else F.lit(none) for c, none in (("kind", ""), ("year", UNKNOWN)))
    titles = titles.select(*(["id"] if "id" in given else []), "title", kind.alias("kind"), F.coalesce(year, F.lit(UNKNOWN)).alias("year"))
    titles = cut(titles.withColumn("level", lot + level))
    sizes = {r["level"]: r["n"] for r in titles.groupBy("level").agg(F.count("*").alias("n")).collect()}  # grows with the longest length's logarithm
    dealt = {k: -(-n // min(MOST_BLOCK, max(BLOCK, -(-n // BLOCKS)))) for k, n in sizes.items()}
    spark = titles.sparkSession
    id_kind = titles.schema["id" if "id" in given else "title"].dataType.simpleString()
    if not dealt:
        return spark.createDataFrame([], f"a {id_kind}, b {id_kind}, ratio int")
    blocks = F.create_map(*(F.lit(x) for k, n in dealt.items() for x in (k, n)))
    near = titles.withColumn("n", blocks[F.col("level")]).withColumn("next", F.coalesce(blocks[F.col("level") + 1], F.lit(0))).withColumn("before", F.coalesce(blocks[F.col("level") - 1], F.lit(0)))
    near = near.withColumn("p", F.pmod(F.xxhash64("title"), F.col("n")).cast("int"))

    def upto(n: Column, of: Callable[[Column], Column]) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of)).otherwise(F.array().cast("array<struct<level:int,p:int,other:int,q:int,side:int>>"))

    def meeting(level: Column, p: Column, other: Column, q: Column, side: Column | int) -> Column:
        return F.struct(level.alias("level"), p.alias("p"), other.alias("other"), q.alias("q"), (F.lit(side) if isinstance(side, int) else side).alias("side"))

    level, p = F.col("level"), F.col("p")
    places = F.concat(
        upto(F.col("n"), lambda q: meeting(level, F.least(p, q), level, F.greatest(p, q), F.when(p <= q, 0).otherwise(1))),
        upto(F.col("next"), lambda q: meeting(level, p, level + 1, q, 0)),
        upto(F.col("before"), lambda q: meeting(level - 1, q, level, p, 1)),
    )
    own = [c for c in ("id", "title", "kind", "year") if c in titles.columns]
    parts = near.select(*own, F.explode(places).alias("m")).select(*own, "m.*")
    # a fixed number of partitions: by their bytes, which are few, Spark would put them all into one task
    many = sum(n * (n + 1) // 2 + n * dealt.get(k + 1, 0) for k, n in dealt.items())
    meet = ["level", "p", "other", "q"]
    return parts.repartition(min(2 * many, PARTITIONS), *meet).groupBy(*meet).applyInPandas(_met(needs), f"a {id_kind}, b {id_kind}, ratio int")


def excluded(edges: DataFrame) -> DataFrame:
    """The nodes (place) that a greedy pass in order of place removes; edges (a, b) join those that exclude one another.

    Each round finds edges whose earlier node has no earlier neighbour that is undecided: it stays, and the later one
    goes with all its edges. A round is three joins on what is undecided; rounds are as many as the longest chain of
    decisions."""
    live = cut(edges.select(F.greatest("a", "b").alias("late"), F.least("a", "b").alias("early")).distinct())
    out = None
    while not live.isEmpty():
        waiting = live.select(F.col("late").alias("early")).distinct()
        gone = cut(live.join(waiting, "early", "left_anti").select("late").distinct())
        out = gone if out is None else out.unionByName(gone)
        live = cut(live.join(gone, "late", "left_anti").join(gone.select(F.col("late").alias("early")), "early", "left_anti"))
    return (live.select("late") if out is None else out).withColumnRenamed("late", "place")


def fuzzy_dedup(df: DataFrame, percent: int = 90, key: str = "media_id", title: str = "title", score: str = "score") -> DataFrame:
    """Rows that the greedy rule keeps: in order of score (null last) and key, each removes later rows whose lower-cased
    title has the ratio. Rows without a title are kept."""
    named = df.where(F.col(title).isNotNull()).withColumn("_t", F.lower(title))
    rank = F.struct(F.col(score).isNull(), -F.col(score), F.col(key))
    # of equal titles the first in order stands for all: it removes the others, or is removed together with them
    heads = named.groupBy("_t").agg(F.min(rank).alias("rank"), F.min_by(F.col(key), rank).alias("place_key"))
    pairs = title_pairs(heads.select(F.col("_t").alias("title")).where("_t <> ''"), percent)
    heads = cut(heads.select("_t", F.struct("rank", "place_key").alias("place"), "place_key"))
    a = heads.select(F.col("_t").alias("a"), F.col("place").alias("pa"))
    b = heads.select(F.col("_t").alias("b"), F.col("place").alias("pb"))
    edges = pairs.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    kept = heads.join(excluded(edges), "place", "left_anti").select(F.col("place_key").alias("_kept"))
    rest = named.where("_t <> ''").join(kept, F.col(key) == F.col("_kept"), "left_semi").select(*df.columns)
    return rest.unionByName(df.where(F.col(title).isNull() | (F.lower(title) == "")))


def source_priority(source: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.lower(source))
    return F.when(place > 0, place - 1).otherwise(F.lit(len(PRIORITY)))


def first_wins(source_a: Column, score_a: Column, source_b: Column, score_b: Column) -> Column:
    """Whether of two matching records the first stays: within a source, or of equal priority, the higher score does
    (a null is 0; equal scores: the first), else the source of higher priority."""
    by_score = F.coalesce(score_a, F.lit(0.0)) >= F.coalesce(score_b, F.lit(0.0))
    pa, pb = source_priority(source_a), source_priority(source_b)
    return F.when((source_a == source_b) | (pa == pb), by_score).otherwise(pa < pb)


def cross_source_pairs(df: DataFrame, threshold: float = 90, key: str = "media_id") -> DataFrame:
    """(a, b, similarity) of records of one media type whose weighted title and year similarity reaches the threshold.

    Only records of one media type meet, and by their years each pair has the title similarity that it needs (at 90: 86 of one
    year, 95 a year apart, 90 where one is unknown, none further apart). Raw and token-sorted titles are matched apart, as
    the higher of the two counts."""
    needs = {apart: least_title(threshold, apart) for apart in (0, 1, 2, None)} | {FAR: least_title(threshold, 3)}
    words = F.array_sort(F.filter(F.split(F.regexp_replace("t", "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    rows = df.where("title is not null and media_type is not null").select(F.col(key).alias("id"), F.lower("title").alias("t"), F.col("media_type").alias("kind"), F.col("_year").alias("year")).where("t <> ''")
    rows = cut(rows.withColumn("s", F.array_join(words, " ")))
    raw = title_pairs(rows.select("id", F.col("t").alias("title"), "kind", "year"), needs).select("a", "b")
    # records alike in sorted words, type and year are one of these, named by the least id
    sorted_ = cut(rows.where("s <> ''").groupBy("s", "kind", "year").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    by_words = title_pairs(sorted_.select("id", F.col("s").alias("title"), "kind", "year"), needs).select("a", "b")
    heads = sorted_.toDF("_s", "_kind", "_year", "head", "n")
    same = [rows[c].eqNullSafe(heads[f"_{c}"]) for c in ("s", "kind", "year")]
    member = cut(rows.join(heads, same[0] & same[1] & same[2]).select("head", F.col("id").alias("member"), "n"))
    x, y = (member.select(F.col("head").alias(h), F.col("member").alias(m)) for h, m in (("a", "ta"), ("b", "tb")))
    alike = member.where("n > 1")
    equal = alike.select("head", F.col("member").alias("ta")).join(alike.select("head", F.col("member").alias("tb")), "head").where("ta < tb").select("ta", "tb")
    found = by_words.join(x, "a").join(y, "b").select("ta", "tb").unionByName(equal)
    pairs = cut(raw.unionByName(found.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))).distinct())
    x = rows.select(F.col("id").alias("a"), F.col("t").alias("ta"), F.col("year").alias("ya"))
    y = rows.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.col("year").alias("yb"))
    similarity = weighted_similarity(title_similarity_udf("ta", "tb"), F.col("ya"), F.col("yb"))
    return pairs.join(x, "a").join(y, "b").withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def replay(heads: list[tuple], links: list[tuple]) -> list:
    """Keys that the sequential rule keeps. heads: (key, class, (priority, -score)) in order of key, links: pairs of classes.

    A record acts at its turn if no earlier acting record of its class or a linked one is as good; it stays if none of
    theirs that is better comes later and is still there. A record that loses to a later one goes on removing later
    ones in its turn, as the rule has it. Work and memory grow with heads times links of their class, not with pairs."""
    near: dict = {c: {c} for _, c, _ in heads}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    last = {c: (n, rank) for n, (_, c, rank) in enumerate(heads)}  # a class's best record is the last of its heads
    best: dict = {}  # of the records that have acted in the class or beside it
    kept = []
    for n, (key, c, rank) in enumerate(heads):
        if c in best and best[c] <= rank:
            continue
        for d in near[c]:
            best[d] = min(best.get(d, rank), rank)
        if not any(last[d][0] > n and last[d][1] < min(rank, best[d]) for d in near[c]):
            kept.append(key)
    return kept


#: Into so many parts a class is dealt before its heads are found.
DEALT = 64
#: Heads that one call replays, about; more where one component has more.
HEADS = 2_000


def _heads(rows: DataFrame) -> DataFrame:
    """Rows (key, class, rank) that are better than all earlier ones of their class.

    What isn't so among a part of a class isn't among all of it, so large classes are first thinned out in parts."""
    for by in (["class", F.pmod(F.xxhash64("key"), F.lit(DEALT))], ["class"]):
        before = Window.partitionBy(*by).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.min("rank").over(before)).where("before is null or rank < before").drop("before")
    return rows


def cross_source_dedup(df: DataFrame, threshold: float = 90, key: str = "media_id") -> DataFrame:
    """Rows that the cross-source rule keeps, as if each record in order of key met all later ones.

    Records alike in title, media type and year are a class: all of them match one another, and whatever matches one
    matches all, so classes are linked, never records. Which of two records stays is an order (priority of source, then
    score; the earlier of equals). Of a class without links the best stays, by an aggregate. Of a linked one only heads
    count, records better than all earlier ones of the class: any other is removed before its turn, by what is there
    when its head is or by its head. A component's heads are replayed by one call; they are few unless scores rise with keys. A
    null media type or source is 'unknown', a null score 0. Rows without title or key stay. df has key, title,
    media_type, source, score, release_date, and metadata.year if any."""
    fallback = F.col("metadata.year") if "metadata" in df.columns else F.lit(None).cast("int")
    kind = F.coalesce("media_type", F.lit("unknown"))
    titled = df.where(F.col("title").isNotNull() & (F.col("title") != "") & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.lower("title").alias("title"), kind.alias("media_type"), year_of(F.col("release_date"), fallback).alias("_year"),
        F.struct(source_priority(F.coalesce("source", F.lit("unknown"))).alias("p"), (-F.coalesce("score", F.lit(0.0))).alias("s")).alias("rank"),
    )
    alike = ["title", "media_type", "_year"]
    classes = cut(titled.groupBy(*alike).agg(F.min("key").alias("class"), F.min(F.struct("rank", "key")).alias("best")))
    links = cut(cross_source_pairs(classes, threshold, "class"))
    linked = cut(links.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    kept = classes.join(linked, "class", "left_anti").select(F.col("best.key").alias("key"))
    if not linked.isEmpty():
        # keys may be texts: components are found by hashes, and two that share one are replayed together all the same
        found = cut(connected_components(links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))))
        ends = links.join(found, F.xxhash64("a") == found["node"]).select("root", "a", "b")
        roots = linked.join(found, F.xxhash64("class") == found["node"]).select("class", "root")
        named = classes.select("class", *(F.col(c).alias(f"_{c}") for c in alike)).join(roots, "class")
        same = [titled[c].eqNullSafe(named[f"_{c}"]) for c in alike]
        members = titled.join(named, same[0] & same[1] & same[2]).select("key", "class", "rank", "root")
        nodes = cut(_heads(members).select("root", "key", "class", "rank.p", "rank.s"))

        def run(nodes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("key")
            heads = list(zip(nodes["key"], nodes["class"], zip(nodes["p"], nodes["s"], strict=True), strict=True))
            return pd.DataFrame({"key": replay(heads, list(zip(ends["a"], ends["b"], strict=True)))}, dtype=nodes["key"].dtype)

        # components don't meet, so several go to one call; by their bytes, which are few, Spark would put all calls into one task
        calls = min(nodes.count() // HEADS + 1, PARTITIONS)
        deal = F.pmod(F.xxhash64("root"), F.lit(calls)).alias("deal")
        nodes, ends = (x.select("*", deal).toDF(*x.columns, "deal").repartition(calls, "deal").groupBy("deal") for x in (nodes, ends))  # both have columns of the same tables
        kept = kept.unionByName(nodes.cogroup(ends).applyInPandas(run, f"key {df.schema[key].dataType.simpleString()}"))
    gone = titled.select("key").join(kept, "key", "left_anti").select(F.col("key").alias("__gone"))
    return df.join(gone, df[key] == gone["__gone"], "left_anti")


def merge_datasets(df: DataFrame, percent: int = 90, threshold: float = 90) -> DataFrame:
    """First row of each id, fuzzy titles, cross-source matches, then the merge order."""
    from .ranking import merge_order

    unique = first_by(df, ["media_id"], [F.desc_nulls_last("score"), F.asc("title")])
    kept = cross_source_dedup(cut(fuzzy_dedup(cut(unique), percent)), threshold)
    return merge_order(kept)


def merge_stats(df: DataFrame) -> DataFrame:
    """(media_type, records, with_synopsis, with_score, mean_score)."""
    return df.groupBy("media_type").agg(
        F.count("*").alias("records"), F.count("synopsis").alias("with_synopsis"), F.count("score").alias("with_score"), F.round(F.avg("score"), 4).alias("mean_score")
    )
