"""N-gram Jaccard self-join by a token-group matrix, exact for every pair of different texts.

Sets. A text's words are the runs of WORD in the text with A-Z lower-cased; its set holds the 64-bit hashes of its
five-word shingles, or of the whole sequence if it has fewer words. Equal sets (by a 64-bit hash of the set) are one
class and are joined once, however many copies there are.

Tokens. A sketch of fixed size (2**20 counters, summed over all tasks) counts every token of every text. Tokens in
counters far above the mean are frequent. Only the order in which a set's tokens are tried depends on the sketch.

Matrix. If two sets reach the threshold, the first n - ceil(t n) + 1 tokens of each, in one global order (rare before
frequent, then by hash), have a token in common. So the matrix of tokens and groups needs these tokens alone, and
tokens of one class alone drop out of it.

Groups. Each class joins the group of the most central class among those it shares tokens with (a group of over
GROUP members is dealt into several), and is verified against that class. Links found so make components.

Queries. A class queries a group if they share a matrix token, a member is of a larger component than its own, and
sizes allow it. A set's row of the matrix is stored as a signature of BITS bits by its size, a group's as the union of its members':
each bit of a query that the union lacks is a token that no member has. A group whose union leaves room for the
threshold is opened, its members are bounded by their own signatures, and what is left is verified with whole sets:
of a query's pairs with one component the likeliest first, the rest only where that has not joined the two. Pairs within a component need no verification, so a group of near copies costs a star and not its square."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.components import connected_components
from spindrift.workers import tidy

from .common import bitmap, cut, only, slot_of, text_hash, without

WORDS, PERCENT = 5, 80
#: Counters of the sketch, and blocks that it is summed in.
CELLS, BLOCKS = 1 << 20, 64
#: Members of a group, and queries that are held against it in one task.
GROUP, QUERIES = 256, 512
#: Least and most bits of a set's signature, its row of the token-group matrix; between them, four a token or more.
BITS = (1 << 9, 1 << 18)
#: Texts that a worker is sent at once.
LONG_ROWS = 2_000
_MUL = (np.array([3, 5, 7, 11, 13, 17, 19, 23], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, changed in place so that each bit depends on all."""
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _odd(n: int, seed: int) -> np.ndarray:
    """n odd numbers that look like random ones, always the same."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return _mixed(_mixed(x)) | np.uint64(1)


#: Whether a byte is between words, and a number for it in a word: A-Z as a-z. Numbers of places in a word.
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE, _PLACES = _odd(256, 1), _odd(256, 2)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_GAP] = 0


def _hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, all at once: the sum over its bytes of the byte's number times the place's, mixed."""
    codes = np.frombuffer(text, np.uint8)
    word = ~_GAP[codes]
    starts = np.flatnonzero(np.diff(word, prepend=False) & word)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = np.diff(starts, append=len(codes))
    place = np.arange(starts[0], len(codes)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    places = _PLACES if longest <= len(_PLACES) else _odd(longest, 2)
    return _mixed(np.add.reduceat(_BYTE[codes[starts[0] :]] * places[place], starts - starts[0]))


class Shingler:
    """Texts to sorted arrays of shingle hashes."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words

    def __call__(self, text: bytes | None) -> np.ndarray:
        h = _hashes(text or b"")
        if len(h) < self.words:
            # bytes.split() takes the six separators of WORD and no others; bytes.lower() lowers A-Z alone
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()), 7)] if len(h) else [], np.uint64)
        n = len(h) - self.words + 1
        s = h[:n] * _MUL[0]
        for k in range(1, self.words):
            s += h[k : k + n] * _MUL[k]
        s = _mixed(s)
        s.sort()
        return s[np.diff(s, prepend=~s[:1]) != 0]


def _key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _signature(tokens: np.ndarray) -> bytes:
    size = min(BITS[1], max(BITS[0], 1 << (4 * len(tokens) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(tokens >> np.uint64(40)).astype(np.int64) & (size - 1)] = 1
    return np.packbits(bits).tobytes()


def _folded(sign: np.ndarray, words: int) -> np.ndarray:
    """A signature, or several in rows, of fewer words: a bit of the result is set if any that falls on it is."""
    return sign if sign.shape[-1] == words else np.bitwise_or.reduce(sign.reshape(*sign.shape[:-1], -1, words), axis=-2)


def _most(a: np.ndarray, n, b: np.ndarray, m) -> np.ndarray:
    """The largest overlap that two sets, of n and m tokens, can have by their signatures: a bit of one that the other
    lacks is a token that it lacks. b and m may be several."""
    words = min(a.shape[-1], b.shape[-1])
    a, b = _folded(a, words), _folded(b, words)
    return np.minimum(n - np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64), m - np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64))


def _least(n, percent: int):
    """The smallest overlap that a set of n tokens can have with a set it links to."""
    return -(-n * percent // 100)


def _count(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, cells, task = Shingler(words), np.zeros(CELLS, np.int64), 0
        for batch in batches:
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            if any(map(len, sets)):
                tokens = np.concatenate(sets)
                cells += np.bincount((tokens >> np.uint64(24)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
                task = int(tokens[0] >> np.uint64(1))
            none = [None] * len(sets)
            signs = [_signature(s) if len(s) else None for s in sets]
            yield _rows(batch.column(0).to_pylist(), [len(s) for s in sets], [_key(s) for s in sets], signs, none, none, none)
        blocks = np.minimum(cells, 0xFFFF).astype("<u2").reshape(BLOCKS, -1)
        used = [k for k in range(BLOCKS) if blocks[k].any()]
        none = [None] * len(used)
        yield _rows(none, none, none, none, used, [task % 16] * len(used), [zlib.compress(blocks[k].tobytes(), 1) for k in used])

    return run


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("sign", pa.binary()), ("block", pa.int32()), ("salt", pa.int32()), ("cells", pa.binary())])


def _rows(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED, strict=True)], schema=_COUNTED)


def _sum_cells(kind: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // BLOCKS, np.int64)
        for c in group["cells"]:
            total += np.frombuffer(zlib.decompress(c), kind)
        return pd.DataFrame({"block": group["block"].iloc[:1], "cells": [zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)]})

    return run


def _frequent(counted: DataFrame) -> np.ndarray:
    """Which counters of the sketch are far above the mean. What comes to the driver is the sketch: 4 MB, whatever the input."""
    some = counted.where("block is not null").select("block", "salt", "cells")
    once = some.groupBy("block", "salt").applyInPandas(_sum_cells("<u2"), "block int, cells binary")
    cells = np.zeros((BLOCKS, CELLS // BLOCKS), np.int64)
    for k, c in once.groupBy("block").applyInPandas(_sum_cells("<u4"), "block int, cells binary").collect():
        cells[k] = np.frombuffer(zlib.decompress(c), "<u4")
    mean = cells.mean()
    return cells.ravel() > mean + max(24, 6 * mean**0.5)


def _prefixes(words: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, often = Shingler(words), set(), np.unpackbits(np.frombuffer(frequent.value, np.uint8)).astype(bool)
        for batch in batches:
            tokens, keys, sizes = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingle(text)
                key = _key(s)
                if not len(s) or key in seen:  # copies are one class; those of other tasks meet in the next step
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                f = often[(s >> np.uint64(24)).astype(np.int64) & (CELLS - 1)]
                take = len(s) - _least(len(s), percent) + 1
                p = s[~f][:take]
                if len(p) < take:
                    p = np.concatenate([p, s[f][: take - len(p)]])
                tokens.append(p)
                keys.append(key)
                sizes.append(len(s))
            if tokens:
                n = [len(p) for p in tokens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), n)), pa.array(np.repeat(np.array(sizes, np.int64), n))],
                    names=["token", "key", "n"],
                )

    return run


def _sets(words: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, bits = Shingler(words), np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7)) & 1 > 0))
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 256):
                sets = [shingle(t) for t in texts[at : at + 256]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + 256], pa.int64()), pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "key", "tokens"],
                )

    return run


def _may_link(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs (a, b, n, m, sign, other) whose signatures leave room for the threshold."""
        for p in batches:
            most = np.array([int(_most(np.frombuffer(x, np.uint64), n, np.frombuffer(y, np.uint64), m)) for x, n, y, m in zip(p["sign"], p["n"], p["other"], p["m"], strict=True)], np.int64)
            yield p.loc[100 * most >= percent * (p["n"].to_numpy() + p["m"].to_numpy() - most), ["a", "b"]]

    return run


def _open(percent: int):
    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Pairs of members and queries of the same groups that neither the group's bound nor their own excludes."""
        names = ["a", "b", "root_a", "root_b", "room"]
        none = pd.DataFrame({c: pd.Series([], dtype="float64" if c == "room" else "int64") for c in names})
        if not len(members) or not len(queries):
            return none
        by = ["home", "part", "lot"]
        members, queries = (x.drop_duplicates([*by, "key"]) for x in (members, queries))
        # within a group, members of one signature size; sets that can link have sizes of signature one step apart at most
        shelves: dict[tuple, dict[int, list]] = {}
        for row in members[[*by, "key", "n", "root", "weight", "sign"]].itertuples(index=False):
            shelves.setdefault(row[:3], {}).setdefault(len(row[7]) // 8, []).append(row[3:])
        held = {}
        for group, shelf in shelves.items():
            for words, rows in shelf.items():
                signs = np.stack([np.frombuffer(r[4], np.uint64) for r in rows])
                held.setdefault(group, {})[words] = (*(np.array([r[k] for r in rows], np.int64) for k in range(4)), signs, np.bitwise_or.reduce(signs, axis=0))
        found = []
        for home, part, lot, key, n, root, weight, sign in queries[[*by, "key", "n", "root", "weight", "sign"]].itertuples(index=False):
            q = np.frombuffer(sign, np.uint64)
            for words, (keys, sizes, roots, weights, signs, union) in held.get((home, part, lot), {}).items():
                least = min(words, len(q))
                lacking = int(np.bitwise_count(_folded(q, least) & ~_folded(union, least)).sum())
                if n - lacking < _least(n, percent):  # not even the union has enough of the query
                    continue
                most = _most(q, n, signs, sizes)
                fits = 100 * most >= percent * (n + sizes - most)
                fits &= (weights > weight) | ((weights == weight) & (roots > root))
                if fits.any():
                    found.append(pd.DataFrame({"a": key, "b": keys[fits], "root_a": root, "root_b": roots[fits], "room": most[fits] / (n + sizes[fits] - most[fits])}))
        return pd.concat(found)[names] if found else none

    return run


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, n_shingles, component_id), a row for each row of docs.

    Two rows link when 100 * |A ∩ B| >= percent * |A ∪ B| for their shingle sets; component_id is the smallest
    doc_id that links reach. A row without words or text (null, empty, blank) has n_shingles 0 and is linked with
    nothing: its component_id is its doc_id. Repeated rows are copies of one another. A null doc_id stays null and
    is never a component's id unless no member has one. Columns besides doc_id and text are not read."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = cut(docs.mapInArrow(tidy(_count(words)), "doc_id long, n long, key long, sign binary, block int, salt int, cells binary"), LONG_ROWS)
    meta = counted.where("block is null").select("doc_id", "n", "key")
    frequent = spark.sparkContext.broadcast(np.packbits(_frequent(counted)).tobytes())

    # the matrix's tokens: those that two classes, of sizes that can link, have among their first
    rows = docs.select("text").mapInArrow(tidy(_prefixes(words, percent, frequent)), "token long, key long, n long")
    rows = rows.repartition("token").dropDuplicates(["token", "key"])
    # of a token's classes by size, each is kept if the next smaller or larger one is near enough in size to link
    sized = Window.partitionBy("token").orderBy("n")
    rows = rows.withColumns({"less": F.lag("n").over(sized), "more": F.lead("n").over(sized)})
    rows = cut(rows.where(f"100 * less >= {percent} * n or 100 * n >= {percent} * more").select("token", "key", "n"), LONG_ROWS)
    degree = rows.groupBy("key").agg(F.count("*").alias("degree"))
    centre = F.max_by(F.struct("degree", "key", "n"), F.struct("degree", "key"))
    rows = rows.join(degree, "key")
    heads = rows.groupBy("token").agg(centre.alias("head"))
    shared = cut(rows.join(heads, "token").select("token", "key", "n", "head"))
    stars = shared.select("key", "n", F.col("head.key").alias("head"), F.col("head.n").alias("m")).where("key <> head").distinct()
    stars = stars.where(f"100 * least(n, m) >= {percent} * greatest(n, m)")

    # one row of each class has its set; signatures of the classes in the matrix
    firsts = meta.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    within = shared.select("key").distinct()
    signs = counted.where("block is null and n > 0").select("key", "sign").join(within, "key", "left_semi")
    signs = cut(signs.groupBy("key").agg(F.first("sign").alias("sign")))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets."""
        ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        bits = spark.sparkContext.broadcast(bitmap(firsts.join(ends, "key", "left_semi"), "first"))
        sets = docs.select("doc_id", "text", slot_of("doc_id").alias("slot")).mapInArrow(tidy(_sets(words, bits)), "doc_id long, key long, tokens array<long>")
        # a hash that only shares its bit with a wanted one adds a set that no pair asks for, or a second one of a class
        sets = cut(sets.select("key", "tokens").repartition("key"), LONG_ROWS)
        mine, others = sets.withColumnsRenamed({"key": "a"}), sets.select(F.col("key").alias("b"), F.col("tokens").alias("others"))
        common = F.size(F.array_intersect("tokens", "others"))
        near = 100 * common >= percent * (F.size("tokens") + F.size("others") - common)
        return pairs.join(mine, "a").join(others, "b").where(near).select("a", "b").distinct()

    other = signs.select(F.col("key").alias("b"), F.col("sign").alias("other"))
    stars = stars.select(F.col("key").alias("a"), F.col("head").alias("b"), "n", "m").join(signs.withColumnRenamed("key", "a"), "a").join(other, "b")
    links = cut(verified(cut(stars.mapInPandas(tidy(_may_link(percent)), "a long, b long"))))
    roots = cut(connected_components(links))

    # groups, and the queries that the first links leave open
    home = shared.groupBy("key").agg(F.max(F.struct("head.degree", "head.key")).alias("home"), F.first("n").alias("n"))
    home = home.select("key", "n", F.col("home.key").alias("home"))
    parts = home.groupBy("home").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    weights = roots.groupBy("root").agg(F.count("*").alias("weight"))
    ranked = roots.join(weights, "root").select(F.col("node").alias("key"), "root", "weight")
    classes = home.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).join(ranked, "key", "left")
    classes = cut(classes.select("key", "n", "home", "part", F.coalesce("root", "key").alias("root"), F.coalesce("weight", F.lit(1)).alias("weight")))
    cells = shared.select("token", "key").join(classes, "key").withColumn("rank", F.struct("weight", "root"))
    groups = cells.groupBy("token", "home", "part").agg(F.max("rank").alias("top"), F.min("n").alias("low"), F.max("n").alias("high"))
    asked = cells.select("token", "key", "n", "root", "weight", "rank").join(groups, "token").where("top > rank")
    asked = asked.where(f"100 * n >= {percent} * low and 100 * high >= {percent} * n").select("key", "home", "part", "n", "root", "weight").distinct()
    asked = cut(asked)
    lots = asked.groupBy("home", "part").agg(F.ceil(F.count("*") / QUERIES).alias("lots"))
    queries = asked.join(lots, ["home", "part"]).withColumn("lot", F.pmod(F.xxhash64("key"), F.col("lots"))).join(signs, "key")
    members = classes.join(lots, ["home", "part"]).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).join(signs, "key")
    deal = F.pmod(F.xxhash64("home", "part", "lot"), F.lit(asked.count() // 2_000 + 1)).alias("deal")  # several groups go to one call
    members, queries = (x.select("*", deal).toDF(*x.columns, "deal") for x in (members, queries))
    opened = members.groupBy("deal").cogroup(queries.groupBy("deal")).applyInPandas(_open(percent), "a long, b long, root_a long, root_b long, room double")
    opened = cut(opened)
    # of a query's pairs with one component the likeliest goes first; the others only if the two are still apart
    likeliest = Window.partitionBy("a", "root_b").orderBy(F.desc("room"), "b")
    opened = cut(opened.withColumn("place", F.row_number().over(likeliest)))
    links = cut(links.unionByName(verified(opened.where("place = 1").select("a", "b"))))
    later = opened.where("place > 1")
    if not later.isEmpty():
        now = cut(connected_components(links))
        mine, others = now.select(F.col("node").alias("a"), F.col("root").alias("now_a")), now.select(F.col("node").alias("b"), F.col("root").alias("now_b"))
        apart = later.join(mine, "a", "left").join(others, "b", "left").where(~F.coalesce(F.col("now_a") == F.col("now_b"), F.lit(False)))
        links = cut(links.unionByName(verified(cut(apart.select("a", "b")))))
    roots = cut(connected_components(links))
    ids = roots.join(firsts, roots["node"] == firsts["key"]).select("node", "root", "first")
    least = ids.groupBy("root").agg(F.min("first").alias("least"))
    joined = ids.join(least, "root").select(F.col("node").alias("key"), "least")
    named = firsts.join(joined, "key", "left").select("key", F.coalesce("least", "first").alias("component"))
    out = meta.where("n > 0").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(meta.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id (null last), whole and with all its columns.

    Rows are told apart by doc_id and text, so null and repeated doc_ids don't matter; of rows that are equal in both
    one stays. A row without words stays, however often it is there."""
    row = F.xxhash64("doc_id", "text")
    found = jaccard_components(docs.select(row.alias("doc_id"), "text"), words, percent).where("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct()
    rows = docs.select("doc_id", text_hash().alias("hash"), row.alias("row")).groupBy("doc_id", "hash", "row").agg(F.count("*").alias("times"))
    rows = cut(rows.join(found, "row"))
    heads = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("head"))
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("hash") == F.col("head.hash"))
    rows = cut(rows.join(heads, "component").select("doc_id", "hash", "times", stays.alias("stays")))
    again = rows.where("stays and times > 1")
    if again.isEmpty():
        return without(docs, rows.where("not stays"))
    once = only(docs, again).withColumn("__sp_hash", text_hash()).dropDuplicates(["doc_id", "__sp_hash"]).drop("__sp_hash")
    return without(docs, rows.where("not stays or times > 1")).unionByName(once)
