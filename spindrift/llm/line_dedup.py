"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

Lines are what \\n splits; a line without a word (blank: of the six separators of WORD alone) takes no part. Equal lines
are one class by a 64-bit hash. A class's set holds its shingles of SHINGLE code points (the whole line, if shorter).
BANDS bands of ROWS minima each make candidates. In a band's bucket every line is first held against the least class and
the one before it in order; where that leaves a bucket in several components, all lines but those of the largest are then held
against all of the bucket, in blocks of about BLOCK lines. So any two lines that share a band are compared, or joined
already. At a similarity of 0.8 two lines share no band once in 540 times, at 0.9 once in 10**5. Candidates are verified
by whole sets; of each component the line that comes first, by doc_id and place, stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.components import connected_components
from spindrift.workers import tidy

from .common import BROADCAST_IDS, cut, let

SHINGLE, PERCENT, BANDS, ROWS = 7, 80, 12, 4
#: Texts that a worker is sent at once.
LONG_ROWS = 1_000
#: Lines of a block, about, and what a line may be made of without having a word.
BLOCK, BLANK = 512, " \t\n\x0b\x0c\r"
#: Characters of a block's lines whose sets are kept (some 100 bytes each).
SETS = 400_000
_ODD = np.random.default_rng(11).integers(1 << 20, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = np.random.default_rng(12).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_POWER = np.array([pow(0x01000193, k, 1 << 32) for k in range(64)], np.uint64).astype(np.uint32)


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All lines' shingle hashes one after another, and where each line's begin."""
    padded = [x if len(x) >= k else x + "\0" * (k - len(x)) for x in lines]
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(c) - k + 1, np.uint32)
    for j in range(k):
        h += c[j : len(c) - k + 1 + j] * _POWER[k - j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(sizes)
    valid = np.ones(len(c), bool)  # not those that begin in one line and end in the next
    for j in range(1, k):
        valid[ends - j] = False
    counts = sizes - (k - 1)
    return h[valid[: len(h)]], np.concatenate([[0], np.cumsum(counts)[:-1]])


def bands(lines: list[str]) -> np.ndarray:
    """A row of BANDS 64-bit band hashes for each line."""
    h, starts = shingle_hashes(lines)
    low = np.empty((len(lines), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        low[:, k] = np.minimum.reduceat(h * _ODD[k] + _ADD[k], starts)
    out = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        out = (out ^ low[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return (out * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        docs, no, hashes = [], [], []
        new: list[tuple[int, str]] = []

        def flush() -> pa.RecordBatch:
            got: list = [None] * len(hashes)
            for a in range(0, len(new), 512):  # small enough for the processor's caches
                some = new[a : a + 512]
                for (k, _), row in zip(some, bands([x for _, x in some]), strict=True):
                    got[k] = row
            take = pa.array(docs, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(no, pa.int32()), pa.array(hashes, pa.int64()), pa.array(got, pa.list_(pa.int64()))],
                names=["doc_id", "hash", "no", "line", "bands"],
            )

        size = 0
        for k, text in enumerate(batch.column(2)):
            for i, line in enumerate((text.as_py() or "").split("\n")):
                if not line.strip(BLANK):
                    continue
                h = _line_hash(line)
                if h not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(h)
                    new.append((len(hashes), line))
                docs.append(k)
                no.append(i)
                hashes.append(h)
                size += len(line)
            if size > 4_000_000:
                yield flush()
                docs, no, hashes, new, size = [], [], [], [], 0
        if hashes:
            yield flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, line) in order to (band, line, low, before) of the bands of several lines, each line once; low is the
    band's least line, before the one before (a band's first line has itself).

    Nothing is held between batches but a band's least line, its last, and whether the first has gone out."""
    at, low, last, waits = None, 0, 0, False
    for batch in batches:
        if not len(batch):
            continue
        band, line = (np.asarray(batch.column(k)) for k in (0, 1))
        again = np.concatenate([[band[0] == at and line[0] == last], (band[1:] == band[:-1]) & (line[1:] == line[:-1])])
        band, line = band[~again], line[~again]
        if not len(band):
            continue
        first = np.concatenate([[band[0] != at], band[1:] != band[:-1]])
        heads, group = np.flatnonzero(first), np.cumsum(first) - 1
        lows = np.where(group >= 0, line[heads[np.maximum(group, 0)]] if len(heads) else low, low)
        before = np.where(first, line, np.concatenate([[last], line[:-1]]))
        goes = ~first
        goes[:-1] |= first[:-1] & ~first[1:]
        out = [x[goes] for x in (band, line, lows, before)]
        if waits and not first[0]:
            out = [np.concatenate([[x], y]) for x, y in zip((at, low, low, low), out, strict=True)]
        waits = bool(first[-1])  # else the band's first line has gone out, with this batch or before
        at, low, last = band[-1], lows[-1], line[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["band", "line", "low", "before"])


def _texts(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            found: list[tuple[int, str]] = []
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if line.strip(BLANK):
                        h = _line_hash(line)
                        slot = (h & (2**64 - 1)) >> 41  # the bit of a line's own hash
                        if bits[slot >> 3] >> (slot & 7) & 1 and h not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(h)
                            found.append((h, line))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], names=["line", "text"])

    return run


def line_shingles(line: str, k: int = SHINGLE) -> set[str]:
    return {line[i : i + k] for i in range(len(line) - k + 1)} if len(line) >= k else {line}


def _similar(a: set[str], b: set[str]) -> bool:
    common = len(a & b)
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _off(both):
    """How far a count of common hashes may be off for two sets of so many shingles together, as unlike ones may share a hash."""
    return 2 + both * both / (1 << 28)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b, text, other) that are similar, by whole sets. Counts of common hashes tell first which can't be."""
    for batch in batches:
        texts = list({*batch["text"], *batch["other"]})
        place = dict(zip(texts, range(len(texts)), strict=True))
        h, starts = shingle_hashes(texts)
        owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(np.append(starts, len(h))))
        keys = owner << np.uint64(32) | h
        keys.sort()
        keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
        ends = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
        hashes, near, last, held = keys.astype(np.uint32), [], None, set()
        for x, y in zip(batch["text"], batch["other"], strict=True):
            i, j = place[x], place[y]
            a, b = hashes[ends[i] : ends[i + 1]], hashes[ends[j] : ends[j + 1]]
            both = len(a) + len(b)
            common = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
            slack = _off(both)
            if 100 * (common + slack) < PERCENT * (both - common - slack):
                near.append(False)
                continue
            if y != last:  # pairs mostly come by their second line
                last, held = y, line_shingles(y)
            near.append(_similar(line_shingles(x), held))
        yield batch.loc[near, ["a", "b"]]


def _apart(block: pd.DataFrame) -> pd.DataFrame:
    """Similar lines (a, b) of a part of a bucket, besides those that roots and the pairs before them already join.

    Rows with `odd` are held against those without. Common shingles are counted by hash for all pairs at once, over the
    shingles of odd lines that another has too; what comes near the threshold is verified by whole sets."""
    texts = block["text"].tolist()
    h, starts = shingle_hashes(texts)
    odd = block["odd"].to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(h))))
    keys = h.astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64)
    keys.sort()
    keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
    owner, names = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), keys >> np.uint64(32)
    sizes = np.bincount(owner, minlength=len(texts))
    column = np.cumsum(np.diff(names, prepend=names[:1]) != 0)  # keys are in order of names
    shared = (np.bincount(column, odd[owner]) > 0) & (np.bincount(column) > 1)
    place = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], place[column[shared[column]]]
    left, right = np.flatnonzero(odd), np.flatnonzero(~odd)
    common = np.zeros((len(left), len(right)), np.float32)
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + 4096, 4096))
    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        has = np.zeros((len(texts), 4096), np.float32)
        has[owner[x:y], column[x:y] - 4096 * k] = 1
        common += has[left] @ has[right].T
    root = block["root"].to_numpy()
    both = sizes[left][:, None] + sizes[right][None, :]
    slack = _off(both.astype(np.float64))
    near = (100 * (common + slack) >= PERCENT * (both - common - slack)) & (root[left][:, None] != root[right][None, :])
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            r = up
        return r

    held: dict[int, set[str]] = {}
    room = SETS

    def shingles(k: int) -> set[str]:
        """A line's set, kept while there is room."""
        nonlocal room
        if k in held:
            return held[k]
        if len(texts[k]) <= room:
            room -= len(texts[k])
            return held.setdefault(k, line_shingles(texts[k]))
        return line_shingles(texts[k])

    out, line, roots = [], block["line"].tolist(), root.tolist()
    for i, j in zip(*np.nonzero(near), strict=True):
        i, j = int(left[i]), int(right[j])
        ri, rj = find(roots[i]), find(roots[j])
        if ri != rj and _similar(shingles(i), shingles(j)):
            parent[max(ri, rj)] = min(ri, rj)
            out.append((line[i], line[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _rest(marks: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Similar lines (a, b) of buckets (band, line) that the roots so far leave in several components; None if there is no such bucket.

    Lines of a bucket's largest component are joined; the others, odd ones, are held against all of the bucket's lines."""
    tagged = cut(marks.join(roots, marks["line"] == roots["node"], "left").select("line", "band", F.coalesce("root", "line").alias("root")))
    groups = tagged.groupBy("band", "root").agg(F.count("*").alias("c"))
    split = groups.groupBy("band").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("n")).where("main.c < n and n > 3")  # of up to three lines, all have met
    split = split.select("band", F.col("main.root").alias("main"), "n", (F.col("n") - F.col("main.c")).alias("odds"))
    left = cut(tagged.join(split, "band"))
    if left.isEmpty():
        return None
    # lines often meet in many bands: buckets of one largest component are compared together, where that is less work
    lines = left.select("main", "line", "root").distinct().groupBy("main").agg(F.count("*").alias("all"), F.count_if(F.col("root") != F.col("main")).alias("all_odds"))
    work = split.groupBy("main").agg(F.sum(F.col("n") * F.col("odds")).alias("work"))
    joint = lines.join(work, "main").where("all * all_odds <= work").select("main", "all", "all_odds")
    left = left.join(joint, "main", "left").withColumn("together", F.col("all").isNotNull())
    parts = {"blocks": F.ceil(F.coalesce("all", "n") / BLOCK), "odds": F.ceil(F.coalesce("all_odds", "odds") / BLOCK), "key": F.when(F.col("together"), F.col("main")).otherwise(F.col("band"))}
    left = left.withColumns(parts).select("line", "root", "main", "together", "key", "blocks", "odds").distinct()
    zero = F.lit(0).cast("long")
    names = ["line", "root", "together", "key"]
    whole = left.select(*names, F.pmod(F.xxhash64("line"), "blocks").alias("i"), F.explode(F.sequence(zero, F.col("odds") - 1)).alias("j"), F.lit(False).alias("odd"))
    odd = left.where("root <> main").select(*names, F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("line", F.lit(1)), "odds").alias("j"), F.lit(True).alias("odd"))
    # most blocks are small, so several go to one call
    by = ["together", "key", "i", "j"]
    dealt = whole.unionByName(odd).withColumn("deal", F.pmod(F.xxhash64(*by), F.lit(left.count() // BLOCK + 1)))

    def several(blocks: pd.DataFrame) -> pd.DataFrame:
        found = [_apart(block) for _, block in blocks.groupby(by, sort=False)]
        return pd.concat(found)

    return dealt.join(texts, "line").groupBy("deal").applyInPandas(several, "a long, b long")


def dropped_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, ...) to the lines that go, as (doc_id, hash, gone ARRAY<INT>), and all lines (doc_id, hash, no, line).

    hash is xxhash64 of the text, which tells rows of one doc_id apart; gone has places among the text's lines, from 0."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text"))
    lines = cut(rows.mapInArrow(tidy(_occurrences), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash long, no int, line long, bands array<long>"), LONG_ROWS)
    marks = lines.where("bands is not null").select(F.explode("bands").alias("band"), "line").repartition("band").sortWithinPartitions("band", "line")
    marks = cut(marks.mapInArrow(tidy(_shared), "band long, line long, low long, before long"))
    pairs = cut(marks.where("low <> line").select(F.explode(F.array_distinct(F.array("low", "before"))).alias("b"), F.col("line").alias("a")).distinct())
    wanted = spark.sparkContext.broadcast(_own_bitmap(marks.select("line")))
    texts = cut(docs.select(F.col("text").cast("string")).mapInArrow(tidy(_texts(wanted)), "line long, text string").dropDuplicates(["line"]), LONG_ROWS)
    held = pairs.join(texts.withColumnRenamed("line", "a"), "a").join(texts.select(F.col("line").alias("b"), F.col("text").alias("other")), "b")
    near = cut(held.mapInPandas(tidy(_verify), "a long, b long"), LONG_ROWS)
    roots = cut(connected_components(near))
    if (rest := _rest(marks.select("line", "band"), roots, texts)) is not None:
        roots = cut(connected_components(near.unionByName(rest)))

    # the lines that occur again, exactly or nearly; all others stay
    again = lines.groupBy("line").agg(F.count("*").alias("times")).where("times > 1").join(roots, F.col("line") == roots["node"], "left_anti")
    wanted = roots.select(F.col("node").alias("line"), "root").unionByName(again.select("line", F.col("line").alias("root")))
    place = F.struct("doc_id", "hash", "no")
    members = cut(lines.select("doc_id", "hash", "no", "line").join(wanted, "line").select("root", place.alias("place")))
    heads = members.groupBy("root").agg(F.min("place").alias("head"))
    gone = members.join(heads, "root").where(~F.col("place").eqNullSafe(F.col("head"))).select("place.*")
    return gone.groupBy("doc_id", "hash").agg(F.collect_set("no").alias("gone")), lines


def _own_bitmap(lines: DataFrame, bits: int = 23) -> bytes:
    """As common.bitmap, of the hashes themselves."""
    slot = F.shiftrightunsigned("line", 64 - bits)
    out = bytearray(1 << (bits - 3))
    words = lines.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
    for w, b in words.collect():
        out[w * 8 : w * 8 + 8] = (b & (2**64 - 1)).to_bytes(8, "little")
    return bytes(out)


def dedup_lines(docs: DataFrame, into: str = "n_dropped") -> DataFrame:
    """docs with text without the lines that repeat, exactly or nearly, an earlier one, and with their number in `into`.

    Earlier is by doc_id (null first), then place. Blank lines stay. Every row stays, with all its columns: a text
    whose lines have all gone is empty, a null text stays null. Rows that repeat both doc_id and text count as one
    and are treated alike. docs may have other columns, of any names but `into` and those that begin with __sp_."""
    gone = cut(dropped_lines(docs)[0])
    gone = gone.select(F.col("doc_id").alias("__sp_id"), F.col("hash").alias("__sp_h"), F.col("gone").alias("__sp_gone"))
    keyed = docs.withColumn("__sp_hash", F.xxhash64("text"))
    ids = gone.select("__sp_id", "__sp_h")

    def same(other: DataFrame) -> Column:
        return keyed["doc_id"].eqNullSafe(other["__sp_id"]) & (keyed["__sp_hash"] == other["__sp_h"])

    if gone.count() <= BROADCAST_IDS:  # the ids alone go everywhere, and only texts that lose lines move
        whole = keyed.join(F.broadcast(ids), same(ids), "left_anti").withColumn("__sp_gone", F.lit(None).cast("array<int>"))
        keyed = keyed.join(F.broadcast(ids), same(ids), "left_semi")
        joined = keyed.join(gone, same(gone)).select(*whole.columns).unionByName(whole)
    else:
        joined = keyed.join(gone, same(gone), "left")
    # places are told apart by hashing, so that a text of many lines that all go takes time by their number
    left = let(F.split("text", "\n", -1), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__sp_gone"), lambda i: F.get(lines, i)))
    text = F.when(F.col("__sp_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumns({"text": text, into: F.coalesce(F.size("__sp_gone"), F.lit(0))}).select(*docs.columns, into)


def keep_lines(docs: DataFrame) -> DataFrame:
    """docs after dedup_lines(), with their own columns; n_chars follows. A row goes if lines were dropped and no word is left."""
    out = dedup_lines(docs, "__sp_dropped").where((F.col("__sp_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__sp_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
