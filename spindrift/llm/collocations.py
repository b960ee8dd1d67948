"""Phrase collocation mining: contiguous pattern growth by projected occurrence pointers.

A slice of the corpus (some SLICE words) numbers its own words; what comes out is its dictionary, in parts by a hash of the
words, and its texts as numbers. A part's task sums up its words' counts by language and numbers the frequent ones for all
slices. A slice then gets the ids of its frequent words (all that a frequent
phrase can be made of) and projects: each occurrence of a frequent word, with the four words after it up to the end of its
piece, is a pointer of that prefix. A prefix's pointers go to one task, with those of other prefixes of its bucket; there
a phrase grows to the right, depth first: its pointers are sorted by the next word, and runs of LEAST or more are the next
phrases. Prefixes with over HOT occurrences would outgrow a task: a slice counts their phrases itself, and the counts are
dealt to the buckets by the whole phrase and summed up there, so no task gets such a prefix whole.

A cut's parts of a candidate are candidates or words themselves, so scores are joins of frequent phrases alone. A phrase is
dropped by a phrase one word longer, if by any: what lies between has no lower count. Sums are longs, products decimals
of 38 digits.

Rows: a null text is empty, a null lang `und`; texts without words give nothing; repeated rows count each. doc_id and all
other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.workers import release, tidy

from .common import cut

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2_000, 100
#: Words of a slice, bytes of text that are split at once, and pointers of a bucket, about (20 bytes each).
SLICE, CHUNK, BUCKET = 8_000_000, 4_000_000, 2_000_000
#: Occurrences of a prefix that one task takes at most.
HOT = 4_000_000
#: What ends a piece, and the byte (in no UTF-8 text) that stands for it.
ENDS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
_TABLE = bytes.maketrans(ENDS + b"\t", END * len(ENDS) + b" ")
#: Characters of texts for each part of the dictionaries, about; a slice has as many words of its own.
PART = 40_000_000
_NUMBERED = "slice long, lang string, part int, ids array<int>, words array<string>, n array<long>, codes binary"
_INTS = pa.list_(pa.int32())
_KNOWN_ROWS = pa.schema(
    [("slice", pa.int64()), ("lang", pa.string()), ("ids", _INTS), ("gids", _INTS), ("hot", pa.list_(pa.bool_())), ("word", pa.string()), ("gid", pa.int32()), ("f", pa.int64()), ("total", pa.int64())]
)
_KNOWN = "slice long, lang string, ids array<int>, gids array<int>, hot array<boolean>, word string, gid int, f long, total long"


def _encoded(size: int, parts: int):
    """Texts (lang, text) to slices: rows of words (lang, part, ids, words, n) and of texts in numbers (lang, codes), where 0
    ends a piece. Numbers are a slice's and a language's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no, known, codes, waiting = TaskContext.get().partitionId(), 0, {}, [], {}

        def number(lang: str, text: bytes) -> int:
            words = text.replace(END, b" \xff ").split()
            if not words:
                return 0
            own = known.setdefault(lang, {})
            found = pa.array(words, pa.binary()).dictionary_encode()
            ids = [0 if w == END else own.setdefault(w, len(own) + 1) for w in found.dictionary.to_pylist()]
            got = np.array(ids, np.int32)[found.indices.to_numpy()]
            codes.append((lang, np.append(got, np.int32(0))))
            return int((got > 0).sum())

        def spent(lang: str) -> int:
            text, words, at = END.join(waiting.pop(lang)[0]).lower().translate(_TABLE), 0, 0
            while at < len(text):  # a long text goes in parts of whole pieces
                end = text.find(END, at + CHUNK)
                end = len(text) if end < 0 else end
                words, at = words + number(lang, text[at:end]), end + 1
            return words

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal no, known, codes
            slice_, n = (task << 32) | no, {lang: np.zeros(len(own) + 1, np.int64) for lang, own in known.items()}
            for lang, c in codes:
                n[lang] += np.bincount(c, minlength=len(n[lang]))
                yield _row(slice_, lang, codes=c.tobytes())
            for lang, own in known.items():
                words = np.array(list(own), object)
                part = np.fromiter((xxhash.xxh32_intdigest(w) % parts for w in own), np.int32, len(own))
                order = np.argsort(part, kind="stable")
                for a, b in zip(*runs(part[order]), strict=True):
                    at = order[a:b]
                    yield _row(slice_, lang, int(part[at[0]]), at + 1, words[at], n[lang][at + 1])
            no, known, codes = no + 1, {}, []

        words = held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw, lang = text.as_py(), "und" if lang is None else lang
                if not raw:
                    continue
                texts, bytes_ = waiting.get(lang, ([], 0))
                texts.append(raw)
                waiting[lang], held = (texts, bytes_ + len(raw)), held + len(raw)
                if held >= CHUNK:
                    words, held = words + sum(spent(x) for x in list(waiting)), 0
                if words >= size:
                    yield from flush()
                    words = 0
        for lang in list(waiting):
            words += spent(lang)
        if codes:
            yield from flush()

    return run


def _row(slice_: int, lang: str, part: int | None = None, ids: np.ndarray | None = None, words: np.ndarray | None = None, n: np.ndarray | None = None, codes: bytes | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([slice_], pa.int64()),
            pa.array([lang], pa.string()),
            pa.array([part], pa.int32()),
            pa.array([ids], pa.list_(pa.int32())),
            pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            pa.array([n], pa.list_(pa.int64())),
            pa.array([codes], pa.binary()),
        ],
        names=["slice", "lang", "part", "ids", "words", "n", "codes"],
    )


def _known(least: int, hot: int, parts: int):
    """A part of all dictionaries to its frequent words (lang, word, gid, f), what each slice needs of them (slice, lang, ids,
    gids, hot), and its languages' (lang, total)."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        number, schema = part["part"][0].as_py(), _KNOWN_ROWS
        words, ids, n = part["words"].combine_chunks(), part["ids"].combine_chunks(), part["n"].combine_chunks()
        langs = np.array(part["lang"].to_pylist(), object)
        ends = np.append(0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))
        out, first = [], 0
        for lang in dict.fromkeys(langs.tolist()):
            own = np.flatnonzero(langs == lang)
            found = pa.concat_arrays([words[int(k)].values for k in own]).dictionary_encode()
            f = np.zeros(len(found.dictionary), np.int64)
            np.add.at(f, found.indices.to_numpy(), np.concatenate([n[int(k)].values.to_numpy() for k in own]))
            many = np.flatnonzero(f >= least)
            gid = np.zeros(len(f), np.int32)
            gid[many] = (np.arange(first, first + len(many)) * parts + number + 1).astype(np.int32)  # 0 is no word
            first += len(many)
            out.append({"lang": [lang], "total": [int(f.sum())]})
            out.append({"lang": [lang] * len(many), "word": found.dictionary.take(pa.array(many)), "gid": gid[many], "f": f[many]})
            indices, at = found.indices.to_numpy(), 0
            for k in own:
                mine = indices[at : at + ends[k + 1] - ends[k]]
                at += len(mine)
                kept = gid[mine] > 0
                if kept.any():
                    out.append({"slice": [part["slice"][int(k)].as_py()], "lang": [lang], "ids": [ids[int(k)].values.to_numpy()[kept]], "gids": [gid[mine[kept]]], "hot": [f[mine[kept]] > hot]})
        if first * parts >= 1 << 31:
            raise ValueError("more than 2**31 frequent words")
        release()
        return pa.concat_tables(pa.table([pa.array(x[c.name], c.type) if c.name in x else pa.nulls(len(x["lang"]), c.type) for c in schema], schema=schema) for x in out)

    return run


def pointers(codes: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """A row for each occurrence of a word (not 0) that another follows: it and the next ones, 0 from the piece's end on."""
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    padded = np.append(codes, np.zeros(longest, codes.dtype))
    rows = np.empty((len(at), longest), np.int32)
    for k in range(longest):
        rows[:, k] = padded[at + k]
        if k:
            rows[rows[:, k - 1] == 0, k] = 0
    return rows


def runs(values: np.ndarray, least: int = 1) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of equal values (0 or more) that are `least` long."""
    begins = np.flatnonzero(np.diff(values, prepend=-1))
    ends = np.append(begins[1:], len(values))[: len(begins)]
    long = ends - begins >= least
    return begins[long].tolist(), ends[long].tolist()


def grow(rows: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Phrases of two words and more with `least` occurrences among the pointers, depth first."""
    todo = [((), rows[np.argsort(rows[:, 0], kind="stable")] if len(rows) else rows)]
    while todo:
        phrase, own = todo.pop()
        depth = len(phrase)
        if depth == 1:  # only what goes on frequently is kept
            own = own[np.argsort(own[:, 1], kind="stable")]
        elif depth > 1:
            own = own[own[:, depth] > 0]
            own = own[np.argsort(own[:, depth], kind="stable")]
        for a, b in zip(*runs(own[:, depth], least), strict=True):
            next_ = (*phrase, int(own[a, depth]))
            if depth:
                yield next_, b - a
            if depth + 1 < own.shape[1]:
                todo.append((next_, own[a:b]))


def summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows and the sum of each one's n."""
    if not len(rows):
        return rows, n
    order = np.lexsort(rows.T[::-1])
    rows, n = rows[order], n[order]
    begins = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return rows[begins], np.add.reduceat(n, begins)


def beginnings(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the different beginnings of the rows, filled up with 0, and how often each is there."""
    rows, n = summed(rows, np.ones(len(rows), np.int64))
    for size in range(rows.shape[1], 1, -1):
        own = rows[:, size - 1] > 0
        yield summed(rows[own], n[own])
        rows = rows.copy()
        rows[:, size - 1] = 0
        rows, n = summed(rows, n)


def _projected(buckets: int):
    """A slice's frequent words (ids, gids, hot) and its texts in numbers to buckets of pointers; of hot prefixes, phrases (as
    rows filled up with 0) with their counts."""
    schema = pa.schema([("bucket", pa.int64()), ("pointers", pa.binary()), ("counted", pa.binary())])

    def bucket_of(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            h = (h ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(buckets)).astype(np.int64)

    def parts(bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        for a, b in zip(*runs(bucket), strict=True):
            yield int(bucket[a]), rows[a:b].tobytes()

    def run(words: pa.Table, texts: pa.Table) -> pa.Table:
        ids, gids, is_hot = (words[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "gids", "hot"))
        hot, size = gids[is_hot.astype(bool)], int(ids.max(initial=0))
        found, hots = [], []
        for codes in texts["codes"]:
            c = np.frombuffer(codes.as_buffer(), np.int32)
            to = np.zeros(max(size, int(c.max(initial=0))) + 1, np.int32)
            to[ids] = gids
            rows = pointers(to[c])
            if len(hot):
                is_hot = np.isin(rows[:, 0], hot)
                hots.append(rows[is_hot])
                rows = rows[~is_hot]
            found += [(k, part, None) for k, part in parts(bucket_of(rows[:, :1]), rows)]
        if hots:
            for grams, n in beginnings(np.concatenate(hots)):
                both = np.concatenate([grams, n.view(np.int32).reshape(-1, 2)], axis=1)
                found += [(k, None, part) for k, part in parts(bucket_of(grams), both)]
        out = pa.table([pa.array([x[i] for x in found], f.type) for i, f in enumerate(schema)], schema=schema)
        release()
        return out

    return run


def _grown(least: int):
    """A bucket's frequent phrases: grown from its pointers, and those counted already."""

    def rows_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
        own = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, width) for x in column if x.is_valid]
        return np.concatenate(own) if own else np.empty((0, width), np.int32)

    def run(bucket: pa.Table) -> pa.Table:
        found = list(grow(rows_of(bucket["pointers"], LONGEST), least))
        counted = rows_of(bucket["counted"], LONGEST + 2)
        grams, n = summed(counted[:, :LONGEST], np.ascontiguousarray(counted[:, LONGEST:]).view(np.int64).ravel())
        found += [(tuple(g[g > 0].tolist()), int(k)) for g, k in zip(grams[n >= least], n[n >= least], strict=True)]
        release()
        return pa.table({"phrase": pa.array([x for x, _ in found], pa.list_(pa.int32())), "f": pa.array([n for _, n in found], pa.int64())})

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (lang, word, gid, f) of words and (phrase, f) of phrases, as ids, with `least` occurrences; and (lang, n) of all
    words."""
    parts = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // PART + 1
    numbered = cut(docs.select("lang", "text").mapInArrow(tidy(_encoded(SLICE, parts)), _NUMBERED), batch=1_000)
    known = cut(numbered.where(F.col("codes").isNull()).groupBy("part").applyInArrow(_known(least, hot, parts), _KNOWN))
    total = known.where(F.col("total").isNotNull()).groupBy("lang").agg(F.sum("total").alias("n"))
    frequent = known.where(F.col("word").isNotNull()).select("lang", "word", "gid", "f")
    buckets = (frequent.agg(F.sum("f")).first()[0] or 0) // BUCKET + 1
    own = known.where(F.col("slice").isNotNull()).select("slice", "lang", "ids", "gids", "hot")
    texts = numbered.where(F.col("codes").isNotNull()).select(F.col("slice").alias("at"), F.col("lang").alias("in"), "codes")
    projected = own.groupBy("slice", "lang").cogroup(texts.groupBy("at", "in")).applyInArrow(_projected(buckets), "bucket long, pointers binary, counted binary")
    return frequent, cut(projected.groupBy("bucket").applyInArrow(_grown(least), "phrase array<int>, f long")), total


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """Each language's first `top` rows (lang, rank, phrase, a, l, r, n, score) of docs (lang, text)."""
    words, phrases, total = frequent_phrases(docs, least, hot)
    f = phrases.select("phrase", F.col("f").alias("a"))
    parts = phrases.unionByName(words.select(F.array("gid").alias("phrase"), "f"))
    longer = f.where(F.size("phrase") > 2)
    inner = F.array(F.expr("slice(phrase, 1, size(phrase) - 1)"), F.expr("slice(phrase, 2, size(phrase) - 1)"))
    longer = longer.select(F.explode(inner).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("most"))
    kept = f.join(longer, "phrase", "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")
    spelt = kept.select("phrase", F.posexplode("phrase").alias("at", "gid")).join(words.select("gid", "lang", "word"), "gid")
    spelt = spelt.groupBy("phrase").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelt = spelt.select("phrase", "lang", F.array_join(F.col("w.word"), " ").alias("text"))
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, size(phrase) - 1)")))
    cuts = cuts.withColumns({"left": F.expr("slice(phrase, 1, k)"), "right": F.expr("slice(phrase, k + 1, size(phrase) - k)")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select(F.col("phrase").alias(side), F.col("f").alias(name)), side)
    cuts = cuts.join(spelt, "phrase").join(total, "lang")
    a, n, left, right = (F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r"))
    cuts = cuts.withColumns({"x": a * n * 1000, "y": left * right}).withColumn("score", F.expr("x div y"))
    least_ = F.min(F.struct("score", "k", "l", "r")).alias("m")
    scored = cuts.groupBy("phrase", "lang", "text", "a", "n").agg(least_)
    order = Window.partitionBy("lang").orderBy(F.col("m.score").desc(), F.col("a").desc(), F.col("text"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "m.l", "m.r", "n", "m.score")
