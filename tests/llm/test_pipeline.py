"""The corpus pipeline: each stage's decisions take effect on its own input, and clean documents stay."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spindrift.llm import line_dedup, ngram_jaccard, packing, pairwise_quality, secrets_index

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        before, after = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, out))
        assert after <= before
        seen[name] = (before, after)
        docs = out
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = seen["quality"][1]
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert seen["secrets"][0] == seen["secrets"][1]
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")).count() == 0
    lines = docs.select(F.explode(F.split("text", "\n")).alias("x")).where("length(x) > 20").groupBy("x").count().where("count > 1")
    assert lines.count() <= 2  # lines that became equal by redaction
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF)
    by_bin = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("c")).collect()
    assert by_bin and all(r["n"] == r["end"] <= 4096 for r in by_bin)


def test_decisions_are_by_row(spark):
    """Null and repeated ids: a row goes for its own text, and of exact copies one stays."""
    good, other = "a clean text of seven words here", "quite another text with its own words"
    rows = [(None, good), (None, good), (None, other), (7, "bad"), (7, "some third text with seven good words"), (8, good), (9, other), (9, other), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(7, "bad"), rows[4], (8, good), (9, other), (None, None), (None, None)], key=str)
    learn = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = learn.join(labels.where("quality is not null"), "doc_id")
    hot = both.select(F.lit(None).cast("long").alias("doc_id"), "text")
    kept = {r["text"] for r in pairwise_quality.keep_good(learn.unionByName(hot), labels).where("doc_id is null").collect()}
    out = pairwise_quality.classify(learn, labels).join(learn, "doc_id").join(both.select("doc_id"), "doc_id").collect()
    assert kept == {r["text"] for r in out if r["predicted"] == 1} and len({r["predicted"] for r in out}) == 2


BLANK = " \t\n\x0b\x0c\r"


def components(n, linked):
    """The least member of each one's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if find(a) != find(b) and linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def brute_lines(rows):
    lines = [(k, i, x) for k, (_, t) in enumerate(rows) for i, x in enumerate((t or "").split("\n")) if x.strip(BLANK)]
    classes = sorted({x for _, _, x in lines})
    sets = [line_dedup.line_shingles(x) for x in classes]
    root = dict(zip(classes, components(len(classes), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])), strict=True))
    first, out = {}, []
    for k, i, x in lines:
        first.setdefault(root[x], (k, i))
    for k, (doc, t) in enumerate(rows):
        parts = (t or "").split("\n")
        keep = [x for i, x in enumerate(parts) if not x.strip(BLANK) or first[root[x]] == (k, i)]
        if len(keep) == len(parts):
            out.append((doc, t))
        elif any(x.strip(BLANK) for x in keep):
            out.append((doc, "\n".join(keep)))
    return out


def brute_near(rows):
    def grams(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [grams(t) for _, t in rows]
    root = components(len(rows), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    return [r for k, r in enumerate(rows) if root[k] == k]


def brute_redacted(text):
    """Each match, in order of start and kind, gives way to its kind; what overlaps one before goes with it."""
    found = sorted((m.start(), k, m.end()) for k, r in enumerate(secrets_index.RULES) for m in re.finditer(r.regex, text or "") if len(m[r.part]) >= r.least)
    out, at = "", 0
    for start, kind, end in found:
        if start >= at:
            out += text[at:start] + f"[{secrets_index.RULES[kind].kind}]"
        at = max(at, end)
    return out + text[at:] if found else text


def corpus(spark, folder):
    """Ids in order, whatever the rows: null, empty and long texts, repeated and templated lines, near and exact copies, secrets, junk."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    notice = "this site asks you to read its terms of use with care before you go on"
    rows = []
    for k in range(90):
        t = "\n".join(prose(rng.randint(8, 30)) for _ in range(rng.randint(1, 5)))
        if k % 7 == 0:
            t += "\n" + notice
        if k % 11 == 0:
            t += f"\npassword = hunter{k}xyz and {'ab12' * 8}"
        if k % 4 == 1:
            t = " ".join(rng.choice(["###", "$$$$", "%%", "x9|", "&&&"]) + str(rng.randint(0, 99)) for _ in range(40))
        rows.append(t)
    rows += [rows[2], rows[6].replace("a", "b", 1), None, "", " \n ", "one two", prose(9000), rows[10] + " more"]
    labels = [(k, 0 if k % 4 == 1 else 1, 0) for k in range(0, 90)]
    spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return list(enumerate(rows)), {k: q for k, q, _ in labels}


def test_run_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, labels = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # quality: totals and cut by plain sums and sorts, under the weights that were learned
    marks = spark.read.parquet(f"{tmp_path}/labels.parquet")
    ranking = pairwise_quality.fit(pairwise_quality.featurize(docs).join(marks, "doc_id"))
    totals = [float(ranking.weights @ ranking.standard(np.array(pairwise_quality.features(t)))) for _, t in rows]
    learned = sorted(totals[i] for i, _ in rows if i in labels)
    below = sum(q == 0 for q in labels.values())
    assert ranking.cut == pytest.approx((learned[below - 1] + learned[below]) / 2)
    rows = [r for r, s in zip(rows, totals, strict=True) if s >= ranking.cut]
    assert [i for i, q in labels.items() if q == 1] == [i for i, _ in rows if i in labels]
    rows = [(i, brute_redacted(t)) for i, t in brute_near(brute_lines(rows))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.WORD_BPE))
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, corpus_pipeline.END_ID]
        for at in range(0, len(ids), packing.LENGTH):
            part = ids[at : at + packing.LENGTH]
            want.append((i, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len({i for i, *_ in want}) <= 70 and any(n > packing.LENGTH for *_, n in want)


def test_run_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, null ids and texts, and other columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, found string, n int, band long"
    labels = "doc_id long, quality int, toxic int, text string, score double"
    rows = [(1, "some words that are fine here", None, "s", 1, "h", "k", "f", 1, 2)] * 2 + [(None, "other words without an id", "en", None, None, None, None, None, None, None), (3, None, "en", "s", 0, "h", "k", "f", 1, 2), (3, "", "en", "s", 0, "h", "k", "f", 1, 2)]
    for name, some in (("empty", []), ("odd", rows)):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0, "t", 0.1)] if some else [], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted((r["doc_id"] or 0, r["doc_tokens"] > 1) for r in out) == ([(0, True), (1, True), (3, False), (3, False)] if some else [])
