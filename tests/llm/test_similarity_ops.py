"""N-gram Jaccard join, line dedup and components against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.llm import line_dedup, ngram_jaccard
from spindrift.operators import components
from spindrift.operators.components import connected_components

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, hash string, found string"


def docs(spark, texts):
    rows = [(i, t, None, "s", 1, "k", 5, "h", "f") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(texts):
    sets = [word_set(t) for _, t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(len(sets), links)
    least = {}
    for k, r in enumerate(root):
        if texts[k][0] is not None:
            least[r] = min(least.get(r, texts[k][0]), texts[k][0])
    return sorted(((i, len(sets[k]), least.get(root[k]) if sets[k] else i) for k, (i, _) in enumerate(texts)), key=str)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 150))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = passage + [rng.choice(words) for _ in range(rng.randint(1, 80))]
        out.append(" ".join(x.upper() if rng.random() < 0.2 else x for x in w))
    out += ["", None, " \t\n", "one two", "ONE  two", "a b c d e", "a b c", "é É", "x " * 30000, "x " * 30001]
    return out


def test_components_equal_brute_force(spark):
    texts = [(k * 7 % 997, t) for k, t in enumerate(corpus())]
    texts += [(texts[5][0], texts[5][1]), (texts[6][0], "another text under one id that is here"), (None, texts[7][1]), (None, None)]
    got = ngram_jaccard.jaccard_components(docs(spark, texts)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(texts)


def test_chain_of_near_copies_is_one_component(spark):
    words = [f"t{k}" for k in range(300)]
    texts = []
    for step in range(12):  # each differs from the last in two places, the first and last in many
        w = list(words)
        for k in range(step):
            w[20 * k] = w[20 * k + 9] = f"z{k}"
        texts.append((step, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(docs(spark, texts)).collect()}
    assert got == {i: c for i, _, c in brute_components(texts)}
    assert len(set(got.values())) < len(texts)


def test_empty_table_and_kept_rows(spark):
    assert ngram_jaccard.jaccard_components(docs(spark, [])).collect() == []
    table = docs(spark, [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, "other words that stand here now"), (4, None), (5, "")])
    kept = ngram_jaccard.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]


@pytest.mark.parametrize("part", [1_000_000, 7])
def test_star_components(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART", part)
    rng = random.Random(2)
    many = [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(180)]
    found = roots(1401, many)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(many, "a long, b long").repartition(3)).collect()}
    assert got == {x: found[x] for a, b in many if a != b for x in (a, b)}
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges + [(None, 5)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_lines(rows):
    """Texts after line dedup, rows in order of id."""
    lines = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(BLANK)]
    classes = sorted({x for _, _, x in lines})
    sets = [line_dedup.line_shingles(x) for x in classes]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = dict(zip(classes, roots(len(classes), links), strict=True))
    first = {}
    for i, k, x in lines:
        first.setdefault(root[x], (i, k))
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        keep = [x for k, x in enumerate(parts) if not x.strip(BLANK) or first[root[x]] == (i, k)]
        out.append((i, None if t is None else "\n".join(keep)))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 200))) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            x = rng.choice(base)
            lines.append(x if rng.random() < 0.6 else x[:-1] + "Z")
        rows.append((i, "\n".join(lines)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "ab"), (64, "ab\nab\n\nabc"), (65, "é" * 50000 + "\n" + "é" * 50001), (66, " \n ")]
    got = line_dedup.dedup_lines(docs(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == brute_lines(rows)


def test_line_recall_at_the_threshold():
    """Of random lines with a similarity of 0.8 to 0.85, nearly all share a band."""
    rng = random.Random(9)
    met = tried = 0
    for _ in range(300):
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))
        b = list(a)
        for k in rng.sample(range(300), 4):
            b[k] = "#"
        b = "".join(b)
        x, y = line_dedup.line_shingles(a), line_dedup.line_shingles(b)
        if len(x & y) >= 0.8 * len(x | y):
            tried += 1
            met += bool((line_dedup.bands([a]) == line_dedup.bands([b])).any())
    assert tried > 100 and met >= 0.98 * tried


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_shared_bands_equal_brute_force(size):
    """Bands that end with a batch, go on in the next, and come in many rows of one line."""
    import pyarrow as pa

    rng = random.Random(size)
    rows = sorted((rng.randint(0, 30), rng.randint(0, 6)) for _ in range(120))
    held = {}
    for band, line in rows:
        held.setdefault(band, set()).add(line)
    want = sorted((b, x, min(xs), max((y for y in xs if y < x), default=x)) for b, xs in held.items() if len(xs) > 1 for x in xs)
    batches = [pa.RecordBatch.from_pydict({"band": [b for b, _ in rows[k : k + size]], "line": [x for _, x in rows[k : k + size]]}) for k in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in line_dedup._shared(iter(batches)) for r in b.to_pylist()]
    assert got == want
    assert list(line_dedup._shared(iter([]))) == []


@pytest.mark.parametrize("block", [512, 16])
def test_all_similar_lines_of_a_bucket_meet(spark, monkeypatch, block):
    """Lines with one long shared passage: those that share a band and are similar become one, whatever else is there."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(12)

    def chars(n):
        return [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)]

    shared, lines = "".join(chars(200)), []
    for k in range(300):
        own = chars(40)
        lines.append(shared + "".join(own))
        if k < 60:
            own[20] = own[30] = "#"
            lines.append(shared + "".join(own))
    rng.shuffle(lines)
    held = line_dedup.bands(lines)
    sets = [line_dedup.line_shingles(x) for x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if (held[a] == held[b]).any() and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) >= 59
    root = roots(len(lines), links)
    got = {r["doc_id"] for r in line_dedup.dedup_lines(docs(spark, list(enumerate(lines)))).where("text <> ''").collect()}
    assert got == set(root)


def test_line_dedup_keeps_columns_and_rows(spark):
    table = docs(spark, [(1, "same line here\nown line one"), (2, "same line here"), (2, "same line here"), (None, "a line without id"), (3, None)])
    out = line_dedup.keep_lines(table)
    assert out.columns == table.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect() if r["text"]) == [(0, "a line without id"), (1, "same line here\nown line one")]
    assert out.where(F.col("doc_id") == 3).count() == 1
    assert line_dedup.keep_lines(docs(spark, [])).collect() == []


@pytest.mark.parametrize("sizes", [(1,), (2, 3)])
def test_shingler_reads_exactly_the_six_separators(sizes):
    s = ngram_jaccard.Shingler()
    assert len(s("a b c\x1cd".encode())) == 1  # two words: one short sequence
    assert (s(b"A B\tC\x0bD\x0cE") == s(b"a b c d\r\ne")).all()


def test_words_of_a_text_are_hashed_at_once(monkeypatch):
    """No call and no memory a word; hashes tell words apart by bytes and places, also long ones and beside any separators."""
    calls = []
    real = ngram_jaccard.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(ngram_jaccard.xxhash, "xxh3_64_intdigest", lambda *x: calls.append(x) or real(*x))
    words = ["ab", "ba", "a", "aa", "aaa", "a" * 300, "a" * 299 + "b", "b" + "a" * 299, "\x00", "a\x00", "\x00a", "é", *(f"w{k}" for k in range(2_000))]
    s = ngram_jaccard.Shingler(1)
    assert len(s(f"  {'\n\t '.join(words)}\x0b".encode())) == len(words)
    assert (s(b"A bc aa") == s(b"\x0caa  a\rBC")).all() and len(s(b" \n")) == len(s(None)) == len(s(b"")) == 0
    assert not calls


def test_long_text_whose_lines_all_go(spark):
    """100,000 lines that an earlier row has too: places are found by hashing, not each by a walk through all."""
    text = "\n".join(f"line {k * 7919 % 1000003} of a long text" for k in range(100_000))
    rows = [(1, text), (2, f"{text}\n\na new line that stays here")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["text"].endswith("\na new line that stays here")
    assert len(got[2]["text"].split("\n")) == 100_002 - got[2]["n_dropped"]
