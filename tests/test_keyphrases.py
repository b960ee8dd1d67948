"""Keyphrases against a plain ranking of each text's words, and odd tables."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spindrift.operators import keyphrases as kp
from spindrift.operators.content import stop_words

SF = "/root/testdata/sf0.001"


def plain(text, n):
    """The ranking with dictionaries, a text at a time."""
    stop = set(stop_words())
    tokens = re.findall(r"[^\W_]+|[.,;:!?()\n]", (text or "").lower())
    tokens = [None if len(w) < 2 or w in stop else w for w in tokens]
    links = {w: {} for w in tokens if w}
    for i, a in enumerate(tokens):
        for b in tokens[i + 1 : i + 1 + kp.WINDOW]:
            if a and b and a != b:
                links[a][b] = links[a].get(b, 0) + 1
                links[b][a] = links[b].get(a, 0) + 1
    rank = dict.fromkeys(links, 1.0)
    for _ in range(kp.ROUNDS):
        rank = {w: 1 - kp.DAMPING + kp.DAMPING * sum(rank[v] * c / sum(links[v].values()) for v, c in links[w].items()) for w in links}
    rank = {w: round(r, kp.DIGITS) for w, r in rank.items()}
    best = set(sorted(rank, key=lambda w: (-rank[w], w))[: -(-len(rank) // 3)])
    runs = " ".join(w if w in best else "|" for w in tokens).split("|")
    phrases = {r.strip(): sum(rank[w] for w in sorted(set(r.split()))) for r in runs if r.strip()}
    out = []
    while phrases and len(out) < n:
        top = max([*phrases.values(), *(w for _, w in out)])

        def worth(p):
            own = set(p.split())
            near = max((len(own & set(q.split())) / len(own | set(q.split())) for q, _ in out), default=0)
            return round(kp.WEIGHT * phrases[p] / top - (1 - kp.WEIGHT) * near, kp.DIGITS)

        chosen = min(phrases, key=lambda p: (-worth(p), p))
        out.append((chosen, phrases.pop(chosen)))
    return out


def found(df, n=5):
    out = {}
    for r in kp.keyphrases(df, "doc_id", F.col("text"), n).orderBy("doc_id", "place").collect():
        out.setdefault(r["doc_id"], []).append((r["phrase"], r["weight"]))
    return out


def test_equals_a_plain_ranking(spark, monkeypatch):
    monkeypatch.setattr(kp, "SLICE", 5_000)  # several texts a slice, and texts longer than one
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = found(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in rows:
        if len(r["text"]) > 20_000:  # the plain ranking is slow
            continue
        want = plain(r["text"], 5)
        have = got.get(r["doc_id"], [])
        assert [p for p, _ in have] == [p for p, _ in want], r["doc_id"]
        assert all(abs(a - b) < 1e-4 for (_, a), (_, b) in zip(have, want, strict=True))


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "the of and"), (4, "word"), (5, "red fox, red fox; blue sea"), (5, "red fox, red fox; blue sea"), (None, "lone phrase"), (7, "x " * 50_000)]
    got = found(spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, place int, phrase string"))
    assert set(got) == {4, 5, None}
    assert got[4] == [("word", 0.15)]
    assert len(got[5]) % 2 == 0 and got[5][0] == got[5][1]  # a repeated row has its own
    assert found(spark.createDataFrame([], "doc_id long, text string")) == {}


def test_phrases_differ():
    weights = {"deep sea": 4.0, "deep sea fish": 3.9, "old harbour": 3.0}
    assert [p for p, _ in kp.picked(weights, 2)] == ["deep sea", "old harbour"]


def test_few_phrases_are_spelled_and_none_is_missed(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["red", "fox", "sea", "old", "of"]) + rng.choice(["", str(rng.randrange(400))]) + rng.choice(["", "", ","]) for _ in range(4_000)) for _ in range(3)]
    texts += ["word " * 3_000, "", "deep sea, " * 500 + "old harbour, red fox"]
    tokens = pa.array([re.findall(r"[^\W_]+|[.,;:!?()\n]", x) for x in texts])
    seen, picked = [], kp.picked
    monkeypatch.setattr(kp, "picked", lambda phrases, *a: seen.append(len(phrases)) or picked(phrases, *a))
    got = {}
    for first, n in ((24, 5), (1, 5), (10**9, 5), (1, 60), (10**9, 60)):
        monkeypatch.setattr(kp, "FIRST", first, raising=False)
        got[first, n] = kp._slice(tokens, n, frozenset(stop_words()))
        assert first > 24 or n > 5 or max(seen) < 400
    assert got[24, 5] == got[1, 5] == got[10**9, 5] and got[1, 60] == got[10**9, 60]
    for have, text in zip(got[24, 5], texts, strict=True):
        assert [p for p, _ in have] == [p for p, _ in plain(text, 5)]


def test_phrases_not_given_are_asked_for_where_they_may_be_picked():
    weights = {"deep sea": 4.0, "deep sea fish": 3.9}
    assert kp.picked(weights, 2, 3.0) is None
    assert [p for p, _ in kp.picked(weights, 1, 3.0)] == ["deep sea"]


def test_words_of_near_texts_are_those_of_the_built_in_function(spark):
    every = "".join(f" x{chr(c)}y{chr(c)}{chr(c)} {chr(c)}" for c in range(kp.NEAR + 1) if max(map(ord, chr(c).lower())) <= kp.NEAR)
    df = spark.createDataFrame([(1, every), (2, "ÄÖ straße, ＡＢ"), (3, ""), (4, every + "я 中文")], "doc_id long, text string")
    rows = df.select("text", F.lower("text").alias("low"), kp.marked_words(F.col("text")).alias("words")).collect()
    plain = pa.array([r["low"] if max(map(ord, r["low"] + " ")) <= kp.NEAR else None for r in rows])
    assert plain.null_count == 2
    assert kp._tokens(plain, pa.array([r["words"] if p is None else None for r, p in zip(rows, plain.to_pylist(), strict=True)])).to_pylist() == [r["words"] for r in rows]
