"""Intents against a plain reading of each query, and the search against all records."""

import random
import re

from pyspark.sql import functions as F

from spindrift.operators import intent

CATALOGUE = "media_id int, title string, genres array<string>, media_type string, status string, score double, release_date string"
ROWS = [
    (1, "One", ["Action", "Slice of Life"], "tv", "finished", 8.0, "1999-01"),
    (2, "Two", ["Action"], "movie", "airing", None, "2001"),
    (3, "Three", ["Slice", "Life"], "tv", None, 9.0, None),
    (4, "Four", None, None, "not_yet_aired", 7.0, "2001-05"),
    (5, None, [], "tv", "finished", 8.0, "2005"),
]


def plain(text, phrases):
    rest = re.sub(r"\s+", " ", (text or "").lower())
    said = {}
    for name, pattern in intent.GRAMMAR.items():
        m = re.search(pattern, rest, re.ASCII)
        said[name] = m and m[1]
        rest = re.sub(pattern, " | ", rest, flags=re.ASCII)
    words = re.findall(r"[^\W_]+|\|", rest)
    at, terms, got = 0, [], {"genre": [], "media_type": [], "status": []}
    while at < len(words):
        for n in range(intent.LONGEST, 0, -1):
            if at + n <= len(words) and " ".join(words[at : at + n]) in phrases:
                kind, value = phrases[" ".join(words[at : at + n])]
                got[kind].append(value)
                at += n
                break
        else:
            if words[at] not in ("|", *intent.FILLER):
                terms.append(words[at])
            at += 1
    year = {k: int(v) for k, v in said.items() if v and k != "min_score"}
    low = year.get("since", year["after"] + 1 if "after" in year else year.get("within"))
    high = year.get("until", year["before"] - 1 if "before" in year else year.get("within"))
    score = float(said["min_score"]) if said["min_score"] and float(said["min_score"]) <= 10 else None
    first = [(got[k] or [None])[0] for k in ("media_type", "status")]
    return " ".join(terms), sorted(set(got["genre"])), *first, score, low, high


def lexicon(spark):
    extra = [("slice", "genre", "Slice"), ("ongoing", "status", "airing"), ("slice of", "media_type", "tv"), ("!!", "genre", "x"), (None, "genre", "x"), ("tv", "genre", "Tube"), ("none", "genre", None)]
    return intent.lexicon(spark.createDataFrame(ROWS, CATALOGUE), spark.createDataFrame(extra, "phrase string, kind string, value string"))


def test_intents_equal_a_plain_reading(spark):
    known = lexicon(spark)
    phrases = {r["phrase"]: (r["kind"], r["value"]) for r in known.collect()}
    assert phrases["tv"] == ("genre", "Tube") and phrases["tv type"] == ("media_type", "tv") and phrases["not yet aired"][1] == "not_yet_aired"
    rng = random.Random(4)
    parts = ["slice", "of", "life", "Slice-of-Life", "action", "tv", "type", "movie", "since 1999", "before 2005", "in 2001", "after 1998", "until 2003", "rated above 7.5", "at least 11", "over 8", "ongoing", "not yet", "aired", "robots", ",", "||", "Ünïcode", "above"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(300)] + ["", " ", None, "slice of life " * 3000, "above 1" + "0" * 400]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, None), (7, "tv"), (None, "action")]
    got = intent.intents(spark.createDataFrame(rows, "query_id int, text string"), known).collect()
    assert len(got) == len(set(rows))
    for r in got:
        assert tuple(r)[2:] == plain(r["text"], phrases), r["text"]
    assert intent.intents(spark.createDataFrame([], "query_id int, text string"), known).count() == 0


def test_search_equals_a_scan_of_all_records(spark):
    texts = ["slice of life", "action", "tv type", "robots", "finished", "above 7", "since 2000", "before 2000", "in 2001", "slice action", "movie type over 1", None]
    catalogue = spark.createDataFrame(ROWS, CATALOGUE)
    found = intent.intents(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), lexicon(spark))
    want = set()
    for q in found.collect():
        fits = [
            r for r in ROWS
            if set(q["genres"]) <= set(r[2] or []) and q["media_type"] in (None, r[3]) and q["status"] in (None, r[4]) and (q["min_score"] is None or (r[5] or -1) >= q["min_score"])
            and (q["year_from"] is None or (r[6] and int(r[6][:4]) >= q["year_from"])) and (q["year_to"] is None or (r[6] and int(r[6][:4]) <= q["year_to"]))
        ]
        fits.sort(key=lambda r: (r[5] is None, -(r[5] or 0), r[0]))
        want |= {(q["query_id"], n + 1, r[0]) for n, r in enumerate(fits[:3])}
    assert {(r["query_id"], r["place"], r["media_id"]) for r in intent.search(found, catalogue, 3).collect()} == want


def test_queries_are_not_joined_back_to_themselves(spark):
    """A join of all queries with all queries may be planned with one side sent to the driver: files are smaller than rows."""
    found = intent.intents(spark.createDataFrame([(1, "action")], "query_id int, text string"), lexicon(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_searches_meet_classes_of_records(spark):
    """Many records alike in all that is asked for: no join makes a row for each record and search."""
    rows = [(n, f"t{n}", ["Action"], "tv", "finished", float(n % 10), "2001") for n in range(2_000)]
    catalogue = spark.createDataFrame(rows, CATALOGUE)
    texts = [f"action tv type since {1900 + n}" for n in range(100)]
    found = intent.intents(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), lexicon(spark))
    got = {(r["query_id"], r["place"], r["media_id"]) for r in intent.search(found, catalogue, 3).collect()}
    assert got == {(q, p + 1, m) for q in range(100) for p, m in enumerate((9, 19, 29))}
    order = [F.desc_nulls_last("score"), F.asc("media_id")]
    assert intent.firsts(catalogue, [0, 1, 5], order, 3).count() == 9
