"""Collocations, interval overlap and host reputation against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import collocations, host_reputation, interval_overlap
from spindrift.llm.common import heavy_keys

DOCS = "doc_id long, text string, lang string, source string, phrase string, slice long, word string, codes binary"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "p", 7, "w", None) for i, (t, lang) in enumerate(rows)], DOCS)


def brute_phrases(rows, least, top, percent=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, g), a in cand.items():
        for i in range(len(g)):
            for j in range(i + 2, len(g) + 1):
                inner = (lang, g[i:j])
                if j - i < len(g) and inner in cand and 100 * a >= percent * cand[inner]:
                    gone.add(inner)
    out = defaultdict(list)
    for (lang, g), a in cand.items():
        if (lang, g) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows_ in out.items() for k, (s, a, p, left, right) in enumerate(sorted(rows_)[:top]))


def phrase_rows(seed=5, n=120):
    rng = random.Random(seed)
    words = ["der", "Haus", "É", "é", "a\u0085b", "x\u00a0y", "New", "york", "the", "of", "\x1cq", "日本"]
    out = [(None, "en"), ("", "en"), (" \t\n", None), ("... !!", "fr"), ("a", None)]
    for _ in range(n):
        w = [rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\x0b"]) for _ in range(rng.randint(1, 90))]
        out.append((rng.choice([" ", "  ", "\t "]).join(w), rng.choice(["en", "en", "fr", None, None])))
    return out + [("to be or not to be " * 30, "en")] * 3 + [("go go go go go go go", "fr")] * 9


@pytest.mark.parametrize("hot", [4_000_000, 300])
def test_phrases_equal_brute_force_with_and_without_hot_prefixes(spark, monkeypatch, hot):
    monkeypatch.setattr(collocations, "SLICE", 900)
    monkeypatch.setattr(collocations, "CHUNK", 2_000)
    monkeypatch.setattr(collocations, "BUCKET", 500)
    rows = phrase_rows()
    got = collocations.collocations(docs(spark, rows), least=12, top=40, hot=hot).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = brute_phrases(rows, 12, 40)
    assert {r[0] for r in want} >= {"en", "und"} and len(want) > 30
    assert sorted(map(tuple, got)) == want


def test_a_lower_percentage_drops_more(spark):
    rows = [("a b c " * 20 + "a b " * 6, "en"), ("b c d. b c. " * 10, "en")]
    for percent in (100, 80):
        got = collocations.collocations(docs(spark, rows), least=10, top=50, percent=percent).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert sorted(map(tuple, got)) == brute_phrases(rows, 10, 50, percent)


def test_phrases_of_odd_tables(spark):
    assert collocations.collocations(docs(spark, [(None, None), ("", "en")])).count() == 0
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    long = ("lorem ipsum dolor " * 40_000, "en")  # without any piece's end
    got = collocations.collocations(docs(spark, [long, ("x y", "en")])).collect()
    assert sorted((r["phrase"], r["a"]) for r in got if len(r["phrase"].split()) == 5) == [("dolor lorem ipsum dolor lorem", 39_998), ("ipsum dolor lorem ipsum dolor", 39_999), ("lorem ipsum dolor lorem ipsum", 39_999)]


def test_growing_is_depth_first_and_whole():
    codes = np.array([1, 2, 3, 1, 2, 3, 0, 1, 2, 0, 3, 1, 0], np.int32)
    got = dict(collocations.grow(collocations.pointers(codes), 2))
    assert got == {(1, 2): 3, (2, 3): 2, (3, 1): 2, (1, 2, 3): 2}


SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, first long, s1 long"
LINES = "sale_id long, line_no int, shipped_at timestamp_ntz, last long"
CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, m long, cell long"
START = datetime(2024, 1, 1)


def brute_overlaps(sales, lines, clicks):
    us, slot = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1), 6 * 3600 * 10**6
    shipped = defaultdict(list)
    for i, at in lines:
        if i is not None and at is not None:
            shipped[i].append(at)
    by = defaultdict(list)
    for ts, c, kind in clicks:
        if ts is not None and c is not None:
            by[c].append((us(ts), kind == "error"))
    sessions = defaultdict(list)
    for c, rows in by.items():
        now = []
        for m, bad in sorted(rows):
            if now and m - now[-1][0] > 900 * 10**6:
                sessions[c].append(now)
                now = []
            now.append((m, bad))
        sessions[c].append(now)
    out = {}
    for i, c, status, sold in sales:
        if c is None or sold is None:
            continue
        s1, e1 = us(sold) // slot, us(max([sold, *shipped[i]])) // slot
        e1 = float("inf") if status == "open" else e1
        for one in sessions[c]:
            s2, last = one[0][0] // slot, one[-1][0]
            e2 = float("inf") if any(bad for m, bad in one if m == last) else last // slot
            if s1 > e2 or s2 > e1:
                continue
            kind = (["overlaps", "finished_by", "contains"] if s1 < s2 else ["starts", "equals", "started_by"] if s1 == s2 else ["during", "finishes", "overlapped_by"])[(e1 >= e2) + (e1 > e2)]
            n, shared, crc = out.get((i, kind), (0, None, 0))
            both = None if e1 == e2 == float("inf") else int(min(e1, e2) - max(s1, s2) + 1)
            out[i, kind] = (n + 1, shared if both is None else (shared or 0) + both, crc + zlib.crc32(str(one[0][0]).encode()))
    return sorted((*k, *v) for k, v in out.items())


def shop(seed, days=6, hot=False):
    rng = random.Random(seed)
    when = lambda: START + timedelta(microseconds=rng.randrange(days * 86_400 * 10**6))
    client = lambda: rng.choice([1] * 6 + [2, 3, 4, None]) if hot else rng.choice([1, 2, 3, 4, None])
    sales = [(k, client(), rng.choice(["open", "done", "held", None]), rng.choice([when(), when(), when(), None])) for k in range(60)]
    sales += [(3, 1, "done", when()), (3, 2, "open", when())]
    lines = [(rng.choice([None, *range(64)]), rng.choice([when(), None, when().replace(hour=0, minute=0, second=0, microsecond=0)])) for _ in range(90)]
    clicks = []
    for _ in range(60):
        ts, c = when(), client()
        for _ in range(rng.randint(1, 5)):
            clicks.append((ts, c, rng.choice(["view", "error", None])))
            clicks += [(ts, c, rng.choice(["view", "error"]))] * rng.choice([0, 0, 1])
            ts += rng.choice([timedelta(minutes=15), timedelta(minutes=15, microseconds=1), timedelta(minutes=3), timedelta(0)])
    return sales, lines, clicks + [(None, 1, "error"), (datetime(1969, 12, 31, 23, 59, 59, 999_999), 1, "error"), (datetime(1969, 12, 31, 23, 50), 1, "view")]


def shop_tables(spark, sales, lines, clicks):
    return (
        spark.createDataFrame([(i, c, s, 1.0, t, 5, 6) for i, c, s, t in sales], SALES),
        spark.createDataFrame([(i, 1, t, 5) for i, t in lines], LINES),
        spark.createDataFrame([(9, t, c, k, 5, 6) for t, c, k in clicks], CLICKS),
    )


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_equal_brute_force(spark, monkeypatch, seed, zone):
    monkeypatch.setattr("spindrift.llm.common.HEAVY", 3)  # client 1 is salted
    data = shop(seed, hot=True)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        tables = shop_tables(spark, *data)
        assert [r[0] for r in heavy_keys(tables[0], "client_id").collect()] == [1]
        got = interval_overlap.overlaps(*tables).select("sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = brute_overlaps(*data)
    assert len({r[1] for r in want}) >= 8
    assert sorted(map(tuple, got)) == want


def test_overlaps_of_empty_tables(spark):
    sales, lines, clicks = shop_tables(spark, *shop(3))
    none = [t.where("false") for t in (sales, lines, clicks)]
    assert interval_overlap.overlaps(none[0], lines, clicks).count() == 0
    assert interval_overlap.overlaps(sales, none[1], none[2]).count() == 0
    assert interval_overlap.overlaps(*none).count() == 0


def test_clicks_of_a_cell_are_summed_up_before_the_window(spark):
    clicks = spark.range(20_000).select(F.lit(1).cast("long").alias("client_id"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 10)).alias("ts"), F.lit("view").alias("kind"))
    assert [(r["last"] - r["first"]) // 10**6 for r in interval_overlap.sessions(clicks).collect()] == [1999]


URLS = [
    ("https://WWW.Example.COM/en/1.html?x=/net/", "www.example.com", "/en/1.html", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("http://x.net/es/?a", "x.net", "/es/", "net/es/", "block"),
    ("http://net/fr/#b", "net", "/fr/", "net/fr/", "block"),
    ("http://x.net/de/", "x.net", "/de/", None, "allow"),
    ("http://x.com?/en/", "x.com", "", None, "allow"),
    ("http://x.com#/", "x.com", "", None, "allow"),
    ("//x.com/en/", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://ÀÉ.Example.com/EN/", "ÀÉ.example.com", "/EN/", "com/", "allow"),
    ("://", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(k, u[0], "h") for k, u in enumerate(URLS)] + [(0, URLS[0][0], "h")], "page_id long, url string, host string")
    got = host_reputation.judge(pages, spark.createDataFrame([], "url string, n long, good long"))
    want = [(k, *u[1:]) for k, u in enumerate(URLS)] + [(0, *URLS[0][1:])]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(want, key=str)
    assert host_reputation.judge(pages.where("false"), spark.createDataFrame([], "url string, n long, good long")).count() == 0


def brute_bounds(hosts):
    h = host_reputation

    def parts(host):
        labels = host.split(".")
        k = 2 if ".".join(labels[-2:]) in h.SUFFIXES else 1
        return ".".join(labels[-k:]), ".".join(labels[-k - 1 :])

    def summed(key):
        out = defaultdict(lambda: [0, 0])
        for host, (n, g) in hosts.items():
            out[key(host)][0] += n
            out[key(host)][1] += g
        return out

    def shrink(level, above):
        a = sum((g - n * above[k]) ** 2 - n * above[k] * (1 - above[k]) for k, (n, g) in level.items())
        b = sum(n * (n - 1) * above[k] * (1 - above[k]) for k, (n, g) in level.items())
        r = a / b if b else 0
        w = min(50.0, max(2.0, 1 / r - 1)) if r > 0 else 50.0
        return {k: (g + w * above[k]) / (n + w) for k, (n, g) in level.items()}, w

    n, g = (sum(x[i] for x in hosts.values()) for i in (0, 1))
    suffixes, domains = summed(lambda x: parts(x)[0]), summed(parts)
    by_suffix, _ = shrink(suffixes, dict.fromkeys(suffixes, (g + 1) / (n + 2)))
    by_domain, _ = shrink(domains, {k: by_suffix[k[0]] for k in domains})
    rate, w = shrink(hosts, {k: by_domain[parts(k)] for k in hosts})
    return {k: min(1.0, rate[k] + 1.645 * (rate[k] * (1 - rate[k]) / (hosts[k][0] + w + 1)) ** 0.5) for k in hosts}


def test_poor_hosts_are_blocked_and_few_bad_pages_block_none(spark, monkeypatch):
    monkeypatch.setattr("spindrift.llm.common.HEAVY", 4)
    rng = random.Random(4)
    hosts = {f"h{k}.shop{k % 7}.{'org' if k % 3 else 'co.uk'}": (n := rng.randint(0, 60), rng.randint(int(0.6 * n), n)) for k in range(40)}
    hosts |= {"bad.spam.org": (200, 6), "new.spam.org": (0, 0), "few.shop1.org": (2, 0), "ok.shop2.org": (300, 290)}
    pages = [(k, f"http://{h}/p/{i}") for k, h in enumerate(hosts) for i in range(300 if h == "ok.shop2.org" else 2)]
    seen = [(f"http://{h}/p/{i % 9}", 1, int(i < g)) for h, (n, g) in hosts.items() for i in range(n)]
    got = host_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(seen, "url string, n long, good long")).collect()
    assert len(got) == len(pages)
    bounds = brute_bounds(hosts)
    assert {r["host"] for r in got} == set(bounds) and all(abs(r["host_bound"] - bounds[r["host"]]) < 1e-6 for r in got)
    assert {r["host"] for r in got if r["verdict"] == "block"} == {h for h, b in bounds.items() if b < 0.5} == {"bad.spam.org", "new.spam.org"}  # the one without labels goes by its domain


def test_outcomes_are_those_of_the_documents_that_pages_show(spark):
    pages = spark.createDataFrame([(1, "http://a.org/en/5.html"), (2, "http://a.org/en/5.html"), (3, "http://b.org/en/6?x=5"), (4, "http://b.org/x7/"), (5, None), (6, "http://c.org/8/"), (7, "http://c.org/" + "9" * 30)], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1, 0, "u"), (5, 0, 0, "u"), (6, None, 1, "u"), (7, 1, 0, "u"), (8, None, None, "u"), (None, 1, 0, "u")], "doc_id long, quality int, toxic int, url string")
    got = sorted(map(tuple, host_reputation.page_outcomes(pages, labels).collect()))
    assert got == [("http://a.org/en/5.html", 4, 2), ("http://b.org/en/6?x=5", 1, 0)]
