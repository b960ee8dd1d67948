"""Operators without SQL twins, and the literal cases of text, filters, normalisers and deduplication."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.functions import errors, similarity, taxonomy, text
from spindrift.operators import keyed, cache, content, dedup, filters, quality, ranking, recommend, vectors
from spindrift.plans import catalogue
from spindrift.sources import limits, normalize, readers, schema, services
from spindrift.streaming import checkpoints, ingest, jobs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("clean", "raw", "want"),
    [
        (text.clean_manga_synopsis, "<p>This is a <b>test</b> synopsis.</p>", "This is a test synopsis."),
        (text.clean_manga_synopsis, "This   has    extra    spaces", "This has extra spaces"),
        (text.clean_manga_synopsis, "Synopsis: This is the actual synopsis", "This is the actual synopsis"),
        (text.clean_manga_synopsis, None, ""),
        (text.clean_screen_synopsis, "Overview: This is the actual overview", "This is the actual overview"),
        (text.clean_screen_synopsis, "This   has    extra    spaces", "This has extra spaces"),
        (text.clean_anime_synopsis, " A story. () [Written by MAL Rewrite]　", "A story."),
        (text.clean_anime_synopsis, "No synopsis information has been added to this title.", None),
        (text.title_case, "SLICE of sci-fi it's", "Slice Of Sci-Fi It'S"),
        (text.clean_nlp, "Some (odd)\ntext, [x] with 12 Words!", "some text with words"),
        (text.halve_spaces, "a   b", "a  b"),
        (taxonomy.status, " Finished ", "completed"),
        (taxonomy.status, None, "unknown"),
        (taxonomy.source_status, "currently_airing", "ongoing"),
        (errors.category, "HTTP 429: network", "rate_limit"),
        (errors.category, "Network down, not found", "transient"),
        (errors.category, "404 and bad json", "permanent"),
        (errors.category, "can't decode", "data_quality"),
        (errors.category, "?", "unknown"),
    ],
)
def test_text(spark, clean, raw, want):
    assert value(spark, clean(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("2005", "2005-01-01"), ("2005-03", "2005-03-01"), ("2005-03-09", "2005-03-09"), (None, None), ("soon", None)])
def test_partial_dates(spark, raw, want):
    got = value(spark, text.padded_date(F.lit(raw).cast("string")))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("url", "want"), [("http://e.com:80/x", True), ("nope", False), ("http:///x", False), ("ht tp://x y", False), (None, None)])
def test_urls(spark, url, want):
    assert value(spark, text.valid_url(F.lit(url).cast("string"))) is want


def test_id_forms(spark):
    assert [tuple(value(spark, text.parse_id(F.lit(x)))) for x in ("tv-tmdb-5-a", "tv-5", "5")] == [("tv", "tmdb", "5-a"), ("tv", "unknown", "5"), ("unknown", "unknown", "5")]


def test_genres(spark):
    raw = F.array(*map(F.lit, (" action", "ACTION ", "", "space", "it's")))
    assert value(spark, taxonomy.clean_genres(raw)) == ["Action", "Space", "It'S"]
    assert value(spark, taxonomy.normal_genres(raw)) == ["Action", "Sci-Fi", "It'S"]
    assert value(spark, taxonomy.split_tags(F.array(F.lit("Memoir"), F.lit("Kids")), manga=True)).themes == ["Memoir"]


def test_filter_arguments():
    assert filters.parse_list(" Action , Comedy , Drama ") == ["Action", "Comedy", "Drama"] and filters.parse_list(None) == []
    assert filters.parse_range(" 7.5 - 10 ") == (7.5, 10.0) and filters.parse_range("invalid") is None and filters.parse_range(None) is None
    got = filters.build_filters(genres="Action,Fantasy", score_range="8-10", media_type="TV", sfw_only=True)
    assert got == {"genres": ["Action", "Fantasy"], "score_min": 8.0, "score_max": 10.0, "media_type": "tv", "sfw": True}
    assert filters.build_filters(media_type="TV", override='{"media_type": "ova"}') == {"media_type": "ova"}


def test_list_match(spark):
    df = spark.createDataFrame([(["Action", "Adventure"],), (["Comedy"],), ([],), (None,)], "g array<string>")
    assert [r[0] for r in df.select(filters.list_match(F.col("g"), ["action", "fantasy"])).collect()] == [True, False, False, False]
    assert value(spark, filters.list_match(F.lit("Comedy, Action"), ["action"], False)) is True


CATALOGUE = [
    (1, "Anime A", ["Action", "Adventure", "Fantasy"], ["Studio X"], 8.5, 24, "tv", "finished_airing", True),
    (2, "Anime B", ["Comedy", "Romance"], ["Studio Y"], 7.2, 1, "movie", "currently_airing", True),
    (3, "Anime C", ["Action", "Drama", "Fantasy"], ["Studio Z"], 9.1, 12, "tv", "finished_airing", False),
    (4, "Anime D", ["Comedy", "Slice of Life"], ["Studio X"], 6.8, 4, "ova", "not_yet_aired", True),
    (5, "Anime E", ["Action", "Sci-Fi"], ["Studio Y"], 8.0, 13, "tv", "currently_airing", True),
]


@pytest.fixture(scope="module")
def shows(spark):
    return spark.createDataFrame(CATALOGUE, "media_id long, title string, genres array<string>, studios array<string>, score double, episodes int, type string, status string, sfw boolean")


@pytest.mark.parametrize(
    ("args", "ids"),
    [({"genres": ["action"]}, [1, 3, 5]), ({"score_min": 8, "score_max": 9}, [1, 5]), ({"media_type": "TV", "sfw": True}, [1, 5]), ({"genres": ["drama"], "sfw": True}, []), ({"status": "Finished_Airing", "episodes_max": 12}, [3])],
)
def test_conditions(shows, args, ids):
    assert [r["media_id"] for r in shows.where(filters.condition(shows, args)).orderBy("media_id").collect()] == ids


def test_relaxation(shows):
    assert sorted(r["media_id"] for r in filters.relaxed(shows, {"genres": ["comedy"], "score_min": 9.5, "sfw": True}).collect()) == [2, 4]
    assert filters.relaxed(shows, {"genres": ["western"], "score_min": 9.5}).collect() == []


def test_similar_items(shows):
    got = content.similar_items(shows, 1, 3).collect()
    assert got[0]["media_id"] == 3 and 1 not in [r["media_id"] for r in got]
    assert content.similar_items(shows, 999, 3).collect() == []


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 8.0), (4, None)], "i int, s double")
    assert [r["r"] for r in ranking.average_rank(df, "s", "r").orderBy("i").collect()] == [1.0, 2.5, 2.5, None]


def test_quality_score(spark):
    rows = [("T", "x" * 60, ["a"], 1.0, "p"), ("T", "short", ["a"], 1.0, "p"), (" ", "x" * 60, ["a"], 1.0, "p"), ("T", "x" * 60, [], 1.0, "p"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "title string, synopsis string, genres array<string>, score double, main_picture string")
    assert [r[0] for r in df.select(quality.quality_score()).collect()] == [1.0, 0.9, 0.8, 0.8, 0.0]


def test_movie_and_manga_validation(spark):
    films = spark.createDataFrame([("m1", "movie", 7.5, 1000, "s"), ("m2", "movie", 8.0, 10, "s"), ("m3", "tv", 3.0, 99, "s"), ("m4", "movie", 9.0, 99, None)], "media_id string, media_type string, score double, vote_count int, synopsis string")
    assert [r["media_id"] for r in filters.valid_screen(films).collect()] == ["m1"]
    manga = spark.createDataFrame([("a", "manga", "s", ["x"]), ("b", "manga", None, []), ("c", "manga", None, ["Romance"]), ("d", "anime", "s", ["x"])], "media_id string, media_type string, synopsis string, genres array<string>")
    assert [r["media_id"] for r in filters.valid_manga(manga).orderBy("media_id").collect()] == ["a", "c"]


# normalisers


def test_manga_record(spark):
    raw = spark.createDataFrame(
        [("x1", ({"en": "Test Manga", "ja": "J"}, {"fr": "F"}, [("391b0423-d847-456f-aff0-8b0cfc03066b",), ("zz",)], "shounen", "ongoing", 2020, "safe", "ja"), [("cover_art", ("c.jpg", None)), ("author", (None, "A")), ("artist", (None, "A"))])],
        "id string, attributes struct<title map<string,string>, description map<string,string>, tags array<struct<id string>>, publicationDemographic string, status string, year int, contentRating string, originalLanguage string>, relationships array<struct<type string, attributes struct<fileName string, name string>>>",
    )
    r = normalize.manga_service(raw).first()
    assert (r["media_id"], r["title"], r["synopsis"], r["genres"], r["sub_type"], r["release_date"]) == ("manga-x1", "Test Manga", "F", ["Action"], "Shounen", "2020")
    assert r["metadata"]["sfw"] and r["metadata"]["authors"] == ["A"] and r["main_picture"].endswith("/x1/c.jpg.512.jpg")


def test_screen_records(spark):
    film = spark.createDataFrame([(550, "Club", "o", "/p.jpg", 8.4, [(18, "Drama")], "1999-10-15", ([("A",), (None,), ("B",), ("C",), ("D",), ("E",)],))], "id long, title string, overview string, poster_path string, vote_average double, genres array<struct<id int, name string>>, release_date string, credits struct<cast array<struct<name string>>>")
    r = normalize.screen_service(film, "movie").first()
    assert (r["media_id"], r["sub_type"], r["score"], r["genres"], r["metadata"]["cast"]) == ("movie-550", "Movie", 8.4, ["Drama"], ["A", "B", "C", "D"])
    assert value(spark, normalize.genre_names(F.array(F.lit(18), F.lit(1)))) == ["Drama"]
    assert value(spark, normalize.screen_sub_type("tv", F.array(F.lit("CN"), F.lit("KR")))) == "K-Drama"


def test_loaded_columns(spark):
    df = schema.renamed(spark.createDataFrame([(1, 8.0, None, "m.jpg")], "anime_id int, mean double, main_picture_large string, main_picture_medium string"))
    r = df.first()
    assert (r["media_id"], r["score"], r["main_picture"], r["media_type"]) == (1, 8.0, "m.jpg", "anime")
    full = schema.canonical(df.withColumn("title", F.lit("T")), "anime")
    assert set(schema.CANONICAL) <= set(full.columns) and full.first()["genres"] == [] and full.first()["status"] == "unknown"


# sources and streams


def test_scans_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "T", "D", ["a", "b"]), ("x", "U", "E", None)], "id string, title string, descr string, genres array<string>")
    readers.write_parquet(df, f"{tmp_path}/a.parquet")
    readers.write_csv(df, f"{tmp_path}/b.csv")
    assert [r["id"] for r in readers.items(readers.read_dataset(spark, f"{tmp_path}/a.parquet", "id", "title", "descr"), "id", "title", "descr").orderBy("title").collect()] == [1, None]
    typed = readers.read_csv_typed(spark, f"{tmp_path}/b.csv", "id string, title string, descr string, genres string", ("genres",))
    assert typed.orderBy("title").first()["genres"] == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_dataset(spark, f"{tmp_path}/a.txt", "id", "title", "descr")
    with pytest.raises(ValueError):
        readers.read_dataset(spark, f"{tmp_path}/a.parquet", "id", "title", "none")
    assert readers.read_existing(spark, [f"{tmp_path}/a.parquet", f"{tmp_path}/none.parquet"]).count() == 2
    with pytest.raises(ValueError):
        readers.read_existing(spark, [f"{tmp_path}/none.parquet"])
    assert readers.read_catalogue(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "c.json").write_text('[{"a": {"b": 1, "c": {"d": 2}}}]')
    assert readers.flatten(readers.read_json_array(spark, f"{tmp_path}/c.json")).columns == ["a_b", "a_c_d"]


def test_paged_source(spark):
    assert readers.page_of(45, 20) == (3, 5)
    spark.dataSource.register(readers.paged_source("fake_pages", "page int, item int", lambda p: [(p, k) for k in range(3)], 4))
    df = spark.read.format("fake_pages").load()
    assert df.count() == 12 and df.rdd.getNumPartitions() == 4


def test_stream_resumes_where_it_ended(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(5).select(F.col("id").alias("media_id")).write.parquet(f"{source}/a")
    start = lambda: ingest.ingest(ingest.read_files(spark, f"{source}/*", "media_id long"), lambda b: b.withColumn("media_id", F.when(F.col("media_id") != 3, F.col("media_id"))), f"{tmp_path}/t", f"{tmp_path}/c", f"{tmp_path}/dead")
    assert ingest.ingest_all({"a": start, "b": lambda: 1 / 0}) == {"a": "done", "b": "failed: division by zero"}
    spark.range(5, 8).select(F.col("id").alias("media_id")).write.parquet(f"{source}/b")
    for _ in range(2):
        start().awaitTermination()
    assert sorted(r["media_id"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [0, 1, 2, 4, 5, 6, 7]
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 1


# vectors


def test_neighbours(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(16)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = rows[7][1]
    exact = [r["vec_id"] for r in vectors.nearest(df, q, 10).collect()]
    assert exact[0] == 7 and len(set(exact)) == 10
    assert value(spark, similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert len(similarity.mock_embedding("a", 8)) == 8 and similarity.mock_embedding("a", 8) == similarity.mock_embedding("a", 8)


def brute_neighbours(rows, asked, k):
    """(query, row, place) by plain cosines; ties go to the lower id."""
    import math

    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) or 1)
    out = set()
    for i, q in asked:
        best = sorted(((-round(cosine(q, v), 9), j) for j, v in rows if j != i and v is not None))[:k]
        out |= {(i, j, place) for place, (_, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_batches_of_neighbours_equal_brute_force(spark, limit):
    """Ties, equal vectors, vectors of no length and null ones; queries in one chunk and in many."""
    rng = random.Random(4)
    rows = [(k, [float(rng.randint(-3, 3)) for _ in range(4)]) for k in range(120)] + [(500, [1.0, 2.0, 3.0, 1.0]), (501, [1.0, 2.0, 3.0, 1.0]), (502, [0.0] * 4), (503, None)]
    asked = [*rows[:10], rows[120], rows[122]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([*asked, (9, None)], "query_id long, query array<float>")
    got = {(r["query_id"], r["vec_id"], r["place"]) for r in vectors.nearest_batch(df, queries, 5, limit=limit).collect()}
    assert got == brute_neighbours(rows, asked, 5)
    assert vectors.nearest_batch(df, queries.where("false"), 5).collect() == []
    assert vectors.nearest_batch(df.where("false"), queries, 5).collect() == []


@pytest.mark.parametrize("shape", ["random", "clusters"])
def test_index_recall(spark, tmp_path, shape, monkeypatch):
    """All rows are indexed, and every row whose id is divisible by 20 finds 0.9 of its neighbours or more."""
    monkeypatch.setattr("spindrift.operators.keyed.FILE_ROWS", 40)
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    make = lambda: [rng.gauss(0, 1) for _ in range(16)] if shape == "random" else [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]
    rows = [(k, make()) for k in range(1500)] + [(k, [1.0] * 16) for k in range(1500, 1900)]  # a hot cell
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors.build_index(df, str(tmp_path))
    assert keyed.read(spark, f"{tmp_path}/rows").count() == len(rows)
    asked = df.where("vec_id % 20 = 0 and vec_id < 1500").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    true = {(r["query_id"], r["vec_id"]) for r in vectors.nearest_batch(df, asked, 10).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in vectors.search_index(spark, str(tmp_path), asked, 10).collect()}
    assert len(true & got) >= 0.9 * len(true)
    cells = spark.read.parquet(f"{tmp_path}/cells").collect()
    if shape == "clusters":
        assert cells[0]["probes"] < len(cells) / 2
    hot = [(r["vec_id"], r["place"]) for r in vectors.search_index(spark, str(tmp_path), spark.createDataFrame([(1500, [1.0] * 16)], "query_id long, query array<double>"), 3).collect()]
    assert sorted(hot) == [(1501, 1), (1502, 2), (1503, 3)]


def test_index_recall_of_the_registered_query(spark):
    d = "/root/testdata/sf0.01"
    table = catalogue.table(spark, d, "embeddings")
    asked = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    true = {(r["query_id"], r["vec_id"]) for r in vectors.nearest_batch(table, asked, 10).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in catalogue.vector_knn_approximate(spark, d).collect()}
    assert len(true & got) >= 0.9 * len(true) and {q for q, _ in got} == {q for q, _ in true}


# services, limits and upkeep


def test_calls_of_the_services():
    assert services.list_ranking("airing", size=50).page(2).url().startswith("https://api.myanimelist.net/v2/anime/ranking?ranking_type=airing&fields=id%2Ctitle")
    assert services.list_ranking(size=50).page(2).params["offset"] == 100 and services.screen_popular().page(2).params["page"] == 3
    for bad in (lambda: services.list_ranking("best"), lambda: services.list_season(2020, "autumn")):
        with pytest.raises(ValueError):
            bad()
    filtered = services.manga_filtered(demographic=["seinen"], status=["ongoing"]).params
    assert filtered["publicationDemographic[]"] == ["seinen"] and filtered["contentRating[]"] == ["safe", "suggestive"] and "originalLanguage[]" not in filtered
    film = services.screen_filtered(region="KR", certification="R", votes=5, low=2.5, genres=[1, 2], year=2001).params
    assert film["certification.lte"] == "R" and film["certification_country"] == "KR" and film["with_genres"] == "1,2" and film["primary_release_year"] == 2001 and "vote_average.lte" not in film
    assert "certification.lte" not in services.screen_filtered("tv", certification="R", year=2001).params and services.screen_filtered("tv", year=2001).params["first_air_date_year"] == 2001


def test_services_are_read_page_by_page(spark, tmp_path):
    """Recorded answers of three pages, read by two tasks and normalised; what a service refuses is an error, unless the call is lenient."""
    call = services.list_search("red", size=2)
    for k in range(3):
        answer = {"data": [{"node": {"id": 10 * k + i, "title": f"T{k}{i}", "media_type": "tv", "mean": 7.5}} for i in range(2)]}
        (tmp_path / services.recorded(call.page(k))).write_text(json.dumps(answer))
    got = services.read(spark, call, services.fixtures(str(tmp_path)), pages=4, tasks=2)
    node = "node struct<id: long, title: string, media_type: string, mean: double>"
    out = normalize.list_service(got.select(F.from_json("record", node).alias("r")).select("r.*"), "anime")
    assert sorted(r["media_id"] for r in out.collect()) == sorted(f"anime-{10 * k + i}" for k in range(3) for i in range(2))
    stats = services.manga_statistics("x")
    (tmp_path / services.recorded(stats)).write_text('{"statistics": {"x": {"follows": 3}}}')
    assert services.read(spark, stats, services.fixtures(str(tmp_path))).first()["record"] == '{"follows": 3}'

    def refuse(call):
        raise LookupError("403")

    assert services.read(spark, services.list_suggestions(), refuse).collect() == []
    with pytest.raises(Exception, match="403"):
        services.read(spark, services.screen_popular(), refuse).collect()


def test_token_bucket_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = limits.TokenBucket(2, 1, clock=lambda: now[0], sleep=sleep)
    assert [bucket.acquire() for _ in range(4)] == [0, 0, 0.5, 0.5]
    now[0] += 10
    assert [bucket.acquire() for _ in range(3)] == [0, 0, 0.5]
    tries = []

    def failing():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return "done"

    waits = []
    assert limits.retried(failing, sleep=waits.append) == "done" and waits == [2, 2]
    with pytest.raises(ConnectionError):
        limits.retried(lambda: (_ for _ in ()).throw(ConnectionError()), sleep=waits.append)
    with pytest.raises(ValueError):
        limits.retried(lambda: int("x"), sleep=lambda s: pytest.fail("a data error is not retried"))


def test_checkpoint_upkeep(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "checkpoints")
    spark.range(5).select(F.col("id").alias("media_id")).write.parquet(f"{source}/a")
    stream = ingest.read_files(spark, f"{source}/*", "media_id long")
    ingest.ingest(stream, lambda b: b, str(tmp_path / "t"), f"{root}/one").awaitTermination()
    found = checkpoints.listed(spark, root)
    assert [(i.name, i.begun, i.finished, i.valid) for i in found] == [("one", 0, 0, True)] and 0 <= found[0].age_hours < 1
    assert checkpoints.fresh(spark, f"{root}/one", 1) and not checkpoints.fresh(spark, f"{root}/one", -1)
    (tmp_path / "checkpoints/one/metadata").write_text("{}")
    assert checkpoints.info(spark, f"{root}/one").problems == ("unreadable metadata",)
    (tmp_path / "checkpoints/one/.metadata.crc").unlink()
    assert checkpoints.info(spark, f"{root}/one").problems == ("metadata without an id",)
    assert checkpoints.clear(spark, f"{root}/one") and not checkpoints.clear(spark, f"{root}/one")
    assert checkpoints.listed(spark, root) == [] == checkpoints.listed(spark, str(tmp_path / "nowhere"))
    assert checkpoints.info(spark, f"{root}/one").problems == ("no metadata",)


def test_results_are_kept_and_the_least_used_go(spark, tmp_path):
    store = cache.ResultCache(spark, str(tmp_path), entries=2)
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert [store.get(k, lambda n=n: make(n)).count() for k, n in (("a", 1), ("b", 2), ("a", 9), ("c", 3), ("b", 4))] == [1, 2, 1, 3, 4]
    assert made == [1, 2, 3, 4] and (store.hits, store.misses) == (1, 4)
    assert cache.ResultCache(spark, str(tmp_path)).get("c", lambda: make(0)).count() == 3
    store.clear()
    assert list(tmp_path.iterdir()) == []


def test_a_job_runs_once_at_a_time():
    import threading

    go = threading.Event()
    job = jobs.Job("index", go.wait)
    assert job.status()["state"] == "idle"
    job.start()
    with pytest.raises(jobs.AlreadyRunning):
        job.start()
    assert job.status()["state"] == "running"
    go.set()
    job.wait()
    assert job.status()["state"] == "done"
    job = jobs.Job("bad", lambda: 1 / 0)
    job.start()
    job.wait()
    assert job.status() == {"name": "bad", "state": "failed", "error": "division by zero"}


def test_over_fetching():
    assert [recommend.over_fetched(10, w) for w in ("hybrid", "filtered", "combined", "title", "cross_media")] == [50, 30, 20, 11, 20] and recommend.over_fetched(80, "hybrid") == 80


# deduplication


def plain_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], (last + 1 if x == y else max(row[k], row[k - 1]))
    return round(200 * row[-1] / (len(a) + len(b))) if a and b else 0


def titles(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 30))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice("abcdeXYZ")
        out.append("".join(t))
    return out


def test_ratio_equals_the_plain_recurrence():
    t = titles(1, 200)
    assert all(similarity.ratio(a, b) == plain_ratio(a, b) for a, b in zip(t, reversed(t), strict=True))
    assert similarity.title_similarity("B a", "a  b!") == 100 and similarity.title_similarity("日本", "日木") == 50


def test_title_pairs_lose_none(spark):
    t = sorted(set(titles(2, 300)))
    got = {(r["a"], r["b"], r["ratio"]) for r in dedup.title_pairs(spark.createDataFrame([(x,) for x in t], "title string")).collect()}
    assert got == {(a, b, plain_ratio(a, b)) for k, a in enumerate(t) for b in t[k + 1 :] if plain_ratio(a, b) >= 90}


@pytest.mark.parametrize("percent", [90, 86, 75])
def test_long_and_short_title_pairs_lose_none(spark, percent):
    """Lengths on both sides of where longer grams are used."""
    rng = random.Random(8)
    t = []
    for n in [1, 2, 3, 5, 8, 9, 10, 11, 12, 15, 40, 55, 58, 60, 62, 66, 75, 90, 200]:
        base = [rng.choice("abcdefg ") for _ in range(n)]
        for _ in range(8):
            x = list(base)
            for _ in range(rng.randint(0, max(1, n // 6))):
                k = rng.randrange(len(x)) if x else 0
                x[k : k + 1] = rng.choice([[], [rng.choice("abcdefg")], [rng.choice("abcdefg"), rng.choice("xyz")]])
            t.append("".join(x))
    t = sorted(set(filter(None, t)))
    got = {(r["a"], r["b"]) for r in dedup.title_pairs(spark.createDataFrame([(x,) for x in t], "title string"), percent).collect()}
    assert got == {(a, b) for k, a in enumerate(t) for b in t[k + 1 :] if plain_ratio(a, b) >= percent}


def test_fuzzy_dedup_equals_the_greedy_loop(spark):
    rng = random.Random(3)
    rows = [(k, x, rng.choice([None, 1.0, 2.0, 3.0])) for k, x in enumerate(titles(4, 160))] + [(900, None, 9.0), (901, None, 9.0), (902, "", 1.0)]
    order = sorted((r for r in rows if r[1]), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    gone = set()
    for i, a in enumerate(order):
        if a[0] not in gone:
            gone |= {b[0] for b in order[i + 1 :] if b[0] not in gone and plain_ratio(a[1].lower(), b[1].lower()) >= 90}
    got = dedup.fuzzy_dedup(spark.createDataFrame(rows, "media_id int, title string, score double"))
    assert sorted(r["media_id"] for r in got.collect()) == sorted(r[0] for r in rows if r[0] not in gone)


def sequential(rows):
    """Ids that the cross-source rule keeps of rows (id, title, type, source, score, date), in order, each against all later ones."""
    place = {"mal": 0, "tmdb": 1, "mangadex": 2}
    gone = set()
    for i, a in enumerate(rows):
        if a[0] in gone:
            continue
        for b in rows[i + 1 :]:
            if b[0] in gone or (a[2] or "unknown") != (b[2] or "unknown") or not a[1] or not b[1]:
                continue
            title = 100 if a[1].lower() == b[1].lower() else similarity.title_similarity(a[1], b[1])
            if a[5] and b[5]:
                title = 0.7 * title + 0.3 * {0: 100, 1: 80, 2: 50}.get(abs(int(a[5][:4]) - int(b[5][:4])), 0)
            if title >= 90:
                pa, pb = place.get(a[3], 3), place.get(b[3], 3)
                gone.add(b[0] if (pa < pb if pa != pb else (a[4] or 0) >= (b[4] or 0)) else a[0])
    return [r[0] for r in rows if r[0] not in gone]


RECORD = "title string, media_type string, source string, score double, release_date string"


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_cross_source_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(k, x, rng.choice(["tv", "movie", None]), rng.choice(["mal", "tmdb", "mangadex", "odd", None]), rng.choice([None, 1.0, 2.0, 3.0, 4.0]), rng.choice(["2000-01", "2001", "2002", None])) for k, x in enumerate([*titles(6, 90), *["Untitled", "untitled"] * 30, *["Untitled 2"] * 20, "", "", None])]
    got = dedup.cross_source_dedup(spark.createDataFrame(rows, f"media_id int, {RECORD}"))
    assert sorted(r["media_id"] for r in got.collect()) == sequential(rows)
    named = [(f"tv-{k:05d}", *r) for k, *r in rows]
    got = dedup.cross_source_dedup(spark.createDataFrame(named, f"media_id string, {RECORD}"))
    assert sorted(r["media_id"] for r in got.collect()) == sequential(named)


@pytest.mark.parametrize("rising", [False, True])
def test_equal_titles_make_no_pairs(spark, rising):
    """20,000 records of one title with different scores, linked with another title: a pair of each would be 2 * 10**8."""
    spread = [(k, "The long way home" if k % 2 else "The long way home!", "tv", "mal", float(k if rising else k * 7919 % 20_011), "2001") for k in range(20_000)]
    got = dedup.cross_source_dedup(spark.createDataFrame(spread, f"media_id int, {RECORD}"))
    assert [r["media_id"] for r in got.collect()] == [max(spread, key=lambda r: (r[4], -r[0]))[0]]
    few = [(*r[:4], r[4] % 97, *r[5:]) for r in spread[:400]]
    got = dedup.cross_source_dedup(spark.createDataFrame(few, f"media_id int, {RECORD}"))
    assert sorted(r["media_id"] for r in got.collect()) == sequential(few)


def test_replay_equals_the_rule_on_random_graphs():
    """Heads alone against all records, on graphs of classes that aren't transitive."""
    for seed in range(300):
        rng = random.Random(seed)
        n = rng.randint(1, 6)
        links = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.4]
        rows = [(k, rng.randrange(n), (rng.randrange(2), rng.randrange(4))) for k in range(25)]
        match = {*links, *((b, a) for a, b in links), *((a, a) for a in range(n))}
        gone = set()
        for i, a in enumerate(rows):
            for b in rows[i + 1 :] if a[0] not in gone else []:
                if b[0] not in gone and (a[1], b[1]) in match:
                    gone.add(b[0] if a[2] <= b[2] else a[0])
        heads = [r for k, r in enumerate(rows) if all(q[2] > r[2] for q in rows[:k] if q[1] == r[1])]
        present = {c for _, c, _ in heads}
        assert dedup.replay(heads, [x for x in links if {*x} <= present]) == [r[0] for r in rows if r[0] not in gone]


@pytest.mark.parametrize(("apart", "least"), [(0, 86), (1, 95), (2, 108), (None, 90)])
def test_least_titles(apart, least):
    assert similarity.least_title(90, apart) == least


def test_title_pairs_make_no_row_for_each_pair_that_meets(spark, monkeypatch):
    """Titles in several blocks are all compared, without a join of what they share."""
    monkeypatch.setattr(dedup, "BLOCK", 7)
    rng = random.Random(8)
    stems = ["".join(rng.choices("abc ", k=rng.randint(8, 14))).strip() for _ in range(12)]
    titles = sorted({s[:k] + rng.choice("abcx") + s[k + 1 :] for s in stems for k in (1, 3, 5)})
    out = dedup.title_pairs(spark.createDataFrame([(t,) for t in titles], "title string"), 86)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {(a, b, similarity.ratio(a, b)) for i, a in enumerate(titles) for b in titles[i + 1 :] if similarity.ratio(a, b) >= 86}
    assert {tuple(r) for r in out.collect()} == want and want


def test_titles_of_like_letters_are_told_apart_many_at_once(spark, monkeypatch):
    """800 titles of the same syllables: only pairs that are nearly alike are measured one by one, and none is lost."""
    rng = random.Random(4)
    words = ["the", "thion", "er", "and", "ingly", "on", "hea", "st"]
    titles = sorted({" ".join(rng.choices(words, k=rng.choice([9, 9, 9, 24, 60, 90]) if n % 50 else 160)) for n in range(800)})
    titles += [t[:k] + "x" + t[k + 1 :] for t in titles[::40] for k in (2, len(t) // 2)]
    measured = []

    def counted(a):
        alike = similarity.subsequence_with(a)
        return lambda b: measured.append(1) or alike(b)

    monkeypatch.setattr(dedup, "subsequence_with", counted)
    part = pd.DataFrame({"title": titles, "kind": "", "year": dedup.UNKNOWN, "side": 0, "level": 1, "p": 0, "other": 1, "q": 0})
    got = {tuple(r) for r in dedup._met({None: 86})(part).itertuples(index=False)}
    met = [(a, b) for i, a in enumerate(sorted(titles)) for b in sorted(titles)[i + 1 :] if len(a) <= 1.4 * len(b) and len(b) <= 1.4 * len(a)]
    want = {(a, b, r) for a, b in met if (r := similarity.ratio(a, b)) >= 86}
    assert got == want and len(want) >= 20
    assert len(measured) < 0.05 * len(met)


def test_title_pairs_by_kind_and_years_apart(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 11)
    rng = random.Random(9)
    rows = [(k, t, rng.choice("ab"), rng.choice([2000, 2001, 2002, 2009, None])) for k, t in enumerate(titles(10, 160))]
    needs = {0: 80, 1: 90, None: 85, 2: 101, dedup.FAR: 100}
    df = spark.createDataFrame(rows, "id int, title string, kind string, year int")
    got = sorted(tuple(r) for r in dedup.title_pairs(df, needs).collect())
    want = []
    for i, (a, s, kind, year) in enumerate(rows):
        for b, t, other, there in rows[i + 1 :]:
            apart = None if None in (year, there) else abs(year - there)
            r = similarity.ratio(s, t)
            if kind == other and r >= needs.get(apart, needs[dedup.FAR]):
                want.append((a, b, r))
    assert got == sorted(want) and want


def test_components_are_replayed_in_several_calls(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HEADS", 3)
    rng = random.Random(12)
    rows = [(k, x, rng.choice(["tv", "movie"]), rng.choice(["mal", "tmdb", None]), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice(["2000", "2001", None])) for k, x in enumerate(titles(13, 120))]
    out = dedup.cross_source_dedup(spark.createDataFrame(rows, f"media_id int, {RECORD}"))
    assert sorted(r["media_id"] for r in out.collect()) == sequential(rows)
    assert "root" not in out._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInPandas")[1].split("[")[1].split("]")[0]
