"""Records of each service to the canonical record: one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.taxonomy import lookup, source_status

#: The tag ids of the manga service, the genre ids of the film service, demographics, urls.
TAGS = {
    "391b0423-d847-456f-aff0-8b0cfc03066b": "Action",
    "87cc87cd-a395-47af-b27a-93258283bbc6": "Adventure",
    "5920b825-4181-4a17-beeb-9918b0ff7a30": "Boys Love",
    "4d32cc48-9f00-4cca-9b5a-a839f0764984": "Comedy",
    "b9af3a63-f058-46de-a9a0-e0c13906197a": "Drama",
    "cdc58593-87dd-415e-bbc0-2ec27bf404cc": "Fantasy",
    "a3c67850-4684-404e-9b7f-c69850ee5da6": "Girls Love",
    "3e2b8dae-350e-4ab8-a8ce-016e844b9f0d": "Historical",
    "cdad7e68-1419-41dd-bdce-27753074a640": "Horror",
    "ace04993-3797-43da-b767-b0a25f89f4b7": "Isekai",
    "acc803a4-c95a-4c22-86fc-eb6b582d82a2": "Martial Arts",
    "50880a9d-5440-4732-9afb-8f457127e836": "Mecha",
    "ee968100-4191-4968-93d3-f82d72be7e46": "Medical",
    "489dd859-9b61-4c37-af75-5b18e88daafc": "Music",
    "92d6d951-ca5e-429c-ac78-451071cbf064": "Mystery",
    "0234a31e-a729-4e28-9d6a-3f87c4966b9e": "Psychological",
    "423e2eae-a7a2-4a8b-ac03-a8351462d71d": "Romance",
    "256c8bd9-4904-4360-bf4f-508a76d67183": "Sci-Fi",
    "e5301a23-ebd9-49dd-a0cb-2add944c7fe9": "Slice of Life",
    "69964a64-2f90-4d33-beeb-f3ed2875eb4c": "Sports",
    "eabc5b4c-6aff-42f3-b657-3e90cbd00b75": "Supernatural",
    "f8f62932-27da-4fe4-8ee1-6779a8c5edba": "Thriller",
}
SCREEN_GENRES = {
    28: "Action", 12: "Adventure", 16: "Animation", 35: "Comedy", 80: "Crime", 99: "Documentary", 18: "Drama", 10751: "Family", 14: "Fantasy",
    36: "History", 27: "Horror", 10402: "Music", 9648: "Mystery", 10749: "Romance", 878: "Sci-Fi", 10770: "TV Movie", 53: "Thriller", 10752: "War",
    37: "Western", 10759: "Action & Adventure", 10762: "Kids", 10763: "News", 10764: "Reality", 10765: "Sci-Fi & Fantasy", 10766: "Soap",
    10767: "Talk", 10768: "War & Politics",
}
READERS = {"shounen": "Shounen", "shoujo": "Shoujo", "seinen": "Seinen", "josei": "Josei"}
COVERS, POSTERS = "https://uploads.mangadex.org/covers/", "https://image.tmdb.org/t/p/w500"


def names(items: Column) -> Column:
    """The names of a list of structs, empty and null ones left out; no list gives an empty one."""
    return F.coalesce(F.filter(F.transform(items, lambda x: x["name"]), lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>"))


def authors(items: Column) -> Column:
    """(name, role) of a list of nodes with first and last names, nameless ones left out."""
    one = lambda x: F.struct(F.trim(F.concat(F.coalesce(x["node"]["first_name"], F.lit("")), F.lit(" "), F.coalesce(x["node"]["last_name"], F.lit("")))).alias("name"), x["role"].alias("role"))
    return F.filter(F.transform(items, one), lambda a: a["name"] != "")


def picture(large: Column, medium: Column) -> Column:
    return F.coalesce(F.nullif(large, F.lit("")), medium)


def unsafe(flag: Column) -> Column:
    return F.coalesce(flag, F.lit("white")).isin("gray", "black")


def list_service(df: DataFrame, kind: str) -> DataFrame:
    """Records of the list service: a struct column `node`; kind is anime or manga."""
    n = lambda c: F.col(f"node.{c}")
    have = set(df.schema["node"].dataType.names)
    opt = lambda c, t: n(c) if c in have else F.lit(None).cast(t)
    shared = {
        "source": F.lit("mal"), "original_id": n("id"), "rank": opt("rank", "int"), "popularity": opt("popularity", "int"), "num_list_users": opt("num_list_users", "bigint"),
        "num_scoring_users": opt("num_scoring_users", "bigint"), "nsfw": unsafe(opt("nsfw", "string")), "sfw": ~unsafe(opt("nsfw", "string")),
        "title_english": F.nullif(n("alternative_titles")["en"], F.lit("")) if "alternative_titles" in have else F.lit(None).cast("string"),
        "title_japanese": F.nullif(n("alternative_titles")["ja"], F.lit("")) if "alternative_titles" in have else F.lit(None).cast("string"),
        "title_synonyms": F.coalesce(n("alternative_titles")["synonyms"], F.array().cast("array<string>")) if "alternative_titles" in have else F.array().cast("array<string>"),
        "end_date": opt("end_date", "string"), "source_material": opt("source", "string"), "rating": opt("rating", "string"),
    }
    if kind == "anime":
        season = F.col("node.start_season") if "start_season" in have else None
        aired = F.col("node.broadcast") if "broadcast" in have else None
        own = {
            "episodes": opt("num_episodes", "int"), "studios": names(n("studios")) if "studios" in have else F.array().cast("array<string>"),
            "season": season["season"] if season is not None else F.lit(None).cast("string"), "year": season["year"] if season is not None else F.lit(None).cast("int"),
            "average_episode_duration": opt("average_episode_duration", "int"),
            "broadcast_day": aired["day_of_the_week"] if aired is not None else F.lit(None).cast("string"), "broadcast_time": aired["start_time"] if aired is not None else F.lit(None).cast("string"),
        }
    else:
        own = {"chapters": opt("num_chapters", "int"), "volumes": opt("num_volumes", "int"), "authors": authors(n("authors")) if "authors" in have else F.lit(None)}
    return df.select(
        F.concat(F.lit(f"{kind}-"), n("id").cast("string")).alias("media_id"), n("title").alias("title"), opt("synopsis", "string").alias("synopsis"),
        (picture(n("main_picture")["large"], n("main_picture")["medium"]) if "main_picture" in have else F.lit(None).cast("string")).alias("main_picture"),
        opt("mean", "double").alias("score"), (names(n("genres")) if "genres" in have else F.array().cast("array<string>")).alias("genres"), F.lit(kind).alias("media_type"),
        (F.upper(opt("media_type", "string")) if kind == "anime" else F.lit(None).cast("string")).alias("sub_type"), source_status(opt("status", "string")).alias("status"),
        opt("start_date", "string").alias("release_date"), F.struct(*(c.alias(k) for k, c in (shared | own).items())).alias("metadata"),
        F.lit("mal").alias("source"), n("id").cast("string").alias("source_id"),
    )


def best_title(titles: Column) -> Column:
    """English, romanised, Japanese, else the first: by whether the key is there."""
    out = F.coalesce(F.try_element_at(F.map_values(titles), F.lit(1)), F.lit("Unknown Title"))
    for language in ("ja", "ja-ro", "en"):
        out = F.when(F.map_contains_key(titles, language), titles[language]).otherwise(out)
    return out


def best_synopsis(descriptions: Column) -> Column:
    return F.when(F.map_contains_key(descriptions, "en"), descriptions["en"]).otherwise(F.try_element_at(F.map_values(descriptions), F.lit(1)))


def manga_service(df: DataFrame) -> DataFrame:
    """Records of the manga service: id, attributes, relationships. It gives no scores."""
    a = lambda c: F.col(f"attributes.{c}")
    covers = F.filter("relationships", lambda r: (r["type"] == "cover_art") & (F.coalesce(r["attributes"]["fileName"], F.lit("")) != ""))
    cover = F.concat(F.lit(COVERS), F.col("id"), F.lit("/"), F.get(covers, F.lit(0))["attributes"]["fileName"], F.lit(".512.jpg"))
    makers = F.filter("relationships", lambda r: r["type"].isin("author", "artist"))
    rating = F.coalesce(a("contentRating"), F.lit("safe"))
    genres = F.array_distinct(F.array_compact(F.transform(a("tags"), lambda t: lookup(t["id"], TAGS))))
    metadata = F.struct(
        F.lit("mangadex").alias("source"), F.col("id").alias("original_id"), F.array_distinct(names(F.transform(makers, lambda r: F.struct(r["attributes"]["name"].alias("name"))))).alias("authors"),
        rating.alias("content_rating"), rating.isin("safe", "suggestive").alias("sfw"), a("publicationDemographic").alias("demographic"), a("originalLanguage").alias("original_language"),
    )
    return df.select(
        F.concat(F.lit("manga-"), "id").alias("media_id"), best_title(a("title")).alias("title"), best_synopsis(a("description")).alias("synopsis"), cover.alias("main_picture"),
        F.lit(None).cast("double").alias("score"), genres.alias("genres"), F.lit("manga").alias("media_type"),
        lookup(a("publicationDemographic"), READERS, F.lit("Manga")).alias("sub_type"), F.coalesce(a("status"), F.lit("unknown")).alias("status"),
        F.nullif(a("year"), F.lit(0)).cast("string").alias("release_date"), metadata.alias("metadata"), F.lit("mangadex").alias("source"), F.col("id").alias("source_id"),
    )


def genre_names(ids: Column) -> Column:
    """The film service's genre ids as names, unknown ones left out."""
    return F.array_compact(F.transform(ids, lambda i: lookup(i, SCREEN_GENRES)))


def screen_sub_type(kind: str, origin: Column) -> Column:
    if kind == "movie":
        return F.lit("Movie")
    out = F.lit("TV Series")
    for country, name in (("CN", "C-Drama"), ("JP", "J-Drama"), ("KR", "K-Drama")):
        out = F.when(F.array_contains(origin, country), F.lit(name)).otherwise(out)
    return out


def first_cast(cast: Column, n: int = 5) -> Column:
    """Names among the first n members; a nameless one takes up its place."""
    return names(F.slice(cast, 1, n))


def screen_service(df: DataFrame, kind: str) -> DataFrame:
    """Records of the film service; kind is movie or tv. Genre ids stand in as text where there are no genres."""
    have = set(df.columns)
    opt = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    movie = kind == "movie"
    listed = names(F.col("genres")) if "genres" in have else F.array().cast("array<string>")
    genres = F.when(F.size(listed) > 0, listed).otherwise(F.coalesce(opt("genre_ids", "array<int>").cast("array<string>"), F.array().cast("array<string>")))
    path = opt("poster_path", "string")
    origin = F.coalesce(opt("origin_country", "array<string>"), F.array().cast("array<string>"))
    own = {"runtime": opt("runtime", "int")} if movie else {"number_of_seasons": opt("number_of_seasons", "int"), "number_of_episodes": opt("number_of_episodes", "int")}
    if "credits" in have:
        own["cast"] = first_cast(F.col("credits.cast"))
    shared = {
        "source": F.lit("tmdb"), "original_id": F.col("id"), "original_title": F.coalesce(F.nullif(opt("original_title", "string"), F.lit("")), opt("original_name", "string")),
        "original_language": opt("original_language", "string"), "origin_country": origin, "popularity": opt("popularity", "double"), "vote_count": opt("vote_count", "int"),
        "adult": F.coalesce(opt("adult", "boolean"), F.lit(False)),
    }
    return df.select(
        F.concat(F.lit(f"{kind}-"), F.col("id").cast("string")).alias("media_id"), opt("title" if movie else "name", "string").alias("title"), opt("overview", "string").alias("synopsis"),
        F.when(path != "", F.concat(F.lit(POSTERS), path)).alias("main_picture"), opt("vote_average", "double").alias("score"), genres.alias("genres"), F.lit(kind).alias("media_type"),
        screen_sub_type(kind, origin).alias("sub_type"), F.coalesce(opt("status", "string"), F.lit("unknown")).alias("status"),
        opt("release_date" if movie else "first_air_date", "string").alias("release_date"), F.struct(*(c.alias(k) for k, c in (shared | own).items())).alias("metadata"),
        F.lit("tmdb").alias("source"), F.col("id").cast("string").alias("source_id"),
    )
