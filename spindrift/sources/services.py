"""The catalogue services as data sources: what can be asked of each, and a table of the answers' records.

A Call is one question, with its filters as parameters, so the service does the filtering. read() spreads a call's
pages over tasks; each asks at its share of the service's rate and retries what fails in passing. Records come as JSON
text, for from_json and the service's normaliser. A transport is what fetches a call: http() does, fixtures() reads
recorded answers from a folder."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .limits import TokenBucket, retried

#: Each service's address and its rate of calls in seconds.
BASE = {"list": "https://api.myanimelist.net/v2", "manga": "https://api.mangadex.org", "screen": "https://api.themoviedb.org/3"}
RATE = {"list": (10, 1), "manga": (5, 1), "screen": (40, 10)}
#: What rankings and seasons there are, fields that records come with, and the manga service's defaults.
RANKINGS = ("all", "airing", "upcoming", "tv", "movie", "ova", "special", "bypopularity", "favorite")
SEASONS = ("winter", "spring", "summer", "fall")
FIELDS = "id,title,main_picture,alternative_titles,start_date,end_date,synopsis,mean,rank,popularity,num_list_users,num_scoring_users,nsfw,genres,created_at,updated_at,media_type,status"
ANIME_FIELDS = "num_episodes,start_season,broadcast,source,average_episode_duration,rating,studios"
MANGA_FIELDS = "num_volumes,num_chapters,authors"
PARTS, SAFE = ["cover_art", "author", "artist"], ["safe", "suggestive"]


@dataclass(frozen=True)
class Call:
    """A question to a service. records is the way to the records in an answer (none: the answer is the record); a call
    without a page size has one answer; a lenient one has no records where the service refuses it."""

    service: str
    path: str
    params: dict = field(default_factory=dict)
    records: tuple[str, ...] = ()
    size: int = 0
    by_page: bool = False
    lenient: bool = False

    def page(self, number: int) -> Call:
        """The call for one of its pages, from 0."""
        if not self.size:
            return self
        place = {"page": number + 1} if self.by_page else {"limit": self.size, "offset": number * self.size}
        return replace(self, params=self.params | place)

    def url(self) -> str:
        query = urllib.parse.urlencode(self.params, doseq=True)
        return f"{BASE[self.service]}{self.path}" + f"?{query}" * bool(query)


def _given(**values) -> dict:
    return {k: v for k, v in values.items() if v not in (None, "", [], ())}


def _fields(kind: str) -> dict:
    return {"fields": f"{FIELDS},{ANIME_FIELDS if kind == 'anime' else MANGA_FIELDS}"}


def list_search(text: str, kind: str = "anime", size: int = 100) -> Call:
    return Call("list", f"/{kind}", {"q": text} | _fields(kind), ("data",), size)


def list_item(item: int, kind: str = "anime") -> Call:
    return Call("list", f"/{kind}/{item}", _fields(kind))


def list_ranking(ranking: str = "all", kind: str = "anime", size: int = 100) -> Call:
    if ranking not in RANKINGS:
        raise ValueError(f"no ranking {ranking}")
    return Call("list", f"/{kind}/ranking", {"ranking_type": ranking} | _fields(kind), ("data",), size)


def list_season(year: int, season: str, size: int = 100) -> Call:
    if season not in SEASONS:
        raise ValueError(f"no season {season}")
    return Call("list", f"/anime/season/{year}/{season}", _fields("anime"), ("data",), size)


def list_suggestions(kind: str = "anime", size: int = 100) -> Call:
    return Call("list", f"/{kind}/suggestions", _fields(kind), ("data",), size, lenient=True)


def manga_search(text: str, size: int = 100) -> Call:
    return Call("manga", "/manga", {"title": text, "includes[]": PARTS, "contentRating[]": SAFE, "order[relevance]": "desc"}, ("data",), size)


def manga_item(item: str) -> Call:
    return Call("manga", f"/manga/{item}", {"includes[]": PARTS}, ("data",))


def manga_filtered(demographic=None, language=None, rating=None, status=None, chapters: bool = True, size: int = 100) -> Call:
    """The most followed manga of the given demographics, languages, ratings (safe ones, if none) and statuses."""
    lists = {"publicationDemographic[]": demographic, "originalLanguage[]": language, "contentRating[]": rating or SAFE, "status[]": status}
    return Call("manga", "/manga", {"includes[]": PARTS, "order[followedCount]": "desc"} | _given(**lists) | ({"hasAvailableChapters": "true"} if chapters else {}), ("data",), size)


def manga_popular(size: int = 100) -> Call:
    return manga_filtered(size=size)


def manga_statistics(item: str) -> Call:
    return Call("manga", f"/statistics/manga/{item}", {}, ("statistics", item))


def manga_author(author: str) -> Call:
    return Call("manga", f"/author/{author}", {}, ("data",))


#: The service's page size is its own.
SCREEN_PAGE = 20
ENGLISH = {"language": "en-US"}


def screen_search(text: str, kind: str = "movie") -> Call:
    return Call("screen", f"/search/{kind}", {"query": text} | ENGLISH, ("results",), SCREEN_PAGE, by_page=True)


def screen_item(item: int, kind: str = "movie") -> Call:
    return Call("screen", f"/{kind}/{item}", {"append_to_response": "credits"} | ENGLISH)


def screen_detailed(item: int, kind: str = "movie") -> Call:
    return Call("screen", f"/{kind}/{item}", {"append_to_response": "credits,keywords,watch/providers,videos,images"} | ENGLISH)


def screen_season(item: int, season: int) -> Call:
    return Call("screen", f"/tv/{item}/season/{season}", ENGLISH)


def screen_popular(kind: str = "movie") -> Call:
    return Call("screen", f"/{kind}/popular", ENGLISH, ("results",), SCREEN_PAGE, by_page=True)


def screen_filtered(kind="movie", language=None, region=None, certification=None, votes=0, low=0.0, high=10.0, genres=None, year=None) -> Call:
    """The most popular titles under the filters; certification is for films only."""
    params = {"sort_by": "popularity.desc"} | ENGLISH | _given(with_original_language=language, region=region, watch_region=region)
    if certification and kind == "movie":
        params |= {"certification_country": region or "US", "certification.lte": certification}
    bounds = {"vote_count.gte": votes if votes > 0 else None, "vote_average.gte": low if low > 0 else None, "vote_average.lte": high if high < 10 else None}
    named = {"with_genres": ",".join(map(str, genres or [])), "primary_release_year" if kind == "movie" else "first_air_date_year": year}
    return Call("screen", f"/discover/{kind}", params | _given(**bounds) | _given(**named), ("results",), SCREEN_PAGE, by_page=True)


def screen_dramas(country: str) -> Call:
    """Series of an Asian country with ten votes or more."""
    return Call("screen", "/discover/tv", {"with_origin_country": country, "sort_by": "popularity.desc", "vote_count.gte": 10} | ENGLISH, ("results",), SCREEN_PAGE, by_page=True)


Transport = Callable[[Call], dict]


def http(headers: dict[str, str] | None = None, timeout: float = 30) -> Transport:
    """Fetches calls over the network; a refusal for too many calls, or a service's failure, counts as a lost connection."""

    def fetch(call: Call) -> dict:
        request = urllib.request.Request(call.url(), headers=headers or {})  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise ConnectionError(str(e)) from e
            raise LookupError(f"{e.code}: {call.url()}") from e

    return fetch


def recorded(call: Call) -> str:
    """The name of the file that a call's answer is recorded in."""
    parts = [call.service, *call.path.strip("/").split("/"), *(str(call.params[k]) for k in ("q", "query", "title", "ranking_type", "page", "offset") if k in call.params)]
    return "-".join(urllib.parse.quote(p, safe="") for p in parts) + ".json"


def fixtures(folder: str) -> Transport:
    """Recorded answers; a call that isn't recorded has an empty one."""

    def fetch(call: Call) -> dict:
        path = Path(folder) / recorded(call)
        return json.loads(path.read_text()) if path.is_file() else {}

    return fetch


def records_of(call: Call, answer: dict) -> list:
    """An answer's records; an empty answer has none."""
    for name in call.records:
        answer = answer.get(name) or {}
    if isinstance(answer, list):
        return answer
    return [answer] if answer else []


class Pages(InputPartition):
    def __init__(self, numbers: list[int]) -> None:
        self.numbers = numbers


def source(name: str, call: Call, fetch: Transport, pages: int = 1, tasks: int = 1) -> type[DataSource]:
    """A data source of (page INT, place INT, record STRING) for spark.dataSource.register."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Pages(list(range(k, pages, tasks))) for k in range(min(tasks, pages))]

        def read(self, partition: Pages) -> Iterator[tuple]:
            rate, per = RATE[call.service]
            bucket = TokenBucket(max(1.0, rate / tasks), per * max(1.0, tasks / rate))
            for number in partition.numbers:
                asked = call.page(number)
                bucket.acquire()
                try:
                    found = records_of(asked, retried(lambda asked=asked: fetch(asked)))
                except (LookupError, ConnectionError, TimeoutError):
                    if not call.lenient:
                        raise
                    found = []
                for place, record in enumerate(found):
                    yield number, place, json.dumps(record, ensure_ascii=False)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "page int, place int, record string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    return Source


def read(spark: SparkSession, call: Call, fetch: Transport, pages: int = 1, tasks: int = 1) -> DataFrame:
    """(page, place, record) of a call's pages, dealt to `tasks` tasks that share the service's rate. A call without pages is one."""
    name = f"{call.service}_service"
    spark.dataSource.register(source(name, call, fetch, pages if call.size else 1, tasks))
    return spark.read.format(name).load()
