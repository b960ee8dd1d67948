"""Genres, themes, demographics and statuses as expressions over fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, title_case

#: The vocabulary of each kind of tag.
GENRES = (
    "Action", "Adventure", "Avant Garde", "Award Winning", "Boys Love", "Comedy", "Drama", "Ecchi", "Erotica", "Fantasy", "Girls Love",
    "Gourmet", "Hentai", "Horror", "Mystery", "Romance", "Sci-Fi", "Slice of Life", "Sports", "Supernatural", "Suspense",
)
THEMES = (
    "Adult Cast", "Anthropomorphic", "CGDCT", "Childcare", "Combat Sports", "Crossdressing", "Delinquents", "Detective", "Educational",
    "Gag Humor", "Gore", "Harem", "High Stakes Game", "Historical", "Idols (Female)", "Idols (Male)", "Isekai", "Iyashikei", "Love Polygon",
    "Magical Sex Shift", "Mahou Shoujo", "Martial Arts", "Mecha", "Medical", "Military", "Music", "Mythology", "Organized Crime", "Otaku Culture",
    "Parody", "Performing Arts", "Pets", "Psychological", "Racing", "Reincarnation", "Reverse Harem", "Romantic Subtext", "Samurai", "School",
    "Showbiz", "Space", "Strategy Game", "Super Power", "Survival", "Team Sports", "Time Travel", "Vampire", "Video Game", "Visual Arts", "Workplace",
)
MANGA_THEMES = (*THEMES, "Memoir", "Villainess")
DEMOGRAPHICS = ("Josei", "Kids", "Seinen", "Shoujo", "Shounen")
ADULT = ("Hentai", "Erotica")

#: Each genre's synonyms.
SYNONYMS = {
    "Action": ("action", "martial arts"),
    "Adventure": ("adventure",),
    "Comedy": ("comedy", "parody"),
    "Drama": ("drama",),
    "Fantasy": ("fantasy", "isekai", "supernatural"),
    "Horror": ("horror", "psychological horror"),
    "Mystery": ("mystery", "detective", "thriller"),
    "Romance": ("romance", "romantic"),
    "Sci-Fi": ("sci-fi", "science fiction", "mecha", "space"),
    "Slice Of Life": ("slice of life", "iyashikei"),
    "Sports": ("sports",),
}

#: Raw statuses by the status they stand for.
STATUSES = {
    "completed": ("finished_airing", "finished", "completed"),
    "ongoing": ("currently_airing", "currently_publishing", "ongoing"),
    "upcoming": ("not_yet_aired", "not_yet_published", "upcoming"),
    "hiatus": ("on_hiatus", "hiatus"),
    "cancelled": ("cancelled", "discontinued"),
}


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """The table's value for a key; the default (null if None) where it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def _inverted(groups: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {v: k for k, vs in groups.items() for v in vs}


def status(raw: Column) -> Column:
    """The unified status; another word stays, lower-cased; blank and null are unknown."""
    key = strip(F.lower(raw))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit("unknown")).otherwise(lookup(key, _inverted(STATUSES), key))


def source_status(raw: Column) -> Column:
    """The six statuses that the list source uses; others pass as they are."""
    own = {v: k for k, vs in STATUSES.items() if k in ("completed", "ongoing", "upcoming") for v in vs if v != k}
    return lookup(raw, own, raw)


def clean_genres(genres: Column) -> Column:
    """Trimmed, title-cased, distinct in order, none empty."""
    return F.array_distinct(F.filter(F.transform(genres, lambda g: title_case(strip(g))), lambda g: g.isNotNull() & (g != "")))


def normal_genres(genres: Column) -> Column:
    """As clean_genres, but synonyms go to their genre first."""
    table = _inverted(SYNONYMS)
    named = F.transform(genres, lambda g: lookup(strip(F.lower(g)), table, title_case(strip(g))))
    return F.array_distinct(F.filter(named, lambda g: g.isNotNull() & (g != "")))


def members(tags: Column, vocabulary: tuple[str, ...]) -> Column:
    """The tags that are in a vocabulary, in order, repeats kept."""
    words = F.array(*map(F.lit, vocabulary))
    return F.filter(tags, lambda t: F.array_contains(words, t))


def split_tags(tags: Column, manga: bool = False) -> Column:
    """A struct of genres, themes and demographics."""
    return F.struct(
        members(tags, GENRES).alias("genres"), members(tags, MANGA_THEMES if manga else THEMES).alias("themes"), members(tags, DEMOGRAPHICS).alias("demographics")
    )


def safe_for_work(genres: Column) -> Column:
    return ~F.arrays_overlap(genres, F.array(*map(F.lit, ADULT)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty or null."""
    some = (F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(b, F.array().cast("array<string>"))) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))
