"""The canonical record, and helpers that bring a table to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The canonical columns and the extensions of each kind of record, as Spark types.
CANONICAL = {
    "media_id": "string", "title": "string", "synopsis": "string", "main_picture": "string", "score": "double", "genres": "array<string>",
    "media_type": "string", "sub_type": "string", "status": "string", "release_date": "string", "source": "string", "source_id": "string",
    "last_updated": "date", "schema_version": "string",
}
EXTENSIONS = {
    "anime": {"episodes": "int", "studios": "array<string>", "broadcast_day": "string", "season": "string", "year": "int", "airing_status": "string", "rating": "string", "duration_minutes": "int", "source_material": "string"},
    "manga": {"chapters": "int", "volumes": "int", "authors": "array<string>", "serialization": "string", "demographic": "string", "content_rating": "string", "original_language": "string", "publication_status": "string", "last_chapter": "string", "follows_count": "int"},
    "movie": {"runtime": "int", "budget": "bigint", "revenue": "bigint", "cast": "array<string>", "directors": "array<string>", "production_companies": "array<string>", "certification": "string"},
    "tv": {"number_of_seasons": "int", "number_of_episodes": "int", "cast": "array<string>", "origin_country": "array<string>"},
    "novel": {"chapters": "int", "volumes": "int", "authors": "array<string>"},
}
VERSION = "1.0"
RENAMED = {"mean": "score", "num_episodes": "episodes", "main_picture_large": "main_picture", "anime_id": "media_id", "id": "media_id"}


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns that it lacks, as nulls of their types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def ensure_lists(df: DataFrame, columns: tuple[str, ...] = ("genres", "studios", "authors")) -> DataFrame:
    """Null lists as empty ones."""
    return df.withColumns({c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in columns if c in df.columns})


def canonical(df: DataFrame, kind: str | None = None) -> DataFrame:
    """df with all canonical columns and those of a kind, records without id or title left out."""
    full = ensure_columns(df, CANONICAL | (EXTENSIONS[kind] if kind else {}))
    full = full.withColumns({"schema_version": F.coalesce("schema_version", F.lit(VERSION)), "status": F.coalesce("status", F.lit("unknown"))})
    return ensure_lists(full.where("media_id is not null and title is not null"))


def renamed(df: DataFrame) -> DataFrame:
    """Loaded columns under their canonical names; media_type is anime where there is none. The medium picture is used
    only where the whole large-picture column is null, found by an aggregate that is joined back."""
    names = {k: v for k, v in RENAMED.items() if k in df.columns and v not in df.columns}
    if "anime_id" in names and "id" in names:
        del names["id"]
    df = df.withColumnsRenamed(names)
    if "media_type" not in df.columns:
        df = df.withColumn("media_type", F.lit("anime"))
    if "main_picture_medium" not in df.columns:
        return df
    if "main_picture" not in df.columns:
        return df.withColumn("main_picture", F.col("main_picture_medium"))
    some = df.agg((F.count("main_picture") > 0).alias("_some"))  # one row
    return df.crossJoin(F.broadcast(some)).withColumn("main_picture", F.when(F.col("_some"), F.col("main_picture")).otherwise(F.col("main_picture_medium"))).drop("_some")


def reordered(df: DataFrame, first: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """df with the given columns first (those that it has), the rest as they are, some left out."""
    named = [c for c in first if c in df.columns and c not in without]
    return df.select(*named, *(c for c in df.columns if c not in named and c not in without))
