"""Predicates from a filter dictionary, keyword search, relaxation and validation filters."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

EAST_ASIA = ("KR", "JP", "CN", "TW", "TH")


def parse_list(raw: str | None) -> list[str]:
    return [x.strip() for x in (raw or "").split(",") if x.strip()]


def parse_range(raw: str | None) -> tuple[float, float] | None:
    """min-max, None unless there are two numbers."""
    parts = (raw or "").split("-")
    try:
        low, high = map(float, parts)
    except ValueError:
        return None
    return low, high


def build_filters(genres=None, studios=None, score_range=None, year_range=None, episode_range=None, media_type=None, status=None, rating=None, sfw_only=False, override=None) -> dict:
    """The filter dictionary of a set of arguments; override is JSON that wins over them."""
    out: dict = {k: v for k, v in (("genres", parse_list(genres)), ("studios", parse_list(studios))) if v}
    for name, raw in (("score", score_range), ("start_year", year_range), ("episodes", episode_range)):
        if (bounds := parse_range(raw)) is not None:
            out |= {f"{name}_min": bounds[0], f"{name}_max": bounds[1]}
    out |= {k: v.lower() for k, v in (("media_type", media_type), ("status", status), ("rating", rating)) if v}
    if sfw_only:
        out["sfw"] = True
    return out | (json.loads(override) if override else {})


def list_match(column: Column, values: list[str], is_array: bool = True) -> Column:
    """Whether any value is in any element, as a substring in any case. False for null and empty."""
    wanted = [v.lower() for v in values]
    if is_array:
        hit = F.exists(column, lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(v)) for v in wanted]))
    else:
        hit = reduce(lambda a, b: a | b, [F.contains(F.lower(column.cast("string")), F.lit(v)) for v in wanted])
    return F.coalesce(hit, F.lit(False))


def same_word(column: Column, value: str) -> Column:
    return F.lower(F.coalesce(column.cast("string"), F.lit(""))) == value.lower()


def sfw_condition(df: DataFrame, names: tuple[str, ...] = ("sfw", "is_sfw", "nsfw", "is_nsfw")) -> Column:
    """By the first of the columns that there is: an unknown sfw counts as safe, an unknown nsfw too."""
    for name in names:
        if name in df.columns:
            return F.coalesce(F.col(name), F.lit(True)) if "nsfw" not in name else ~F.coalesce(F.col(name), F.lit(False))
    return F.lit(True)


def condition(df: DataFrame, filters: dict) -> Column:
    """One predicate of all filters whose columns there are; Catalyst pushes its scalar parts to the scan."""
    out = F.lit(True)
    for name in ("genres", "studios", "themes", "demographics"):
        if filters.get(name) and name in df.columns:
            out &= list_match(F.col(name), filters[name], isinstance(df.schema[name].dataType, ArrayType))
    for name in ("score", "start_year", "episodes"):
        if name in df.columns:
            for end, test in (("min", lambda c, v: c >= v), ("max", lambda c, v: c <= v)):
                if (v := filters.get(f"{name}_{end}")) is not None:
                    out &= test(F.col(name), v)
    for name, column in (("media_type", "type" if "type" in df.columns else "media_type"), ("status", "status"), ("rating", "rating")):
        if filters.get(name) and column in df.columns:
            out &= same_word(F.col(column), filters[name])
    if filters.get("sfw"):
        out &= sfw_condition(df)
    return F.coalesce(out, F.lit(False))


def relaxed(df: DataFrame, filters: dict) -> DataFrame:
    """The rows of all filters; if there are none, those of sfw and genres alone. One plan: whether any row is strict is
    an aggregate that is joined back, not a driver's decision."""
    loose = {k: v for k, v in filters.items() if k in ("sfw", "genres")}
    marked = df.withColumns({"_strict": condition(df, filters), "_loose": condition(df, loose)})
    found = marked.agg(F.coalesce(F.bool_or("_strict"), F.lit(False)).alias("_any"))
    both = marked.where("_strict or _loose").crossJoin(F.broadcast(found))  # found is one row
    return both.where(F.when(F.col("_any"), F.col("_strict")).otherwise(F.col("_loose"))).select(*df.columns)


def restrict(ranked: DataFrame, allowed: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k of a ranked list whose keys are allowed, in its order."""
    return ranked.join(allowed.select(key).distinct(), key, "left_semi").orderBy(*order).limit(k)


def keyword(df: DataFrame, query: str, media_type: str | None = None, genres: list[str] | None = None) -> DataFrame:
    """Rows with the query in title, synopsis or English title, or among the synonyms, in any case."""
    q = query.lower()
    hits = [F.contains(F.lower(F.col(c)), F.lit(q)) for c in ("title", "synopsis", "title_english") if c in df.columns]
    if "title_synonyms" in df.columns:
        synonyms = F.col("title_synonyms")
        array = isinstance(df.schema["title_synonyms"].dataType, ArrayType)
        hits.append(F.array_contains(F.transform(synonyms, F.lower), q) if array else F.contains(F.lower(synonyms), F.lit(q)))
    out = df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))
    if media_type:
        out = out.where(F.col("media_type") == media_type)
    if genres:
        out = out.where(F.arrays_overlap("genres", F.array(*map(F.lit, genres))))
    return out


def payload(df: DataFrame, filters: dict | None) -> DataFrame:
    """All filters hold: a list means any of its values, None is passed over. Goes before a similarity, so few vectors are read."""
    for name, value in (filters or {}).items():
        if value is not None and name in df.columns:
            is_array = isinstance(df.schema[name].dataType, ArrayType)
            values = value if isinstance(value, (list, tuple)) else [value]
            df = df.where(F.arrays_overlap(name, F.array(*map(F.lit, values))) if is_array else F.col(name).isin(*values))
    return df


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=[c for c in columns if c in df.columns])


def valid_anime(df: DataFrame, least_synopsis: int = 50, least_score: float = 0.0) -> DataFrame:
    """A synopsis is absent or long enough, a score absent or high enough; a title and genres there are."""
    text = F.coalesce(F.col("synopsis"), F.lit(""))
    return df.where(
        ((text == "") | (F.length(text) >= least_synopsis)) & (F.col("score").isNull() | (F.col("score") >= least_score)) & (F.size("genres") > 0) & (F.trim("title") != "")
    )


def valid_manga(df: DataFrame) -> DataFrame:
    has_text = F.coalesce(F.col("synopsis"), F.lit("")) != ""
    return df.where((F.col("media_type") == "manga") & (has_text | F.coalesce(F.size("genres") > 0, F.lit(False))))


def valid_screen(df: DataFrame, least_votes: int = 50, least_score: float = 5.0) -> DataFrame:
    """Films and series with enough votes, score and a synopsis; a null fails."""
    ok = F.col("media_type").isin("movie", "tv") & (F.col("vote_count") >= least_votes) & (F.col("score") >= least_score)
    return df.where(ok & (F.coalesce(F.col("synopsis"), F.lit("")) != "")).drop("vote_count")


def split_drama(df: DataFrame, origin: str = "metadata.origin_country") -> tuple[DataFrame, DataFrame]:
    """East Asian series, and the rest; every row is in one of the two."""
    asian = F.coalesce((F.col("media_type") == "tv") & F.arrays_overlap(origin, F.array(*map(F.lit, EAST_ASIA))), F.lit(False))
    return df.where(asian), df.where(~asian)


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row of each key, the first in order. Unlike dropDuplicates, which row stays is defined."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: The fields that an expression of the vector store may name.
ALLOWED = ("media_type", "genres", "score", "status")


def allow_list(df: DataFrame, filters: dict | None) -> DataFrame:
    """Equality on allowed fields alone, quotes taken out of texts; lists, None and other fields are passed over."""
    for name, value in (filters or {}).items():
        if name in ALLOWED and name in df.columns and value is not None and not isinstance(value, (list, tuple, set, dict)):
            plain = value.replace('"', "").replace("'", "") if isinstance(value, str) else value
            is_array = isinstance(df.schema[name].dataType, ArrayType)
            df = df.where(F.array_contains(name, F.lit(plain)) if is_array else F.col(name) == F.lit(plain))
    return df
