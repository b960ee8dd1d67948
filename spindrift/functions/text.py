"""Text, date and id expressions. All are Columns: they stay in the JVM and reach the scan's projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholder synopses that are removed from a text, and the prefixes of each cleaner.
PLACEHOLDERS = ("No synopsis information has been added to this title.", "[Written by MAL Rewrite]", "(Source: ")
MANGA_PREFIXES = ("Synopsis:", "Description:")
SCREEN_PREFIXES = ("Overview:", "Synopsis:", "Plot:")


def let(value: Column, body) -> Column:
    """body of value, with value computed once: an expression that a lambda refers to may be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_case(text: Column) -> Column:
    """Each run of letters begins upper case and goes on lower case: Sci-Fi, It'S."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, F.lit(2), F.length(t)))), "")


def without_prefix(text: Column, prefixes: tuple[str, ...]) -> Column:
    return F.regexp_replace(text, "(?i)^(" + "|".join(prefixes) + r")\s*", "")


def clean_manga_synopsis(text: Column) -> Column:
    """Tags and a leading label gone, white space squeezed; null as empty."""
    return F.coalesce(strip(without_prefix(squeeze(F.regexp_replace(text, "<[^>]+>", "")), MANGA_PREFIXES)), F.lit(""))


def clean_screen_synopsis(text: Column) -> Column:
    """A leading label gone, white space squeezed; null as empty. Tags stay."""
    return F.coalesce(strip(without_prefix(squeeze(text), SCREEN_PREFIXES)), F.lit(""))


def clean_anime_synopsis(text: Column) -> Column:
    """Placeholders and empty brackets gone; null if nothing is left."""
    out = strip(text)
    for p in (*PLACEHOLDERS, "()"):
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.nullif(strip(out), F.lit(""))


def fallback_synopsis(synopsis: Column, title: Column, sub_type: Column, genres: Column) -> Column:
    """The synopsis, or a sentence made of the record's other fields where it is blank."""
    listed = F.when(F.size(F.coalesce(genres, F.array().cast("array<string>"))) > 0, F.array_join(genres, ", ")).otherwise(F.lit("various genres"))
    made = F.concat(F.lit("A "), F.coalesce(sub_type, F.lit("")), F.lit(" manga titled '"), title, F.lit("' featuring "), listed, F.lit("."))
    return F.when(F.coalesce(synopsis, F.lit("")) == "", made).otherwise(synopsis)


def clean_nlp(text: Column) -> Column:
    """For keyword models: no bracketed passages, line breaks or anything but letters; lower case, single spaces."""
    out = F.regexp_replace(text, r"\([^()]*\)|\[[^\[\]]*\]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[\r\n]+", " "), "[^A-Za-z ]", " ")
    return F.lower(F.trim(F.regexp_replace(out, " +", " ")))


def halve_spaces(text: Column) -> Column:
    """Each two spaces as one, in one pass."""
    return F.replace(text, F.lit("  "), F.lit(" "))


def blank_to_null(text: Column, blanks: tuple[str, ...] = ("", " ", "N/A", "n/a")) -> Column:
    return F.when(~text.isin(*blanks), text)


def padded_date(raw: Column) -> Column:
    """A date of YYYY, YYYY-MM or YYYY-MM-DD, the missing parts as 01; null where it is none."""
    parts = F.size(F.split(raw, "-"))
    padded = F.when(parts == 1, F.concat(raw, F.lit("-01-01"))).when(parts == 2, F.concat(raw, F.lit("-01"))).otherwise(raw)
    return F.try_to_date(padded, "yyyy-MM-dd")


def year_of(release_date: Column, fallback: Column) -> Column:
    """The year in the first four characters of a date, else the fallback."""
    return F.coalesce(F.left(release_date, F.lit(4)).try_cast("int"), fallback.try_cast("int"))


def bounded_score(score: Column, top: float = 10.0) -> Column:
    """A score from 0 to top, rounded to two places; null otherwise."""
    x = score.try_cast("double")
    return F.when(x.between(0, top), F.round(x, 2))


def minutes(seconds: Column) -> Column:
    """Whole minutes of a positive number of seconds."""
    return F.when(seconds > 0, F.floor(seconds / 60).cast("long"))


def total_duration(minutes_each: Column, episodes: Column) -> Column:
    """Seconds of all episodes."""
    return (minutes_each * 60 * episodes).cast("long")


def zero_epoch_to_null(at: Column) -> Column:
    return F.when(F.unix_timestamp(at) != 0, at)


def build_id(kind: Column, source: Column, number: Column) -> Column:
    return F.concat_ws("-", kind, source, number.cast("string"))


def parse_id(media_id: Column) -> Column:
    """(media_type, source, source_id) of an id of three, two or one parts; what lacks is 'unknown'."""
    parts, n = F.split(media_id, "-", 3), F.size(F.split(media_id, "-", 3))
    unknown = F.lit("unknown")
    return F.struct(
        F.when(n >= 2, F.get(parts, F.lit(0))).otherwise(unknown).alias("media_type"),
        F.when(n == 3, F.get(parts, F.lit(1))).otherwise(unknown).alias("source"),
        F.get(parts, n - 1).alias("source_id"),
    )


def embedding_text(title: Column, alternative: Column, media_type: Column, synopsis: Column) -> Column:
    """What an item's embedding is made of."""
    names = F.concat_ws(" / ", title, F.nullif(alternative, F.lit("")))
    return F.concat(names, F.lit(" ("), media_type, F.lit("): "), F.coalesce(synopsis, F.lit("")))


def string_list(raw: Column) -> Column:
    """A list written as text with single or double quotes; null where it can't be read."""
    return F.from_json(F.translate(raw, "'", '"'), "array<string>")


def valid_url(url: Column) -> Column:
    """Whether a url has a scheme and an authority; null for a null url."""
    has = F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(url, F.lit("AUTHORITY")).isNotNull()
    return F.when(url.isNotNull(), has)


def approved(popularity: Column) -> Column:
    """Whether an item has been let into the ranking: its popularity is not 0; unknown counts as let in."""
    return ~popularity.eqNullSafe(F.lit(0))


def public_picture(url: Column) -> Column:
    """The picture's address at the public host, for one at the service's own."""
    return F.replace(url, F.lit("api-"), F.lit(""))


def age_hours(at: Column, now: Column) -> Column:
    """Hours from one time to another, with their parts."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 3_600_000_000
