"""Error categories, retries and backoff as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of each category, in the order that the categories are tried.
CATEGORIES = {
    "rate_limit": ("rate limit", "429"),
    "transient": ("timeout", "connection", "network", "temporary", "unavailable", "503", "502", "504"),
    "permanent": ("not found", "404", "unauthorized", "401", "forbidden", "403", "invalid api key", "invalid client"),
    "data_quality": ("validation", "parse", "decode", "json", "format"),
}
MAX_RETRIES, MAX_BACKOFF, FACTOR = 3, 60, 2


def category(message: Column) -> Column:
    """The first category with a word in the message, else unknown."""
    out = F.lit("unknown")
    for name, words in reversed(CATEGORIES.items()):
        out = F.when(F.lower(message).rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def should_retry(category_: Column, attempt: Column) -> Column:
    return category_.isin("transient", "rate_limit") & (attempt < MAX_RETRIES)


def backoff_seconds(category_: Column, attempt: Column) -> Column:
    """Doubles with each attempt, twice that for rate limits, MAX_BACKOFF at most."""
    base = F.pow(F.lit(float(FACTOR)), attempt)
    return F.least(F.when(category_ == "rate_limit", 2 * base).otherwise(base), F.lit(float(MAX_BACKOFF)))
