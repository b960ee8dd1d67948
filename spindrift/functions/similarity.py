"""Vector and string similarity."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, IntegerType


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order, in doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def hamming(a: Column, b: Column) -> Column:
    """Share of places that differ."""
    odd = F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))
    return F.aggregate(odd, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def display_similarity(distance: Column, top: Column) -> Column:
    """1 at no distance, 0 at the largest of the list; 1 if all are 0."""
    return F.when(top == 0, F.lit(1.0)).otherwise(F.round(1 - distance / top, 4))


def subsequence_with(a: str) -> Callable[[str], int]:
    """A function of texts to the length of the longest subsequence in common with one, by bits: a machine word's worth of columns a step."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1

    def alike(b: str) -> int:
        row = full
        for c in b:
            hit = row & where.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    return alike


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return subsequence_with(a)(b)


def ratio(a: str | None, b: str | None) -> int:
    """0 to 100: twice the common subsequence by both lengths. 0 if a side is empty."""
    if not a or not b:
        return 0
    return round(200 * common_subsequence(a, b) / (len(a) + len(b)))


def token_sorted(text: str | None) -> str:
    """Lower-cased words of ASCII letters and digits, in order."""
    return " ".join(sorted(re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()))


def title_similarity(a: str | None, b: str | None) -> int:
    """The higher of ratio and token-sorted ratio; a side without ASCII words has no token-sorted ratio."""
    a, b = (a or "").lower(), (b or "").lower()
    return 100 if a == b and a else max(ratio(a, b), ratio(token_sorted(a), token_sorted(b)))


@pandas_udf(IntegerType())
def title_similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([title_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def weighted_similarity(title: Column, year_a: Column, year_b: Column, title_weight: float = 0.7, year_weight: float = 0.3) -> Column:
    """Title and year similarity by weight: 100, 80 and 50 for years 0, 1 and 2 apart. Without a year on each side the title alone counts."""
    apart = F.abs(year_a - year_b)
    year = F.when(apart == 0, 100.0).when(apart == 1, 80.0).when(apart == 2, 50.0).otherwise(0.0)
    both = (title * title_weight + year * year_weight) / (title_weight + year_weight)
    return F.when(year_a.isNotNull() & year_b.isNotNull(), both).otherwise(title.cast("double"))


def least_title(threshold: float, apart: int | None, title_weight: float = 0.7, year_weight: float = 0.3) -> int:
    """The least whole title similarity that reaches the threshold, with years `apart` years apart or one not known."""
    if apart is None:
        return int(np.ceil(threshold - 1e-9))
    year = {0: 100, 1: 80, 2: 50}.get(apart, 0)
    return int(np.ceil((threshold * (title_weight + year_weight) - year * year_weight) / title_weight - 1e-9))


def mock_embedding(text: str | None, size: int) -> list[float]:
    """A unit vector that depends on the text alone, the same in every process."""
    seed = int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little")
    v = np.random.default_rng(seed).standard_normal(size)
    return (v / np.linalg.norm(v)).astype("float32").tolist()


def embedder(size: int = 384, model=None):
    """A pandas UDF that embeds texts: by model(list of texts), or by mock_embedding where no model is given."""

    @pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        if model is not None:
            return pd.Series([list(map(float, v)) for v in model(texts.fillna("").tolist())])
        return pd.Series([mock_embedding(t, size) for t in texts])

    return embed
