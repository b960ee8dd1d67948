"""Connected components of an edge table, on the executors: forests of bounded parts, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.storage import cut
from spindrift.workers import tidy

#: Edges of a part, which one task holds (some 60 MB).
PART = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that isn't its component's least, and that least node."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    odd = root != np.arange(len(nodes))
    return nodes[odd], nodes[root[odd]]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges in parts of PART at most, each as its spanning stars."""
    held, n = [], 0

    def stars() -> pd.DataFrame:
        u, v = (np.concatenate([x[c].to_numpy(np.int64) for x in held]) for c in ("u", "v"))
        return pd.DataFrame(dict(zip(("u", "v"), forest(u, v), strict=True)))

    for batch in batches:
        if held and n + len(batch) > PART:
            yield stars()
            held, n = [], 0
        held.append(batch)
        n += len(batch)
    if n:
        yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that an edge joins to another; root is the component's smallest node.

    edges: two BIGINT columns in any order; nulls, loops and repeats are ignored. Each task first reduces what it holds
    to spanning stars, part by part. If all that is left is one part, a task ends it; else rounds of alternating stars
    do, where the rows of a hot node are pre-aggregated by min before they meet, and the join of its edges is one that
    Spark can split. Rounds grow with the logarithm of a component's diameter; each ends in a checkpoint."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    e = cut(e.mapInPandas(tidy(_parts), "u long, v long"))
    left = e.count()
    if not left:
        return spark.createDataFrame([], "node long, root long")
    if left <= PART:
        return _ends(cut(e.coalesce(1).mapInPandas(tidy(_parts), "u long, v long")))
    mark = None
    while True:
        e = cut(_small_star(_large_star(e)).mapInPandas(tidy(_parts), "u long, v long"))
        # the sum of 31-bit hashes tells whether the edge set has changed
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(2**31 - 1))).first()
        if now == mark:
            return _ends(e)
        mark = now


def _ends(stars: DataFrame) -> DataFrame:
    """(node, root) of spanning stars, the roots themselves included."""
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
