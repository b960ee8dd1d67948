"""Exact and approximate nearest neighbours over a table (id, embedding, payload columns), and its upkeep."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.similarity import cosine, euclidean
from spindrift.storage import cut

from . import keyed
from .filters import payload
from .ranking import top_per


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def nearest(table: DataFrame, query: list[float] | DataFrame, k: int, metric: str = "cosine", filters: dict | None = None, key: str = "vec_id", exclude: list | None = None) -> DataFrame:
    """The k nearest rows with their score, nearest first: cosine similarity or Euclidean distance.

    query is a vector, or a table of one row with a column `query`, which is sent to every task. Filters come before
    any similarity. The top k are taken in each task and then of all: nothing is sorted as a whole."""
    table = payload(table, filters)
    if exclude:
        table = table.where(~F.col(key).isin(*exclude))
    if isinstance(query, DataFrame):
        table, q = table.crossJoin(F.broadcast(query.select("query").limit(1))), F.col("query")
    else:
        q = literal(query)
    measure = cosine(F.col("embedding"), q) if metric == "cosine" else euclidean(F.col("embedding"), q)
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    return table.withColumn("score", measure).drop("query").orderBy(order, key).limit(k)


#: Bytes of query vectors that are sent to every task at once, and scores that a task holds at once.
QUERY_BYTES, SCORES = 64 << 20, 4_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of doubles; null ones must be gone."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each two rows, 0 where one has no length."""
    size = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
    return np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0)


def _best(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, keys: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, keys, scores) of each query's k best rows, and of rows that tie with the last; own is each query's key, left out.

    Products of matrices tell which rows come into question; their scores are then summed up row by row, so equal
    vectors have equal scores wherever they stand."""
    step = max(1, SCORES // max(1, len(rows)))
    sizes = np.sqrt((rows * rows).sum(axis=1))
    for at in range(0, len(queries), step):
        scores = _cosines(queries[at : at + step], rows)
        scores[own[at : at + step, None] == keys[None, :]] = -np.inf
        least = -np.partition(-scores, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
        for i in range(len(scores)):
            some = np.flatnonzero((scores[i] >= least[i] - 1e-9) & (scores[i] > -np.inf))
            q = queries[at + i]
            size = sizes[some] * np.sqrt((q * q).sum())
            exact = np.divide((rows[some] * q).sum(axis=1), size, out=np.zeros(len(some)), where=size > 0)
            first = np.lexsort((keys[some], -exact))[:k]
            yield at + i, keys[some][first], exact[first]


def nearest_batch(table: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", limit: int = QUERY_BYTES) -> DataFrame:
    """(query_id, key, score, place): each query's k nearest rows by cosine, itself left out.

    Queries (query_id, query) go to every task in chunks of `limit` bytes, each of which is a pass over the table. A
    task keeps k rows a query, whatever it reads, and only those are shuffled. Rows and queries without a vector are
    left out; ids are whole numbers."""
    asked = queries.where("query_id is not null and query is not null").select(F.col("query_id").cast("long"), F.col("query").cast("array<double>"))
    size = asked.agg(F.sum(F.size("query") * 8 + 8).alias("b")).first()["b"] or 0
    chunks, spark = size // limit + 1, table.sparkSession
    rows = table.where(F.col("embedding").isNotNull()).select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>"))
    parts = []
    for n in range(chunks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == n).orderBy("query_id").toArrow()
        if not len(some):
            continue
        ids, held = some.column(0).to_numpy(), _matrix(some.column(1).combine_chunks())
        sent = spark.sparkContext.broadcast((ids, held))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, held = sent.value
            keys, scores = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                if not len(batch):
                    continue
                fresh = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf)
                for i, own, score in _best(held, ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k):
                    fresh[0][i, : len(own)], fresh[1][i, : len(own)] = own, score
                keys, scores = np.hstack([keys, fresh[0]]), np.hstack([scores, fresh[1]])
                order = np.lexsort((keys, -scores), axis=1)[:, :k]
                keys, scores = np.take_along_axis(keys, order, 1), np.take_along_axis(scores, order, 1)
            real = scores > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(axis=1))), pa.array(keys[real]), pa.array(scores[real])], names=["query_id", key, "score"])

        parts.append(rows.mapInArrow(run, f"query_id long, {key} long, score double"))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"query_id long, {key} long, score double")
    return top_per(found, "query_id", [F.desc("score"), F.asc(key)], k)


#: Rows that an index's cells are found from at most, cells at most, and queries that tell how many cells to probe.
SAMPLE, CELLS, TRIALS = 20_000, 4096, 200


def _directions(vectors: np.ndarray) -> np.ndarray:
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def _centres(sample: np.ndarray, cells: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    x = _directions(sample)
    centres = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where((sums * sums).sum(axis=1, keepdims=True) > 0, _directions(sums), centres)
    return centres


def _cell_of(spark: SparkSession, centres: np.ndarray, probes: int = 1) -> Callable:
    """A function of vectors to their nearest cells, nearest first."""
    sent = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def near(vectors: pd.Series) -> pd.Series:
        scores = np.stack(vectors.to_numpy()) @ sent.value.T if len(vectors) else np.zeros((0, 1))
        return pd.Series(list(np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return near


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    near = _cell_of(rows.sparkSession, centres)
    return rows.withColumn("cell", F.get(near(F.col("embedding").cast("array<double>")), F.lit(0)))


def build_index(table: DataFrame, path: str, key: str = "vec_id", recall: float = 0.95, k: int = 10, seed: int = 5) -> None:
    """Writes an index of all rows with a vector: path/rows, a keyed table by cell, and path/cells (cell, centre, probes).

    Cells are found by k-means on SAMPLE rows at most; every row is then put into that of the nearest centre. How many
    cells a query probes is measured: for TRIALS rows, as many as hold the share `recall` of their k true neighbours,
    found by brute force over all rows. Rows without a key are left out."""
    spark = table.sparkSession
    rows = table.where(F.col("embedding").isNotNull() & F.col(key).isNotNull())
    vector = F.col("embedding").cast("array<double>")
    some = rows.orderBy(F.xxhash64(key, F.lit(seed)), key).select(key, vector.alias("v")).limit(SAMPLE).toArrow()
    if not len(some):
        raise ValueError("no row has a vector")
    sample = _matrix(some.column(1).combine_chunks())
    centres = _centres(sample, max(1, min(CELLS, round(len(sample) ** 0.5))), seed)
    keyed.create(_placed(rows, centres), f"{path}/rows", key, by="cell")
    indexed = keyed.read(spark, f"{path}/rows")
    trial = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(some.column(0).to_pylist()[:TRIALS], sample[:TRIALS], strict=True)], "query_id long, query array<double>")
    true = nearest_batch(indexed, trial, k, key).join(indexed.select(key, "cell"), key).groupBy("query_id").agg(F.collect_list("cell").alias("cells")).collect()
    ranks = []
    at = {int(i): n for n, i in enumerate(some.column(0).to_pylist()[:TRIALS])}
    for r in true:  # TRIALS rows
        order = np.argsort(np.argsort(-(sample[at[r["query_id"]]] @ centres.T), kind="stable"), kind="stable")
        ranks += [int(order[c]) for c in r["cells"]]
    probes = int(np.sort(ranks)[max(0, math.ceil(recall * len(ranks)) - 1)]) + 1 if ranks else len(centres)
    cells = [(c, centre.tolist(), probes) for c, centre in enumerate(centres)]
    spark.createDataFrame(cells, "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _cells(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # CELLS rows at most
    return np.array([r["centre"] for r in cells]), cells[0]["probes"]


def merge_index(spark: SparkSession, path: str, changes: DataFrame, deleted: str | None = None, version: str | None = None) -> int:
    """Inserts, replaces or deletes rows of an index by key, as its next generation, whose number it gives.

    Only cells that lose or get a row are written anew. Cells and probes stay as they were built: when most rows have
    changed, build again. A change without a vector takes its key's row out, as `deleted` does."""
    centres, _ = _cells(spark, path)
    empty = F.col("embedding").isNull()
    gone = (F.coalesce(F.col(deleted), F.lit(False)) | empty) if deleted else empty
    like = changes.schema["embedding"].dataType
    held = changes.withColumns({"_gone": gone, "embedding": F.coalesce("embedding", F.lit(centres[0].tolist()).cast(like))})
    return keyed.merge(spark, f"{path}/rows", _placed(held, centres), "_gone", version, moves=True)


def _chunks(asked: DataFrame, centres: np.ndarray, bytes_: Column, limit: int) -> list[DataFrame]:
    """Queries in chunks of about `limit` bytes, those whose nearest cells are alike together."""
    own = F.get("cells", F.lit(0))
    sizes = {r["c"]: r["b"] for r in asked.groupBy(own.alias("c")).agg(F.sum(bytes_).alias("b")).collect()}  # CELLS rows at most
    out, now, held = [], [], 0
    for c in sorted(sizes, key=lambda c: float(centres[c] @ centres[0])):
        parts = sizes[c] // limit + 1
        if parts > 1:  # one cell's queries are too many for a chunk
            out += [asked.where((own == c) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n)) for n in range(parts)]
            continue
        if now and held + sizes[c] > limit:
            out, now, held = [*out, asked.where(own.isin(now))], [], 0
        now, held = [*now, c], held + sizes[c]
    return [*out, asked.where(own.isin(now))] if now else out


def probed(spark: SparkSession, path: str, cells: set[int], filters: dict | None = None) -> DataFrame:
    """An index's rows in some cells: only those cells' folders are opened, and filters go down to the files."""
    return payload(keyed.read(spark, f"{path}/rows", cells), filters)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str = "vec_id", filters: dict | None = None, limit: int = QUERY_BYTES) -> DataFrame:
    """(query_id, key, score, place): each query's k nearest rows among the cells that it probes, itself left out.

    Queries go to the tasks in chunks of `limit` bytes; a chunk opens only the folders of cells that it probes, and what
    `filters` asks (see filters.payload) goes down to the files. Rows stay where they are read: a task keeps k rows a query,
    and only those are shuffled."""
    centres, probes = _cells(spark, path)
    vector = F.col("query").cast("array<double>")
    asked = queries.where("query_id is not null and query is not null").select(F.col("query_id").cast("long"), vector.alias("query"))
    asked = cut(asked.withColumn("cells", _cell_of(spark, centres, probes)("query")))
    parts = []
    for some in _chunks(asked, centres, F.size("query") * 8 + F.size("cells") * 4 + 8, limit):
        some = some.orderBy("query_id").toArrow()
        ids, held = some.column(0).to_numpy(), _matrix(some.column(1).combine_chunks())
        cells = np.stack(some.column(2).to_numpy(zero_copy_only=False))
        of, who = np.unique(cells.ravel(), return_inverse=True)[0], np.repeat(np.arange(len(ids)), cells.shape[1])
        by_cell = {int(c): who[cells.ravel() == c] for c in of}
        sent = spark.sparkContext.broadcast((ids, held, by_cell))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, held, by_cell = sent.value
            keys, scores = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf)
            for batch in batches:
                if not len(batch):
                    continue
                own, vectors, cells = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
                for c in np.unique(cells):
                    q, at = by_cell[int(c)], np.flatnonzero(cells == c)
                    fresh = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
                    for i, near, score in _best(held[q], ids[q], vectors[at], own[at], k):
                        fresh[0][i, : len(near)], fresh[1][i, : len(near)] = near, score
                    both = np.hstack([keys[q], fresh[0]]), np.hstack([scores[q], fresh[1]])
                    order = np.lexsort((both[0], -both[1]), axis=1)[:, :k]
                    keys[q], scores[q] = np.take_along_axis(both[0], order, 1), np.take_along_axis(both[1], order, 1)
            real = scores > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(axis=1))), pa.array(keys[real]), pa.array(scores[real])], names=["query_id", key, "score"])

        rows = probed(spark, path, set(by_cell), filters)
        rows = rows.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>"), "cell")
        parts.append(rows.mapInArrow(run, f"query_id long, {key} long, score double"))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"query_id long, {key} long, score double")
    return top_per(found, "query_id", [F.desc("score"), F.asc(key)], k)


def save(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    """The table at the path without its rows; its columns stay."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def upsert(table: DataFrame, changes: DataFrame, key: str = "vec_id") -> DataFrame:
    """The table with the changes' rows in place of its own of the same key; of several changes the last by _version."""
    version = "_version" in changes.columns
    both = table.withColumn("_new", F.lit(-1).cast("long")).unionByName(
        changes.withColumn("_new", F.col("_version").cast("long") if version else F.lit(0).cast("long")).drop("_version"), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def by_id(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def one_hot(df: DataFrame, key: str, column: str) -> DataFrame:
    """A 0/1 column for each value of a column."""
    return df.groupBy(key).pivot(column).agg(F.lit(1)).fillna(0)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean by its population deviation; a constant column becomes 0. Moments are one row, joined back."""
    moments = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return df.crossJoin(F.broadcast(moments)).withColumns(scaled).select(*df.columns)


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column to 0..1; a constant one to 0.5, a null to its column's scaled mean."""
    ends = df.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("l", F.min), ("h", F.max), ("m", F.avg))))

    def scaled(c: str) -> Column:
        low, high = F.col(f"_l_{c}"), F.col(f"_h_{c}")
        return F.when(high > low, (F.coalesce(F.col(c), F.col(f"_m_{c}")) - low) / (high - low)).otherwise(0.5)

    return df.crossJoin(F.broadcast(ends)).withColumns({c: scaled(c) for c in columns}).select(*df.columns)

