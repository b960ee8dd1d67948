"""Stored tables that batches of changes are merged into, without rewriting what a batch doesn't touch.

Rows lie in folders a partition (a hash bucket of the key, or a column such as an index's cell). A merge writes the touched
partitions anew, under the next generation, and last of all that generation's list of partitions; readers take the newest
list that was written whole. So a reader sees a merge in full or not at all, and a merge that failed leaves the last
generation as it was. Lists have a row a partition, so they are bounded by the number of buckets or cells."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from spindrift.storage import cut

from .ranking import top_per

#: The partition column of a table that is dealt by its key.
BUCKET = "bucket"
#: Rows of a file, about; a partition of more has several, written by as many tasks.
FILE_ROWS = 1_000_000


def _files(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark._jsc.hadoopConfiguration()), to


def generations(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all generations that were written whole, oldest first."""
    fs, lists = _files(spark, f"{path}/lists")
    if not fs.exists(lists):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(lists)]
    done = [n for n in names if fs.exists(_files(spark, f"{path}/lists/{n}/_SUCCESS")[1])]
    return sorted(int(n) for n in done)


def places(spark: SparkSession, path: str, generation: int | None = None) -> dict:
    """Each partition's generation, as of the newest generation or another."""
    own = generations(spark, path)
    if not own:
        raise FileNotFoundError(f"no table at {path}")
    at = own[-1] if generation is None else generation
    return {r["part"]: r["generation"] for r in spark.read.parquet(f"{path}/lists/{at:08d}").collect()}


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, generation: int, by: str) -> list[int]:
    """Writes rows as the partitions of a generation, large ones by several tasks; gives the partitions."""
    df = cut(df)
    sizes = df.groupBy(by).agg(F.count("*").alias("__n"))  # a row a partition
    file = F.monotonically_increasing_id() % F.ceil(F.col("__n") / FILE_ROWS)
    dealt = df.join(F.broadcast(sizes), by).withColumn("__file", file).repartition(by, "__file")
    dealt.drop("__n", "__file").write.partitionBy(by).parquet(f"{path}/data/{generation:08d}")
    return [r[by] for r in sizes.collect()]


def _commit(spark: SparkSession, path: str, generation: int, parts: dict) -> None:
    rows = spark.createDataFrame(sorted(parts.items()), "part int, generation int")
    rows.coalesce(1).write.parquet(f"{path}/lists/{generation:08d}")


def create(df: DataFrame, path: str, key: str, buckets: int = 64, by: str | None = None) -> None:
    """Writes a table's first generation: by hash buckets of the key, or by the integer column `by`."""
    spark = df.sparkSession
    if generations(spark, path):
        raise FileExistsError(path)
    df = df if by else df.withColumn(BUCKET, bucket_of(key, buckets))
    parts = _write(df, path, 1, by or BUCKET)
    spark.createDataFrame([(key, by or BUCKET, buckets, df.drop(by or BUCKET).schema.json())], "key string, part string, buckets int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    _commit(spark, path, 1, dict.fromkeys(parts, 1))


def read(spark: SparkSession, path: str, only: set[int] | None = None, generation: int | None = None) -> DataFrame:
    """The table's rows with the partition column; of some partitions alone, only their folders are opened."""
    about = spark.read.parquet(f"{path}/about").first()
    parts = {p: g for p, g in places(spark, path, generation).items() if only is None or p in only}
    schema = about["schema"]
    empty = spark.createDataFrame([], _schema(schema)).withColumn(about["part"], F.lit(None).cast("int"))
    by_generation: dict[int, list[int]] = {}
    for p, g in parts.items():
        by_generation.setdefault(g, []).append(p)
    out = empty
    for g, own in sorted(by_generation.items()):
        rows = spark.read.schema(_schema(schema).add(about["part"], IntegerType())).parquet(f"{path}/data/{g:08d}")
        rows = rows.where(F.col(about["part"]).isin(sorted(own)))  # a filter of folders
        out = rows if out is empty else out.unionByName(rows)
    return out


def _schema(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


def merge(spark: SparkSession, path: str, changes: DataFrame, deleted: str | None = None, version: str | None = None, moves: bool = False) -> int:
    """Merges changes (the table's columns) by key, as a new generation, whose number it gives.

    A row replaces that of its key or is added; where the boolean column `deleted` holds, the key's row goes. Of several
    changes of a key the last by `version` counts, of those alike any one. moves: a row may change its partition, so the
    stored rows' keys (no other column) are read to see where they are; else a key's partition is always the same."""
    about = spark.read.parquet(f"{path}/about").first()
    key, by = about["key"], about["part"]
    own = generations(spark, path)
    parts = places(spark, path)
    changes = changes if by != BUCKET else changes.withColumn(BUCKET, bucket_of(key, about["buckets"]))
    order = [F.desc(version)] if version else [F.asc(key)]
    last = cut(top_per(changes.where(F.col(key).isNotNull()), key, order, 1).drop("place"))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    touched = {r[0] for r in last.where(~gone | F.lit(not moves)).select(by).distinct().collect()}  # partitions at most
    if moves:
        touched |= {r[0] for r in read(spark, path).select(key, by).join(last.select(key), key, "left_semi").select(by).distinct().collect()}
    if not touched:
        return own[-1]
    kept = read(spark, path, touched).join(last.select(key), key, "left_anti")
    fresh = last.where(~gone).select(*kept.columns)
    # numbers of generations that failed are not taken again
    fs, data = _files(spark, f"{path}/data")
    number = max(own[-1], *(int(x.getPath().getName()) for x in fs.listStatus(data))) + 1
    written = _write(kept.unionByName(fresh), path, number, by)
    _commit(spark, path, number, {p: g for p, g in parts.items() if p not in touched} | dict.fromkeys(written, number))
    return number


def clear(spark: SparkSession, path: str) -> int:
    """A generation without rows; the table's columns stay."""
    number = generations(spark, path)[-1] + 1
    _commit(spark, path, number, {})
    return number


def tidy(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes folders that none of the last `keep` generations has, once no reader is on older ones; says how many."""
    own, removed = generations(spark, path), 0
    used = {(g, p) for n in own[-keep:] for p, g in places(spark, path, n).items()}
    part = spark.read.parquet(f"{path}/about").first()["part"]
    for n in own[:-keep]:
        fs, lists = _files(spark, f"{path}/lists/{n:08d}")
        fs.delete(lists, True)
    fs, data = _files(spark, f"{path}/data")
    for g in fs.listStatus(data):
        number = int(g.getPath().getName())
        for p in fs.listStatus(g.getPath()):
            name = p.getPath().getName()
            if name.startswith(f"{part}=") and number <= own[-1] and (number, int(name.split("=")[1])) not in used:
                fs.delete(p.getPath(), True)
                removed += 1
    return removed
