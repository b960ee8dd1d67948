"""Ingest that takes each record once and stops a source at its tenth error, over any number of batches and restarts.

Ids that were seen are the stream's own state, kept for a time limit. How many errors each source has had is a small table a
batch, written with the batch's rows: a batch that is run again finds the counts of the one before it and overwrites its own.
Within a batch only a source's first errors, up to the limit, are ordered; the row at which the limit is reached is the
source's last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.operators.ranking import top_per
from spindrift.storage import cut

LIMIT = 10
_COUNTS = "source string, errors long"


def _counts(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Errors by source after a batch; nothing before the first."""
    if batch < 0:
        return spark.createDataFrame([], _COUNTS)
    return spark.read.schema(_COUNTS).parquet(f"{path}/counts/batch={batch}")


def admitted(rows: DataFrame, before: DataFrame, failed: Column, source: str, at: str, key: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows up to each source's last, in order of (at, key), and the new counts (source, errors).

    before: errors that a source has had; sources are compared as text, a null one is a source of its own."""
    of = F.coalesce(F.col(source).cast("string"), F.lit("\0"))
    rows = rows.withColumns({"__source": of, "__failed": F.coalesce(failed, F.lit(False))})
    before = before.select(F.col("source").alias("__source"), F.col("errors").alias("__errors"))
    first = top_per(rows.where("__failed").select("__source", at, key), "__source", [F.asc(at), F.asc(key)], limit)
    last = first.join(before, "__source", "left").where(F.col("place") + F.coalesce("__errors", F.lit(0)) == limit)
    last = last.select("__source", F.col(at).alias("__at"), F.col(key).alias("__key"))
    open_ = rows.join(before.where(F.col("__errors") >= limit), "__source", "left_anti").join(last, "__source", "left")
    up_to = F.col("__at").isNull() | (F.col(at) < F.col("__at")) | ((F.col(at) == F.col("__at")) & (F.col(key) <= F.col("__key")))
    kept = cut(open_.where(up_to).drop("__at", "__key"))
    now = before.unionByName(kept.where("__failed").groupBy("__source").agg(F.count("*").alias("__errors")))
    counts = now.groupBy(F.col("__source").alias("source")).agg(F.sum("__errors").alias("errors"))
    return kept.drop("__source", "__failed"), counts


def ingest(stream: DataFrame, path: str, key: str, at: str, source: str, failed: Column, checkpoint: str, seen_for: str = "30 days", limit: int = LIMIT) -> StreamingQuery:
    """Starts a query that adds what there is of a stream to path/rows and ends; started again on its checkpoint it goes on.

    Of rows of one key the first to come is taken, if the others come within `seen_for` (in the time `at`); a row that is
    older than that is late and left out. Rows without a key or time are left out too."""
    once = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, seen_for).dropDuplicatesWithinWatermark([key])

    def save(batch: DataFrame, number: int) -> None:
        rows, counts = admitted(cut(batch), _counts(batch.sparkSession, path, number - 1), failed, source, at, key, limit)
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return once.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stopped(spark: SparkSession, path: str, batch: int, limit: int = LIMIT) -> DataFrame:
    """The sources that had reached the limit after a batch."""
    return _counts(spark, path, batch).where(F.col("errors") >= limit)
