"""Ingestion as Structured Streaming: offsets, restarts and progress are the checkpoint's; each source is a query of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.functions.errors import backoff_seconds, category, should_retry


def ingest(source: DataFrame, normalize: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, dead_letters: str | None = None) -> StreamingQuery:
    """Starts a query that appends what there is of a streaming source, normalised, to a Parquet table and ends.

    Records without an id go to dead_letters. Started again on its checkpoint it appends only what has come since; a
    batch that is run again overwrites its own folder, so none is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        rows = normalize(batch)
        rows.where("media_id is not null").write.mode("overwrite").parquet(f"{path}/batch={number}")
        if dead_letters:
            rows.where("media_id is null").write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_files(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 100) -> DataFrame:
    """A stream of a folder's files, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def ingest_all(queries: dict[str, Callable[[], StreamingQuery]]) -> dict[str, str]:
    """Starts every source's query and waits for all; a failed one doesn't stop the others. The state of each by name."""
    started: dict[str, StreamingQuery | Exception] = {}
    for name, start in queries.items():
        try:
            started[name] = start()
        except Exception as e:  # noqa: BLE001  one source's failure is reported, whatever it is
            started[name] = e
    out = {}
    for name, query in started.items():
        if isinstance(query, Exception):
            out[name] = f"failed: {query}"
            continue
        try:
            query.awaitTermination()
            out[name] = "done"
        except Exception as e:  # noqa: BLE001
            out[name] = f"failed: {e}"
    return out


def status(query: StreamingQuery) -> dict:
    return {"running": query.isActive, "message": query.status["message"], "rows": sum(p["numInputRows"] for p in query.recentProgress)}


def error_stats(errors: DataFrame, source: str = "source", message: str = "message") -> DataFrame:
    """(source, category, errors, over_limit): ten or more of a kind are over the limit."""
    out = errors.groupBy(source, category(F.col(message)).alias("category")).agg(F.count("*").alias("errors"))
    return out.withColumn("over_limit", F.col("errors") >= 10)


def retry_plan(errors: DataFrame, message: str = "message", attempt: str = "attempt") -> DataFrame:
    """Errors with category, whether to retry, and the wait."""
    kind = category(F.col(message))
    return errors.withColumns({"category": kind, "retry": should_retry(kind, F.col(attempt)), "wait": backoff_seconds(kind, F.col(attempt))})


def recent_errors(errors: DataFrame, n: int, at: str = "ts", key: str = "event_id") -> DataFrame:
    """The last n errors, the latest first; of one time, the highest key."""
    return errors.orderBy(F.desc(at), F.desc(key)).limit(n)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with a watermark: an extension beside the ingest, for batch and streaming tables alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
