"""Storage that driver and executors share, and the end of a DataFrame's lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    The session's spark.checkpoint.dir is used where it is set; a temporary folder is set only where it is not
    (a local session, as in tests)."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spindrift-checkpoint-")
    sc.setCheckpointDir(path)
    return path


#: Spark then removes an execution's shuffle files when it ends, and not when the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a batch that Python workers are sent.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df, written once to the shared checkpoint folder: its lineage ends there and a lost executor costs a reread.

    The shuffles that it was made by are of no more use then, so their files go at once. Python workers get so many rows
    at a time, where `batch` says: fewer than Spark's own number if rows may be long."""
    spark = df.sparkSession
    shared_dir(spark)
    own = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        # a plan takes the settings when it is made
        return df.select("*").checkpoint(eager=True)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
