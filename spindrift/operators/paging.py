"""Pages by cursor over a table that is stored in order: a page opens the one or two files that its rows are in.

Rows are dealt to ranges of the order, a folder each, and sorted there; beside them is a row a range with its last row's
place and its number of rows. A cursor is the place of a page's last row. The next page seeks the first range that ends
after it, and as many more as its rows may need; no page sorts or counts the table, wherever it is."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from spindrift.storage import cut

#: Rows of a range, about.
RANGE_ROWS = 200_000
#: The column of ranges.
PART = "__part"


def _order(by: list[str]) -> list[Column]:
    """Sort columns of names, descending where a name begins with a minus; nulls come last either way."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in by]


def _after(by: list[str], cursor: tuple, prefix: str = "") -> Column:
    """Whether a row's place in the order comes after the cursor's."""
    out, same = [], []
    for c, value in zip(by, cursor, strict=True):
        column = F.col(prefix + c.removeprefix("-"))
        if value is None:  # nothing comes after a null but the next columns' order
            same.append(column.isNull())
            continue
        later = column < F.lit(value) if c.startswith("-") else column > F.lit(value)
        out.append(reduce(lambda a, b: a & b, [*same, later | column.isNull()]))
        same.append(column.eqNullSafe(F.lit(value)))
    return reduce(lambda a, b: a | b, out, F.lit(False))


def store(df: DataFrame, path: str, by: list[str], ranges: int | None = None) -> None:
    """Writes a table in the order of some columns, the last of them unique, as path/rows and path/ranges."""
    names, rows = [c.removeprefix("-") for c in by], cut(df)
    ranges = ranges or rows.count() // RANGE_ROWS + 1
    sorted_ = cut(rows.repartitionByRange(ranges, *_order(by)).sortWithinPartitions(*_order(by)).withColumn(PART, F.spark_partition_id()).withColumn("__no", F.monotonically_increasing_id()))
    last = sorted_.groupBy(PART).agg(F.count("*").alias("n"), F.max_by(F.struct(*names), "__no").alias("last"))
    last.select(PART, "n", "last.*").coalesce(1).sortWithinPartitions(PART).write.mode("overwrite").parquet(f"{path}/ranges")
    spark = df.sparkSession
    spark.createDataFrame([(df.schema.json(),)], "columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    sorted_.drop("__no").write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")


def parts_of(spark: SparkSession, path: str, by: list[str], size: int, cursor: tuple | None = None) -> list[int]:
    """The ranges that a page's rows are in: the cursor's own, and more until `size` rows are sure to be there."""
    ranges = spark.read.parquet(f"{path}/ranges")
    later = ranges if cursor is None else ranges.where(_after(by, cursor))
    out, more = [], 0
    # size + 1 ranges hold the page even if each has a row
    for r in later.orderBy(PART).limit(size + 1).select(PART, "n").collect():
        out.append(r[PART])
        more += r["n"] if len(out) > 1 or cursor is None else 0  # of the first, all may come before the cursor but its last
        if more >= size:
            break
    return out


def page(spark: SparkSession, path: str, by: list[str], size: int, cursor: tuple | None = None) -> DataFrame:
    """The first `size` rows of a stored table, or those after a cursor, in order."""
    parts = parts_of(spark, path, by, size, cursor)
    columns = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/about").first()["columns"]))
    rows = spark.read.schema(columns.add(PART, IntegerType())).parquet(f"{path}/rows").where(F.col(PART).isin(parts))  # a filter of folders
    rows = rows if cursor is None else rows.where(_after(by, cursor))
    return rows.drop(PART).orderBy(*_order(by)).limit(size)


def cursor_of(rows: list, by: list[str]) -> tuple | None:
    """The cursor after a page's rows; None where there are none."""
    return tuple(rows[-1][c.removeprefix("-")] for c in by) if rows else None
