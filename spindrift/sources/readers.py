"""Scans and sinks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, MapType, StructType

log = logging.getLogger(__name__)


def read_dataset(spark: SparkSession, path: str, id_col: str, title_col: str, desc_col: str) -> DataFrame:
    """A CSV or Parquet table that has the three columns; another extension or a lacking column is an error."""
    if path.endswith(".csv"):
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"neither CSV nor Parquet: {path}")
    if lacking := {id_col, title_col, desc_col} - set(df.columns):
        raise ValueError(f"{path} lacks {sorted(lacking)}")
    return df


def items(df: DataFrame, id_col: str, title_col: str, desc_col: str) -> DataFrame:
    """(id, title, description); an id that is no number is null."""
    return df.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(title_col).alias("title"), F.col(desc_col).alias("description"))


def read_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet, else JSON lines, else an empty table of the schema."""
    for read in (spark.read.parquet, spark.read.schema(schema).json):
        try:
            df = read(path)
            df.schema  # noqa: B018  resolved here, so a path that isn't there falls through
            return df
        except AnalysisException as e:
            log.warning("can't read %s: %s", path, e)
    return spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that are each one JSON array; a glob reads many. A record that can't be read is kept in _corrupt_record."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def read_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union by name of the Parquet tables that there are; an error if there is none."""
    found: list[DataFrame] = []
    for path in paths:
        try:
            found.append(spark.read.parquet(path))
        except AnalysisException as e:
            log.warning("left out %s: %s", path, e)
    if not found:
        raise ValueError("no table can be read")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Struct fields as columns of their own, at any depth."""

    def fields(schema: StructType, path: str, name: str) -> Iterator:
        for f in schema.fields:
            at, to = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, StructType):
                yield from fields(f.dataType, f"{at}.", f"{to}{separator}")
            else:
                yield F.col(at).alias(to)

    return df.select(*fields(df.schema, "", ""))


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Lists, maps and structs as JSON."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    df.withColumns(nested).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a given schema, columns of lists read from their text."""
    from spindrift.functions.text import string_list

    df = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    return df.withColumns({c: string_list(F.col(c)) for c in lists})


def month_stamped(name: str, year: int, month: int) -> str:
    return f"{name}-{year:04d}-{month:02d}.parquet"


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


def page_of(offset: int, size: int) -> tuple[int, int]:
    """The page, from 1, that an offset is on, and the place there."""
    return offset // size + 1, offset % size


def paged_source(name: str, schema: str, fetch: Callable[[int], list[tuple]], pages: int) -> type[DataSource]:
    """A data source of a paged service: a partition for each page, fetched on an executor by fetch(page number).

    Register it with spark.dataSource.register and read it with spark.read.format(name)."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Page(k) for k in range(1, pages + 1)]

        def read(self, partition: Page) -> Iterator[tuple]:
            yield from fetch(partition.number)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    return Source
