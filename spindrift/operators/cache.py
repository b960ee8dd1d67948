"""Results that are kept: tables in shared storage, the least recently used of which go first."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class ResultCache:
    """Tables by the question that they answer, so many at most. Any session that has the folder can read them.

    A result is written once, whole, under a name made of its key; a folder without its mark of success isn't read."""

    def __init__(self, spark: SparkSession, folder: str, entries: int = 1024) -> None:
        self.spark, self.folder, self.entries, self.used = spark, folder, entries, OrderedDict()
        self.hits = self.misses = 0

    def _path(self, key: str) -> str:
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()}"

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a key, made if there is none."""
        path = self._path(key)
        fs, mark = self._files(f"{path}/_SUCCESS")
        if fs.exists(mark):
            self.hits += 1
        else:
            self.misses += 1
            make().write.mode("overwrite").parquet(path)
        self.used[key] = True
        self.used.move_to_end(key)
        while len(self.used) > self.entries:
            self.drop(next(iter(self.used)))
        return self.spark.read.parquet(path)

    def drop(self, key: str) -> None:
        self.used.pop(key, None)
        fs, at = self._files(self._path(key))
        fs.delete(at, True)

    def clear(self) -> None:
        for key in list(self.used):
            self.drop(key)
