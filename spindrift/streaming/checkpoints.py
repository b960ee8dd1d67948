"""Upkeep of streaming checkpoints: which there are, how far they have come, whether they can be gone on from.

Offsets, commits and atomic renames are Structured Streaming's own. Folders are read through Hadoop's file systems, so
they may be anywhere that the session can write."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Info:
    """A checkpoint: its name, the last batch that was begun and the last that was finished, hours since, what is wrong with it."""

    name: str
    begun: int
    finished: int
    age_hours: float
    problems: tuple[str, ...]

    @property
    def valid(self) -> bool:
        return not self.problems


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _batches(fs, at, jvm, name: str) -> dict[int, int]:
    """Numbers of the batches in a log, with the times that they were written."""
    path = jvm.org.apache.hadoop.fs.Path(at, name)
    if not fs.exists(path):
        return {}
    return {int(f.getPath().getName()): f.getModificationTime() for f in fs.listStatus(path) if f.getPath().getName().isdigit()}


def info(spark: SparkSession, path: str, now: float | None = None) -> Info:
    """What there is of a checkpoint; problems name what hinders a restart."""
    fs, at = _folder(spark, path)
    begun, finished = (_batches(fs, at, spark._jvm, n) for n in ("offsets", "commits"))
    problems = []
    meta = spark._jvm.org.apache.hadoop.fs.Path(at, "metadata")
    if not fs.exists(meta):
        problems.append("no metadata")
    else:
        try:
            text = "\n".join(r["value"] for r in spark.read.text(meta.toString()).collect())
            if not json.loads(text).get("id"):
                problems.append("metadata without an id")
        except (ValueError, Py4JJavaError, PySparkException):  # no JSON, or a file that fails its checksum
            problems.append("unreadable metadata")
    if lost := sorted(set(finished) - set(begun)):
        problems.append(f"batches {lost} were finished and never begun")
    if begun and finished and max(begun) - max(finished) > 1:
        problems.append("more than one batch is unfinished")
    last = max([*begun.values(), *finished.values()], default=0) / 1000
    age = (now if now is not None else time.time()) - last if last else float("inf")
    return Info(at.getName(), max(begun, default=-1), max(finished, default=-1), age / 3600, tuple(problems))


def listed(spark: SparkSession, root: str) -> list[Info]:
    """The checkpoints in a folder, by name."""
    fs, at = _folder(spark, root)
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at) if f.isDirectory()]
    return sorted((info(spark, p.toString()) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "offsets"))), key=lambda x: x.name)


def clear(spark: SparkSession, path: str) -> bool:
    """Removes a checkpoint, so that its query begins anew; whether there was one."""
    fs, at = _folder(spark, path)
    return fs.exists(at) and fs.delete(at, True)


def fresh(spark: SparkSession, path: str, hours: float) -> bool:
    """Whether a checkpoint can be gone on from and has moved in the last hours."""
    found = info(spark, path)
    return found.valid and found.age_hours <= hours
