"""Mergeable sketches of quality figures, kept a source and day: quantiles by log-linear bins, distinct counts by registers.

A sketch is a table of (keys, kind, field, slot, n, top): counts of bins add up, registers' tops take the greatest, so
merging is one aggregate and gives the same in any order. A group has at most 15,000 bins a number and 4,096 registers
an id, whatever its rows, so a hot source is summed up before it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Numbers are told apart to a thousandth and, beyond, to eight leading bits.
SCALE, BITS = 1000, 8
#: Hexadecimal digits of a register's number, and of what its top is taken from.
REGISTER, REST = 3, 8
REGISTERS = 16**REGISTER
#: Fixed value: the estimator's constant for so many registers.
ALPHA = 0.7213 / (1 + 1.079 / REGISTERS)


def _bits(n: Column) -> Column:
    """How many bits a number from 0 has; 0 has one."""
    return F.length(F.bin(n))


def bin_of(value: Column) -> Column:
    """The end nearer to zero of a number's bin, in thousandths; null for null and NaN. Beyond 9 * 10**15 all share one."""
    size = F.least(F.abs(value.cast("double")) * SCALE + 0.5, F.lit(9e18)).cast("long")
    shift = F.greatest(_bits(size) - BITS, F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.when(value < 0, -low).otherwise(low))


def value_of(slot: Column) -> Column:
    """The middle of a bin: off by a 256th of a number and a thousandth at most."""
    shift = F.greatest(_bits(F.abs(slot)) - BITS, F.lit(0))
    return (slot + F.signum(slot) * (F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1) / 2) / SCALE


def sketch(df: DataFrame, keys: list[str], numbers: list[str], ids: list[str]) -> DataFrame:
    """(keys, kind, field, slot, n, top) of a batch, in one shuffle of what each task has summed up.

    kind is rows (all), number (filled ones) or id. A null key is a group of its own."""
    none = F.lit(None).cast("int")

    def entry(kind: str, field: str, slot: Column, top: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), slot.cast("long").alias("slot"), top.cast("int").alias("top"))

    def hexed(c: str, first: int, n: int) -> Column:
        return F.conv(F.substring(F.md5(F.col(c).cast("string")), first, n), 16, 10).cast("long")

    entries = [entry("rows", "", F.lit(0)), *(entry("number", c, bin_of(F.col(c))) for c in numbers)]
    for c in ids:
        rest = hexed(c, REGISTER + 1, REST)
        top = F.when(rest == 0, 4 * REST + 1).otherwise(4 * REST + 1 - _bits(rest))
        entries.append(entry("id", c, hexed(c, 1, REGISTER), top))
    rows = df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*").where(F.col("slot").isNotNull())
    return rows.groupBy(*keys, "kind", "field", "slot").agg(F.count("*").alias("n"), F.max("top").alias("top"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the same keys, or of more, as one for each group of the keys."""
    return sketches.groupBy(*keys, "kind", "field", "slot").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def quantiles(merged: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """(keys, field, filled, a column for each name of `at`): the value at place ceil(share * filled) in order, as its bin has it."""
    by = Window.partitionBy(*keys, "field")  # of at most some 15,000 bins
    rows = merged.where("kind = 'number'").withColumns({"_upto": F.sum("n").over(by.orderBy("slot")), "_all": F.sum("n").over(by)})
    picked = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), F.struct("slot")))["slot"] for q in at.values()]
    return rows.groupBy(*keys, "field").agg(F.sum("n").alias("filled"), *(value_of(x).alias(name) for name, x in zip(at, picked, strict=True)))


def distinct(merged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, distinct): about how many different values, with a standard error of 1.6 %; few are counted by empty registers."""
    sums = merged.where("kind = 'id'").groupBy(*keys, "field").agg(F.count("*").alias("_set"), F.sum(F.pow(F.lit(2.0), -F.col("top"))).alias("_sum"))
    empty = REGISTERS - F.col("_set")
    raw = ALPHA * REGISTERS * REGISTERS / (F.col("_sum") + empty)
    few = (raw <= 2.5 * REGISTERS) & (empty > 0)
    return sums.select(*keys, "field", F.round(F.when(few, REGISTERS * F.log(REGISTERS / empty)).otherwise(raw)).cast("long").alias("distinct"))


def keep(sketches: DataFrame, folder: str, day: str = "day") -> None:
    """Writes sketches by day; the days written replace those kept, so that a batch may be run again. Others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)


def report(spark: SparkSession, folder: str, keys: list[str], at: dict[str, float], since: str | None = None, until: str | None = None, day: str = "day") -> DataFrame:
    """(keys, field, records, filled, the names of `at`, distinct) of the kept days from since to until, from sketches alone.

    Files of other days aren't opened. A number has no distinct count, an id no quantiles; a field without values has no row."""
    kept = spark.read.parquet(folder)
    if since is not None:
        kept = kept.where(F.col(day) >= F.lit(since))
    if until is not None:
        kept = kept.where(F.col(day) <= F.lit(until))
    merged = merge(kept, keys)
    records = merged.where("kind = 'rows'").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("n").alias("records"))
    numbers = quantiles(merged, keys, at).withColumn("distinct", F.lit(None).cast("long"))
    counted = distinct(merged, keys).withColumns({"filled": F.lit(None).cast("long"), **{name: F.lit(None).cast("double") for name in at}})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = numbers.unionByName(counted)
    joined = both.join(records, same) if same else both.crossJoin(records)  # without keys records is one row
    return joined.select(*keys, "field", "records", "filled", *at, "distinct")
