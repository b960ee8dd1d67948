"""What the training-data operators share: shared storage, tables and small SQL idioms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.storage import cut

#: Words are runs of anything but these six code points (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"
#: Java and RE2 class of the characters between words.
GAP = r"[\x20\x09-\x0D]+"


#: Rows up to which a list of their ids and hashes (24 MB as a hash table) is sent to every executor.
BROADCAST_IDS = 500_000


def text_hash() -> Column:
    """What tells rows of one doc_id (or without any) apart, unless their texts are equal."""
    return F.xxhash64("text")


def _met(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    rows = cut(rows.select(F.col("doc_id").alias("__sp_id"), F.col("hash").alias("__sp_h")).distinct())
    few = rows.count() <= BROADCAST_IDS
    same = F.col("doc_id").eqNullSafe(F.col("__sp_id")) & (F.col("__sp_hash") == F.col("__sp_h"))
    return docs.withColumn("__sp_hash", text_hash()).join(F.broadcast(rows) if few else rows, same, how).drop("__sp_hash")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without those of the rows (doc_id, hash), null-safe, with all their columns; hash is text_hash().

    A list of BROADCAST_IDS rows or fewer is broadcast, so texts don't move; a longer one meets docs in a join that
    shuffles both."""
    return _met(docs, rows, "left_anti")


def only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those rows of docs that without() takes away."""
    return _met(docs, rows, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once a row.

    Catalyst may inline an expression into a lambda that refers to it and so compute it anew for each element; a
    value bound by a one-element transform is not inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bitmap(df: DataFrame, column: str, bits: int = 23) -> bytes:
    """A bitmap of 2**bits (1 MB by default, whatever the input) of the column's hashes, for a test without false negatives."""
    slot = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    rows = (
        df.select(slot.alias("s"))
        .groupBy(F.shiftright("s", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
        .collect()  # 2**(bits - 6) rows at most
    )
    out = bytearray(1 << (bits - 3))
    for w, b in rows:
        out[w * 8 : w * 8 + 8] = (b & (2**64 - 1)).to_bytes(8, "little")
    return bytes(out)


def slot_of(column: str, bits: int = 23) -> Column:
    """The bit that bitmap() sets for the column's value."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits)


#: A key is heavy with more than one in so many of the rows; there are fewer of these than this, whatever the input.
HEAVY = 1_000


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys with more than one in HEAVY of df's rows each: fewer than HEAVY rows, so they can be broadcast."""
    least = df.count() / HEAVY
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).select(key)


def dealt(left: DataFrame, right: DataFrame, heavy: DataFrame, key: str, salts: int, *by: str) -> tuple[DataFrame, DataFrame]:
    """left and right with a column __sp_salt to join on beside the key: a heavy key's rows of left are dealt to `salts`
    by the columns `by`, its rows of right are repeated for each; other keys have the salt 0. A null key has it too."""
    marked = heavy.select(F.col(key).alias("__sp_heavy"), F.lit(True).alias("__sp_is"))

    def known(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(marked), F.col(key) == F.col("__sp_heavy"), "left")

    one = F.when(F.col("__sp_is"), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)
    all_ = F.explode(F.when(F.col("__sp_is"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return known(left).withColumn("__sp_salt", one).drop("__sp_heavy", "__sp_is"), known(right).withColumn("__sp_salt", all_).drop("__sp_heavy", "__sp_is")
