"""Interval overlap join: click sessions against sales of the same client, by time slots, with the relation of each pair.

Sessions come by lag and cumulative sum over a client's cells of GAP: clicks of one cell are never GAP apart, so a cell is
summed up on the map side (first ts, last ts, error at the last) before any window. A client has as many cells as its time
span allows, whatever its number of clicks. Sessions and sales are then classes of (client, start slot, end slot), at most
so many as the time span allows again; only classes meet in the join, and a class carries its number of sessions and the
sum of their checksums. Clients with more than a thousandth of the sales are salted: their sales' classes are dealt to
SALTS tasks, their sessions' classes (as few as slots) are repeated in each.

Rows: a null client_id, sold_at or ts takes no part. Each row of sales is an interval, so a repeated sale_id (or none) adds
up; repeated clicks and lines change nothing. A null kind or status is not open, a null shipped_at is ignored. Empty tables
give no rows; other columns are not read. Timestamps may be with a zone or without."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, heavy_keys

#: Microseconds after which a click begins another session, and those of a slot.
GAP, SLOT = 15 * 60 * 1_000_000, 6 * 3600 * 1_000_000
SALTS = 32
#: The end of an open interval: later than all others.
OPEN = 1 << 60


def micros(ts: Column) -> Column:
    """Whole microseconds since 1970 of a timestamp as it is written, whatever the session's time zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    second = F.date_part(F.lit("second"), ts)
    return (day * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60) * 1_000_000 + (second * 1_000_000).cast("long")


def _floor(m: Column, width: int) -> Column:
    return ((m - F.pmod(m, F.lit(width))) / width).cast("long")


def sessions(clicks: DataFrame, gap: int = GAP) -> DataFrame:
    """Sessions (client_id, first, last, open) of clicks; first and last are microseconds."""
    m = micros(F.col("ts"))
    rows = clicks.where(F.col("client_id").isNotNull() & F.col("ts").isNotNull()).select("client_id", m.alias("m"), F.coalesce(F.col("kind") == "error", F.lit(False)).cast("long").alias("error"))
    # the last ts and whether a click there is an error, in one number
    cells = rows.groupBy("client_id", _floor(F.col("m"), gap).alias("cell")).agg(F.min("m").alias("first"), F.max(F.col("m") * 2 + F.col("error")).alias("last"))
    by_time = Window.partitionBy("client_id").orderBy("cell")
    begins = F.col("first") - F.shiftright(F.lag("last").over(by_time), 1) > gap
    numbered = cells.withColumn("begins", F.coalesce(begins, F.lit(True)).cast("long")).withColumn("no", F.sum("begins").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("client_id", "no").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return out.select("client_id", "first", F.shiftright("last", 1).alias("last"), (F.col("last").bitwiseAND(1) == 1).alias("open"))


def sale_intervals(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """Intervals (sale_id, client_id, first, last, open) of sales, from sold_at through the last shipping."""
    shipped = lines.where(F.col("sale_id").isNotNull() & F.col("shipped_at").isNotNull()).groupBy("sale_id").agg(F.max(micros(F.col("shipped_at"))).alias("shipped"))
    own = sales.where(F.col("client_id").isNotNull() & F.col("sold_at").isNotNull()).select("sale_id", "client_id", micros(F.col("sold_at")).alias("first"), F.coalesce(F.col("status") == "open", F.lit(False)).alias("open"))
    return own.join(shipped, "sale_id", "left").select("sale_id", "client_id", "first", F.greatest("first", "shipped").alias("last"), "open")


def _slots(intervals: DataFrame, s: str, e: str, slot: int) -> DataFrame:
    return intervals.withColumns({s: _floor(F.col("first"), slot), e: F.when(F.col("open"), OPEN).otherwise(_floor(F.col("last"), slot))})


def relation(s1: str, e1: str, s2: str, e2: str) -> Column:
    """Allen's relation of the interval (s1, e1) to (s2, e2), for two that share a slot."""
    a, b = F.col(s1), F.col(s2)
    ends = [F.col(e1) < F.col(e2), F.col(e1) == F.col(e2)]

    def by_end(less: str, equal: str, more: str) -> Column:
        return F.when(ends[0], less).when(ends[1], equal).otherwise(more)

    return F.when(a < b, by_end("overlaps", "finished_by", "contains")).when(a == b, by_end("starts", "equals", "started_by")).otherwise(by_end("during", "finishes", "overlapped_by"))


def overlaps(sales: DataFrame, lines: DataFrame, clicks: DataFrame, slot: int = SLOT, gap: int = GAP) -> DataFrame:
    """Rows (sale_id, relation, n_pairs, overlap_slots, sessions_crc) of the pairs of a sale and a session that share a slot."""
    mine = _slots(sale_intervals(sales, lines), "s1", "e1", slot).select("sale_id", "client_id", "s1", "e1")
    theirs = _slots(sessions(clicks, gap), "s2", "e2", slot).groupBy("client_id", "s2", "e2")
    theirs = theirs.agg(F.count("*").alias("n"), F.sum(F.crc32(F.col("first").cast("string").cast("binary"))).alias("crc"))
    hot = heavy_keys(sales, "client_id")
    dealt_sales, dealt_sessions = dealt(mine, theirs, hot, "client_id", SALTS, "s1", "e1")
    classes = dealt_sales.select("client_id", "__sp_salt", "s1", "e1").distinct()
    met = classes.join(dealt_sessions, ["client_id", "__sp_salt"]).where((F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")))
    shared = F.least("e1", "e2") - F.greatest("s1", "s2") + 1
    shared = F.when((F.col("e1") == OPEN) & (F.col("e2") == OPEN), None).otherwise(shared * F.col("n"))
    found = met.groupBy("client_id", "__sp_salt", "s1", "e1", relation("s1", "e1", "s2", "e2").alias("relation"))
    found = found.agg(F.sum("n").alias("n_pairs"), F.sum(shared).alias("overlap_slots"), F.sum("crc").alias("sessions_crc"))
    each = mine.join(found.drop("__sp_salt"), ["client_id", "s1", "e1"])
    return each.groupBy("sale_id", "relation").agg(*(F.sum(c).alias(c) for c in ("n_pairs", "overlap_slots", "sessions_crc")))
