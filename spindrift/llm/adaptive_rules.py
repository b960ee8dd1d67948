"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each rule is about a rate: a count by a length, as an integer (thousandths, or hundredths of a code point). A quantile
sketch of each rate is kept per language and source: counts of values by their BITS highest bits, so a quantile is
within a 64th of its value. Sketches merge by adding counts, and are the same whatever the order of rows; a language's
is its sources' merged. Each quantile of a group is weighed by the group's documents against PRIOR documents of its
language, whose quantile is weighed in the same way against that of all, so no group's size switches anything.

An upper threshold is the rule's quantile of all the group's rates or, where that is lower, the LOW-th percentile of
those that aren't 0 (weighed against 0 in the end): in a group where nearly no document has symbols, a document may have
fewer than those few that do. A short text's rate is off by chance, so a document fails if its count is beyond the
threshold's by more than the square root of that, an interval that shrinks, as a rate, with the text's length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
BITS, PRIOR, LOW = 7, 20, 1


@dataclass(frozen=True)
class Rule:
    """A rate of scale * count / per, and the percentage of documents below its quantile (a lower bound if under 50)."""

    count: str
    per: str
    scale: int
    percent: int

    @property
    def rate(self) -> str:
        return f"{self.scale} * {self.count} div greatest({self.per}, 1)"

    @property
    def inside(self) -> str:
        """SQL of a document that keeps to the bound."""
        beyond = f"{self.scale} * {self.count} - {{bound}} * {self.per}"
        if self.percent < 50:
            beyond = f"{{bound}} * {self.per} - {self.scale} * {self.count}"
        return f"{beyond} <= sqrt(cast({self.scale} * {{bound}} * {self.per} as double))"


RULES = {
    "symbols": Rule("n_symbols", "n_words", 1000, 90),
    "dup_lines": Rule("n_dup_lines", "n_lines", 1000, 98),
    "repeats": Rule("n_repeat_words", "n_words", 1000, 99),
    "long_word": Rule("word_chars", "n_words", 100, 95),
    "short_word": Rule("word_chars", "n_words", 100, 5),
}
_NULL = "\u0000"


def repeated_words(words: Column) -> Column:
    """How many words are in a window of WINDOW words that the array has twice or more."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(places, i + 1) - p), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def repeats(sorted_: Column) -> Column:
        same = F.filter(sorted_, lambda x, i: F.coalesce(x["h"] == F.get(sorted_, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(sorted_, i + 1)["h"], F.lit(False)))
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    def counted(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.array_sort(placed), repeats))

    def hashed(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return let(F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))), counted)

    # each word is hashed once, and a window by its words' hashes
    return F.when(F.size(words) > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), hashed)).otherwise(F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, ...) to its counts and measures, a row for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"))

    out = docs.select(
        "doc_id", F.coalesce("lang", F.lit(_NULL)).alias("lang"), F.coalesce("source", F.lit(_NULL)).alias("source"),
        let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), counts).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    out = out.select("doc_id", "lang", "source", "w.*", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("l.n").alias("n_lines"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumns({f"m_{k}": F.expr(r.rate) for k, r in RULES.items()})


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, c): the sketches of the documents that don't fail the base rules."""
    values = F.array(*(F.struct(F.lit(k).alias("measure"), F.col(f"m_{k}").alias("value")) for k in RULES))
    rows = measured.where("not base_failed").select("lang", "source", F.explode(values).alias("x")).select("lang", "source", "x.measure", "x.value")
    rows = rows.withColumn("drop", F.greatest(F.length(F.bin("value")) - BITS, F.lit(0))).withColumn("bucket", F.expr("shiftleft(shiftright(value, drop), drop)"))
    return rows.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("c"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, n, edge, some, low) of each sketch, after merging those that `by` doesn't tell apart: its documents
    and the rule's quantile, those whose rate isn't 0 and their LOW-th percentile (null without any)."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("c").alias("c"))
    group = Window.partitionBy(*by, "measure")
    percent = F.create_map(*(F.lit(x) for k, r in RULES.items() for x in (k, r.percent)))[F.col("measure")]
    sums = {"n": F.sum("c").over(group), "some": F.sum(F.expr("if(bucket > 0, c, 0)")).over(group), "upto": F.sum("c").over(group.orderBy("bucket"))}
    run = merged.withColumns(sums | {"percent": percent})
    # a bucket's highest value; equal values share a bucket, so those of the quantile itself are inside an upper bound
    top = F.expr(f"bucket + shiftleft(1L, greatest(length(bin(bucket)) - {BITS}, 0)) - 1")
    top = F.when((F.col("percent") < 50) | (F.col("bucket") == 0), F.col("bucket")).otherwise(top)
    edge = F.min(F.when(F.expr("100 * upto >= percent * n"), top))
    low = F.min(F.when(F.expr(f"bucket > 0 and 100 * (upto - n + some) >= {LOW} * some"), F.col("bucket")))
    return run.groupBy(*by, "measure").agg(F.max("n").alias("n"), edge.alias("edge"), F.max("some").alias("some"), low.alias("low"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, bound) for every group of the sketch."""
    own = quantiles(sketch, ["lang", "source"])
    wide = quantiles(sketch, ["lang"]).withColumnsRenamed({c: f"{c}_lang" for c in ("n", "edge", "some", "low")})
    whole = quantiles(sketch, []).withColumnsRenamed({c: f"{c}_all" for c in ("n", "edge", "some", "low")})

    def weighed(n: str, value: str, prior: str) -> str:
        return f"(({n} * coalesce({value}, 0) + {PRIOR} * {prior}) div ({n} + {PRIOR}))"

    edge = weighed("n", "edge", weighed("n_lang", "edge_lang", "edge_all"))
    low = weighed("some", "low", weighed("some_lang", "low_lang", weighed("some_all", "low_all", "0")))
    lower = ", ".join(f"'{k}'" for k, r in RULES.items() if r.percent < 50)
    bound = F.expr(f"case when measure in ({lower}) then {edge} else greatest({edge}, {low}) end")
    return own.join(wide, ["lang", "measure"]).join(whole, "measure").select("lang", "source", "measure", bound.cast("long").alias("bound"))


def apply_rules(docs: DataFrame) -> DataFrame:
    """docs to (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row.

    A null text has no words and so fails. A null language or source is a group of its own. Repeated rows count as
    often as they occur, and share a verdict. A document of a group without sketch (all its documents fail the base
    rules) isn't kept, as it fails them. Columns besides doc_id, text, lang and source are not read."""
    measured = cut(measures(docs))
    wide = thresholds(sketches(measured)).groupBy("lang", "source").pivot("measure", list(RULES)).agg(F.first("bound"))
    wide = wide.select("lang", "source", *(F.col(k).alias(f"b_{k}") for k in RULES))
    joined = measured.join(wide, ["lang", "source"], "left")
    ok = ~F.col("base_failed")
    for k, r in RULES.items():
        ok = ok & F.coalesce(F.expr(r.inside.format(bound=f"b_{k}")), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", ok.alias("kept"))
