"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces, in DataFrame functions only.

A paragraph is a line, a section SECTION lines, and a piece what ends in a sentence's end or after PIECE code points:
a paragraph without line breaks still has many leaves. A leaf is the first 16 hex digits of its piece's SHA-256, an
inner node that of its children's joined digests, the root the whole SHA-256 of the sections' digests. A fingerprint
is root|section;section, a section its paragraphs joined by /, a paragraph its leaves joined by a comma: inner nodes
follow from it, so two fingerprints can be compared from the root down without the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

SECTION, PIECE = 8, 160
#: A piece; the repetition of all pieces is the paragraph. Java and RE2 read it alike.
PIECES = rf"[^.!?]{{1,{PIECE}}}[.!?]*|[.!?]+"
#: Rows of a bucket in the search for each row's next one, about; buckets at most.
BUCKET, BUCKETS = 2_000, 65_536


def _digest(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; a null text is an empty one, whose tree has one paragraph without leaves."""

    def leaves(line: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(line, F.lit(PIECES), F.lit(0)), _digest), ",")

    def sections(paragraphs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(paragraphs), F.lit(SECTION))
        return F.transform(starts, lambda k: F.array_join(F.slice(paragraphs, k, F.lit(SECTION)), "/"))

    def node(section: Column) -> Column:
        return _digest(F.array_join(F.transform(F.split(section, "/"), _digest), ","))

    def whole(parts: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(parts, node), ","), 256)
        return F.concat(root, F.lit("|"), F.array_join(parts, ";"))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), leaves), lambda p: let(sections(p), whole))


def _leaves(print_: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(F.array_remove(F.split(F.substring_index(print_, "|", -1), "[,/;]"), ""))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the distinct leaves in common by those of both, and less than 1: trees of the same
    leaves in other places, or as often repeated, are not equal."""

    def shared(x: Column, y: Column) -> Column:
        n = F.size(x) + F.size(y)
        return F.least(2.0 * F.size(F.array_intersect(x, y)) / F.greatest(n, F.lit(1)), 1 - 1 / (n + F.lit(1.0)))

    ratio = let(_leaves(a), lambda x: let(_leaves(b), lambda y: shared(x, y)))
    return F.when(F.left(a, F.lit(64)) == F.left(b, F.lit(64)), F.lit(1.0)).otherwise(ratio)


def differing(a: Column, b: Column) -> Column:
    """Where two trees differ: an array of (section, paragraph), from 0, of the paragraphs of a that b has not at that place.

    Equal sections are passed over as a whole; equal roots give an empty array."""

    def parts(x: Column) -> Column:
        return F.split(F.substring_index(x, "|", -1), ";")

    def inside(s: Column, k: Column, other: Column) -> Column:
        there = F.split(F.coalesce(F.get(other, k), F.lit("-")), "/")
        marked = F.transform(F.split(s, "/"), lambda p, i: F.struct(k.alias("section"), i.alias("paragraph"), (~p.eqNullSafe(F.get(there, i))).alias("odd")))
        return F.filter(marked, lambda m: m["odd"])

    def found(mine: Column, other: Column) -> Column:
        none = F.array().cast("array<struct<section:int,paragraph:int,odd:boolean>>")
        return F.flatten(F.transform(mine, lambda s, k: F.when(s.eqNullSafe(F.get(other, k)), none).otherwise(inside(s, k, other))))

    same = F.left(a, F.lit(64)) == F.left(b, F.lit(64))
    plain = let(parts(a), lambda x: let(parts(b), lambda y: found(x, y)))
    return F.transform(F.when(same, F.array().cast("array<struct<section:int,paragraph:int,odd:boolean>>")).otherwise(plain), lambda m: F.struct(m["section"].alias("section"), m["paragraph"].alias("paragraph")))


def _longs(values: list[int]) -> Column:
    # a string that is split once, when the plan is made: thousands of literals would slow the planner
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds, which ascend, are not above the key: by every n-th of them, then by those between. 0 for null."""
    step = max(1, int(len(bounds) ** 0.5))
    top = F.size(F.filter(_longs(bounds[::step]), lambda b: b <= key))
    low = F.size(F.filter(F.slice(_longs(bounds), F.greatest(top - 1, F.lit(0)) * step + 1, F.lit(step)), lambda b: b <= key))
    return F.when(key.isNull() | (top == 0), F.lit(0)).otherwise((top - 1) * step + low)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) with next_<column> of the next row by ascending doc_id, of the first row after the last.

    Nulls go first; rows of one doc_id follow one another by text. Rows are dealt into buckets by quantiles of doc_id
    (a sketch finds them; BUCKETS at most come to the driver), and the first row of a bucket goes to the bucket
    before it as well, so no row is sorted beyond its bucket."""
    counts = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id")).first()
    buckets = min(BUCKETS, -(-counts[0] // BUCKET))
    bounds: list[int] = []
    if buckets > 1 and counts[1]:
        marks = docs.select("doc_id").approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 1 / (8 * buckets))
        # the sketch keeps doubles, which large ids don't fit: the bounds are the least ids that there are between its marks
        between = docs.groupBy(_bucket(F.col("doc_id"), sorted({int(m) for m in marks})).alias("b")).agg(F.min("doc_id").alias("least"))
        bounds = sorted({r["least"] for r in between.collect() if r["least"] is not None} - {counts[2]})
    key = F.col("doc_id")
    first = key.isNull() if counts[0] > counts[1] else key == counts[2]
    placed = docs.withColumn("_bucket", _bucket(key, bounds))
    bound = F.coalesce((F.col("_bucket") > 0) & (F.get(_longs(bounds), F.col("_bucket") - 1) == key), F.lit(False))
    copies = F.array_compact(
        F.array(
            F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("part")),
            F.when(bound, F.struct((F.col("_bucket") - 1).alias("bucket"), F.lit(1).alias("part"))),
            F.when(first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(2).alias("part"))),
        )
    )
    dealt = placed.withColumn("_copy", F.explode(copies)).withColumns({"_bucket": F.col("_copy.bucket"), "_part": F.col("_copy.part")}).drop("_copy")
    w = Window.partitionBy("_bucket").orderBy("_part", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_part = 0").drop("_bucket", "_part")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs to (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_at), a row for each row.

    A null text is an empty one. The edited text has its last quarter replaced by the first as many code points of
    the next row's text. A table of one row is its own next; an empty table gives no rows. Repeated rows are next to
    one another. edited_at is the first branch of the text's tree that the edited one's lacks, as section:paragraph from
    0, null if it lacks none. Columns besides doc_id and text are not read."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - part), F.left("next_text", part))
    out = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    out = out.select("doc_id", "fingerprint", "next_fingerprint", n.cast("long").alias("n_chars"), edited.alias("edited"))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        let(F.get(differing(F.col("fingerprint"), F.col("edited_fingerprint")), F.lit(0)), lambda x: F.when(x.isNotNull(), F.concat_ws(":", x["section"], x["paragraph"]))).alias("edited_at"),
    )
