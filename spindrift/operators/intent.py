"""Intent of text queries without a model: known phrases by a join, scores and years by a small grammar, then the search.

A lexicon is a table (phrase, kind, value), so it may be of any size: a query's runs of words meet it in an equi-join
that Catalyst broadcasts or shuffles, and of the runs found the leftmost, then longest, count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import year_of
from spindrift.storage import cut

from .ranking import top_per

#: Kinds of phrases, the first wins where a phrase has several, and words that say nothing by themselves.
KINDS = ("genre", "media_type", "status")
FILLER = ("a", "all", "an", "and", "any", "for", "from", "in", "like", "me", "of", "show", "some", "something", "that", "the", "titles", "to", "with")
#: What is said of scores and years, in lower case; the number is the group.
YEAR = r"((?:19|20)[0-9][0-9])\b"
GRAMMAR = {
    "min_score": r"\b(?:rated |rating |score |scored )?(?:above|over|at least) ([0-9]+(?:\.[0-9]+)?)\b",
    "since": rf"\b(?:since|from) {YEAR}",
    "after": rf"\bafter {YEAR}",
    "until": rf"\buntil {YEAR}",
    "before": rf"\bbefore {YEAR}",
    "within": rf"\bin {YEAR}",
}
#: Words of a phrase at most.
LONGEST = 4


def normal(phrase: Column) -> Column:
    """Lower-cased words, one space apart; what parts them in a query is any other character."""
    return F.array_join(F.regexp_extract_all(F.lower(phrase), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")


def lexicon(catalogue: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(phrase, kind, value) of a catalogue's genres, media types (as '<type> type' too) and statuses, and of synonyms of that form.

    A phrase has one meaning: of several the first kind of KINDS, then the least value. Phrases without a word go."""
    genres = catalogue.select(F.explode("genres").alias("value")).distinct().select(F.col("value").alias("phrase"), F.lit("genre").alias("kind"), "value")
    types = catalogue.select(F.col("media_type").alias("value")).distinct().select(F.explode(F.array("value", F.concat("value", F.lit(" type")))).alias("phrase"), F.lit("media_type").alias("kind"), "value")
    states = catalogue.select(F.col("status").alias("value")).distinct().select(F.regexp_replace("value", "_", " ").alias("phrase"), F.lit("status").alias("kind"), "value")
    all_ = genres.unionByName(types).unionByName(states)
    if synonyms is not None:
        all_ = all_.unionByName(synonyms.select("phrase", "kind", "value"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = all_.withColumn("phrase", normal(F.col("phrase"))).where("phrase <> '' and value is not null").groupBy("phrase").agg(F.min(F.struct(order, "kind", "value")).alias("m"))
    return one.select("phrase", "m.kind", "m.value")


def intents(queries: DataFrame, phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """queries (query_id, text) to (query_id, text, search_terms, genres, media_type, status, min_score, year_from, year_to).

    genres are all that are named, in order; of types and statuses the first named counts. A score over 10 is none. Search terms
    are what is left of the words. Rows alike in id and text are one; a null text has no terms and no filters. Phrases of
    over `longest` words aren't found."""
    rows = queries.select("query_id", "text").distinct()
    lower = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")
    rows = rows.withColumn("_rest", lower)
    for name, pattern in GRAMMAR.items():  # what one has read is no other's, nor a phrase's; | ends a run of words
        rows = rows.withColumn(f"_{name}", F.nullif(F.regexp_extract("_rest", pattern, 1), F.lit(""))).withColumn("_rest", F.regexp_replace("_rest", pattern, " | "))
    rows = rows.withColumn("_words", F.regexp_extract_all("_rest", F.lit(r"([\p{L}\p{N}]+|\|)"), F.lit(1)))
    n, words = F.size("_words"), F.col("_words")
    none = F.array().cast("array<int>")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    # a query goes through the join with its runs and is put together once: joined back to itself, it is twice as many
    # rows, and Spark, which goes by the files' sizes, may take one side for small and send it to the driver
    held = ["_words", *(f"_{name}" for name in GRAMMAR)]
    runs = rows.select("query_id", "text", *held, F.explode_outer(starts).alias("at"))
    runs = runs.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(longest)))).where((F.col("at") + F.col("n") <= n) | (F.col("at").isNull() & (F.col("n") == 1)))
    # a query's words go with its first run alone
    once = F.coalesce(F.col("at"), F.lit(0)) + F.col("n") == 1
    runs = runs.select("query_id", "text", "at", "n", F.array_join(F.slice(words, F.col("at") + 1, F.col("n")), " ").alias("phrase"), *(F.when(once, F.col(c)).alias(c) for c in held))
    kind = "array<struct<at:int,n:int,kind:string,value:string>>"
    named_run = F.when(F.col("kind").isNotNull(), F.struct("at", (-F.col("n")).alias("n"), "kind", "value"))
    met = runs.join(phrases, "phrase", "left").groupBy("query_id", "text")
    rows = met.agg(F.array_sort(F.collect_list(named_run)).alias("_met"), *(F.any_value(c, True).alias(c) for c in held))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("taken"))

    def take(state: Column, run: Column) -> Column:
        taken = F.struct((run["at"] - run["n"]).alias("end"), F.concat(state["taken"], F.array(run)).alias("taken"))
        return F.when(run["at"] >= state["end"], taken).otherwise(state)

    rows = rows.withColumn("_taken", F.aggregate(F.coalesce("_met", F.array().cast(kind)), empty, take)["taken"])
    covered = F.flatten(F.transform("_taken", lambda r: F.sequence(r["at"], r["at"] - r["n"] - 1)))
    left = F.transform(F.array_except(starts, covered), lambda i: F.get(words, i))
    terms = F.filter(left, lambda w: ~w.isin("|", *FILLER))

    def named(k: str) -> Column:
        return F.transform(F.filter("_taken", lambda r: r["kind"] == k), lambda r: r["value"])

    def year(name: str) -> Column:
        return F.col(f"_{name}").cast("int")

    score = F.col("_min_score").try_cast("double")
    return rows.select(
        "query_id", "text", F.array_join(terms, " ").alias("search_terms"), F.array_sort(F.array_distinct(named("genre"))).alias("genres"),
        F.get(named("media_type"), F.lit(0)).alias("media_type"), F.get(named("status"), F.lit(0)).alias("status"), F.when(score <= 10, score).alias("min_score"),
        F.coalesce(year("since"), year("after") + 1, year("within")).alias("year_from"), F.coalesce(year("until"), year("before") - 1, year("within")).alias("year_to"),
    )


#: What a search may ask for beside genres and a least score; which of them it does is its kind, of these bits.
ASKS = {"media_type": 1, "status": 2, "year": 4}
FILTERS = ("genres", "media_type", "status", "min_score", "year_from", "year_to")


def firsts(catalogue: DataFrame, kinds: list[int], order: list[Column], k: int) -> DataFrame:
    """Each kind's classes of records, of the k first each: alike in genres and in what the kind asks for, which is null elsewhere."""
    genres = F.array_sort(F.array_distinct(F.coalesce("genres", F.array().cast("array<string>"))))
    year = year_of(F.col("release_date"), F.lit(None).cast("int"))
    records = catalogue.select("media_id", "title", genres.alias("genres"), "media_type", "status", "score", year.alias("year"), F.explode(F.array(*map(F.lit, kinds)).cast("array<int>")).alias("kind"))
    for c, bit in ASKS.items():  # a record without what is asked for is none
        wanted = F.col("kind").bitwiseAND(bit) != 0
        records = records.where(~wanted | F.col(c).isNotNull()).withColumn(c, F.when(wanted, F.col(c)))
    return top_per(records, ["kind", "genres", *ASKS], order, k).drop("place")


def search(found: DataFrame, catalogue: DataFrame, k: int = 5) -> DataFrame:
    """intents() to (query_id, text, place, media_id, title): the k records of each query's filters, by score (null last) and id.

    A record has all the genres, and a score or year where one is asked for. Queries with the same filters are one search.
    Of records alike in what a search asks for (the set of genres; type, status and year where they are asked for) only the
    k first can be among its own, whatever least score it names. So searches meet such classes, by first genre, type and
    status, never all records: work grows with different searches times different classes."""
    found = cut(found)  # read twice
    asked = found.select(*FILTERS).distinct()
    key = F.md5(F.to_json(F.struct(*FILTERS)))
    said = {"media_type": F.col("media_type"), "status": F.col("status"), "year": F.coalesce("year_from", "year_to")}
    kind = reduce(Column.__add__, [F.when(said[c].isNotNull(), bit).otherwise(0) for c, bit in ASKS.items()])
    asked = cut(asked.select(key.alias("search"), kind.alias("kind"), F.coalesce(F.get("genres", F.lit(0)), F.lit("")).alias("first"), *(F.col(c).alias(f"_{c}") for c in FILTERS)))
    kinds = [r["kind"] for r in asked.select("kind").distinct().collect()]  # eight at most
    order = [F.desc_nulls_last("score"), F.asc("media_id")]
    classes = firsts(catalogue, kinds, order, k)
    classes = classes.withColumn("first", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("genres"))))
    equal = [F.col("a.first") == F.col("c.first"), F.col("a.kind") == F.col("c.kind"), F.col("_media_type").eqNullSafe(F.col("media_type")), F.col("_status").eqNullSafe(F.col("status"))]
    # classes may be as many as records: Spark goes by the size of their files, and isn't to send them to the driver
    met = asked.alias("a").join(classes.alias("c").hint("merge"), equal)
    for wanted, has in (("_min_score", F.col("score") >= F.col("_min_score")), ("_year_from", F.col("year") >= F.col("_year_from")), ("_year_to", F.col("year") <= F.col("_year_to"))):
        met = met.where(F.col(wanted).isNull() | has)
    met = met.where((F.size("_genres") == 0) | (F.size(F.array_except("_genres", "genres")) == 0))
    top = top_per(met.select("search", "media_id", "title", "score"), "search", order, k).drop("score")
    return found.withColumn("search", key).join(top, "search").select("query_id", "text", "place", "media_id", "title")
