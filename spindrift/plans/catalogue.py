"""The registered queries of the catalogue engine, and the SQL that each must agree with.

Parts stand for catalogue items: names for titles and genres, types for media types, brands for studios, prices for
scores. Every fifth item has no synopsis, every seventh no score. Documents, pages, embeddings and events stand for
texts, urls, vectors and the ingest log. Each query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import similarity, taxonomy, text
from spindrift.operators import content, dedup, eda, filters, quality, ranking, recommend, vectors
from spindrift.sources import normalize, readers
from spindrift.storage import shared_dir
from spindrift.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    synopsis = F.when(key % 5 == 0, None).when(key % 5 == 1, F.concat(F.lit("Synopsis:  A <b>"), name, F.lit("</b>  thing"))).otherwise(F.concat(name, F.lit(" by "), "p_brand", F.lit(" for everyone who ever wanted one")))
    return table(spark, d, "part").select(
        key.alias("media_id"), name.alias("title"), synopsis.alias("synopsis"), F.col("p_type").alias("media_type"), F.split(name, " ").alias("genres"), F.array("p_brand").alias("studios"),
        F.col("p_size").alias("episodes"), F.when(key % 7 != 0, F.round((F.col("p_retailprice") - 900) / 10, 3)).alias("score"), (key % 97).alias("popularity"),
        (F.col("p_size") * 10).cast("long").alias("vote_count"), F.when(key % 3 != 0, F.concat(F.lit("http://e.com/"), key)).alias("main_picture"), (key % 11 != 0).alias("sfw"),
        F.element_at(F.array(F.lit("finished_airing"), F.lit("currently_airing"), F.lit("On_Hiatus"), F.lit("lost")), (key % 4 + 1).cast("int")).alias("status"),
        F.element_at(F.array(F.lit("mal"), F.lit("tmdb"), F.lit("mangadex"), F.lit("other")), (key % 4 + 1).cast("int")).alias("source"),
        F.concat((F.lit(1990) + key % 30).cast("string"), F.lit("-05")).alias("release_date"),
    )


ITEMS = """with items as (select p_partkey as media_id, p_name as title,
    case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then 'Synopsis:  A <b>' || p_name || '</b>  thing' else p_name || ' by ' || p_brand || ' for everyone who ever wanted one' end as synopsis,
    p_type as media_type, string_split(p_name, ' ') as genres, [p_brand] as studios, p_size as episodes,
    case when p_partkey % 7 <> 0 then round((p_retailprice - 900) / 10, 3) end as score, p_partkey % 97 as popularity, (p_size * 10)::bigint as vote_count,
    case when p_partkey % 3 <> 0 then 'http://e.com/' || p_partkey end as main_picture, p_partkey % 11 <> 0 as sfw,
    ['finished_airing', 'currently_airing', 'On_Hiatus', 'lost'][p_partkey % 4 + 1] as status, ['mal', 'tmdb', 'mangadex', 'other'][p_partkey % 4 + 1] as source,
    (1990 + p_partkey % 30)::varchar || '-05' as release_date from part) """
_QUERY = "(select embedding from embeddings where vec_id = 0)"
_COS = "list_cosine_similarity(embedding::double[], {q}::double[])"


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


def vector_of(spark: SparkSession, d: str, vec_id: int) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query"))


# vectors


@query(f"select vec_id, round({_COS.format(q=_QUERY)}, 6) as score from embeddings order by {_COS.format(q=_QUERY)} desc, vec_id limit 20")
def vector_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.nearest(table(spark, d, "embeddings"), vector_of(spark, d, 0), 20).select("vec_id", "score"), "score")


@query(f"select vec_id, round(list_distance(embedding::double[], {_QUERY}::double[]), 6) as score from embeddings order by list_distance(embedding::double[], {_QUERY}::double[]), vec_id limit 20")
def vector_knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.nearest(table(spark, d, "embeddings"), vector_of(spark, d, 0), 20, metric="l2").select("vec_id", "score"), "score")


@query(f"select vec_id, round({_COS.format(q=_QUERY)}, 6) as score from embeddings where label in (1, 2, 3) order by {_COS.format(q=_QUERY)} desc, vec_id limit 20")
def vector_knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.nearest(table(spark, d, "embeddings"), vector_of(spark, d, 0), 20, filters={"label": [1, 2, 3], "none": None}).select("vec_id", "score"), "score")


@query("""select query_id, vec_id, round(score, 6) as score, place from (select q.vec_id as query_id, e.vec_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as score,
    row_number() over (partition by q.vec_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) as place
    from embeddings e, embeddings q where q.vec_id % 20 = 0 and e.vec_id <> q.vec_id) where place <= 5""")
def batch_knn_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(vectors.nearest_batch(rows, asked, 5), "score")


@query()
def vector_knn_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against the index of all."""
    rows = table(spark, d, "embeddings")
    path = f"{shared_dir(spark)}/index-{uuid4().hex}"
    vectors.build_index(rows, path)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(vectors.search_index(spark, path, asked, 10), "score")


@query("""select vec_id, case when vec_id % 3 = 0 then label + 100 else label end as label from embeddings union all select vec_id + 1000000, 7 from embeddings where vec_id < 10""")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    old = rows.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 50).alias("label"), F.lit(1).alias("_version"))
    new = rows.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("_version"))
    added = rows.where("vec_id < 10").select((F.col("vec_id") + 1000000).alias("vec_id"), F.lit(7).alias("label"), F.lit(1).alias("_version"))
    return vectors.upsert(rows, old.unionByName(new).unionByName(added))


@query("select label, count(*) as vectors from embeddings group by label")
def vector_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"))


# recommendation


@query(ITEMS + f""", hits as (select vec_id, {_COS.format(q=_QUERY)} as s from embeddings order by s desc, vec_id limit 50)
    select media_id, title, round(s + 0.05 * (coalesce(score, 5) / 10), 6) as score from hits join items on vec_id = media_id order by s + 0.05 * (coalesce(score, 5) / 10) desc, media_id limit 10""")
def hybrid_recommend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(recommend.hybrid(table(spark, d, "embeddings"), items(spark, d), recommend.Request(vector_of(spark, d, 0))), "score")


@query(ITEMS + f""", hits as (select vec_id, {_COS.format(q='(select embedding from embeddings where vec_id = 3)')} as s from embeddings where vec_id <> 3 and label in (0, 1, 2, 3, 4) order by s desc, vec_id limit 50)
    select media_id, title, round(s + 0.05 * (coalesce(score, 5) / 10), 6) as score from hits join items on vec_id = media_id order by s + 0.05 * (coalesce(score, 5) / 10) desc, media_id limit 10""")
def recommend_by_item(spark: SparkSession, d: str) -> DataFrame:
    return rounded(recommend.hybrid(table(spark, d, "embeddings"), items(spark, d), recommend.Request(media_id=3, filters={"label": [0, 1, 2, 3, 4]})), "score")


@query(ITEMS + f""", hits as (select vec_id, {_COS.format(q='(select embedding from embeddings where vec_id = 7)')} as s from embeddings
        where vec_id in (select media_id from items where media_type in ('PROMO', 'SMALL')) order by s desc, vec_id limit 20)
    select media_id, title, media_type, round(s, 6) as score from hits join items on vec_id = media_id where media_id <> 7 and media_type in ('PROMO', 'SMALL') order by s desc, media_id limit 10""")
def cross_media_semantic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(recommend.cross_media(table(spark, d, "embeddings"), items(spark, d), 7, ["PROMO", "SMALL"], 10), "score")


@query(ITEMS + """, own as (select genres as g from items where media_id = 7), j as (select media_id, title, len(list_intersect(genres, g)) / len(list_distinct(list_concat(genres, g))) as s
    from items, own where media_type in ('PROMO', 'LARGE')) select media_id, title, round(s, 6) as score from j where s > 0 order by s desc, media_id limit 25""")
def genre_jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(recommend.by_genres(items(spark, d), 7, ["PROMO", "LARGE"], 25), "score")


@query(ITEMS + f""", a as (select vec_id as media_id, {_COS.format(q=_QUERY)} as s from embeddings order by s desc, vec_id limit 30), b as (select media_id, score / 10 as s from items order by score desc nulls last, media_id limit 30)
    select media_id, round(0.6 * coalesce(a.s, 0) + (1 - 0.6) * coalesce(b.s, 0), 6) as score from a full join b using (media_id) order by 0.6 * coalesce(a.s, 0) + (1 - 0.6) * coalesce(b.s, 0) desc, media_id limit 20""")
def combined_alpha_blend(spark: SparkSession, d: str) -> DataFrame:
    semantic = vectors.nearest(table(spark, d, "embeddings"), vector_of(spark, d, 0), 30).select(F.col("vec_id").alias("media_id"), "score")
    by_score = items(spark, d).select("media_id", (F.col("score") / 10).alias("score")).orderBy(F.desc_nulls_last("score"), "media_id").limit(30)
    return rounded(recommend.combined(semantic, by_score, 0.6, 20), "score")


_TFIDF = """, words as (select media_id, unnest(regexp_extract_all(lower(concat_ws(' ', array_to_string(genres, ' '), array_to_string(studios, ' '))), '\\w\\w+')) as term from items),
    tf as (select media_id, term, count(*) as tf from words group by all), idf as (select term, ln((1 + (select count(*) from items)) / (1 + count(*))) + 1 as idf from tf group by term),
    raw as (select media_id, term, tf * idf as w from tf join idf using (term)), len_ as (select media_id, sqrt(sum(w * w)) as l from raw group by media_id),
    weights as (select media_id, term, w / l as weight from raw join len_ using (media_id))"""


@query(ITEMS + _TFIDF + """, mm as (select min(score) sl, max(score) sh, avg(score) sm, min(episodes) el, max(episodes) eh from items),
    n as (select media_id, (coalesce(score, sm) - sl) / (sh - sl) as a, (episodes - el) / (eh - el) as b from items, mm), o as (select a as oa, b as ob from n where media_id = 5),
    t as (select w.media_id, sum(w.weight * q.weight) as t from weights w join (select * from weights where media_id = 5) q using (term) group by w.media_id),
    s as (select media_id, sum(weight * weight) as s from weights group by media_id),
    z as (select n.media_id, coalesce(t, 0) + a * oa + b * ob as dot, sqrt(coalesce(s, 0) + a * a + b * b) as size from n join o on true left join t using (media_id) left join s using (media_id))
    select media_id, round(dot / (size * (select size from z where media_id = 5)), 6) as score from z where media_id <> 5 order by score desc, media_id limit 20""")
def content_tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    out = content.similar_items(items(spark, d), 5, 200)
    return rounded(out, "score").orderBy(F.desc("score"), "media_id").limit(20)


@query(ITEMS + _TFIDF + " select media_id, term, round(weight, 6) as weight from weights")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(content.tfidf(items(spark, d), "media_id", content.features(F.col("genres"), F.col("studios"))), "weight")


@query()
def text_tfidf_ngrams(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return rounded(content.similar_texts(docs, docs.agg(F.min("doc_id")).first()[0], 10, "doc_id", F.col("text")), "score", to=4)


@query(ITEMS + ", s as (select min(score) l, max(score) h, avg(score) m from items) select media_id, round((coalesce(score, m) - l) / (h - l), 6) as score, 0.5 as constant from items, s")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.min_max(items(spark, d).select("media_id", "score", F.lit(3.0).alias("constant")), ["score", "constant"]), "score", "constant")


@query(ITEMS + ", s as (select avg(score) m, stddev_pop(score) s from items) select media_id, round((score - m) / s, 6) as score from items, s")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.standard_scale(items(spark, d).select("media_id", "score"), ["score"]), "score")


@query(ITEMS + """, r as (select vec_id, round(list_distance(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]), 6) as dist from embeddings order by dist, vec_id limit 20)
    select vec_id, round(1 - dist / (select max(dist) from r), 4) as similarity from r""")
def display_similarity(spark: SparkSession, d: str) -> DataFrame:
    hits = rounded(vectors.nearest(table(spark, d, "embeddings"), vector_of(spark, d, 0), 20, metric="l2").select("vec_id", F.col("score").alias("dist")), "dist")
    return hits.crossJoin(hits.agg(F.max("dist").alias("top"))).select("vec_id", similarity.display_similarity(F.col("dist"), F.col("top")).alias("similarity"))


# orders and pages


@query(ITEMS + "select media_id, title, score, popularity from items order by score desc nulls last, popularity nulls last, media_id limit 20")
def trending_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.trending(items(spark, d)).select("media_id", "title", "score", "popularity")


@query(ITEMS + """, r as (select media_id, vote_count, case when score is not null then rank() over (order by score desc nulls last) + (count(*) over (partition by score) - 1) / 2 end as score_rank,
    rank() over (order by vote_count desc) + (count(*) over (partition by vote_count) - 1) / 2 as scored_by_rank from items)
    select media_id, score_rank::double as score_rank, scored_by_rank::double as scored_by_rank, (score_rank + scored_by_rank)::double as rank_sum from r""")
def catalogue_rank_sum(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_sum(items(spark, d).withColumn("scored_by", F.col("vote_count"))).select("media_id", "score_rank", "scored_by_rank", "rank_sum")


@query(ITEMS + """select media_id, round(coalesce(score, 0) / 10 + coalesce(nullif(popularity, 0), vote_count) / (select max(coalesce(nullif(popularity, 0), vote_count)) from items) * 0.5, 6) as merge_score
    from items order by merge_score desc, media_id limit 50""")
def merge_quality_order(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(ranking.merge_order(items(spark, d)).select("media_id", "merge_score"), "merge_score")
    return out.orderBy(F.desc("merge_score"), "media_id").limit(50)


@query(ITEMS + "select media_id, title from items order by title, media_id limit 15 offset 30")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.page(items(spark, d), ["title", "media_id"], 30, 15).select("media_id", "title")


@query("""select id, updated_at from (select o_orderkey as id, o_orderdate as updated_at, max(o_orderkey) over (order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as top from orders) where top is null or id > top""")
def running_max_frontier(spark: SparkSession, d: str) -> DataFrame:
    return ranking.frontier(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at")))


@query("""with o as (select o_orderkey as id, o_orderdate as updated_at from orders), f as (select id, updated_at from (select *, max(id) over (order by updated_at, id rows between unbounded preceding and 1 preceding) as top from o) where top is null or id > top)
    select o.id, o.updated_at, (select f.updated_at from f where f.id >= o.id order by f.id limit 1) as created_at_before from o""")
def created_at_asof(spark: SparkSession, d: str) -> DataFrame:
    return ranking.created_before(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at")))


# filters


@query(ITEMS + "select media_id from items where contains(lower(title), 'ring') or coalesce(contains(lower(synopsis), 'ring'), false) order by media_id")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return filters.keyword(items(spark, d), "RING").select("media_id")


@query(ITEMS + "select media_id from items where title like '%red%' or title like '%old%'")
def list_filter_any(spark: SparkSession, d: str) -> DataFrame:
    df = items(spark, d)
    return df.where(filters.condition(df, {"genres": ["Red", "old"]})).select("media_id")


@query(ITEMS + "select media_id from items where score between 2 and 8 and episodes between 5 and 30")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    df = items(spark, d)
    return df.where(filters.condition(df, filters.build_filters(score_range="2-8", episode_range="5-30"))).select("media_id")


@query(ITEMS + "select media_id from items where lower(media_type) = 'promo' and lower(status) = 'lost'")
def single_filter(spark: SparkSession, d: str) -> DataFrame:
    df = items(spark, d)
    return df.where(filters.condition(df, filters.build_filters(media_type="Promo", status="LOST"))).select("media_id")


@query(ITEMS + "select media_id from items where coalesce(sfw, true)")
def sfw_filter(spark: SparkSession, d: str) -> DataFrame:
    df = items(spark, d)
    return df.where(filters.condition(df, {"sfw": True})).select("media_id")


@query(ITEMS + "select media_id from items where sfw and (title like '%red%')")
def filter_relaxation(spark: SparkSession, d: str) -> DataFrame:
    return filters.relaxed(items(spark, d), {"genres": ["red"], "sfw": True, "score_min": 99}).select("media_id")


@query(ITEMS + "select media_id, score from (select * from items order by score desc nulls last, media_id limit 100) where sfw order by score desc nulls last, media_id limit 10")
def semi_join_restrict(spark: SparkSession, d: str) -> DataFrame:
    df = items(spark, d)
    order = [F.desc_nulls_last("score"), F.asc("media_id")]
    return filters.restrict(df.orderBy(*order).limit(100), df.where("sfw"), "media_id", order, 10).select("media_id", "score")


@query(f"""{ITEMS}, h as (select vec_id as media_id from embeddings order by vec_id desc limit 40) select media_id, coalesce(title, 'Title Not Found') as title from h left join items using (media_id)""")
def hydrate_left_join(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "embeddings").select(F.col("vec_id").alias("media_id")).orderBy(F.desc("media_id")).limit(40)
    return recommend.titled(hits, items(spark, d)).select("media_id", "title")


@query(ITEMS + "select media_id from items where score >= 5 and vote_count >= 50 and synopsis is not null")
def valid_screen(spark: SparkSession, d: str) -> DataFrame:
    return filters.valid_screen(items(spark, d).withColumn("media_type", F.lit("tv"))).select("media_id")


@query(ITEMS + "select media_id from items where (synopsis is null or length(synopsis) >= 50) and (score is null or score >= 1) and len(genres) > 0")
def valid_anime(spark: SparkSession, d: str) -> DataFrame:
    return filters.valid_anime(items(spark, d), 50, 1.0).select("media_id")


@query(ITEMS + "select media_id, media_id % 3 = 0 and media_type = 'SMALL' as asian from items")
def drama_split(spark: SparkSession, d: str) -> DataFrame:
    df = items(spark, d).withColumn("metadata", F.struct(F.when(F.col("media_id") % 3 == 0, F.array(F.lit("KR"))).otherwise(F.array(F.lit("US"))).alias("origin_country")))
    df = df.withColumn("media_type", F.when(F.col("media_type") == "SMALL", "tv").otherwise("movie"))
    asian, rest = filters.split_drama(df)
    return asian.select("media_id", F.lit(True).alias("asian")).unionByName(rest.select("media_id", F.lit(False).alias("asian")))


# aggregations and quality


@query(ITEMS + "select distinct unnest(genres) as genre from items order by genre")
def distinct_genres(spark: SparkSession, d: str) -> DataFrame:
    return recommend.genres_of(items(spark, d))


@query(ITEMS + "select media_type as value, count(*) as count, round(100 * count(*) / sum(count(*)) over (), 4) as percent from items group by media_type")
def value_counts_pct(spark: SparkSession, d: str) -> DataFrame:
    return quality.shares(items(spark, d), "media_type")


_FIELDS = ("title", "synopsis", "score", "main_picture")


@query(ITEMS + " union all ".join(f"select '{c}' as field, count({c}) as filled, round(100 * count({c}) / count(*), 2) as percent from items" for c in _FIELDS))
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return quality.completeness(items(spark, d).select(*_FIELDS))


@query(ITEMS + ", f as (" + " union all ".join(f"select '{c}' as field, round(100 * count({c}) / count(*), 4) as percent from items" for c in ("title", "synopsis", "genres", "score", "main_picture")) + ") select *, case when percent >= 95 then 'good' when percent >= 80 then 'fair' else 'poor' end as mark from f")
def core_completeness(spark: SparkSession, d: str) -> DataFrame:
    return quality.core_completeness(items(spark, d))


@query(ITEMS + "select count(score) as scored, round(avg(score), 6) as mean, round(median(score), 6) as median, min(score) as low, max(score) as high, round(avg(length(synopsis)), 6) as synopsis_length from items")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.score_stats(items(spark, d)), "mean", "median", "synopsis_length")


@query("select doc_id, copies from (select doc_id, count(*) over (partition by text) as copies from documents) where copies > 1")
def duplicates_all(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_members(table(spark, d, "documents"), "text").select("doc_id", "copies")


@query("select (count(*) - count(distinct text))::bigint as duplicates from documents")
def duplicate_count(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_count(table(spark, d, "documents").select("text"), "text")


_QUALITY = "round((1 + case when length(synopsis) >= 50 then 1 when length(synopsis) > 0 then 0.5 else 0 end + (score is not null)::int + 1 + (main_picture is not null)::int) / 5, 2)"


@query(ITEMS + f"select media_id, {_QUALITY}::double as quality_score from items")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("media_id", quality.quality_score().alias("quality_score"))


@query(ITEMS + f"select {_QUALITY}::double as value, count(*) as count, round(100 * count(*) / sum(count(*)) over (), 4) as percent from items group by 1")
def quality_distribution(spark: SparkSession, d: str) -> DataFrame:
    return quality.shares(items(spark, d).select(quality.quality_score().alias("q")), "q")


@query(ITEMS + f"select media_id, {_QUALITY}::double as quality_score from items where {_QUALITY} < 0.75")
def low_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.low_quality(items(spark, d), 0.75).select("media_id", "quality_score")


@query(ITEMS + f"select count(*) as records, round(avg({_QUALITY}), 4)::double as mean_quality, count(*) filter ({_QUALITY} < 0.6) as low_quality, array_to_string(list_sort(list_distinct(list(media_type))), ',') as odd_types, 0::bigint as odd_scores, 0::bigint as duplicates from items")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(items(spark, d))


@query("select page_id from pages where page_id % 4 <> 0 and page_id % 4 <> 3")
def invalid_urls(spark: SparkSession, d: str) -> DataFrame:
    # of four pages one keeps its url, one loses the scheme, one the host, one the whole
    url = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "^[a-z]+://", "")).when(F.col("page_id") % 4 == 2, F.lit("http:///x"))
    return quality.invalid_urls(table(spark, d, "pages").select("page_id", url.alias("url")), "url").select("page_id")


@query(ITEMS + "select media_type, count(*) as records, count(synopsis) as with_synopsis, count(score) as with_score, round(avg(score), 4) as mean_score from items group by media_type")
def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merge_stats(items(spark, d))


# text and taxonomy


@query(r"""select page_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\s\x0B\x1C-\x1F\x85\xA0\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]+', ' ', 'g')), '^(Synopsis:|Description:)\s*', '', 'i'), '^ | $', '', 'g')) as synopsis from pages""")
def clean_html_synopsis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.clean_manga_synopsis(F.col("html")).alias("synopsis"))


@query(ITEMS + r"select media_id, coalesce(trim(regexp_replace(regexp_replace(synopsis, '\s+', ' ', 'g'), '^(Overview:|Synopsis:|Plot:)\s*', '', 'i')), '') as synopsis from items")
def clean_prefix(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("media_id", text.clean_screen_synopsis(F.col("synopsis")).alias("synopsis"))


@query(ITEMS + "select media_id, coalesce(synopsis, 'A Seinen manga titled ''' || title || ''' featuring ' || array_to_string(genres, ', ') || '.') as synopsis from items")
def fallback_synopsis(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("media_id", text.fallback_synopsis(F.col("synopsis"), F.col("title"), F.lit("Seinen"), F.col("genres")).alias("synopsis"))


@query(ITEMS + ", t as (select media_id, list_transform(genres, lambda g: upper(g[1]) || lower(g[2:])) as g from items) select media_id, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), '|') as genres from t")
def title_case_genres(spark: SparkSession, d: str) -> DataFrame:
    raw = F.transform("genres", lambda g: F.concat(F.lit(" "), F.upper(g), F.lit(" ")))
    return items(spark, d).select("media_id", F.array_join(taxonomy.clean_genres(raw), "|").alias("genres"))


_TAGS = "list_transform([p_partkey % 5, p_partkey % 7, p_partkey % 3], lambda k: ['Action', 'Isekai', 'Kids', 'School', 'Drama', 'Hentai', 'Unknown'][k + 1])"


@query(f"""with t as (select p_partkey as media_id, {_TAGS} as tags from part) select media_id, array_to_string(list_filter(tags, lambda t: t in ('Action', 'Drama', 'Hentai')), '|') as genres,
    array_to_string(list_filter(tags, lambda t: t in ('Isekai', 'School')), '|') as themes, array_to_string(list_filter(tags, lambda t: t = 'Kids'), '|') as demographics, not list_contains(tags, 'Hentai') as sfw from t""")
def taxonomy_split(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Action", "Isekai", "Kids", "School", "Drama", "Hentai", "Unknown")))
    key = F.col("p_partkey")
    tags = F.transform(F.array(key % 5, key % 7, key % 3), lambda k: F.get(names, k.cast("int")))
    split = table(spark, d, "part").select(key.alias("media_id"), tags.alias("tags")).withColumn("s", taxonomy.split_tags(F.col("tags")))
    joined = [F.array_join(F.col(f"s.{c}"), "|").alias(c) for c in ("genres", "themes", "demographics")]
    return split.select("media_id", *joined, taxonomy.safe_for_work(F.col("s.genres")).alias("sfw"))


@query("""select p_partkey as media_id, ['Sci-Fi', 'Fantasy', 'Slice Of Life', 'Sci-Fi', 'Magic-School''S'][p_partkey % 5 + 1] as genre from part""")
def genre_synonyms(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(F.lit("science fiction"), F.lit(" ISEKAI "), F.lit("Iyashikei"), F.lit("mecha"), F.lit("magic-school's")), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("media_id"), F.array_join(taxonomy.normal_genres(F.array(raw, raw)), "|").alias("genre"))


@query(ITEMS + "select media_id, case status when 'finished_airing' then 'completed' when 'currently_airing' then 'ongoing' when 'On_Hiatus' then 'hiatus' else status end as status from items")
def status_map(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("media_id", taxonomy.status(F.col("status")).alias("status"))


@query("""select o_orderkey as id, case o_orderkey % 3 when 0 then date_trunc('year', o_orderdate)::date when 1 then date_trunc('month', o_orderdate)::date else o_orderdate::date end as day from orders""")
def partial_date(spark: SparkSession, d: str) -> DataFrame:
    length = F.element_at(F.array(F.lit(4), F.lit(7), F.lit(10)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    raw = F.left(F.date_format("o_orderdate", "yyyy-MM-dd"), length)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.padded_date(raw).alias("day"))


@query("""select p_partkey as media_id, case when p_partkey % 3 < 2 then lower(p_type) else 'unknown' end as media_type, case when p_partkey % 3 = 0 then 'mal' else 'unknown' end as source, case when p_partkey % 3 = 0 then p_partkey || '-x' else p_partkey::varchar end as source_id from part""")
def id_parse(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    full = text.build_id(F.lower("p_type"), F.lit("mal"), F.concat(key.cast("string"), F.lit("-x")))
    raw = F.when(key % 3 == 0, full).when(key % 3 == 1, F.concat_ws("-", F.lower("p_type"), key)).otherwise(key.cast("string"))
    return table(spark, d, "part").select(key.alias("media_id"), text.parse_id(raw).alias("p")).select("media_id", "p.*")


@query(ITEMS + "select media_id, title || ' (' || media_type || '): ' || coalesce(synopsis, '') as embedding_text from items")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("media_id", text.embedding_text(F.col("title"), F.lit(None).cast("string"), F.col("media_type"), F.col("synopsis")).alias("embedding_text"))


@query("""select event_id, (props->>'k')::int as k, round(value, 2) as value, case when value between 0 and 10 then round(value, 2) end as score from events""")
def json_and_scores(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", parsed.alias("k"), F.round("value", 2).alias("value"), text.bounded_score(F.col("value")).alias("score"))


# sources, union, dedup


@query("""select doc_id as id, source, 'docs' as origin from documents union all select page_id, null, 'pages' from pages""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.lit("docs").alias("origin"))
    return docs.unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("origin")), allowMissingColumns=True)


@query("select text_id, doc_id from (select md5(text) as text_id, doc_id, row_number() over (partition by text order by doc_id) as n from documents) where n = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first(table(spark, d, "documents"), "text", "doc_id").select(F.md5("text").alias("text_id"), "doc_id")


@query()
def fuzzy_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.fuzzy_dedup(_titled(spark, d)).select("media_id", "title", "score")


@query()
def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cross_source_dedup(_titled(spark, d)).select("media_id", "title", "source")


@query()
def merge_datasets(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merge_datasets(_titled(spark, d)).select("media_id", "title", "merge_score")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """Items whose titles are the first sentences of documents, whole."""
    sentence = F.trim(F.regexp_extract("text", r"^\s*([^.!?\n]*)", 1))
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        n.alias("media_id"), sentence.alias("title"), F.col("lang").alias("media_type"), F.element_at(F.array(F.lit("mal"), F.lit("tmdb"), F.lit("mangadex"), F.lit(None)), (n % 4 + 1).cast("int")).alias("source"),
        F.when(n % 9 != 0, (n % 101) / 10).alias("score"), F.concat((F.lit(2000) + n % 3).cast("string"), F.lit("-01-01")).alias("release_date"), (n % 13).alias("popularity"), (n % 7).alias("vote_count"),
    )


@query(ITEMS + """select a.media_id, case when a.source = b.source or (a.source = 'other' and b.source = 'other') then coalesce(a.score, 0) >= coalesce(b.score, 0)
    else list_position(['mal', 'tmdb', 'mangadex', 'other'], a.source) < list_position(['mal', 'tmdb', 'mangadex', 'other'], b.source) end as first_wins
    from items a join items b on b.media_id = a.media_id + 1 + a.media_id % 4""")
def source_conflict(spark: SparkSession, d: str) -> DataFrame:
    a, b = items(spark, d), items(spark, d).select(F.col("media_id").alias("other"), F.col("source").alias("source_b"), F.col("score").alias("score_b"))
    met = a.join(b, F.col("other") == F.col("media_id") + 1 + F.col("media_id") % 4)
    return met.select("media_id", dedup.first_wins(F.col("source"), F.col("score"), F.col("source_b"), F.col("score_b")).alias("first_wins"))


@query(ITEMS + "select 'anime-' || media_id as media_id, title, main_picture, score, array_to_string(genres, '|') as genres, 'TV' as sub_type, case status when 'finished_airing' then 'completed' when 'currently_airing' then 'ongoing' else status end as status, media_id % 2 = 1 as nsfw from items")
def normalize_list_service(spark: SparkSession, d: str) -> DataFrame:
    raw = items(spark, d).select(F.struct(
        F.col("media_id").alias("id"), "title", F.struct(F.lit("").alias("large"), F.col("main_picture").alias("medium")).alias("main_picture"), F.col("score").alias("mean"), "status", F.lit("tv").alias("media_type"),
        F.transform("genres", lambda g: F.struct(g.alias("name"))).alias("genres"), F.when(F.col("media_id") % 2 == 1, "black").alias("nsfw"),
    ).alias("node"))
    return normalize.list_service(raw, "anime").select("media_id", "title", "main_picture", "score", F.array_join("genres", "|").alias("genres"), "sub_type", "status", F.col("metadata.nsfw").alias("nsfw"))


@query(ITEMS + """select 'tv-' || media_id as media_id, title, case when media_id % 4 < 3 then ['K-Drama', 'J-Drama', 'C-Drama'][media_id % 4 + 1] else 'TV Series' end as sub_type, '18|' || (media_id % 3) as genres, coalesce(vote_count, 0)::int as votes from items""")
def normalize_screen_service(spark: SparkSession, d: str) -> DataFrame:
    country = F.get(F.array(F.lit("KR"), F.lit("JP"), F.lit("CN"), F.lit("US")), (F.col("media_id") % 4).cast("int"))
    raw = items(spark, d).select(F.col("media_id").alias("id"), F.col("title").alias("name"), F.array(country).alias("origin_country"), F.array(F.lit(18), (F.col("media_id") % 3).cast("int")).alias("genre_ids"), F.col("vote_count").cast("int").alias("vote_count"))
    return normalize.screen_service(raw, "tv").select("media_id", "title", "sub_type", F.array_join("genres", "|").alias("genres"), F.col("metadata.vote_count").alias("votes"))


# statistics


@query("select lang, round(avg((quality is null)::int), 6) as missing_rate, count(*) as records from documents left join labels using (doc_id) group by lang")
def missing_rate_by_group(spark: SparkSession, d: str) -> DataFrame:
    return eda.missing_rate(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "quality", "lang")


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]))
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return eda.correlations(table(spark, d, "lineitem"), list(_NUMBERS))


@query("select least(greatest(floor(l_extendedprice / 1000) + 1, 1), 100)::int as bin, count(*) as count from lineitem group by 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.histogram(table(spark, d, "lineitem"), "l_extendedprice", 0, 100_000, 100)


@query("select strftime(date_trunc('month', o_orderdate), '%Y-%m') as month, o_orderstatus, count(*) as count from orders where year(o_orderdate) >= 1980 group by 1, 2")
def date_histogram(spark: SparkSession, d: str) -> DataFrame:
    return eda.by_month(table(spark, d, "orders").where(eda.since(F.col("o_orderdate"))), "o_orderdate", "o_orderstatus")


@query("select p_partkey, " + ", ".join(f"(p_type = '{t}')::int as {t}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " from part")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return vectors.one_hot(table(spark, d, "part"), "p_partkey", "p_type")


@query("""with m as (select p_size as mode from part where p_partkey % 5 <> 0 group by p_size order by count(*) desc, p_size limit 1) select p_partkey, case when p_partkey % 5 <> 0 then p_size else mode end as p_size from part, m""")
def mode_impute(spark: SparkSession, d: str) -> DataFrame:
    return eda.impute_mode(table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size")), "p_size")


@query("select p_size, count(*) as count from part group by p_size order by count(*) desc, p_size limit 30")
def group_top30(spark: SparkSession, d: str) -> DataFrame:
    return eda.top_counts(table(spark, d, "part"), "p_size")


@query(" union all ".join(f"select '{c}' as field, count(*) - count({c}) as missing, count(distinct {c}) as distinct from part" for c in ("p_name", "p_brand", "p_type")))
def null_and_distinct(spark: SparkSession, d: str) -> DataFrame:
    return eda.null_and_distinct(table(spark, d, "part").select("p_name", "p_brand", "p_type"))


@query("""with e as (select *, case event_type when 'error' then '429 slow down' when 'click' then 'Connection reset' when 'view' then 'Not Found: 404' when 'signup' then 'bad JSON' else 'odd' end as m from events)
    select user_id % 5 as source, case event_type when 'error' then 'rate_limit' when 'click' then 'transient' when 'view' then 'permanent' when 'signup' then 'data_quality' else 'unknown' end as category, count(*) as errors, count(*) >= 10 as over_limit from e group by 1, 2""")
def error_category_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.error_stats(_errors(spark, d))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    messages = {"error": "429 slow down", "click": "Connection reset", "view": "Not Found: 404", "signup": "bad JSON"}
    return table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("source"), (F.col("event_id") % 7).cast("int").alias("attempt"), taxonomy.lookup(F.col("event_type"), messages, F.lit("odd")).alias("message"))


@query("""select event_id, event_type in ('error', 'click') and event_id % 7 < 3 as retry, least((case when event_type = 'error' then 2 else 1 end) * pow(2, event_id % 7), 60)::double as wait from events""")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    return ingest.retry_plan(_errors(spark, d)).select("event_id", "retry", "wait")


@query("select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    counts = ingest.windowed_counts(table(spark, d, "events"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", F.round("total", 4).alias("total"))


@query("select event_id as media_id, event_type as title from events")
def stream_ingest_available_now(spark: SparkSession, d: str) -> DataFrame:
    """Streams the event table into a Parquet table twice on one checkpoint; the second run adds nothing."""
    root = f"{shared_dir(spark)}/ingest-{uuid4().hex}"
    source = ingest.read_files(spark, f"{d}/[e]vents.parquet", table(spark, d, "events").schema)
    for _ in range(2):
        ingest.ingest(source, lambda b: b.select(F.col("event_id").alias("media_id"), F.col("event_type").alias("title")), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return readers.read_existing(spark, [f"{root}/table"]).select("media_id", "title")


@query("select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as place from conversations qualify place <= 3")
def top_per_key(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], 3)
