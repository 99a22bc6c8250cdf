"""The tables at hand in the shape of reviews, and the star of apps, listings and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.fingerprint import source_key
from voxmill.functions.text import upper_signs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews out of events: one row each, with store, market, rating 1 to 5, topic and version."""
    e = table(spark, sf_dir, "events")
    store = F.when(F.col("user_id") % 2 == 0, "app_store").otherwise("google_play")
    market = lambda *names: F.when(F.col("user_id") % 3 == 0, names[0]).when(F.col("user_id") % 3 == 1, names[1]).otherwise(names[2])
    rating = F.when(F.col("value") < 11, 1).when(F.col("value") < 26, 2).when(F.col("value") < 46, 3).when(F.col("value") < 80, 4).otherwise(5)
    version = F.concat(F.lit("v"), F.floor(F.regexp_extract("props", '"k": *"?([0-9]+)', 1).cast("int") / 25).cast("string"))
    rows = e.select(
        F.col("event_id").alias("review_id"), F.col("ts").alias("reviewed_at"), F.to_date("ts").alias("day"), store.alias("store"), market("us", "de", "br").alias("country"),
        market("en", "de", "pt").alias("language"), rating.alias("rating"), F.col("event_type").alias("topic"), version.alias("app_version"), "user_id", "value",
    )
    return rows.withColumn("source", source_key(F.col("store"), F.col("country"), F.col("language")))


#: The same in SQL, to put before a query.
REVIEWS_SQL = """with reviews as (
  select event_id review_id, ts reviewed_at, ts::date as day, store, country, language, rating::int rating, event_type topic, 'v' || (k // 25) app_version, user_id, value,
    store || ':' || case when store = 'app_store' then country else language end as source
  from (select *, case when user_id % 2 = 0 then 'app_store' else 'google_play' end store, case user_id % 3 when 0 then 'us' when 1 then 'de' else 'br' end country,
    case user_id % 3 when 0 then 'en' when 1 then 'de' else 'pt' end language, case when value < 11 then 1 when value < 26 then 2 when value < 46 then 3 when value < 80 then 4 else 5 end rating,
    regexp_extract(props, '"k": *"?([0-9]+)', 1)::int k from events))
"""


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The review model over the tables at hand: documents as reviews of the listings of 25 apps, each listing one of two stores'."""
    d = table(spark, sf_dir, "documents").withColumn("said", F.coalesce("text", F.lit("")))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("app_id"), F.col("n_name").alias("slug"))
    k = F.col("doc_id")
    stores = n.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    listings = stores.select((F.col("app_id") * 2 + F.col("s")).cast("long").alias("listing_id"), F.when(F.col("s") == 0, "app_store").otherwise("google_play").alias("store"), "app_id", "slug")
    reviews_ = d.select(
        k.alias("review_id"), (k % 50).alias("listing_id"), F.concat(F.lit("d"), F.floor(k / 50).cast("string")).alias("external_id"), (k % 5 + 1).cast("int").alias("rating"), F.col("said").alias("body"),
        F.when(k % 4 != 0, F.col("lang")).alias("language"), F.element_at(F.array(*map(F.lit, ("us", "de", "br"))), (k % 3 + 1).cast("int")).alias("country"), F.when(k % 3 == 0, F.left("said", F.lit(120))).alias("reply"),
        F.concat(F.lit("v"), (k % 4).cast("string")).alias("app_version"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 720).cast("int"))).alias("reviewed_at"),
    )
    digest = F.md5("said")
    enriched = d.where("doc_id % 5 <> 0").select(k.alias("review_id"), F.col("said").alias("model_text"), F.when(k % 7 != 0, F.col("lang")).alias("language"), digest.alias("text_hash"), F.when(k % 2 == 0, "detected").otherwise("store_hint").alias("language_source"))
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id").join(d.select("doc_id", digest.alias("now")), "doc_id")
    embedded = e.select(k.alias("review_id"), F.when(k % 2 == 0, "m1").otherwise("m2").alias("model"), F.when(k % 7 == 0, "old").otherwise(F.col("now")).alias("text_hash"), "embedding")
    translated = d.where("doc_id % 3 = 1").select(
        k.alias("review_id"), F.lit("t1").alias("model"), F.when(k % 2 == 0, "en").otherwise("de").alias("target_language"), F.col("lang").alias("source_language"),
        F.when(k % 11 == 0, "old").otherwise(digest).alias("text_hash"), upper_signs(F.left("said", F.lit(40))).alias("translated_text"),
    )
    members = d.select((k % 25).alias("run_id"), k.alias("review_id"), (k % 25 * 10 + F.floor(k / 25) % 10).alias("topic_id"), (k * 7919 % 1000 / 1000.0).alias("distance"))
    runs = n.select(F.col("app_id").cast("long").alias("run_id"), "slug", F.date_add(F.lit("2024-01-01").cast("date"), F.col("app_id").cast("int")).alias("created_at"))
    topics = members.groupBy("run_id", "topic_id").agg(F.count("*").alias("size"))
    o = table(spark, sf_dir, "orders")
    ingested = o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 50).alias("listing_id"), F.col("o_orderpriority").alias("partition_key"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("status"), F.col("o_orderdate").alias("started_at"))
    cursors = ingested.groupBy("listing_id", "partition_key").agg(F.max("started_at").alias("newest_reviewed_at"))
    names = "apps listings reviews enriched embedded translated members runs topics ingested cursors".split()
    return dict(zip(names, (n, listings, reviews_, enriched, embedded, translated, members, runs, topics, ingested, cursors), strict=True))


#: The same in SQL, to put before a query.
STAR_SQL = """with d as (select *, coalesce(text, '') said, doc_id k from documents),
apps as (select n_nationkey app_id, n_name slug from nation),
listings as (select (app_id * 2 + s)::bigint listing_id, case s when 0 then 'app_store' else 'google_play' end store, app_id, slug from apps, (values (0), (1)) v(s)),
reviews as (
  select k review_id, k % 50 listing_id, 'd' || (k // 50) external_id, (k % 5 + 1)::int rating, said body, case when k % 4 <> 0 then lang end as language,
    ['us', 'de', 'br'][k % 3 + 1] country, case when k % 3 = 0 then left(said, 120) end reply, 'v' || (k % 4) app_version,
    timestamp '2024-01-01' + to_hours((k % 720)::int) reviewed_at
  from d),
enriched as (
  select k review_id, said model_text, case when k % 7 <> 0 then lang end as language, md5(said) text_hash,
    case when k % 2 = 0 then 'detected' else 'store_hint' end language_source
  from d where k % 5 <> 0),
embedded as (
  select k review_id, case when k % 2 = 0 then 'm1' else 'm2' end model, case when k % 7 = 0 then 'old' else md5(said) end text_hash, embedding
  from embeddings join d on vec_id = k),
translated as (
  select k review_id, 't1' model, case when k % 2 = 0 then 'en' else 'de' end target_language, lang source_language,
    case when k % 11 = 0 then 'old' else md5(said) end text_hash, upper(left(said, 40)) translated_text
  from d where k % 3 = 1),
members as (select k % 25 run_id, k review_id, k % 25 * 10 + k // 25 % 10 topic_id, (k * 7919 % 1000) / 1000.0 distance from d),
runs as (select app_id::bigint run_id, slug, (date '2024-01-01' + app_id::int)::date created_at from apps),
topics as (select run_id, topic_id, count(*) size from members group by all),
ingested as (
  select o_orderkey run_id, o_custkey % 50 listing_id, o_orderpriority partition_key,
    case when o_orderstatus = 'F' then 'failed' else 'succeeded' end status, o_orderdate started_at
  from orders),
cursors as (select listing_id, partition_key, max(started_at) newest_reviewed_at from ingested group by all)
"""
