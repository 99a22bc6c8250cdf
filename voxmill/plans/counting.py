"""Listings, roll-ups and snapshots over the tables at hand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from voxmill.functions.text import mood
from voxmill.operators import browse, merge
from voxmill.sources.views import REVIEWS_SQL, reviews, table


def _scope(spark, d):
    """Orders as facts, customers as listings, nations as apps."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "listing_id")
    listings = table(spark, d, "customer").select(F.col("c_custkey").alias("listing_id"), F.col("c_nationkey").alias("app_id"), F.col("c_mktsegment").alias("store"))
    apps = table(spark, d, "nation").select(F.col("n_nationkey").alias("app_id"), F.col("n_name").alias("slug"))
    first = apps.agg(F.min("slug")).first()[0]
    return browse.in_scope(orders, listings, apps, first).groupBy("store").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _browse(spark, d, sort, offset=0, **filters):
    kept = browse.filtered(reviews(spark, d), **filters)
    return browse.page(kept, sort, 20, offset).select("review_id", "store", "language", "rating", "reviewed_at")


def _browse_sql(order: str, where: str = "true", offset: int = 0) -> str:
    return REVIEWS_SQL + f"select review_id, store, language, rating, reviewed_at from reviews where {where} order by {order} limit 20 offset {offset}"


def _funnel(spark, d):
    docs, labels = table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), "lang"), table(spark, d, "labels").select(F.col("doc_id").alias("review_id"), "quality", "toxic")
    return browse.funnel(docs, labels, labels.where("quality = 1"), labels.where("toxic = 1"))


def _snapshots(spark, d):
    """Orders up to 1999 as the store; from 1998 on as the batch, where every third price has changed, and all votes, which
    the hash leaves out."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("external_id"), F.lit("x").alias("listing_id"), F.col("o_custkey").alias("rating"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), (F.col("o_orderkey") % 100).alias("votes"), "o_orderdate")
    hashed = lambda df: df.withColumn("content_hash", F.sha2(F.concat_ws(chr(31), F.col("rating").cast("string"), F.col("price").cast("string")), 256))
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    stored = hashed(o.where(F.col("o_orderdate") < t("2000-01-01"))).drop("o_orderdate").withColumns({"first_seen_at": t("2000-01-01"), "last_seen_at": t("2000-01-01")})
    batch = o.where(F.col("o_orderdate") >= t("1998-01-01")).withColumn("price", F.when(F.col("external_id") % 3 == 0, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)")).withColumn("votes", F.col("votes") + 1)
    return stored, hashed(batch.drop("o_orderdate"))


def _merge_classify(spark, d):
    return merge.classify(*_snapshots(spark, d), ["listing_id", "external_id"]).groupBy("change").agg(F.count("*").alias("reviews"))


def _merge_snapshot(spark, d):
    new = merge.merged(*_snapshots(spark, d), ["listing_id", "external_id"], F.lit("2001-01-01").cast("timestamp_ntz"), mutable=("rating", "price", "votes", "content_hash"))
    return new.select("external_id", F.col("price").cast("double").alias("price"), "votes", F.year("first_seen_at").alias("first_seen"), F.year("last_seen_at").alias("last_seen"))


_BATCHES = """with o as (select o_orderkey external_id, o_custkey rating, o_totalprice::decimal(18,2) price, o_orderdate from orders),
stored as (select *, rating || '|' || price as h from o where o_orderdate < '2000-01-01'),
batch as (select *, rating || '|' || price as h from (select external_id, rating, o_orderdate, case when external_id % 3 = 0 then (price + 1)::decimal(18,2) else price end price from o where o_orderdate >= '1998-01-01'))
"""


def _dedupe_last(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("external_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("seq"), "l_quantity")
    return merge.last_of_repeats(rows, ["external_id"])


def _cap_newest(spark, d):
    feed = reviews(spark, d).select(F.col("source").alias("partition_key"), F.col("review_id").alias("external_id"), "reviewed_at")
    cutoffs = feed.select("partition_key").distinct().withColumn("cutoff", F.lit(datetime(2024, 1, 11)).cast("timestamp_ntz"))
    kept, coverage = merge.newest_in_window(feed, cutoffs, 500)
    return kept.groupBy("partition_key").agg(F.count("*").alias("kept"), F.min("external_id").alias("first_id")).join(coverage, "partition_key", "right").select("partition_key", "kept", "first_id", "coverage_complete")


def _cursors(spark, d):
    feed = reviews(spark, d).select(F.col("source").alias("partition_key"), "reviewed_at")
    old = feed.groupBy("partition_key").agg(F.min("reviewed_at").alias("newest_reviewed_at")).where("partition_key like 'app%'")
    return merge.advance(old, feed, feed.where("partition_key not like '%:br'"))


def _stale(spark, d):
    docs = table(spark, d, "documents")
    known = docs.select(F.col("doc_id").alias("review_id"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))
    enriched = docs.where("doc_id % 5 <> 0").select(
        F.col("doc_id").alias("review_id"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.coalesce("text", F.lit("")))).alias("content_hash"),
        F.when(F.col("doc_id") % 11 == 0, 1).otherwise(2).alias("enrichment_version"), F.coalesce("text", F.lit("")).alias("model_text"), F.md5("text").alias("text_hash"),
    )
    embedded = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("review_id"), F.md5("text").alias("text_hash"))
    return merge.stale_enrichments(known, enriched, embedded, 2).groupBy("reason").agg(F.count("*").alias("reviews"))


def _pending(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("model_text"), F.col("lang").alias("language"), F.md5("text").alias("text_hash"))
    done = docs.where("review_id % 2 = 0").select("review_id", F.when(F.col("review_id") % 6 == 0, F.lit("old")).otherwise(F.col("text_hash")).alias("text_hash"))
    return merge.pending_translations(docs, done, "en").groupBy("language").agg(F.count("*").alias("pending"))


def _fresh(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("review_id"), F.col("lang").alias("language"), F.md5("text").alias("text_hash"))
    derived = docs.select("review_id", "text_hash", F.when(F.col("review_id") % 4 == 0, F.lit("xx")).otherwise(F.col("language")).alias("source_language"))
    one = merge.fresh(derived, docs).agg(F.count("*").alias("by_text"))
    return one.crossJoin(merge.fresh(derived, docs, same_language=True).agg(F.count("*").alias("by_text_and_language")))


def _runs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("app_id"), F.col("o_orderdate").alias("created_at"))


def _prune(spark, d):
    runs, lines = merge.keep_latest(_runs(spark, d), "app_id", 3, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "run_id"))
    return runs.agg(F.count("*").alias("runs")).crossJoin(lines.agg(F.count("*").alias("members")))


def _top_n(spark, d):
    best = browse.first_n_per(table(spark, d, "orders"), "o_orderpriority", 3, F.desc("o_totalprice"), "o_orderkey")
    return best.select("o_orderpriority", "o_orderkey", F.col("place"))


def _audit(spark, d):
    changes = merge.classify(*_snapshots(spark, d), ["listing_id", "external_id"]).withColumn("partition_key", F.col("external_id") % 4)
    parts = spark.createDataFrame([(0, None, True), (1, None, False), (2, "TimeoutError: feed", True), (3, None, True), (4, None, True)], "partition_key long, error string, coverage_complete boolean")
    return merge.totals(merge.run_audit(changes, parts))


def _spine(spark, d):
    return browse.day_spine(browse.daily_counts(reviews(spark, d).where("rating <= 2")))


def _mood(spark, d):
    stats = reviews(spark, d).groupBy("topic", "source").agg(F.avg("rating").alias("average_rating"))
    return stats.select("topic", "source", F.round("average_rating", 6).alias("average_rating"), mood(F.col("average_rating")).alias("mood"))


PLANS = {
    "scope_star_join": (_scope, """select c_mktsegment store, count(*) orders, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey
        where c_nationkey in (select n_nationkey from nation where n_name = (select min(n_name) from nation)) group by all"""),
    "browse_newest": (lambda s, d: _browse(s, d, "newest", stores=["app_store"], rating=(1, 3)), _browse_sql("reviewed_at desc, review_id desc", "store = 'app_store' and rating <= 3")),
    "browse_oldest": (lambda s, d: _browse(s, d, "oldest"), _browse_sql("reviewed_at, review_id")),
    "browse_lowest": (lambda s, d: _browse(s, d, "lowest", languages=["de", "pt"]), _browse_sql("rating, reviewed_at desc, review_id desc", "language in ('de', 'pt')")),
    "browse_highest_page3": (lambda s, d: _browse(s, d, "highest", 40, since=datetime(2024, 1, 10)), _browse_sql("rating desc, reviewed_at desc, review_id desc", "reviewed_at >= '2024-01-10'", 40)),
    "browse_total": (lambda s, d: browse.filtered(reviews(s, d), stores=["google_play"], rating=(2, 4)).agg(F.count("*").alias("total")), REVIEWS_SQL + "select count(*) total from reviews where store = 'google_play' and rating between 2 and 4"),
    "reviews_by_ids": (lambda s, d: browse.by_ids(reviews(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("review_id"))).select("review_id", "rating"),
        REVIEWS_SQL + "select review_id, rating from reviews where review_id in (select o_orderkey from orders)"),
    "market_summary": (lambda s, d: browse.market_summary(reviews(s, d)).withColumn("average_rating", F.round("average_rating", 6)), REVIEWS_SQL + "select store, country, count(*) reviews, round(avg(rating), 6) average_rating, min(reviewed_at) oldest, max(reviewed_at) newest from reviews group by all"),
    "rating_histogram": (lambda s, d: browse.rating_histogram(reviews(s, d)), REVIEWS_SQL + "select store, rating, count(*) reviews from reviews group by all"),
    "rating_breakdown": (lambda s, d: browse.rating_breakdown(browse.rating_histogram(reviews(s, d))).withColumns({"share": F.round("share", 8), "mean_rating": F.round("mean_rating", 8)}),
        REVIEWS_SQL + ", h as (select store, rating, count(*) reviews from reviews group by all) select *, round(reviews / sum(reviews) over (partition by store), 8) share, round(sum(rating * reviews) over (partition by store) / sum(reviews) over (partition by store), 8) mean_rating from h"),
    "language_mix": (lambda s, d: browse.language_mix(reviews(s, d)), REVIEWS_SQL + "select store, language, count(*) reviews from reviews group by all"),
    "top6_other": (lambda s, d: browse.top_and_other(table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("reviews")), "lang", "source"),
        """with m as (select lang, source, count(*) reviews from documents group by all), r as (select *, row_number() over (partition by lang order by reviews desc, source nulls last) place from m)
        select lang, case when place > 6 then 'other' else coalesce(source, 'unknown') end as label, sum(reviews)::bigint reviews from r group by all"""),
    "overview_rollup": (lambda s, d: browse.overview(reviews(s, d)).withColumn("average_rating", F.round("average_rating", 8)), REVIEWS_SQL + "select count(*) reviews, round(sum(rating) / count(rating), 8) average_rating, count(distinct language) languages from reviews"),
    "pipeline_funnel": (_funnel, """select count(*) reviews, count(l.doc_id) enriched, count(q.doc_id) embedded, count(t.doc_id) translated from documents d left join (select distinct doc_id from labels) l using (doc_id)
        left join (select distinct doc_id from labels where quality = 1) q using (doc_id) left join (select distinct doc_id from labels where toxic = 1) t using (doc_id)"""),
    "merge_classify": (_merge_classify, _BATCHES + "select case when s.h is null then 'inserted' when s.h = b.h then 'unchanged' else 'updated' end as change, count(*) reviews from batch b left join stored s using (external_id) group by all"),
    "merge_snapshot": (_merge_snapshot, _BATCHES + """select coalesce(s.external_id, b.external_id) external_id, coalesce(b.price, s.price)::double price, external_id % 100 + case when b.h is not null and s.h is distinct from b.h then 1 else 0 end votes, case when s.external_id is null then 2001 else 2000 end::int first_seen,
        case when b.external_id is null then 2000 else 2001 end::int last_seen from stored s full join batch b using (external_id)"""),
    "ingest_totals": (_audit, _BATCHES + """select count_if(s.h is null) inserted, count_if(s.h <> b.h) updated, count_if(s.h = b.h) unchanged, 1::bigint failed from batch b left join stored s using (external_id)"""),
    "dedupe_last": (_dedupe_last, "select external_id, max(seq) seq, max_by(l_quantity, seq) l_quantity from (select l_orderkey external_id, l_linenumber::bigint * 1000000000 + l_partkey * 100 + l_quantity::bigint seq, l_quantity from lineitem) group by 1"),
    "cap_newest": (_cap_newest, REVIEWS_SQL + """, f as (select source partition_key, review_id external_id, row_number() over (partition by source order by reviewed_at desc, review_id desc) place, count(*) over (partition by source) found from reviews where reviewed_at >= '2024-01-11'),
        k as (select partition_key, count(*) kept, min(external_id) first_id from f where place <= 500 group by 1), c as (select source partition_key, count_if(reviewed_at >= '2024-01-11') <= 500 coverage_complete from reviews group by 1)
        select partition_key, kept, first_id, coverage_complete from c left join k using (partition_key)"""),
    "cursor_advance": (_cursors, REVIEWS_SQL + "select source partition_key, case when source like '%:br' then min(reviewed_at) else max(reviewed_at) end as newest_reviewed_at from reviews where source like 'app%' or source not like '%:br' group by source"),
    "stale_work": (_stale, """select reason, count(*) reviews from (select case when doc_id % 5 = 0 then 'missing' when doc_id % 7 = 0 and coalesce(text, '') <> 'old' then 'content' when doc_id % 11 = 0 then 'version'
        when length(coalesce(text, '')) > 0 and doc_id % 13 = 0 then 'vector' end as reason from documents) where reason is not null group by 1"""),
    "pending_translation": (_pending, "select lang as language, count(*) pending from documents where length(text) > 0 and lang <> 'en' and (doc_id % 2 <> 0 or doc_id % 6 = 0) group by 1"),
    "fresh_derived": (_fresh, "select count(*) by_text, count_if(doc_id % 4 <> 0 and lang is not null) by_text_and_language from documents where text is not null"),
    "latest_order_per_customer": (lambda s, d: browse.latest_per(_runs(s, d), "app_id", "created_at", "run_id").select("app_id", "run_id"), "select o_custkey app_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) run_id from orders group by 1"),
    "topn_per_group": (_top_n, "select o_orderpriority, o_orderkey, place::int place from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) place from orders) where place <= 3"),
    "prune_latest_k": (_prune, """with k as (select o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) place from orders) where place <= 3)
        select (select count(*) from k) runs, (select count(*) from lineitem where l_orderkey in (select o_orderkey from k)) members"""),
    "topic_day_counts": (lambda s, d: browse.daily_counts(reviews(s, d)), REVIEWS_SQL + "select topic, day, count(*) reviews from reviews group by all"),
    "topic_day_spine": (_spine, REVIEWS_SQL + """, n as (select topic, day, count(*) reviews from reviews where rating <= 2 group by all),
        days as (select unnest(generate_series((select min(day) from n), (select max(day) from n), interval 1 day))::date as day) select topic, day, coalesce(reviews, 0) reviews from (select distinct topic from n) cross join days left join n using (topic, day)"""),
    "rising_topics": (lambda s, d: browse.rising(browse.daily_counts(reviews(s, d))).withColumn("factor", F.round("factor", 8)), REVIEWS_SQL + """, g as (select topic, count(*) size, count_if(day > (select max(day) from reviews) - 7) recent from reviews group by 1)
        select topic, size, recent, round(recent / size / (select sum(recent) / sum(size) from g), 8) factor, recent / size / (select sum(recent) / sum(size) from g) >= 1.5 and size >= 10 rising from g"""),
    "mood_bucket": (_mood, REVIEWS_SQL + "select topic, source, round(avg(rating), 6) average_rating, case when avg(rating) <= 2.5 then 'negative' when avg(rating) < 3.8 then 'mixed' else 'positive' end as mood from reviews group by 1, 2"),
}
