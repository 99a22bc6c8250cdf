"""Read models over the star of apps, listings and reviews, and small functions over texts, keys and catalogs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxmill.functions import fingerprint as P
from voxmill.functions import language as L
from voxmill.functions import text as X
from voxmill.operators import anomalies as A
from voxmill.operators import browse as B
from voxmill.operators import merge as M
from voxmill.operators import replies as R
from voxmill.operators import topics as T
from voxmill.sources.views import REVIEWS_SQL, STAR_SQL, reviews, star, table

_FIRST = "(select min(slug) from apps)"


def _over(use):
    """A query over the star."""
    return lambda spark, d: use(star(spark, d))


def _first_listings(s):
    first = s["apps"].agg(F.min("slug").alias("slug"))
    return s["listings"].join(F.broadcast(first), "slug")  # one row


def _named(s):
    return s["reviews"].join(s["listings"].drop("app_id"), "listing_id")


def _browse(s):
    shown = B.displayed(s["reviews"], s["enriched"])
    return shown.select("review_id", "language", "resolved_language", F.md5("text").alias("digest"))


def _filters(s):
    shown = B.displayed(s["reviews"], s["enriched"])
    return shown.agg(F.count_if(F.col("language") == "de").alias("browsed"), F.count_if(F.col("resolved_language") == "de").alias("searched"))


def _models(s):
    one = M.of_model(s["embedded"], "m1").agg(F.count("*").alias("embedded"))
    return one.crossJoin(M.of_model(s["translated"], "t1", "en").agg(F.count("*").alias("translated")))


def _in_app(s):
    first = s["runs"].where("run_id = 0").select("slug").first()[0]
    mine = B.topic_in_app(s["topics"], s["runs"], 3, first).withColumn("asked", F.lit("its own"))
    other = B.topic_in_app(s["topics"], s["runs"], 13, first).withColumn("asked", F.lit("another's"))
    return mine.union(other).select("asked", "topic_id", "size")


def _members(s):
    rows = B.member_texts(s["members"], s["reviews"], s["enriched"], M.of_model(s["translated"], "t1", "en"), 4)
    return rows.select("topic_id", "review_id", "rating", "language", F.md5("text").alias("digest"), "translation", "place")


def _vectors(s):
    keys = _named(s).where("rating = 2")
    rows = B.fresh_vectors(M.of_model(s["embedded"], "m1"), s["enriched"], _named(s), keys)
    return rows.select("review_id", "slug", "store", "external_id", F.size("embedding").cast("long").alias("dimension"))


def _by_key(s):
    rows = _named(s).withColumnRenamed("slug", "app")
    return R.by_natural_key(rows.where("rating = 2"), rows).select("review_id", "app", "store", "external_id")


def _candidates(s):
    e = s["enriched"].join(s["reviews"].select("review_id", "rating"), "review_id")
    t = M.of_model(s["translated"], "t1", "en").select("review_id", "text_hash", F.col("translated_text").alias("translation"))
    v = M.of_model(s["embedded"], "m1").select("review_id", "text_hash")
    rows = e.join(v, ["review_id", "text_hash"], "left_semi").join(t, ["review_id", "text_hash"], "left")
    return T.candidates(rows).select("review_id", "rating", F.md5("english").alias("english"))


def _drafts(s):
    stored = s["translated"].select("review_id", F.col("target_language").alias("version"), F.col("translated_text").alias("text"))
    known = s["enriched"].join(_named(s).select("review_id", F.col("slug").alias("app_name")), "review_id")
    known = known.join(M.of_model(s["embedded"], "m1").select("review_id", "text_hash", F.col("embedding").alias("vector")), ["review_id", "text_hash"], "left")
    asked = s["reviews"].select("review_id")
    return R.draft_outcomes(asked, known, stored, "en", needs_vector=True).groupBy("outcome").agg(F.count("*").alias("drafts"), F.count("draft").alias("texts"))


def _translations(s):
    asked = s["reviews"].select("review_id", (-F.col("review_id")).alias("position"))
    stored = M.of_model(s["translated"], "t1", "en")
    out = R.translation_outcomes(asked.union(asked), s["enriched"], stored, "en", ["de", "es"])
    return out.groupBy("outcome").agg(F.count("*").alias("reviews"), F.count("translated_text").alias("texts"), F.min("position").alias("first"))


def _markets(spark, d):
    """Ten countries of one language each, and three of several."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    country = F.when(k < 10, F.concat(F.char(k + 97), F.lit("x"))).otherwise(F.concat(F.char(k % 3 + 97), F.lit("y")))
    return n.select(country.alias("country"), F.substring((F.col("n_regionkey") + 10).cast("string"), 1, 2).alias("language"), "n_nationkey")


def _jobs(spark, d):
    s, markets = star(spark, d), _markets(spark, d).agg(F.collect_list(F.struct("country", "language")).alias("markets"))
    return M.plan_jobs(s["listings"].crossJoin(F.broadcast(markets))).select("listing_id", "store", "partition_key")


def _cutoffs(s):
    now = F.lit(datetime(2001, 8, 2)).cast("timestamp_ntz")
    rows = s["cursors"].join(s["listings"].select("listing_id", "store"), "listing_id")
    cursor = F.when(F.col("listing_id") % 3 != 0, F.col("newest_reviewed_at"))
    return rows.select("listing_id", "partition_key", M.cutoff(cursor, F.col("store"), now).alias("cutoff"))


def _keyed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return o.where("k % 3 <> 0"), o.where("k % 2 = 0").withColumn("v", (F.col("v") + 1).cast("decimal(18,2)"))


def _sums(df):
    return df.agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))


_KEYED = """with o as (select o_orderkey k, o_totalprice::decimal(18,2) v from orders), s as (select * from o where k % 3 <> 0),
b as (select k, (v + 1)::decimal(18,2) v from o where k % 2 = 0) """


def _synced(s):
    apps = s["apps"].where("app_id % 5 <> 0").select("slug", F.lit("old").alias("name"))
    catalog = s["apps"].where("app_id % 3 <> 0").select("slug", F.concat(F.lit("new "), "slug").alias("name"))
    own = s["listings"].where("app_id % 5 <> 0").select("slug", "store", F.lit("x").alias("external_id"))
    wanted = s["listings"].where("app_id % 3 <> 0").select("slug", "store", F.lit("y").alias("external_id"))
    names, listings = M.synced(catalog, apps, own, wanted)
    return listings.join(names, "slug", "left").select("slug", "store", "external_id", "name")


def _labels(s):
    k = F.col("topic_id")
    words = F.array(F.concat(F.lit("alpha"), (k % 3).cast("string")), F.concat(F.lit("beta"), (k % 5).cast("string")), F.lit("gamma"), F.lit("delta"))
    name = F.when(k % 2 == 0, F.concat(F.lit("Alpha0 name "), (k % 4).cast("string")))
    rows = s["topics"].where("run_id = 0").select("topic_id", words.alias("keywords"), name.alias("name"))
    return T.resolved_labels(rows).select("topic_id", "label")


def _relabelled(s):
    topics = s["topics"].select("run_id", F.col("topic_id").alias("topic"), F.lit("old").alias("label"), F.array(F.lit("a")).alias("keywords"))
    new = topics.where("topic % 3 = 0").select("run_id", "topic", F.lit("new").alias("label"), F.array(F.lit("b"), F.lit("c")).alias("keywords"))
    out = T.relabelled(s["runs"].where("run_id < 10"), topics, new)
    return out.select("run_id", "topic", "label", F.concat_ws(",", "keywords").alias("keywords"))


def _written(s):
    w = s["listings"].select(F.col("slug").alias("app"), "store", F.concat(F.lit("d"), (F.col("listing_id") % 7).cast("string")).alias("external_id"), F.lit("Thanks").alias("written"))
    return R.attach_written(w, _named(s).select(F.col("slug").alias("app"), "store", "external_id", "review_id")).select("app", "store", "external_id", "review_id")


def _ordered(s):
    keys = s["reviews"].select(F.concat(F.lit("k"), F.col("review_id").cast("string")).alias("key"))
    return R.eval_order(keys, 20)


def _hydrated(s):
    ranked = s["reviews"].where("rating = 5").select("review_id", (F.col("review_id") * 31 % 1009).alias("rank"))
    return B.in_rank_order(ranked, s["reviews"].select("review_id", "app_version")).select("rank", "review_id", "app_version")


def _texts(spark, d):
    c = table(spark, d, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    said = F.concat(F.lit("<think>x\ny</think> "), F.lit('"{app_name}"  '), F.col("t"))
    return c.select("conv_id", "turn", X.excerpt(F.col("t"), 60).alias("line"), F.md5(X.clean_completion(said)).alias("completion"), F.md5(X.render_reply(F.concat(F.lit("{app_name}: {support_contact} "), "t"), F.lit("App"), F.lit(None).cast("string"))).alias("rendered"))


def _keys(spark, d):
    rows = star(spark, d)["reviews"].select("review_id", X.natural_key(F.lit("app"), F.lit("s"), F.concat("external_id", F.lit(":x"))).alias("key"))
    version = P.version_of(F.lit("model"), F.col("key"), F.lit("guide"))
    return rows.select("review_id", "key", *X.split_key(F.col("key")), version.alias("version"))


def _consumed(spark, d):
    """Events as a feed of pages of 40, newest first; page 10 is the last one that it hands out."""
    place = F.row_number().over(Window.partitionBy("partition_key").orderBy(F.desc("reviewed_at"), "external_id")) - 1
    rows = reviews(spark, d).select(F.col("source").alias("partition_key"), F.col("review_id").alias("external_id"), "reviewed_at")
    pages = rows.withColumn("place", place).withColumns({"page": F.floor(F.col("place") / 40) + 1, "position": F.col("place") % 40})
    pages = pages.withColumn("hit_provider_limit", F.col("page") == 10).drop("place")
    cut = F.when(F.col("partition_key").like("app%"), F.lit(datetime(2024, 1, 25))).otherwise(F.lit(datetime(2024, 1, 5))).cast("timestamp_ntz")
    cutoffs = pages.select("partition_key").distinct().withColumn("cutoff", cut)
    kept, coverage = M.consume_pages(pages, cutoffs, 700)
    return kept.groupBy("partition_key").agg(F.count("*").alias("kept"), F.min("reviewed_at").alias("oldest")).join(coverage, "partition_key")


def _detected(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    detector = L.NgramDetector.fit(docs.where("doc_id % 2 = 0"))
    told = docs.select("doc_id", "lang", L.detected(detector)(F.col("text")).alias("d"))
    return told.select("doc_id", "lang", "d.candidate", F.round("d.confidence", 6).alias("confidence"))


def _observations(s):
    rows = A.run_observations(s["members"], s["reviews"], s["listings"], s["enriched"], 7)
    return rows.select("review_id", "topic", "source", "day", "app_version", F.round("distance", 6).alias("distance"))


_LISTED = f"(select * from listings where slug = {_FIRST})"
_NAMED = "reviews join listings using (listing_id)"
PLANS = {
    "recent_runs": (_over(lambda s: B.recent_runs(s["ingested"], _first_listings(s), 20).select("run_id", "store", "partition_key", "status", "started_at")),
        STAR_SQL + f"select run_id, store, partition_key, status, started_at from ingested join {_LISTED} using (listing_id) order by started_at desc, run_id desc limit 20"),
    "cursors_listed": (_over(lambda s: B.cursors_of(s["cursors"], _first_listings(s)).select("store", "partition_key", "newest_reviewed_at")),
        STAR_SQL + f"select store, partition_key, newest_reviewed_at from cursors join {_LISTED} using (listing_id)"),
    "display_columns": (_over(_browse), STAR_SQL + """select review_id, coalesce(e.language, r.language) as language, e.language resolved_language,
        md5(coalesce(model_text, body)) digest from reviews r left join enriched e using (review_id)"""),
    "display_filters": (_over(_filters), STAR_SQL + """select count_if(coalesce(e.language, r.language) = 'de') browsed, count_if(e.language = 'de') searched
        from reviews r left join enriched e using (review_id)"""),
    "model_keys": (_over(_models), STAR_SQL + "select (select count(*) from embedded where model = 'm1') embedded, (select count(*) from translated where model = 't1' and target_language = 'en') translated"),
    "topic_listing": (_over(lambda s: B.topics_of(s["topics"], 0).select("topic_id", "size")), STAR_SQL + "select topic_id, size from topics where run_id = 0"),
    "topic_in_app": (_over(_in_app), STAR_SQL + "select 'its own' asked, topic_id, size from topics where topic_id = 3"),
    "topic_members_page": (_over(lambda s: B.topic_page(s["members"], 3, 10, 1)[1].select("review_id", "distance")),
        STAR_SQL + "select review_id, distance::double distance from members where topic_id = 3 order by distance, review_id limit 10 offset 1"),
    "topic_members_total": (_over(lambda s: B.topic_page(s["members"], 3, 10)[0]), STAR_SQL + "select count(*) total from members where topic_id = 3"),
    "member_texts": (_over(_members), STAR_SQL + """select topic_id, review_id, rating, e.language, md5(model_text) digest, translated_text as translation,
        (row_number() over (partition by topic_id order by distance, review_id))::int place
        from members join reviews using (review_id) join enriched e using (review_id)
        left join (select * from translated where target_language = 'en') t using (review_id, text_hash) where run_id = 4"""),
    "example_texts": (_over(lambda s: B.example_texts(s["members"].where("run_id = 2"), s["enriched"]).select("review_id", F.md5("text").alias("digest"))),
        STAR_SQL + "select review_id, md5(model_text) digest from enriched where review_id in (select review_id from members where run_id = 2)"),
    "vectors_by_key": (_over(_vectors), STAR_SQL + f"""select review_id, slug, store, external_id, len(embedding) as dimension
        from (select * from {_NAMED} where rating = 2) join enriched using (review_id) join embedded using (review_id, text_hash) where model = 'm1'"""),
    "reviews_by_key": (_over(_by_key), STAR_SQL + f"select review_id, slug app, store, external_id from {_NAMED} where rating = 2"),
    "published_replies": (_over(lambda s: R.published(_named(s).join(s["enriched"].select("review_id"), "review_id"), [r.slug for r in s["apps"].where("app_id < 5").collect()]).select("slug", "review_id")),
        STAR_SQL + f"select slug, review_id from {_NAMED} join enriched using (review_id) where reply is not null and app_id < 5"),
    "run_observations": (_over(_observations), STAR_SQL + """select review_id, topic_id topic,
        store || ':' || coalesce(case when store = 'app_store' then country else coalesce(e.language, r.language) end, 'unknown') as source,
        reviewed_at::date as day, app_version, round(distance, 6)::double distance
        from members join reviews r using (review_id) join listings using (listing_id) left join enriched e using (review_id) where run_id = 7 and rating <= 3"""),
    "topic_candidates": (_over(_candidates), STAR_SQL + r""", c as (select review_id, rating, model_text, case when trim(translated_text) <> '' then translated_text when e.language = 'en' then model_text end english
        from enriched e join reviews using (review_id) join (select * from embedded where model = 'm1') v using (review_id, text_hash)
        left join (select * from translated where target_language = 'en') t using (review_id, text_hash)), w as (select *, coalesce(english, model_text) shown from c)
        select review_id, rating, md5(english) english from w where rating <= 3 and (trim(regexp_replace(shown, '\s+', ' ', 'g')) <> '' and len(string_split(trim(regexp_replace(shown, '\s+', ' ', 'g')), ' ')) >= 4
        or len(regexp_extract_all(shown, '[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]')) >= 12)"""),
    "language_sources": (_over(lambda s: B.language_sources(s["reviews"], s["enriched"])), STAR_SQL + "select language_source, count(*) reviews from enriched group by 1"),
    "fresh_translations": (_over(lambda s: M.fresh(M.of_model(s["translated"], "t1", "en"), s["enriched"], same_language=True).select("review_id", "source_language", "translated_text")),
        STAR_SQL + """select review_id, source_language, translated_text from translated t join enriched e using (review_id, text_hash)
        where target_language = 'en' and source_language = e.language"""),
    "draft_outcomes": (_over(_drafts), STAR_SQL + """, j as (select r.review_id, case when e.review_id is null or model_text = '' or v.review_id is null then 'unavailable' when t.target_language = 'en' then 'cached' else 'generate' end outcome, t.translated_text draft
        from reviews r left join enriched e using (review_id) left join (select * from embedded where model = 'm1') v on v.review_id = r.review_id and v.text_hash = e.text_hash left join translated t on t.review_id = r.review_id)
        select outcome, count(*) drafts, count(case when outcome = 'cached' then draft end) texts from j group by 1"""),
    "translation_outcomes": (_over(_translations), STAR_SQL + """, j as (select r.review_id, -r.review_id as p, t.translated_text, case when e.language = 'en' then 'not_needed' when t.translated_text is not null then 'cached'
        when e.language in ('de', 'es') and model_text <> '' then 'translate' else 'unavailable' end outcome
        from reviews r left join enriched e using (review_id) left join (select * from translated where target_language = 'en') t on t.review_id = r.review_id and t.text_hash = e.text_hash)
        select outcome, count(*) reviews, count(translated_text) texts, min(p) "first" from j group by 1"""),
    "market_defaults": (lambda s, d: L.market_defaults(_markets(s, d)), """select country, min(l) as language from (select case when n_nationkey < 10 then chr(97 + n_nationkey::int) || 'x' else chr(97 + (n_nationkey % 3)::int) || 'y' end country, left((n_regionkey + 10)::varchar, 2) l from nation)
        group by 1 having count(distinct l) = 1"""),
    "planned_jobs": (_jobs, STAR_SQL + """, m as (select case when n_nationkey < 10 then chr(97 + n_nationkey::int) || 'x' else chr(97 + (n_nationkey % 3)::int) || 'y' end country, left((n_regionkey + 10)::varchar, 2) l from nation)
        select distinct listing_id, store, case store when 'app_store' then country else l end partition_key from listings, m"""),
    "cutoffs": (_over(_cutoffs), STAR_SQL + """select listing_id, partition_key, case when listing_id % 3 = 0 then timestamp '2001-08-02' - interval 30 days
        when store = 'google_play' then newest_reviewed_at - interval 336 hours else newest_reviewed_at - interval 72 hours end cutoff from cursors join listings using (listing_id)"""),
    "insert_absent": (lambda s, d: _sums(M.inserted_if_absent(*_keyed(s, d), ["k"])), _KEYED + "select count(*) n, sum(v)::double total from (from s union all from b where k not in (select k from s))"),
    "upsert_overwrite": (lambda s, d: _sums(M.overwritten(*_keyed(s, d), ["k"])), _KEYED + "select count(*) n, sum(v)::double total from (from b union all from s where k not in (select k from b))"),
    "conditional_delete": (lambda s, d: _sums(M.without(*_keyed(s, d), ["k"])), _KEYED + "select count(*) n, sum(v)::double total from s where k not in (select k from b)"),
    "catalog_sync": (_over(_synced), STAR_SQL + """select slug, store, case when app_id % 3 <> 0 then 'y' else 'x' end external_id, case when app_id % 3 <> 0 then 'new ' || slug else 'old' end as name
        from listings where app_id % 3 <> 0 or app_id % 5 <> 0"""),
    "label_resolution": (_over(_labels), STAR_SQL + """, t as (select topic_id, ['alpha' || (topic_id % 3), 'beta' || (topic_id % 5), 'gamma', 'delta'] w, case when topic_id % 2 = 0 then 'Alpha0 name ' || (topic_id % 4) end as name from topics where run_id = 0),
        l as (select *, coalesce(name, array_to_string(w[1:3], ' · ')) label, count(*) over (partition by lower(coalesce(name, array_to_string(w[1:3], ' · ')))) n from t)
        select topic_id, case when n > 1 and name is not null then label || ' (' || list_filter(w, lambda x: not contains(lower(label), lower(x)))[1] || ')' else label end as label from l"""),
    "relabelled_topics": (_over(_relabelled), STAR_SQL + "select run_id, topic_id topic, case when run_id < 10 and topic_id % 3 = 0 then 'new' else 'old' end as label, case when run_id < 10 and topic_id % 3 = 0 then 'b,c' else 'a' end keywords from topics"),
    "written_attached": (_over(_written), STAR_SQL + f"""select slug app, store, w.external_id, review_id from (select *, 'd' || (listing_id % 7) external_id from listings) w
        left join (select review_id, slug, store, external_id from {_NAMED}) r using (slug, store, external_id)"""),
    "eval_order": (_over(_ordered), "select 'k' || doc_id as key from documents order by sha256('k' || doc_id), 1 limit 20"),
    "rank_hydration": (_over(_hydrated), STAR_SQL + "select review_id * 31 % 1009 as rank, review_id, app_version from reviews where rating = 5"),
    "lines_and_completions": (_texts, r"""with c as (select *, coalesce(text, '') t, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) s from conversations)
        select conv_id, turn, case when length(s) <= 60 then s else rtrim(left(s, 59)) || '…' end as line, md5(trim(regexp_replace('{app_name} ' || regexp_replace(t, '["''“”‘’](\{[a-z_]+\})["''“”‘’]', '\1', 'g'), '\s+', ' ', 'g'))) completion,
        md5(trim('App: App support ' || s)) rendered from c"""),
    "natural_keys": (_keys, STAR_SQL + """select review_id, 'app:s:' || external_id || ':x' as key, 'app' app, 's' store, external_id || ':x' external_id,
        'model-' || left(sha256('app:s:' || external_id || ':x' || chr(31) || 'guide'), 12) as version from reviews"""),
    "consumed_pages": (_consumed, REVIEWS_SQL + """, p as (select source k, review_id id, reviewed_at seen, row_number() over (partition by source order by reviewed_at desc, review_id) - 1 place, case when source like 'app%' then timestamp '2024-01-25' else timestamp '2024-01-05' end cutoff from reviews),
        q as (select *, place // 40 + 1 page, seen >= cutoff inside from p), g as (select k, page, count(*) n, count_if(inside) m from q group by all), t as (select *, sum(m) over (partition by k order by page) total from g),
        l as (select k, coalesce(min(case when m < n or total > 700 then page end), max(page) + 1) last from t group by 1),
        c as (select k, not bool_or(page = 10 and page < last) and not bool_or(page <= last and total > 700) coverage_complete from t join l using (k) group by 1),
        a as (select q.*, row_number() over (partition by k order by page, place) r from q join l using (k) where inside and page <= last)
        select k partition_key, count(*) kept, min(seen) oldest, any_value(coverage_complete) coverage_complete from a join c using (k) where r <= 700 group by 1"""),
    "detect_language": (_detected, None),
}
