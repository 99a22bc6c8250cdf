"""Scopes, filters, listings and roll-ups over reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SORTS = {
    "newest": [F.desc, "reviewed_at", F.desc, "review_id"],
    "oldest": [F.asc, "reviewed_at", F.asc, "review_id"],
    "lowest": [F.asc, "rating", F.desc, "reviewed_at", F.desc, "review_id"],
    "highest": [F.desc, "rating", F.desc, "reviewed_at", F.desc, "review_id"],
}


def in_scope(facts: DataFrame, listings: DataFrame, apps: DataFrame, slug: str) -> DataFrame:
    """Facts of one app, through listings; Spark broadcasts the dimensions if they are small."""
    chosen = listings.join(apps.where(F.col("slug") == slug).select("app_id"), "app_id", "left_semi")
    return facts.join(chosen, "listing_id")


def filtered(reviews: DataFrame, stores: Sequence[str] = (), languages: Sequence[str] = (), rating: tuple[int, int] = (1, 5), since=None) -> DataFrame:
    """Reviews that meet all filters; an empty set is no filter.  All are plain predicates and reach the scan."""
    low, high = rating
    if not 1 <= low <= high <= 5:
        raise ValueError("ratings go from 1 to 5")
    out = reviews.where(F.col("rating").between(low, high))
    if stores:
        out = out.where(F.col("store").isin(list(stores)))
    if languages:
        out = out.where(F.col("language").isin(list(languages)))
    return out if since is None else out.where(F.col("reviewed_at") >= since)


def page(reviews: DataFrame, sort: str = "newest", limit: int = 20, offset: int = 0) -> DataFrame:
    """One page, by a top-k of offset + limit rows a task; the id is always the last key."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit goes from 1 to 100, offset from 0")
    spec = SORTS[sort]
    return reviews.orderBy(*(way(name) for way, name in zip(spec[::2], spec[1::2], strict=True))).offset(offset).limit(limit)


def by_ids(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """Reviews with the given ids; unknown ids are absent."""
    return reviews.join(ids.select("review_id").distinct(), "review_id", "left_semi")


def in_rank_order(ranked: DataFrame, details: DataFrame, key: str = "review_id") -> DataFrame:
    return ranked.join(details, key).orderBy("rank")


def market_summary(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("store", "country").agg(F.count("*").alias("reviews"), F.avg("rating").alias("average_rating"), F.min("reviewed_at").alias("oldest"), F.max("reviewed_at").alias("newest"))


def rating_histogram(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("store", "rating").agg(F.count("*").alias("reviews"))


def rating_breakdown(histogram: DataFrame) -> DataFrame:
    """Mean and shares of each store, from its histogram."""
    store = Window.partitionBy("store")
    total = F.sum("reviews").over(store)
    mean = F.sum(F.col("rating") * F.col("reviews")).over(store) / total
    return histogram.select("store", "rating", "reviews", (F.col("reviews") / total).alias("share"), mean.alias("mean_rating"))


def language_mix(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("store", "language").agg(F.count("*").alias("reviews"))


def top_and_other(mix: DataFrame, group: str, value: str, keep: int = 6) -> DataFrame:
    """The `keep` most frequent values of each group, the rest as one."""
    order = Window.partitionBy(group).orderBy(F.desc("reviews"), F.col(value).asc_nulls_last())
    named = mix.withColumn("place", F.row_number().over(order)).withColumn("label", F.when(F.col("place") > keep, "other").otherwise(F.coalesce(F.col(value), F.lit("unknown"))))
    return named.groupBy(group, "label").agg(F.sum("reviews").alias("reviews"))


def overview(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("reviews"), (F.sum("rating") / F.count("rating")).alias("average_rating"), F.count_distinct("language").alias("languages"))


def funnel(reviews: DataFrame, enriched: DataFrame, embedded: DataFrame, translated: DataFrame, key: str = "review_id") -> DataFrame:
    """How many reviews each stage has stored a row for, fresh or not."""
    marks = [part.select(key).distinct().withColumn(name, F.lit(True)) for part, name in ((enriched, "enriched"), (embedded, "embedded"), (translated, "translated"))]
    for mark in marks:
        reviews = reviews.join(mark, key, "left")
    return reviews.agg(F.count("*").alias("reviews"), *(F.count(n).alias(n) for n in ("enriched", "embedded", "translated")))


def language_sources(reviews: DataFrame, enriched: DataFrame, key: str = "review_id") -> DataFrame:
    """Enriched reviews by the evidence for their language."""
    return enriched.join(reviews.select(key).distinct(), key, "left_semi").groupBy("language_source").agg(F.count("*").alias("reviews"))


def latest_per(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The last row of each group in an order, by a partial aggregate: no group is gathered."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(group).agg(last.alias("r")).select("r.*")


def first_n_per(rows: DataFrame, group: str, n: int, *order: Column | str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def daily_counts(reviews: DataFrame, group: str = "topic") -> DataFrame:
    return reviews.groupBy(group, "day").agg(F.count("*").alias("reviews"))


def day_spine(daily: DataFrame, group: str = "topic") -> DataFrame:
    """daily with a row for every day from the first to the last of all, zero where there was none."""
    ends = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    # groups x days: two small lists, whose product is the result
    spine = daily.select(group).distinct().crossJoin(F.broadcast(days))
    return spine.join(daily, [group, "day"], "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))


def rising(daily: DataFrame, group: str = "topic", days: int = 7, least_factor: float = 1.5, least_size: int = 10) -> DataFrame:
    """Share of each group's reviews in the last days, against the same share of all."""
    last = daily.agg(F.max("day").alias("last"))
    recent = F.sum(F.when(F.col("day") > F.date_sub("last", days), F.col("reviews")).otherwise(0))
    grouped = daily.crossJoin(F.broadcast(last)).groupBy(group).agg(F.sum("reviews").alias("size"), recent.alias("recent"))
    whole = grouped.agg((F.sum("recent") / F.sum("size")).alias("overall"))
    out = grouped.crossJoin(F.broadcast(whole)).withColumn("factor", F.col("recent") / F.col("size") / F.col("overall"))
    return out.select(group, "size", "recent", "factor", ((F.col("factor") >= least_factor) & (F.col("size") >= least_size)).alias("rising"))


def displayed(reviews: DataFrame, enriched: DataFrame) -> DataFrame:
    """Reviews as they are shown: the redacted text and resolved language once enriched, the store's own before.

    Browsing filters on the language shown; search on `resolved_language` alone, which is null before enrichment.
    """
    e = enriched.select("review_id", "model_text", F.col("language").alias("resolved_language"))
    return reviews.join(e, "review_id", "left").withColumns({"text": F.coalesce("model_text", "body"), "language": F.coalesce("resolved_language", "language")}).drop("model_text", "body")


def recent_runs(runs: DataFrame, listings: DataFrame, limit: int = 20) -> DataFrame:
    """The latest runs of an app's listings, newest first."""
    return runs.join(listings.select("listing_id", "store"), "listing_id").orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def cursors_of(cursors: DataFrame, listings: DataFrame) -> DataFrame:
    return cursors.join(listings.select("listing_id", "store"), "listing_id").orderBy("store", "partition_key")


def topics_of(topics: DataFrame, run_id) -> DataFrame:
    """A run's topics, largest first."""
    return topics.where(F.col("run_id") == run_id).orderBy(F.desc("size"), "topic_id")


def topic_in_app(topics: DataFrame, runs: DataFrame, topic_id, slug: str) -> DataFrame:
    """A topic of an app's runs; none if it is another app's."""
    return topics.where(F.col("topic_id") == topic_id).join(runs.where(F.col("slug") == slug).select("run_id"), "run_id", "left_semi")


def topic_page(members: DataFrame, topic_id, limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(total, one page) of a topic's reviews, closest first."""
    own = members.where(F.col("topic_id") == topic_id)
    return own.agg(F.count("*").alias("total")), own.orderBy("distance", "review_id").offset(offset).limit(limit)


def member_texts(members: DataFrame, reviews: DataFrame, enriched: DataFrame, translated: DataFrame, run_id) -> DataFrame:
    """A run's reviews with their text and fresh translation; place is theirs in the topic, closest first."""
    rows = members.where(F.col("run_id") == run_id).join(reviews.select("review_id", "rating"), "review_id")
    rows = rows.join(enriched.select("review_id", "language", F.col("model_text").alias("text"), "text_hash"), "review_id")
    rows = rows.join(translated.select("review_id", "text_hash", F.col("translated_text").alias("translation")), ["review_id", "text_hash"], "left").drop("text_hash")
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy("distance", "review_id"))
    return rows.withColumn("place", place)


def example_texts(ids: DataFrame, enriched: DataFrame) -> DataFrame:
    """The redacted text of enriched reviews among ids."""
    return enriched.join(ids.select("review_id").distinct(), "review_id", "left_semi").select("review_id", F.col("model_text").alias("text"))


def fresh_vectors(embedded: DataFrame, enriched: DataFrame, reviews: DataFrame, keys: DataFrame) -> DataFrame:
    """Vectors of the asked (slug, store, external_id), where they are of the text as it is now."""
    named = reviews.join(keys.select("slug", "store", "external_id").distinct(), ["slug", "store", "external_id"])
    now = embedded.join(enriched.select("review_id", "text_hash"), ["review_id", "text_hash"])
    return named.select("review_id", "slug", "store", "external_id").join(now.select("review_id", "embedding"), "review_id")


def store_info(spark: SparkSession, tables: dict[str, DataFrame], version: int) -> DataFrame:
    """What the store is: Spark's version, the layout version of the snapshot and the newest, and its tables' columns."""
    rows = [(spark.version, int(spark.conf.get("voxmill.schema.version", str(version))), version, name, len(df.columns)) for name, df in sorted(tables.items())]
    return spark.createDataFrame(rows, "spark string, revision int, head_revision int, table string, columns int").withColumn("current", F.col("revision") == F.col("head_revision"))
