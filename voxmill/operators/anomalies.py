"""Surges of topics: the retrospective test, the day-by-day monitor, incidents and what caused them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.functions.fingerprint import source_key
from voxmill.functions.stats import ln_binomial_tail
from voxmill.sources.shared import settled

ALPHA, LEAST_COUNT, LEAST_LIFT, LEAST_DAYS = 0.01, 5, 3.0, 5
BASELINE_DAYS, GAP_DAYS, VERSION_DAYS, PRIOR_SHARE, RELEASE_SHARE = 28, 1, 7, 0.25, 0.5


def observations(reviews: DataFrame, max_rating: int | None = 3) -> DataFrame:
    """One row for each review that counts: source, topic, day, app_version."""
    return reviews if max_rating is None else reviews.where(F.col("rating") <= max_rating)


def run_observations(members: DataFrame, reviews: DataFrame, listings: DataFrame, enriched: DataFrame, run_id, max_rating: int | None = 3) -> DataFrame:
    """The reviews of a topic run with their source, UTC day and version; those without enrichment have the store's language."""
    rows = members.where(F.col("run_id") == run_id).join(observations(reviews, max_rating), "review_id")
    rows = rows.join(listings.select("listing_id", "store"), "listing_id").join(enriched.select("review_id", F.col("language").alias("resolved")), "review_id", "left")
    source = source_key(F.col("store"), F.col("country"), F.coalesce("resolved", "language"))
    return rows.select("review_id", F.col("topic_id").alias("topic"), source.alias("source"), F.to_date("reviewed_at").alias("day"), "app_version", "distance")


def usable_days(obs: DataFrame) -> DataFrame:
    """Days with reviews, strictly between a source's first and last, with the source's reviews of the day."""
    daily = obs.groupBy("source", "day").agg(F.count("*").alias("day_reviews"))
    whole = Window.partitionBy("source")
    ends = daily.withColumns({"first_day": F.min("day").over(whole), "last_day": F.max("day").over(whole)})
    return ends.where((F.col("day") > F.col("first_day")) & (F.col("day") < F.col("last_day")))


def source_coverage(obs: DataFrame, least_days: int = LEAST_DAYS) -> DataFrame:
    """source, first_day, last_day, usable_days, tested."""
    daily = obs.select("source", "day").distinct().groupBy("source").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
    usable = F.greatest(F.col("days") - 2, F.lit(0))
    return daily.select("source", "first_day", "last_day", usable.alias("usable_days"), (usable >= least_days).alias("tested"))


def spike_cells(obs: DataFrame, alpha: float = ALPHA, least_count: int = LEAST_COUNT, least_lift: float = LEAST_LIFT, least_days: int = LEAST_DAYS) -> DataFrame:
    """Every tested cell (source, topic, day): each day against all other usable days of its source.

    Counts come first, by partial aggregation; windows then run over cells, of which a source has topics times days.
    """
    days = usable_days(obs)
    many = days.withColumn("usable", F.count("*").over(Window.partitionBy("source"))).where(F.col("usable") >= least_days)
    cells = obs.groupBy("source", "topic", "day").agg(F.count("*").alias("n")).join(many.select("source", "day", "day_reviews"), ["source", "day"])
    totals = many.groupBy("source").agg(F.sum("day_reviews").alias("all_reviews"))
    cells = cells.join(totals, "source").withColumn("topic_reviews", F.sum("n").over(Window.partitionBy("source", "topic")))
    expected = (F.col("topic_reviews") - F.col("n") + 0.5) / (F.col("all_reviews") - F.col("day_reviews") + 1.0)
    cells = cells.withColumn("expected", expected).withColumn("share", F.col("n") / F.col("day_reviews"))
    cells = cells.withColumn("lift", F.col("share") / F.col("expected")).withColumn("ln_p", ln_binomial_tail(F.col("n"), F.col("day_reviews"), F.col("expected")))
    tests = cells.agg(F.count("*").alias("tests"))
    cells = cells.crossJoin(F.broadcast(tests))  # one row
    spike = (F.col("n") >= least_count) & (F.col("lift") >= least_lift) & (F.col("ln_p") <= F.log(F.lit(alpha) / F.col("tests")))
    return cells.select("source", "topic", "day", "n", "day_reviews", "expected", "share", "lift", "ln_p", "tests", F.coalesce(spike, F.lit(False)).alias("spike"))


def with_top_version(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """cells with the version that most of their reviews have (the smallest of equals, null last) and its share."""
    keys = ["source", "topic", "day"]
    counted = obs.groupBy(*keys, "app_version").agg(F.count("*").alias("m"))
    order = Window.partitionBy(*keys).orderBy(F.desc("m"), F.col("app_version").asc_nulls_last())
    top = counted.withColumn("place", F.row_number().over(order)).where("place = 1").select(*keys, F.col("app_version").alias("top_version"), F.col("m").alias("top_reviews"))
    return cells.join(top, keys).withColumn("top_share", F.col("top_reviews") / F.col("n")).drop("top_reviews")


def member_ids(cells: DataFrame, obs: DataFrame, order: Column, samples: int = 3) -> DataFrame:
    """The ids of each cell's first reviews in an order, at most `samples`."""
    keys = ["source", "topic", "day"]
    placed = obs.join(cells.select(*keys), keys, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "review_id"))).where(F.col("place") <= samples)
    return placed.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "review_id"))), lambda x: x.review_id).alias("review_ids"))


def incident_members(found: DataFrame, alerts: DataFrame, obs: DataFrame, order: Column) -> DataFrame:
    """Each incident's reviews with their place: those of its most significant day first, then in an order."""
    keys = ["source", "topic", "incident"]
    inside = alerts.select("source", "topic", "day", "ln_p").join(found.select(*keys, "first_day", "last_day"), ["source", "topic"]).where(F.col("day").between(F.col("first_day"), F.col("last_day")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ln_p", "day", order, "review_id"))
    return obs.join(inside.drop("first_day", "last_day"), ["source", "topic", "day"]).withColumn("place", place).select(*keys, "place", "review_id")


def incidents(alerts: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """Alerts of a source and topic as incidents: islands of days with gaps of `gap_days` at most."""
    by_day = Window.partitionBy("source", "topic").orderBy("day")
    new = F.coalesce(F.date_diff("day", F.lag("day").over(by_day)) > gap_days + 1, F.lit(True)).cast("int")
    grouped = alerts.withColumn("new", new).withColumn("incident", F.sum("new").over(by_day)).groupBy("source", "topic", "incident")
    peak = F.min_by("day", F.struct("ln_p", -F.col("n"), "day"))
    return grouped.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("alert_days"), F.sum("n").alias("reviews"), F.min("ln_p").alias("peak_ln_p"), peak.alias("peak_day"))


def release_attribution(found: DataFrame, alerts: DataFrame, obs: DataFrame, days: int = VERSION_DAYS, prior_share: float = PRIOR_SHARE, release_share: float = RELEASE_SHARE) -> DataFrame:
    """Incidents with their top version, its share in them, and its share of the source in the days before them.

    The days before an incident are a range join of incidents with daily counts of versions, both small, equal on source.
    """
    keys = ["source", "topic", "incident"]
    inside = alerts.select("source", "topic", "day").join(found.select(*keys, "first_day", "last_day"), ["source", "topic"]).where(F.col("day").between(F.col("first_day"), F.col("last_day")))
    counted = obs.groupBy("source", "topic", "day", "app_version").agg(F.count("*").alias("m")).join(inside, ["source", "topic", "day"]).groupBy(*keys, "app_version").agg(F.sum("m").alias("m"))
    whole = Window.partitionBy(*keys)
    top = counted.withColumn("all", F.sum("m").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.desc("m"), F.col("app_version").asc_nulls_last()))).where("place = 1")
    top = top.select(*keys, F.col("app_version").alias("top_version"), (F.col("m") / F.col("all")).alias("top_share"))
    daily = obs.groupBy("source", "day", "app_version").agg(F.count("*").alias("m"))
    spans = found.join(top, keys)
    before = spans.select(*keys, "top_version", "first_day").join(daily, "source").where((F.col("day") < F.col("first_day")) & (F.col("day") >= F.date_sub("first_day", days)))
    prior = before.groupBy(*keys).agg((F.sum(F.when(F.col("app_version").eqNullSafe(F.col("top_version")), F.col("m")).otherwise(0)) / F.sum("m")).alias("prior_share"))
    out = spans.join(prior, keys, "left")
    release = F.col("top_version").isNotNull() & (F.col("top_share") >= release_share) & F.col("prior_share").isNotNull() & (F.col("prior_share") <= prior_share)
    return out.withColumn("release", F.coalesce(release, F.lit(False)))


def match_spikes(spikes: DataFrame, found: DataFrame, obs: DataFrame, baseline_days: int = BASELINE_DAYS, least_days: int = LEAST_DAYS) -> DataFrame:
    """Each spike with the first incident of its source and topic that covers its day, or why the monitor raised none: too
    few usable days before it, or not significant against them."""
    i = found.select(F.col("source").alias("i_source"), F.col("topic").alias("i_topic"), "incident", "first_day", "last_day")
    covers = (F.col("source") == F.col("i_source")) & (F.col("topic") == F.col("i_topic")) & F.col("day").between(F.col("first_day"), F.col("last_day"))
    joined = spikes.select("source", "topic", "day").join(i, covers, "left").drop("i_source", "i_topic")
    first = joined.withColumn("place", F.row_number().over(Window.partitionBy("source", "topic", "day").orderBy(F.col("first_day").asc_nulls_last()))).where("place = 1").drop("place")
    days = usable_days(obs).select(F.col("source").alias("u_source"), F.col("day").alias("usable"))
    inside = (F.col("source") == F.col("u_source")) & (F.col("usable") < F.col("day")) & (F.col("usable") >= F.date_sub("day", baseline_days))
    # one row for each spike and usable day before it: a month of days at most
    told = first.join(days, inside, "left").groupBy("source", "topic", "day", "incident", "first_day").agg(F.count("usable").alias("earlier"))
    earlier = F.coalesce("earlier", F.lit(0))
    outcome = F.when(F.col("incident").isNotNull(), "matched").when(earlier < least_days, "too little coverage").otherwise("not significant")
    return told.select("source", "topic", "day", "incident", F.date_diff("first_day", "day").alias("delay_days"), earlier.alias("earlier_days"), outcome.alias("outcome"))


def usable_cells(obs: DataFrame) -> DataFrame:
    """(source, topic, day, n) of the usable days of each source."""
    cells = obs.groupBy("source", "topic", "day").agg(F.count("*").alias("n"))
    return cells.join(usable_days(obs).select("source", "day"), ["source", "day"])


def judged(cells: DataFrame, alerted: DataFrame, alpha: float = ALPHA, baseline_days: int = BASELINE_DAYS, least_days: int = LEAST_DAYS, least_count: int = LEAST_COUNT, least_lift: float = LEAST_LIFT) -> DataFrame:
    """Each cell against its source's usable days in the `baseline_days` before it, without those (source, day) in `alerted`.

    Windows run over a source's days and a topic's days, not over reviews.  A day's number of tests is over all sources, a
    row a day.
    """
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-baseline_days, -1)
    calm = alerted.select("source", "day", F.lit(False).alias("calm"))
    days = cells.groupBy("source", "day").agg(F.sum("n").alias("day_reviews")).join(calm, ["source", "day"], "left").withColumn("calm", F.coalesce("calm", F.lit(True)))
    known = {"baseline_days": F.count_if("calm").over(earlier("source")).cast("int"), "everything": F.sum(F.when(F.col("calm"), F.col("day_reviews"))).over(earlier("source"))}
    told = cells.join(days.withColumns(known), ["source", "day"])
    told = told.withColumn("seen", F.coalesce(F.sum(F.when(F.col("calm"), F.col("n"))).over(earlier("source", "topic")), F.lit(0)))
    tested = told.where(F.col("baseline_days") >= least_days).withColumn("expected", (F.col("seen") + 0.5) / (F.col("everything") + 1))
    tested = tested.withColumn("lift", F.col("n") / F.col("day_reviews") / F.col("expected")).withColumn("ln_p", ln_binomial_tail(F.col("n"), F.col("day_reviews"), F.col("expected")))
    tested = tested.join(tested.groupBy("day").agg(F.count("*").alias("tests")), "day")
    alert = (F.col("n") >= least_count) & (F.col("lift") >= least_lift) & (F.col("ln_p") <= F.log(F.lit(alpha) / F.col("tests")))
    return tested.select("source", "topic", "day", "n", "day_reviews", "expected", "lift", "ln_p", "baseline_days", "tests", alert.alias("alert"))


def replay(cells: DataFrame, before: DataFrame, since=None, **settings) -> DataFrame:
    """The (source, day) pairs that alert from day `since` on, those of `before` included: the causal monitor's memory.

    What a day raises follows from the alerts of the days before it.  So all days are judged with the alerts known, until
    they no longer change: after each round one more day on which they hang together is right, and as alerts are rare and
    reach no further than the baseline, few rounds do; there are never more than days.
    """
    known, last = before, None
    while True:
        found = judged(cells, known, **settings).where("alert")
        found = found if since is None else found.where(F.col("day") >= since)
        now = settled(found.select("source", "day").distinct().union(before).distinct())
        same = now.agg(F.count("*"), F.sum(F.xxhash64("source", "day").cast("decimal(38,0)"))).first()
        if same == last:
            return now
        known, last = now, same


def monitor_backtest(obs: DataFrame, **settings) -> DataFrame:
    """Every judged cell of the causal monitor: each day against its source's earlier days that raised no alert."""
    cells = settled(usable_cells(obs))
    none = obs.sparkSession.createDataFrame([], "source string, day date")
    return judged(cells, replay(cells, none, **settings), **settings)


def backtest_summary(judged: DataFrame) -> DataFrame:
    """tests, judged_days and alert_days of a replay: days on which any source was judged, and on which any alerted."""
    return judged.agg(F.count("*").alias("tests"), F.count_distinct("day").alias("judged_days"), F.count_distinct(F.when(F.col("alert"), F.col("day"))).alias("alert_days"))
