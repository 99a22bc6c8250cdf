"""Snapshots: merging batches, finding stale work, pruning.  Every change is a new snapshot; nothing is updated in place."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

MUTABLE = ("rating", "title", "body", "app_version", "helpful_count", "reply", "replied_at", "reviewed_at", "content_hash", "raw")


def plan_jobs(listings: DataFrame) -> DataFrame:
    """One job for each listing and distinct partition of its markets; unknown stores have none."""
    key = F.when(F.col("store") == "app_store", F.col("m.country")).when(F.col("store") == "google_play", F.col("m.language"))
    jobs = listings.withColumn("m", F.explode("markets")).select("listing_id", "store", key.alias("partition_key"))
    return jobs.where("partition_key is not null").dropDuplicates(["listing_id", "partition_key"])


def cutoff(cursor: Column, store: Column, now: Column, since: datetime | None = None, lookback_days: int = 30, overlap_hours: int = 72, play_overlap_hours: int = 336) -> Column:
    """From when on a partition is read: as told, else some overlap behind the cursor, else the lookback."""
    if since is not None:
        return F.lit(since)
    overlap = F.when(store == "google_play", F.make_dt_interval(F.lit(0), F.lit(play_overlap_hours))).otherwise(F.make_dt_interval(F.lit(0), F.lit(overlap_hours)))
    return F.coalesce(cursor - overlap, now - F.make_dt_interval(F.lit(lookback_days)))


def newest_in_window(feed: DataFrame, cutoffs: DataFrame, most: int, key: str = "partition_key") -> tuple[DataFrame, DataFrame]:
    """(kept reviews, coverage): the newest `most` of each partition since its cutoff; more than that is no full coverage.

    Partitions are bounded by what a feed hands out, so the window's groups are.
    """
    inside = feed.join(cutoffs, key).where("reviewed_at >= cutoff")
    placed = inside.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("reviewed_at"), F.desc("external_id"))))
    found = inside.groupBy(key).agg(F.count("*").alias("found"))
    coverage = cutoffs.select(key).join(found, key, "left").select(key, (F.coalesce("found", F.lit(0)) <= most).alias("coverage_complete"))
    return placed.where(F.col("place") <= most).drop("place", "cutoff"), coverage


def consume_pages(pages: DataFrame, cutoffs: DataFrame, most: int, key: str = "partition_key") -> tuple[DataFrame, DataFrame]:
    """(kept reviews, coverage) of feeds read page by page, newest first: rows (key, page, position, hit_provider_limit,
    reviewed_at, external_id).

    A feed is read up to its first page with a review before the cutoff, or to the page on which `most` is passed; coverage
    is incomplete if `most` was passed, or if a page before the last one read was the provider's last.
    """
    rows = pages.join(cutoffs, key).withColumn("inside", F.col("reviewed_at") >= F.col("cutoff"))
    by_page = rows.groupBy(key, "page").agg(F.count("*").alias("n"), F.count_if("inside").alias("n_inside"), F.max("hit_provider_limit").alias("limited"))
    upto = Window.partitionBy(key).orderBy("page")  # a feed has few pages
    by_page = by_page.withColumn("total", F.sum("n_inside").over(upto))
    ends = by_page.groupBy(key).agg(F.min(F.when((F.col("n_inside") < F.col("n")) | (F.col("total") > most), F.col("page"))).alias("last"), F.max("page").alias("end"))
    ends = ends.withColumn("last", F.coalesce("last", F.col("end") + 1)).drop("end")
    seen = by_page.join(ends, key)
    limited = F.max(F.coalesce(F.col("limited") & (F.col("page") < F.col("last")), F.lit(False)))
    passed = F.max((F.col("page") <= F.col("last")) & (F.col("total") > most))
    coverage = seen.groupBy(key).agg((~limited & ~passed).alias("coverage_complete"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("page", "position"))
    kept = rows.join(ends, key).where("inside and page <= last").withColumn("place", place).where(F.col("place") <= most)
    return kept.drop("place", "cutoff", "inside", "last"), cutoffs.select(key).join(coverage, key, "left").withColumn("coverage_complete", F.coalesce("coverage_complete", F.lit(True)))


def advance(cursors: DataFrame, batch: DataFrame, succeeded: DataFrame, key: str = "partition_key") -> DataFrame:
    """Cursors moved on to the newest review of partitions that succeeded; never back."""
    seen = batch.join(succeeded.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max("reviewed_at").alias("newest"))
    both = cursors.join(seen, key, "full_outer")
    return both.select(key, F.greatest("newest_reviewed_at", "newest").alias("newest_reviewed_at"))


def last_of_repeats(batch: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of rows with equal keys, the last one of the batch."""
    others = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(*keys, "r.*")


def classify(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """batch keys with inserted, updated or unchanged, by content hash."""
    old = stored.select(*keys, F.col("content_hash").alias("old_hash"))
    kind = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("updated")
    return batch.join(old, keys, "left").withColumn("change", kind).drop("old_hash")


def merged(stored: DataFrame, batch: DataFrame, keys: list[str], seen_at: Column, mutable: tuple[str, ...] = MUTABLE, order: str | None = None) -> DataFrame:
    """The snapshot after a batch: new rows; rows of another content hash with new mutable columns; the others that came are
    touched alone, whatever else about them differs.  Of repeated keys in the batch, the last by `order` counts, where given.
    """
    batch = batch if order is None else last_of_repeats(batch, keys, order)
    new = batch.select(*keys, F.struct(*[c for c in stored.columns if c in batch.columns and c not in keys]).alias("b"))
    both = stored.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    came, old = F.col("b").isNotNull(), F.coalesce(F.col("_old"), F.lit(False))
    changed = came & ~F.col("content_hash").eqNullSafe(F.col("b.content_hash"))
    columns = []
    for c in stored.columns:
        if c in keys:
            now = F.col(c)
        elif c == "last_seen_at":
            now = F.when(came, seen_at).otherwise(F.col(c))
        elif c == "first_seen_at":
            now = F.when(old, F.col(c)).otherwise(seen_at)
        elif c in batch.columns:
            now = F.when(changed if c in mutable else ~old, F.col(f"b.{c}")).otherwise(F.col(c))
        else:
            now = F.col(c)
        columns.append(now.alias(c))
    return both.select(*columns)


def inserted_if_absent(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(rows.dropDuplicates(keys).join(stored, keys, "left_anti"))


def overwritten(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """stored with rows in place of those of equal keys."""
    return stored.join(rows, keys, "left_anti").unionByName(rows)


def without(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone, keys, "left_anti")


def keep_latest(runs: DataFrame, group: str, keep: int, *dependents: DataFrame, key: str = "run_id") -> list[DataFrame]:
    """The latest runs of each group, and only their rows of the dependent tables."""
    order = Window.partitionBy(group).orderBy(F.desc("created_at"), F.desc(key))
    kept = runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).drop("place")
    return [kept, *(d.join(kept.select(key), key, "left_semi") for d in dependents)]


def stale_enrichments(reviews: DataFrame, enriched: DataFrame, embedded: DataFrame, version: int, key: str = "review_id") -> DataFrame:
    """Reviews to enrich: no row, other content, other version, or text whose vector is missing or of another text."""
    e = enriched.select(key, F.col("content_hash").alias("e_hash"), F.col("enrichment_version").alias("e_version"), "model_text", F.col("text_hash").alias("e_text"))
    v = embedded.select(key, F.col("text_hash").alias("v_text"))
    joined = reviews.join(e, key, "left").join(v, key, "left")
    vector = (F.coalesce(F.length("model_text"), F.lit(0)) > 0) & ~F.col("v_text").eqNullSafe(F.col("e_text"))
    reason = (
        F.when(F.col("e_hash").isNull(), "missing").when(F.col("e_hash") != F.col("content_hash"), "content").when(F.col("e_version") != version, "version").when(vector, "vector")
    )
    return joined.withColumn("reason", reason).where("reason is not null").select(key, "reason")


def fresh(derived: DataFrame, enriched: DataFrame, key: str = "review_id", same_language: bool = False) -> DataFrame:
    """Derived rows of the text as it is now; with same_language, of its language too."""
    keys = [key, "text_hash"] + ["source_language"] * same_language
    now = enriched.select(key, "text_hash", F.col("language").alias("source_language"))
    return derived.join(now.select(*keys), keys, "left_semi")


def of_model(derived: DataFrame, model: str, target: str | None = None) -> DataFrame:
    """Derived rows of one model, and of one target language where they have one: what joins by review take."""
    out = derived.where(F.col("model") == model)
    return out if target is None else out.where(F.col("target_language") == target)


def pending_translations(enriched: DataFrame, translated: DataFrame, target: str, key: str = "review_id", max_rating: int | None = None) -> DataFrame:
    """Texts of another known language than the target's without a translation of that very text and language."""
    if max_rating is not None:
        enriched = enriched.where(F.col("rating") <= max_rating)
    wanted = enriched.where((F.length("model_text") > 0) & F.col("language").isNotNull() & (F.col("language") != target))
    if "source_language" not in translated.columns:
        return wanted.join(translated.select(key, "text_hash"), [key, "text_hash"], "left_anti")
    done = translated.select(key, "text_hash", F.col("source_language").alias("language"))
    return wanted.join(done, [key, "text_hash", "language"], "left_anti")


def run_audit(changes: DataFrame, partitions: DataFrame, key: str = "partition_key") -> DataFrame:
    """Counters of each partition: failed ones have their error and no coverage."""
    counts = changes.groupBy(key).agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("inserted", "updated", "unchanged")))
    out = partitions.join(counts, key, "left")
    status = F.when(F.col("error").isNull(), "succeeded").otherwise("failed")
    return out.select(key, status.alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("inserted", "updated", "unchanged")), F.when(F.col("error").isNull(), F.col("coverage_complete")).alias("coverage_complete"), "error")


def totals(audit: DataFrame) -> DataFrame:
    return audit.agg(*(F.sum(c).alias(c) for c in ("inserted", "updated", "unchanged")), F.count_if(F.col("status") == "failed").alias("failed"))


def synced(catalog: DataFrame, apps: DataFrame, listings: DataFrame, catalog_listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(apps, listings) after a catalog: new ones are added, names and external ids follow it, and what it dropped stays."""
    names = catalog.select("slug", F.col("name").alias("new"))
    both = apps.join(names, "slug", "full_outer").select("slug", F.coalesce("new", "name").alias("name"))
    ids = catalog_listings.select("slug", "store", F.col("external_id").alias("new"))
    return both, listings.join(ids, ["slug", "store"], "full_outer").select("slug", "store", F.coalesce("new", "external_id").alias("external_id"))


def isolated(jobs: dict[str, Callable[[], int]]) -> list[tuple[str, str, int, str | None]]:
    """(partition, status, rows, error) of each partition's job: one that fails keeps what it has written and stops no other.

    A job reads, merges and writes one partition with Spark and returns its rows; the driver only calls them.
    """
    out = []
    for partition, job in jobs.items():
        try:
            out.append((partition, "succeeded", job(), None))
        except Exception as error:  # whatever a partition raises is its own
            out.append((partition, "failed", 0, f"{type(error).__name__}: {error}".splitlines()[0]))
    return out


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation that counts them, and what is told to count, as they are written."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("processed"), *(F.count_if(c).alias(k) for k, c in counts.items())), seen


def throughput(seen: Observation, seconds: float) -> dict[str, float]:
    """An observation's counts with rows a second, 0 where no time has passed."""
    counts = dict(seen.get)
    return counts | {"per_second": counts["processed"] / seconds if seconds > 0 else 0.0}
