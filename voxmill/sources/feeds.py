"""Store feeds, written replies and judgments: JSON in, JSON out."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxmill.functions.fingerprint import author_hash
from voxmill.operators.replies import foreign_placeholders

_LABEL = "struct<label: string>"
# Fixed value: the feed's field names.
_ENTRY = f"struct<id: {_LABEL}, title: {_LABEL}, content: {_LABEL}, updated: {_LABEL}, `im:rating`: {_LABEL}, `im:version`: {_LABEL}, `im:voteSum`: {_LABEL}, author: struct<name: {_LABEL}, uri: {_LABEL}>>"
PLAY_RECORD = "reviewId string, userName string, content string, score int, thumbsUpCount int, reviewCreatedVersion string, appVersion string, at timestamp_ntz, replyContent string, repliedAt timestamp_ntz"


def parse_app_store(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, rejects) of rows (country, payload).  A lone entry may be an object; entries without a rating are no reviews;
    malformed ones are rejects; empty labels are null; the author stays as a pseudonym alone."""
    listed = F.from_json("payload", f"feed struct<entry: array<{_ENTRY}>>")
    alone = F.from_json("payload", f"feed struct<entry: {_ENTRY}>")
    entries = F.coalesce(listed["feed"]["entry"], F.when(alone["feed"]["entry"].isNotNull(), F.array(alone["feed"]["entry"])))
    rows = payloads.select("country", F.explode(entries).alias("e")).where("e.`im:rating`.label is not null")
    label = lambda path: F.nullif(F.trim(F.col(f"e.{path}.label")), F.lit(""))
    parsed = rows.select(
        label("id").alias("external_id"), F.expr("try_cast(e.`im:rating`.label as int)").alias("rating"), label("title").alias("title"), F.coalesce(label("content"), F.lit("")).alias("body"),
        F.expr("try_cast(e.updated.label as timestamp)").alias("reviewed_at"), "country", F.lit(None).cast("string").alias("language"), label("`im:version`").alias("app_version"),
        F.expr("try_cast(e.`im:voteSum`.label as int)").alias("helpful_count"), author_hash(F.lit("app_store"), F.coalesce(label("author.uri"), label("author.name"))).alias("author_hash"),
    )
    fine = F.col("external_id").isNotNull() & F.coalesce(F.col("rating").between(1, 5), F.lit(False)) & F.col("reviewed_at").isNotNull()
    return parsed.where(fine), parsed.where(~fine)


def parse_play(records: DataFrame, language: str, local_zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """(reviews, rejects) of records with naive local times; the author stays as a pseudonym alone."""
    utc = lambda c: F.to_utc_timestamp(F.col(c).cast("timestamp"), local_zone)
    parsed = records.select(
        F.col("reviewId").alias("external_id"), F.col("score").alias("rating"), F.lit(None).cast("string").alias("title"), F.coalesce("content", F.lit("")).alias("body"), utc("at").alias("reviewed_at"),
        F.lit(None).cast("string").alias("country"), F.lit(language).alias("language"), F.coalesce("reviewCreatedVersion", "appVersion").alias("app_version"), F.col("thumbsUpCount").alias("helpful_count"),
        author_hash(F.lit("google_play"), F.col("userName")).alias("author_hash"), F.col("replyContent").alias("reply"), utc("repliedAt").alias("replied_at"),
    )
    fine = F.col("external_id").isNotNull() & F.coalesce(F.col("rating").between(1, 5), F.lit(False)) & F.col("reviewed_at").isNotNull()
    return parsed.where(fine), parsed.where(~fine)


def read_written_replies(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all *.jsonl files with their file and line; blank lines are skipped, and a line that lacks a field, names an
    unknown store or holds a placeholder that is not ours is an error that names both."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).where(F.length(F.trim("value")) > 0)
    rows = rows.withColumn("line", F.col("line") + 1).withColumn("r", F.from_json("value", "app string, store string, id string, reply string"))
    wrong = F.array_join(foreign_placeholders(F.col("r.reply")), ", ")
    lacking = F.col("r.app").isNull() | F.col("r.id").isNull() | F.col("r.reply").isNull() | ~F.coalesce(F.col("r.store").isin("google_play", "app_store"), F.lit(False))
    where = F.concat(F.lit(" in "), "file", F.lit(":"), F.col("line").cast("string"))
    checked = F.when(lacking, F.raise_error(F.concat(F.lit("invalid written reply"), where))).when(F.length(wrong) > 0, F.raise_error(F.concat(F.lit("unknown placeholder "), wrong, where))).otherwise(F.col("r.reply"))
    return rows.select("r.app", "r.store", F.col("r.id").alias("external_id"), checked.alias("reply"), "file", "line")


def write_records(records: DataFrame, path: str) -> None:
    """One folder a split, JSON lines with keys in a fixed order."""
    fields = ("split", "key", "source", "app", "store", "rating", "language", "review", "reply")
    records.select(*(c for c in fields if c in records.columns)).write.partitionBy("split").json(path)


def write_benchmark(drafts: DataFrame, summary: DataFrame, path: str) -> None:
    drafts.write.json(f"{path}/drafts")
    summary.coalesce(1).write.json(f"{path}/summary")


def write_pool(pool: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuses to replace annotations unless told to."""
    pool.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_judgments(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """query_id, id and grade of a judgment set; grades go from 0 to 2, a document is judged once a query."""
    flat = [(q["id"], str(j["id"]), int(j["grade"])) for q in rows for j in q["judgments"]]
    if len({r[:2] for r in flat}) < len(flat) or len({q["id"] for q in rows}) < len(rows):
        raise ValueError("queries have ids of their own, and judge a document once")
    if any(not 0 <= g <= 2 for _, _, g in flat):
        raise ValueError("grades go from 0 to 2")
    return spark.createDataFrame(flat, "query_id string, id string, grade int")


def read_catalog(spark: SparkSession, apps: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(apps, listings with their markets) of a parsed catalog: slugs are unique, countries and languages have two letters."""
    allowed = {"slug", "name", "listings", "support_contact", "markets"}
    if len({a["slug"] for a in apps}) < len(apps) or any(set(a) - allowed for a in apps):
        raise ValueError("slugs are unique, and an app has no other fields than " + ", ".join(sorted(allowed)))
    if any(len(m["country"]) != 2 or len(m["language"]) != 2 for a in apps for m in a["markets"]):
        raise ValueError("countries and languages are codes of two letters")
    dims = [(a["slug"], a["name"], a.get("support_contact")) for a in apps]
    listings = [(f"{a['slug']}:{s}", a["slug"], s, x, [(m["country"], m["language"]) for m in a["markets"]]) for a in apps for s, x in a["listings"].items()]
    return spark.createDataFrame(dims, "slug string, name string, support_contact string"), spark.createDataFrame(listings, "listing_id string, slug string, store string, external_id string, markets array<struct<country string, language string>>")


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A catalog, query set or judgment set from a YAML file, read by Spark from wherever it lies."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first().value)


class PagedFeed(DataSource):
    """Feed pages as a data source: `spark.dataSource.register(PagedFeed)`, then format("paged_feed") with a path.

    A partition key is a folder of pages 1.json, 2.json, ... newest first, each one a Spark partition.  Reading stops at a
    page that is absent or has no review, and after `max_pages`, whose last page is marked as the provider's limit.
    """

    #: What a store's feed hands out at most.
    MAX_PAGES = 10

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "partition_key string, page int, payload string, hit_provider_limit boolean"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["path"], int(self.options.get("max_pages", self.MAX_PAGES)))


class _PageReader(DataSourceReader):
    def __init__(self, path: str, max_pages: int):
        self.path, self.max_pages = path.removeprefix("file:"), max_pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in sorted(os.listdir(self.path)) if os.path.isdir(os.path.join(self.path, k))]

    def read(self, partition: InputPartition):
        for page in range(1, self.max_pages + 1):
            file = os.path.join(self.path, partition.value, f"{page}.json")
            if not os.path.exists(file):
                return
            with open(file, encoding="utf-8") as held:
                payload = held.read()
            if not _has_entries(json.loads(payload)):
                return
            yield partition.value, page, payload, page == self.max_pages


def _has_entries(payload) -> bool:
    """Whether a page of either store has a review."""
    if isinstance(payload, list):
        return bool(payload)
    entries = payload.get("feed", {}).get("entry", [])
    entries = entries if isinstance(entries, list) else [entries]
    return any("im:rating" in e for e in entries)
