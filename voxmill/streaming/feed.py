"""Store feeds as a stream: every trigger reads each partition from its cursor, less an overlap, and cursors move on success.

A feed hands out pages newest first, by continuation token, and may change behind its newest review: texts are edited, and
reviews appear late.  So a batch's offset is not a place in the feed, but the cursors that it reads from and the time it was
asked: a batch that comes again after a failure reads from the same cursors.  Cursors live with what has been stored, in the
sink's folder, and move with the batch that stored the reviews, for the partitions that were read to their end.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from voxmill.operators.merge import advance

#: fetch(partition key, token) -> (records (external_id, reviewed_at, payload), next token or None, the provider's limit?)
Fetch = Callable[[str, object], tuple[list[tuple[str, dt.datetime, str]], object, bool]]
SCHEMA = "partition_key string, external_id string, reviewed_at timestamp, payload string, coverage_complete boolean, error string"
UTC = dt.timezone.utc


def read_pages(fetch: Fetch, key: str, cutoff: dt.datetime, most: int) -> Iterable[tuple]:
    """A partition's reviews from the cutoff on, at most the newest `most`, and a last row without a review that ends it.

    Pages are asked for up to the first with a review before the cutoff, or up to the cap.  The last row tells whether all
    reviews since the cutoff came, or what went wrong; the pages read until then count.
    """
    token, left, complete = None, most, True
    try:
        while True:
            records, token, limited = fetch(key, token)
            inside = [r for r in records if r[1] >= cutoff]
            for external_id, at, payload in inside[:left]:
                yield key, external_id, at, payload, None, None
            complete = complete and len(inside) <= left
            left -= len(inside)
            if len(inside) < len(records) or left < 0:
                break
            complete = complete and not limited
            if not records or token is None:
                break
        yield key, None, None, None, complete, None
    except Exception as error:  # a partition's failure is its own
        yield key, None, None, None, None, f"{type(error).__name__}: {error}".splitlines()[0]


class _Partition(InputPartition):
    def __init__(self, key: str, cutoff: str):
        super().__init__(key)
        self.key, self.cutoff = key, cutoff


class _FeedReader(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, options: dict):
        self.fetch = fetch
        self.keys = sorted({k for k in options["partitions"].split(",") if k})
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("max_reviews", 1 << 62))
        self.overlap = dt.timedelta(hours=float(options.get("overlap_hours", 72)))
        self.lookback = dt.timedelta(days=float(options.get("lookback_days", 30)))
        self.since, self.now = options.get("since"), options.get("now")

    def initialOffset(self) -> dict:
        return {"asked": "", "cursors": {}}

    def latestOffset(self) -> dict:
        return {"asked": self.now or dt.datetime.now(UTC).isoformat(), "cursors": stored_cursors(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        def cutoff(key: str) -> str:
            if self.since:
                return self.since
            cursor = end["cursors"].get(key)
            return (dt.datetime.fromisoformat(cursor) - self.overlap if cursor else dt.datetime.fromisoformat(end["asked"]) - self.lookback).isoformat()

        return [_Partition(k, cutoff(k)) for k in self.keys]

    def read(self, partition: _Partition) -> Iterable[tuple]:
        return read_pages(self.fetch, partition.key, dt.datetime.fromisoformat(partition.cutoff), self.most)


def review_feed(fetch: Fetch, name: str = "review_feed") -> type[DataSource]:
    """A data source to register: format(name) with path (the sink's folder), partitions, and optionally max_reviews,
    overlap_hours, lookback_days, since (a backfill) and now."""

    class ReviewFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _FeedReader(fetch, dict(self.options))

    return ReviewFeed


def stored_cursors(path: str) -> dict[str, str]:
    """Cursors of the newest finished batch in the sink's folder, one row a partition."""
    files, where = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    found = files.get_file_info(pafs.FileSelector(f"{where}/cursors", recursive=True, allow_not_found=True))
    done = [int(f.path.split("batch=")[1].split("/")[0]) for f in found if f.path.endswith("/_SUCCESS")]
    out = {}
    for f in found:
        if done and f.path.endswith(".json") and f"/batch={max(done)}/" in f.path:
            for line in files.open_input_stream(f.path).read().decode().splitlines():
                row = json.loads(line)
                out[row["partition_key"]] = row["newest_reviewed_at"]
    return out


class FeedSink:
    """Stores a feed's batches: merge(reviews, batch) first, then the run's audit, then the cursors that it may move.

    Each batch writes folders of its own number, so one that comes again writes them anew; merge is to be idempotent by
    number or by content.
    """

    def __init__(self, path: str, merge: Callable[[DataFrame, int], None]):
        self.path, self.merge = path.rstrip("/"), merge

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        kept = rows.persist()
        try:
            reviews = kept.where("external_id is not null").select("partition_key", "external_id", "reviewed_at", "payload")
            self.merge(reviews, batch)
            ends = kept.where("external_id is null").select("partition_key", "coverage_complete", "error")
            fetched = reviews.groupBy("partition_key").agg(F.count("*").alias("fetched"))
            runs = ends.join(fetched, "partition_key", "left").select("partition_key", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), F.coalesce("fetched", F.lit(0)).alias("fetched"), "coverage_complete", "error")
            runs.write.mode("overwrite").parquet(f"{self.path}/runs/batch={batch}")
            before = list(stored_cursors(self.path).items())
            cursors = spark.createDataFrame(before, "partition_key string, at string").select("partition_key", F.to_timestamp("at").alias("newest_reviewed_at"))
            moved = advance(cursors, reviews, ends.where("error is null"))
            iso = F.date_format(F.to_utc_timestamp("newest_reviewed_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
            moved.select("partition_key", iso.alias("newest_reviewed_at")).where("newest_reviewed_at is not null").coalesce(1).write.mode("overwrite").json(f"{self.path}/cursors/batch={batch}")
        finally:
            kept.unpersist()


def ingest_feed(spark, path: str, partitions: list[str], merge: Callable[[DataFrame, int], None], checkpoint: str, name: str = "review_feed", **options) -> StreamingQuery:
    """One run over all partitions of a registered feed: each is read from its cursor, merged, and its cursor moved."""
    stream = spark.readStream.format(name).option("path", path).option("partitions", ",".join(partitions)).options(**options).load()
    return stream.writeStream.foreachBatch(FeedSink(path, merge)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
