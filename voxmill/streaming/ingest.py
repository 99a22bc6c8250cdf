"""Reviews as a stream: late repeats are absorbed, days are counted, snapshots are merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OVERLAP = {"google_play": "14 days", "app_store": "72 hours"}


def without_repeats(stream: DataFrame, overlap: str = OVERLAP["google_play"]) -> DataFrame:
    """Each version of a review once, within the overlap; an edit has another hash and passes.  State ends with the watermark."""
    return stream.withWatermark("reviewed_at", overlap).dropDuplicatesWithinWatermark(["listing_id", "external_id", "content_hash"])


def daily_counts(stream: DataFrame, late: str = OVERLAP["google_play"]) -> DataFrame:
    """Reviews of each source, topic and UTC day, final once the watermark has passed the day."""
    counted = stream.withWatermark("reviewed_at", late).groupBy(F.window("reviewed_at", "1 day"), "source", "topic").agg(F.count("*").alias("reviews"))
    return counted.select(F.to_date("window.start").alias("day"), "source", "topic", "reviews")


def sessions(stream: DataFrame, gap_days: int = 1, late: str = OVERLAP["google_play"]) -> DataFrame:
    """Incidents as they arise: alerts of a source and topic with gaps of at most gap_days days between them."""
    window = F.session_window("day_start", f"{gap_days + 1} days")
    grouped = stream.withWatermark("day_start", late).groupBy(window, "source", "topic").agg(F.min("day_start").alias("first"), F.max("day_start").alias("last"), F.sum("n").alias("reviews"))
    return grouped.select("source", "topic", F.to_date("first").alias("first_day"), F.to_date("last").alias("last_day"), "reviews")


def merge_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs merge(batch, batch id) over what is there.  A batch may come again after a failure: merge by its id or by content."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
