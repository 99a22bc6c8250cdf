"""The causal monitor as a stream: days are judged once they are over, batch by batch, against the tables of days before."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from voxmill.operators.anomalies import BASELINE_DAYS, judged, replay
from voxmill.streaming.ingest import OVERLAP, daily_counts, merge_stream

COUNTS = "source string, topic string, day date, n long, batch long"
SOURCES = "source string, first_day date, batch long"
JUDGED = "source string, topic string, day date, n long, day_reviews long, expected double, lift double, ln_p double, baseline_days int, tests long, alert boolean, batch long"


def _before(spark, path: str, schema: str, batch: int) -> DataFrame:
    """A table's rows of earlier batches; what a batch wrote that fell over is its own again."""
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("batch") < batch)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class DailyMonitor:
    """Judges the days that a batch of final day counts (source, topic, day, reviews) completes, under `path`.

    A day is due `hold_days` after it, by the newest day that is final.  A source takes part if the day is neither its first
    nor its last one so far.  All sources of a due day meet in its number of tests, so this is a barrier; it holds one row a
    source, topic and day of the trailing window, whatever the number of reviews.  Each batch writes tables of its own
    number and reads only those of smaller ones: a batch that comes again after a failure writes the same rows.
    """

    def __init__(self, path: str, hold_days: int = 1, baseline_days: int = BASELINE_DAYS, **settings):
        self.path, self.hold, self.baseline, self.settings = path.rstrip("/"), hold_days, baseline_days, settings

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        _write(rows.select("source", "topic", "day", F.col("reviews").cast("long").alias("n")), f"{self.path}/counts", batch)
        counts = spark.read.schema(COUNTS).parquet(f"{self.path}/counts").where(F.col("batch") <= batch)
        now, last = counts.agg(F.max("day"), F.max(F.when(F.col("batch") < batch, F.col("day")))).first()
        known = _before(spark, f"{self.path}/sources", SOURCES, batch)
        fresh = counts.where(F.col("batch") == batch).groupBy("source").agg(F.min("day").alias("first_day")).join(known, "source", "left_anti")
        _write(fresh, f"{self.path}/sources", batch)
        if now is None or now == last:
            return
        until = now - timedelta(days=self.hold)
        since = last - timedelta(days=self.hold - 1) if last else None
        trailing = counts.where(F.col("day") >= since - timedelta(days=self.baseline)) if last else counts
        window = trailing.groupBy("source", "topic", "day").agg(F.sum("n").alias("n"))
        firsts = spark.read.schema(SOURCES).parquet(f"{self.path}/sources").where(F.col("batch") <= batch).groupBy("source").agg(F.min("first_day").alias("first_day"))
        ends = window.groupBy("source").agg(F.max("day").alias("last_day")).join(firsts, "source")
        cells = window.join(ends, "source").where((F.col("day") > F.col("first_day")) & (F.col("day") < F.col("last_day")) & (F.col("day") <= until)).drop("first_day", "last_day")
        alerts = _before(spark, f"{self.path}/judged", JUDGED, batch).where("alert").select("source", "day").distinct()
        settings = self.settings | {"baseline_days": self.baseline}
        out = judged(cells, replay(cells, alerts, since, **settings), **settings)
        _write(out.where(F.col("day") >= since) if last else out, f"{self.path}/judged", batch)


def monitor_stream(reviews: DataFrame, path: str, checkpoint: str, late: str = OVERLAP["google_play"], **settings) -> StreamingQuery:
    """Runs the monitor over a stream of (source, topic, reviewed_at); what it finds is under path/judged."""
    return merge_stream(daily_counts(reviews, late), DailyMonitor(path, **settings), checkpoint)
