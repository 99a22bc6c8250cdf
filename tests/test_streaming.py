import datetime as dt

from voxmill.streaming import ingest


def test_repeats_are_absorbed_and_edits_pass(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [("l", "a", "h1", t), ("l", "a", "h1", t), ("l", "a", "h2", t)]
    spark.createDataFrame(rows, "listing_id string, external_id string, content_hash string, reviewed_at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("listing_id string, external_id string, content_hash string, reviewed_at timestamp").parquet(f"{tmp_path}/in")
    seen = []
    ingest.merge_stream(ingest.without_repeats(stream), lambda batch, _: seen.extend(r.content_hash for r in batch.collect()), f"{tmp_path}/check").awaitTermination()
    assert sorted(seen) == ["h1", "h2"]


def test_days_and_sessions_are_final_after_the_watermark(spark, tmp_path):
    t = lambda day: dt.datetime(2024, 1, day, 1, tzinfo=dt.timezone.utc)
    rows = [("s", "t", t(d), t(d), 1) for d in (1, 1, 2, 4, 9)] + [("s", "t", t(30), t(30), 1)]
    spark.createDataFrame(rows, "source string, topic string, reviewed_at timestamp, day_start timestamp, n long").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("source string, topic string, reviewed_at timestamp, day_start timestamp, n long").parquet(f"{tmp_path}/in")
    for name, made in (("days", ingest.daily_counts(stream())), ("incidents", ingest.sessions(stream()))):
        made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.day.day, r.reviews) for r in spark.table("days").collect()) == [(1, 2), (2, 1), (4, 1), (9, 1)]
    assert sorted((r.first_day.day, r.last_day.day, r.reviews) for r in spark.table("incidents").collect()) == [(1, 4, 4), (9, 9, 1)]
