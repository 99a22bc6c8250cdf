"""The feed as a stream: re-runs, edits, late arrivals, crashes, failing partitions, limits and caps."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from voxmill.streaming import feed

NOW = dt.datetime(2024, 5, 30, 12, tzinfo=dt.timezone.utc)


def _ago(hours):
    return (NOW - dt.timedelta(hours=hours)).isoformat()


class Shop:
    """A feed scripted by a file, and a store of what has been merged, by content."""

    def __init__(self, spark, folder):
        self.spark, self.path, self.script, self.log = spark, f"{folder}/sink", f"{folder}/script.json", f"{folder}/asked"
        script, log = self.script, self.log

        def fetch(key, token):
            with open(log, "a") as f:
                f.write(f"{key} {token}\n")
            pages = json.load(open(script)).get(key, [])
            at = token or 0
            if at >= len(pages):
                return [], None, False
            page = pages[at]
            if page.get("fails"):
                raise ConnectionError("store unavailable")
            rows = [(i, dt.datetime.fromisoformat(t), body) for i, t, body in page["reviews"]]
            return rows, at + 1 if at + 1 < len(pages) else None, page.get("limited", False)

        spark.dataSource.register(feed.review_feed(fetch, "shop"))
        self.stored, self.crash, self.folder = {}, False, folder

    def merge(self, rows, batch):
        for r in rows.collect():
            self.stored[r.external_id] = r.payload
        if self.crash:
            raise RuntimeError("lost power")

    def run(self, pages, keys=("us",), **options):
        json.dump(pages, open(self.script, "w"))
        open(self.log, "w").close()
        feed.ingest_feed(self.spark, self.path, list(keys), self.merge, f"{self.folder}/check", "shop", **({"now": NOW.isoformat()} | options)).awaitTermination()
        runs = self.spark.read.parquet(f"{self.path}/runs")
        last = runs.where(F.col("batch") == runs.agg(F.max("batch")).first()[0])
        return {r.partition_key: (r.status, r.fetched, r.coverage_complete, r.error) for r in last.collect()}

    def asked(self):
        return open(self.log).read().split("\n")[:-1]


def _page(*reviews, **more):
    return {"reviews": [(i, _ago(h), body) for i, h, body in reviews]} | more


@pytest.fixture
def shop(spark, tmp_path):
    return Shop(spark, str(tmp_path))


def test_reruns_edits_and_late_arrivals(shop):
    first = {"us": [_page(("a", 1, "x"), ("b", 2, "y"))]}
    assert shop.run(first) == {"us": ("succeeded", 2, True, None)}
    assert feed.stored_cursors(shop.path) == {"us": _ago(1).replace("+00:00", ".000000+00:00")}
    # The cursor is an hour old: 72 hours before it, "late" is still seen, "old" no more.
    edited = {"us": [_page(("a", 1, "now it crashes"), ("late", 70, "z")), _page(("old", 74, "o")), _page(("older", 99, "o"))]}
    later = (NOW + dt.timedelta(hours=5)).isoformat()
    assert shop.run(edited, now=later) == {"us": ("succeeded", 2, True, None)}
    assert shop.stored == {"a": "now it crashes", "b": "y", "late": "z"} and shop.asked() == ["us None", "us 1"]
    # Another store's overlap, and a backfill.
    later = lambda minutes: (NOW + dt.timedelta(hours=6, minutes=minutes)).isoformat()
    assert shop.run(edited, now=later(0), overlap_hours="336")["us"][1] == 4
    assert shop.run(edited, now=later(1), since=_ago(71))["us"][1] == 2


def test_a_crash_before_the_batch_is_done_moves_no_cursor(shop):
    pages = {"us": [_page(("a", 1, "x"))]}
    shop.crash = True
    with pytest.raises(Exception, match="lost power"):
        shop.run(pages)
    assert feed.stored_cursors(shop.path) == {}
    shop.crash = False
    more = {"us": [_page(("new", 0.5, "n"), ("a", 1, "x")), _page(("b", 29 * 24, "y"))]}
    shop.run(more)
    # The batch again, from where it was asked first, and the run's own.
    assert shop.stored == {"new": "n", "a": "x", "b": "y"} and list(feed.stored_cursors(shop.path)) == ["us"]


def test_a_failing_partition_stops_no_other_and_keeps_its_cursor(shop):
    pages = {"us": [_page(("a", 1, "x")), {"fails": True}], "de": [_page(("d", 2, "x"))]}
    assert shop.run(pages, ("us", "de", "us")) == {"us": ("failed", 1, None, "ConnectionError: store unavailable"), "de": ("succeeded", 1, True, None)}
    assert list(feed.stored_cursors(shop.path)) == ["de"] and shop.stored.keys() == {"a", "d"}
    healed = {"us": [_page(("a", 1, "x")), _page(("b", 300, "y"))], "de": []}
    assert shop.run(healed, ("us", "de"))["us"] == ("succeeded", 2, True, None) and feed.stored_cursors(shop.path).keys() == {"us", "de"}


def test_limits_and_caps_mark_the_coverage(shop):
    limited = {"us": [_page(("a", 1, "x")), _page(("b", 2, "y"), limited=True)], "de": [_page(("c", 1, "x"), ("d", 2, "x")), _page(("e", 3, "x"))]}
    assert shop.run(limited, ("us", "de"), max_reviews="2") == {"us": ("succeeded", 2, False, None), "de": ("succeeded", 2, False, None)}
    assert shop.stored.keys() == {"a", "b", "c", "d"}
    crossed = {"us": [_page(("a", 1, "x"), ("b", 900, "y"), limited=True)]}
    assert shop.run(crossed)["us"] == ("succeeded", 1, True, None)
