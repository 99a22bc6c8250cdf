import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voxmill.operators import anomalies, browse, merge, replies, search, topics
from voxmill.sources import feeds


def _surge(spark, extra=30):
    day = dt.date(2024, 1, 1)
    rows = [(f"r{d}-{t}-{k}", f"t{t}", "app_store:us", day + dt.timedelta(d), "v1", 1) for d in range(10) for t in range(5) for k in range(4)]
    rows += [(f"x{k}", "t0", "app_store:us", day + dt.timedelta(5), "v2", 1) for k in range(extra)]
    return spark.createDataFrame(rows, "review_id string, topic string, source string, day date, app_version string, rating int")


def test_surge_is_found_and_attributed(spark):
    obs = anomalies.observations(_surge(spark))
    cells = anomalies.spike_cells(obs)
    assert cells.count() == 8 * 5
    spikes = cells.where("spike").collect()
    assert [(s.topic, s.day.day, s.n) for s in spikes] == [("t0", 6, 34)]
    alerts = cells.where("spike")
    found = anomalies.incidents(alerts)
    told = anomalies.release_attribution(found, alerts, obs).first()
    assert (told.top_version, told.release, told.prior_share) == ("v2", True, 0.0)
    assert anomalies.match_spikes(alerts, found, obs).first().outcome == "matched"
    early = anomalies.match_spikes(alerts, found.where("false"), obs).first()
    assert (early.outcome, early.earlier_days) == ("too little coverage", 4)
    assert anomalies.incident_members(found, alerts, obs, F.col("review_id")).count() == 34


def test_monitor_needs_history_and_alerts_once(spark):
    judged = anomalies.monitor_backtest(_surge(spark)).toPandas()
    assert set(judged[judged.alert].topic) == set()  # four earlier usable days are too few
    judged = anomalies.monitor_backtest(_surge(spark), least_days=4).toPandas()
    assert list(judged[judged.alert].topic) == ["t0"]
    two = _surge(spark).union(_surge(spark, 0).withColumn("source", F.lit("google_play:de")))
    judged = anomalies.monitor_backtest(two, least_days=4).toPandas()
    assert set(judged.tests) == {10} and len(judged) == 4 * 10 and judged.alert.sum() == 1


def test_alerted_days_leave_baselines(spark):
    day = dt.date(2024, 1, 1)
    rows = [(f"r{d}-{t}-{k}", f"t{t}", "s", day + dt.timedelta(d), "v1", 1) for d in range(20) for t in range(5) for k in range(4)]
    rows += [(f"x{d}-{k}", "t0", "s", day + dt.timedelta(d), "v2", 1) for d in (8, 9, 11, 15) for k in range(30)]
    judged = anomalies.monitor_backtest(spark.createDataFrame(rows, "review_id string, topic string, source string, day date, app_version string, rating int"))
    found = anomalies.incidents(judged.where("alert")).orderBy("first_day").collect()
    assert [(f.first_day.day - 1, f.last_day.day - 1, f.alert_days) for f in found] == [(8, 11, 3), (15, 15, 1)]


def test_merge_keeps_first_seen_and_counts(spark):
    stored = spark.createDataFrame([("l", "a", 1, "h1", 1, 1), ("l", "b", 2, "h2", 1, 1)], "listing_id string, external_id string, rating int, content_hash string, first_seen_at int, last_seen_at int")
    batch = spark.createDataFrame([("l", "b", 5, "h9"), ("l", "c", 3, "h3")], "listing_id string, external_id string, rating int, content_hash string")
    keys = ["listing_id", "external_id"]
    assert {r.external_id: r.change for r in merge.classify(stored, batch, keys).collect()} == {"b": "updated", "c": "inserted"}
    new = {r.external_id: (r.rating, r.first_seen_at, r.last_seen_at) for r in merge.merged(stored, batch, keys, F.lit(7)).collect()}
    assert new == {"a": (1, 1, 1), "b": (5, 1, 7), "c": (3, 7, 7)}


def test_an_unchanged_review_is_only_touched(spark):
    shape = "external_id string, rating int, helpful_count int, content_hash string"
    stored = spark.createDataFrame([("a", 1, 10, "h1", 1, 1), ("b", 2, 10, None, 1, 1)], shape + ", first_seen_at int, last_seen_at int")
    batch = spark.createDataFrame([("a", 1, 99, "h1", 1), ("b", 2, 99, "h2", 1), ("c", 3, 5, "x", 1), ("c", 4, 6, "y", 2)], shape + ", seq int")
    new = merge.merged(stored, batch, ["external_id"], F.lit(7), order="seq")
    assert {r.external_id: tuple(r)[1:] for r in new.collect()} == {"a": (1, 10, "h1", 1, 7), "b": (2, 99, "h2", 1, 7), "c": (4, 6, "y", 7, 7)}


def test_fusion(spark):
    lists = [spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id long, rank int") for ids in ([1, 2, 3], [3, 1, 4])]
    assert [r.id for r in search.fuse(*lists).orderBy(F.desc("score"), "best_rank", "id").collect()] == [1, 3, 2, 4]


def test_lexical_grammar_and_covers(spark):
    docs = spark.createDataFrame([(1, "slow start of the app"), (2, "start slow"), (3, "slow crash at start"), (4, None)], "doc_id long, text string")
    found = search.lexical(docs, "slow start -crash", 10).collect()
    assert [(r.id, round(r.score, 3)) for r in found] == [(1, 1.0), (2, 1.0)]
    assert [r.id for r in search.lexical(docs, '"start slow" or crash', 10).collect()] == [2, 3]


def test_metrics(spark):
    judged = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "query_id int, id string, grade int")
    ranks = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, id string, rank int")
    row = search.ranking_metrics(ranks, judged).first()
    assert (row.ndcg, row.precision, row.reciprocal_rank, row.judged) == (1.0, 0.2, 1.0, 0.2)


def test_keywords_have_new_stems(spark):
    scores = spark.createDataFrame([("t", "crash", 3, 3.0), ("t", "crashs", 3, 2.5), ("t", "slow start", 3, 2.0), ("t", "start", 3, 1.0), ("t", "sorry sorry", 3, 0.9), ("u", "x", 1, 0.0)], "topic string, term string, n long, score double")
    assert [(r.topic, r.keywords) for r in topics.diverse_keywords(scores).collect()] == [("t", ["crash", "slow start"])]
    many = spark.createDataFrame([("t", f"{w} {v}", 2, 9.0 - k / 1000) for k, (w, v) in enumerate((w, v) for w in ("aaaa", "bbbb") for v in map(str, range(150)))] + [("t", "last", 2, 0.1)], "topic string, term string, n long, score double")
    assert topics.diverse_keywords(many).first().keywords == ["aaaa 0", "bbbb 1", "last"]


def test_terms_of_topics(spark):
    rows = [("e", "energy runs out after one lesson"), ("e", "no energy left for the next lesson"), ("e", "energy refill is slow"), ("a", "too many ads after every lesson"), ("a", "ads everywhere in each lesson"), ("a", "watch ads again"), ("none", "the a")]
    words = {r.topic: r.keywords for r in topics.diverse_keywords(topics.term_scores(spark.createDataFrame(rows, "topic string, text string"))).collect()}
    assert words["e"][0] == "energy" and words["a"][0] == "ads" and "none" not in words
    assert topics.app_stop_words("My Duo", "duo") == ["duo", "my"]


def test_relabel_leaves_membership(spark):
    runs = spark.createDataFrame([(1, "app", 1, {"k": "20"}), (2, "app", 2, {"k": "20"}), (3, "other", 9, {})], "run_id long, slug string, created_at long, parameters map<string,string>")
    rows = spark.createDataFrame([(2, 1, "old", ["x"]), (1, 1, "old", ["x"]), (2, 2, "old", ["x"])], "run_id long, topic long, label string, keywords array<string>")
    texts = spark.createDataFrame([(2, 1, "streak lost", "en", None), (2, 1, "x", "de", "streak gone"), (2, 2, "kaputt", "de", None)], "run_id long, topic long, text string, language string, translation string")
    new, noted = topics.relabel(runs, rows, texts, "app", name="The App")
    assert sorted((r.run_id, r.topic, r.label, r.keywords) for r in new.collect()) == [(1, 1, "old", ["x"]), (2, 1, "streak", ["streak"]), (2, 2, "(no distinctive terms)", [])]
    assert {r.run_id: r.parameters.get("naming") for r in noted.collect()} == {1: None, 2: "fallbacks=0", 3: None}


def test_kmeans_covers_all(spark):
    rows = [(i, [1.0 if i % 3 == k else 0.01 * (i % 2) for k in range(3)]) for i in range(30)]
    placed = topics.kmeans_topics(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).toPandas()
    assert len(placed) == 30 and placed.topic.nunique() == 3 and placed.distance.between(0, 2).all()


def test_curation_reasons(spark):
    rows = [(i, f"Thank you for the kind words number {i}") for i in range(7)] + [(8, "Thank you for the kind words number 0"), (9, None), (10, "two words " * 40 + "."), (11, "Thank you for the kind words number 6")]
    out = {r.id: r.reason for r in replies.curate(spark.createDataFrame(rows, "id long, reply string"), ["id"]).collect()}
    assert (out[0], out[5], out[8], out[9], out[10], out[11]) == (None, "template opening", "duplicate", "unusable", "too long", "template opening")


@pytest.mark.parametrize(("said", "wanted"), [
    ("hi John, thanks for the feedback ! mail help@x.example 🙂", "Hi, thanks for the feedback! mail {support_contact}"),
    ("Hallo Tobias! Wir freuen uns über dein Feedback.", "Hallo! Wir freuen uns über dein Feedback."),
    ("Hola, Lyox:\n\nSe pregunta por la edad.", "Hola, Se pregunta por la edad."),
    ("Thank you for your feedback, Irene. Glad you enjoy it.", "Thank you for your feedback. Glad you enjoy it."),
    ("Thank you for your feedback Sadiq. Glad it helps.", "Thank you for your feedback. Glad it helps."),
    ("Omar, thank you! We keep improving it.", "Thank you! We keep improving it."),
    ("Hi there, please reach us at help@acme.com?", "Hi there, please reach us at {support_contact}?"),
    ("Danke für dein Feedback zu Übungen.\nAcme Team\n", "Danke für dein Feedback zu Übungen."),
    ("We shared your idea today! Best, Acme team", "We shared your idea today!"),
    ("Danke für dein Feedback zu Übungen! Liebe Grüße :)", "Danke für dein Feedback zu Übungen!"),
    ("Glad you like the new lessons. Thanks for your patience with us", "Glad you like the new lessons. Thanks for your patience with us"),
    ("ご意見ありがとうございます。いただいた声はチームに共有いたします。", "ご意見ありがとうございます。いただいた声はチームに共有いたします。"),
    ("We will look into this soon...", "We will look into this soon..."),
    ("Thanks, Anna!", None), ("some more words " * 22 + "cut...", None),
])
def test_clean_reply(spark, said, wanted):
    assert spark.range(1).select(replies.clean_reply(F.lit(said), ["Acme", "Other"]).alias("x")).first().x == wanted


def _checks(spark, reply, review="the app crashes", language="en", told="en"):
    c = replies.check_reply(F.lit(reply), F.lit(review), F.lit(language), F.lit(told), F.lit("App"), F.lit(None).cast("string"), ["Babbel"])
    return {k for k, v in spark.range(1).select(*(v.alias(k) for k, v in c.items())).first().asDict().items() if not v}


def test_reply_checks(spark):
    assert _checks(spark, "Sorry for this, please write to {support_contact}.") == set()
    assert _checks(spark, "Thanks for using Babbel, we look into it.") == {"no_foreign_brand_or_contact"}
    assert _checks(spark, "Thanks for Babbelmore and {nobody} now") == {"valid_placeholders", "complete"}
    assert _checks(spark, "Two words.") == {"non_empty"}
    assert _checks(spark, "one, two three four five six seven eight nine!", "One two three, four five six seven eight") == {"not_copied"}
    assert _checks(spark, "Vielen Dank für alles.", told="de") == {"right_language"}
    assert _checks(spark, "All is fine now”" + " a" * 200 + "]") == {"within_limit", "complete"}


def test_benchmark_scores_references_first(spark):
    examples = spark.createDataFrame([(k, "the app crashes", "en", "App", None, "Sorry for the crash, please write to {support_contact}.") for k in "ab"], "key string, review string, language string, app_name string, contact string, reference string")
    generated = spark.createDataFrame([(k, g, r, 0.5) for k in "ab" for g, r in (("good", "We are sorry, please write to us."), ("leaky", "Thanks for using Babbel, all is well."))], "key string, generator string, reply string, seconds double")
    drafts, summary = replies.benchmark(examples, generated, lambda bare: F.lit("en"), ["Babbel"])
    assert [(r.generator, r.pass_rate, r.seconds_per_reply) for r in summary.collect()] == [("reference", 1.0, 0.0), ("good", 1.0, 0.5), ("leaky", 0.0, 0.5)]
    assert drafts.count() == 6


def test_app_store_feed(spark):
    label = lambda x: '{"label": "%s"}' % x
    entry = '{"id": %s, "title": %s, "content": %s, "updated": %s, "im:rating": %s, "author": {"name": %s}}'
    one = entry % tuple(map(label, ("1", "", "good", "2024-01-01T00:00:00-07:00", "5", "me")))
    bad = entry % tuple(map(label, ("2", "t", "odd", "2024-01-01T00:00:00-07:00", "x", "me")))
    rows = [("us", '{"feed": {"entry": [%s, %s]}}' % (one, bad)), ("de", '{"feed": {"entry": %s}}' % one), ("fr", '{"feed": {}}')]
    kept, rejects = feeds.parse_app_store(spark.createDataFrame(rows, "country string, payload string"))
    assert sorted((r.country, r.title, r.rating, r.reviewed_at.hour) for r in kept.collect()) == [("de", None, 5, 7), ("us", None, 5, 7)]
    assert rejects.count() == 1


def test_unknown_placeholder_is_an_error(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"app": "a", "store": "app_store", "id": "1", "reply": "Hi"}\n\n{"app": "a", "store": "app_store", "id": "2", "reply": "Hi {nobody}"}\n')
    with pytest.raises(Exception, match="unknown placeholder.*a.jsonl:3"):
        feeds.read_written_replies(spark, str(tmp_path)).collect()


def test_pages_are_read_up_to_the_cutoff(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("a", 1, 0, False, t(9), "x"), ("a", 2, 0, False, t(3), "y"), ("a", 3, 0, False, t(8), "late"), ("b", 1, 0, True, t(9), "x"), ("b", 2, 0, False, t(8), "y"), ("c", 1, 0, False, t(9), "x"), ("c", 1, 1, False, t(8), "y"), ("c", 2, 0, False, t(7), "z")]
    pages = spark.createDataFrame(rows, "partition_key string, page int, position int, hit_provider_limit boolean, reviewed_at timestamp, external_id string")
    kept, coverage = merge.consume_pages(pages, spark.createDataFrame([(k, t(5)) for k in "abcd"], "partition_key string, cutoff timestamp"), 2)
    assert sorted((r.partition_key, r.external_id) for r in kept.collect()) == [("a", "x"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", "y")]
    assert {r.partition_key: r.coverage_complete for r in coverage.collect()} == {"a": True, "b": False, "c": False, "d": True}


def test_a_failed_partition_stops_no_other():
    def fails():
        raise TimeoutError("feed")

    assert merge.isolated({"us": lambda: 3, "de": fails, "br": lambda: 1}) == [("us", "succeeded", 3, None), ("de", "failed", 0, "TimeoutError: feed"), ("br", "succeeded", 1, None)]


def test_throughput(spark):
    rows, seen = merge.observed(spark.range(10), "enrichment", embedded=F.col("id") < 7)
    rows.write.format("noop").mode("overwrite").save()
    assert merge.throughput(seen, 2.0) == {"processed": 10, "embedded": 7, "per_second": 5.0} and merge.throughput(seen, 0)["per_second"] == 0


def test_batches_of_like_lengths(spark):
    rows = spark.createDataFrame([(k, "x" * (k % 7)) for k in range(50)], "id long, text string")
    out = replies.length_batches(rows, 8).collect()
    lengths = [sorted((len(r.text) for r in out if r.batch == b), reverse=True) for b in range(7)]
    assert sum(lengths, []) == sorted((len(r.text) for r in out), reverse=True) and [len(x) for x in lengths] == [8] * 6 + [2]


def test_modes_are_compared_one_after_the_other(spark):
    docs = spark.createDataFrame([(1, "slow start"), (2, "start")], "doc_id long, text string")
    ticks = iter([0.0, 2.0, 2.0, 5.0])
    rows, seconds = search.compare_modes([("q", "start")], {"one": lambda q: search.lexical(docs, q, None), "two": lambda q: search.lexical(docs, f"slow {q}", None)}, 5, clock=lambda: next(ticks))
    assert sorted((r.mode, r.id, r.rank) for r in rows.collect()) == [("one", 1, 1), ("one", 2, 2), ("two", 1, 1)] and seconds == [("one", 2.0), ("two", 3.0)]


def test_store_info(spark):
    row = browse.store_info(spark, {"reviews": spark.range(1)}, 3).first()
    assert (row.table, row.columns, row.current) == ("reviews", 1, True)


def test_play_records(spark):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [("1", "me", "good", 5, 1, None, "2.0", at, None, None), ("2", "me", None, None, 0, "1", "2", at, None, None), ("3", None, None, 4, 0, "1.5", "2", at, "thanks", at)]
    kept, rejects = feeds.parse_play(spark.createDataFrame(rows, feeds.PLAY_RECORD), "de", "Europe/Berlin")
    assert sorted((r.external_id, r.body, r.app_version, r.reviewed_at.hour, r.author_hash is None) for r in kept.collect()) == [("1", "good", "2.0", 11, False), ("3", "", "1.5", 11, True)]
    assert [r.external_id for r in rejects.collect()] == ["2"]


def test_feed_pages_as_a_source(spark, tmp_path):
    page = '{"feed": {"entry": [{"im:rating": {"label": "5"}}]}}'
    for key, pages in {"us": [page, page, '{"feed": {}}', page], "de": [page] * 12, "br": ["[]"]}.items():
        (tmp_path / key).mkdir()
        for k, text in enumerate(pages, 1):
            (tmp_path / key / f"{k}.json").write_text(text)
    spark.dataSource.register(feeds.PagedFeed)
    rows = spark.read.format("paged_feed").option("path", str(tmp_path)).load().collect()
    assert sorted((r.partition_key, r.page) for r in rows) == [("de", k) for k in range(1, 11)] + [("us", 1), ("us", 2)]
    assert [(r.partition_key, r.page) for r in rows if r.hit_provider_limit] == [("de", 10)]


def test_yaml_catalog(spark, tmp_path):
    (tmp_path / "apps.yaml").write_text("apps:\n- slug: a\n  name: A\n  listings: {app_store: '1'}\n  markets: [{country: us, language: en}]\n")
    apps, listings = feeds.read_catalog(spark, feeds.read_yaml(spark, str(tmp_path / "apps.yaml"))["apps"])
    assert apps.first().slug == "a" and merge.plan_jobs(listings).first().partition_key == "us"
    assert replies.brand_names(apps, ["a"]) == ["A", "a"] and replies.other_brands(apps, "b") == ["A"]


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("k", "train", "written", "a", "s", 1, "en", "r", "ü")], "key string, split string, source string, app string, store string, rating int, language string, review string, reply string")
    feeds.write_records(rows, f"{tmp_path}/records")
    assert spark.read.json(f"{tmp_path}/records").first().reply == "ü"
    feeds.write_pool(rows, f"{tmp_path}/pool")
    with pytest.raises(Exception, match="(?i)exists"):
        feeds.write_pool(rows, f"{tmp_path}/pool")
    feeds.write_benchmark(rows, rows, f"{tmp_path}/bench")
    assert spark.read.json(f"{tmp_path}/bench/summary").count() == 1
    with pytest.raises(ValueError):
        feeds.read_judgments(spark, [{"id": "q", "judgments": [{"id": "1", "grade": 3}]}])


def test_nearest_examples_keep_every_query(spark):
    queries = spark.range(1200).select((F.col("id") + 10).alias("id"), F.array(F.lit(1.0), F.col("id") / 1200).alias("vector"))
    examples = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "id long, vector array<double>")
    out = search.nearest_examples(queries, examples, 1)
    assert out.count() == out.select("query_id").distinct().count() == 1200


def test_nearest_examples_in_small_blocks(spark):
    r = random.Random(6)
    vector = lambda: r.choice([None, [], [0.0, 0.0], [1.0, None], [1.0, 2.0, 3.0]]) if r.random() < 0.2 else [float(r.randint(-2, 2)), float(r.randint(1, 3))]
    examples = [(k % 40, vector()) for k in range(60)]
    queries = [(k, vector()) for k in range(30)]
    length = lambda v: sum(x * x for x in v) ** 0.5 if v and None not in v else 0.0
    wanted = {}
    for q, a in queries:
        near = [(-sum(x * y for x, y in zip(a, b, strict=True)) / (length(a) * length(b)), e) for e, b in examples if e != q and length(a) and length(b) and len(a) == len(b)]
        if near:
            wanted[q] = [(e, round(-s, 9)) for s, e in sorted((round(s, 12), e) for s, e in near)[:4]]
    shape = "id long, vector array<double>"
    out = search.nearest_examples(spark.createDataFrame(queries, shape), spark.createDataFrame(examples, shape), 4, query_block=7, example_block=9).collect()
    got = {q: [(x.example_id, round(x.similarity, 9)) for x in sorted((x for x in out if x.query_id == q), key=lambda x: -x.position)] for q in {x.query_id for x in out}}
    assert {q: [s for _, s in v] for q, v in got.items()} == {q: [s for _, s in v] for q, v in wanted.items()}
    assert all(x.position <= len(got[x.query_id]) for x in out)
