"""Search over the positional index against search over the texts, batch by batch and within a scope."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voxmill.operators import search, text_index

DOCS = "doc_id long, text string"
QUERIES = ["w1 w2", '"w1 w2" -w3', "w4 or w5 w1", '"w1 w1"', "w9 -w1", "nothing", '"w2 w3 w4" or w7']


def _texts(n, seed):
    r = random.Random(seed)
    return [(k, r.choice([None, ""]) if k % 17 == 0 else r.choice([" ", ", "]).join(f"W{r.randrange(10)}" for _ in range(r.randint(1, 60)))) for k in range(n)]


def _rows(df):
    return sorted((r.id, round(r.score, 9)) for r in df.collect())


def test_batches_repeats_and_scopes(spark, tmp_path):
    path = f"{tmp_path}/index"
    first, second = dict(_texts(80, 1)), {k + 50: t for k, t in _texts(60, 2)}
    write = lambda rows, batch: text_index.write_batch(spark.createDataFrame(list(rows.items()), DOCS), path, batch)
    write({1: "w1 gone"}, 0)
    write(first, 0)  # the same number again
    now = spark.createDataFrame(list(first.items()), DOCS)
    for query in QUERIES[:3]:
        assert _rows(text_index.lexical(spark, path, query, None)) == _rows(search.lexical(now, query, None))
    write(second, 1)
    now = spark.createDataFrame(list((first | second).items()), DOCS)
    scope = spark.range(0, 110, 3)
    for query in QUERIES:
        assert _rows(text_index.lexical(spark, path, query, None)) == _rows(search.lexical(now, query, None)), query
        assert _rows(text_index.lexical(spark, path, query, 7, scope)) == _rows(search.lexical(now.where("doc_id % 3 = 0"), query, 7)), query


def test_a_query_reads_its_own_terms(spark, tmp_path):
    path = f"{tmp_path}/index"
    text_index.write_batch(spark.createDataFrame([(k, f"common term{k}") for k in range(2000)], DOCS), path, 0)
    found = text_index.postings_of(spark, path, ["term7"])
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "term7" in plan.split("PushedFilters")[1]


def test_filters_hold_before_ranking(spark):
    day = dt.datetime(2024, 1, 1)
    reviews = spark.createDataFrame([(k, ("a", "b")[k % 2], ("en", "de", None)[k % 3], k % 5 + 1, day + dt.timedelta(days=k)) for k in range(30)], "review_id long, store string, language string, rating int, reviewed_at timestamp_ntz")
    ids = lambda **f: sorted(r.id for r in search.filtered_ids(reviews, **f).collect())
    assert ids() == list(range(30)) and ids(stores=["b"]) == list(range(1, 30, 2))
    assert ids(languages=["en"], min_rating=2, max_rating=3) == [k for k in range(30) if k % 3 == 0 and 2 <= k % 5 + 1 <= 3]
    assert ids(since=day + dt.timedelta(days=28)) == [28, 29]
    docs = spark.createDataFrame([(k, "slow start" if k < 20 else "slow") for k in range(30)], DOCS)
    vectors = spark.createDataFrame([(k, "m1" if k < 25 else "m2", [1.0, k / 30]) for k in range(30)], "vec_id long, model string, embedding array<double>")
    scope = search.filtered_ids(reviews, stores=["b"])
    out = search.hybrid(docs, vectors, "slow", [1.0, 0.0], limit=30, scope=scope, model="m1").collect()
    # Vectors of the other model rank nowhere, but their texts do.
    assert sorted(r.id for r in out) == list(range(1, 30, 2)) and next(r for r in out if r.id == 29).score == pytest.approx(1 / (60 + 15))


def test_postings_are_made_and_sorted_without_comparing_texts(spark, tmp_path):
    texts = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "a")], "doc_id long, text string")
    text_index.write_batch(texts, str(tmp_path), 0)
    rows = spark.read.parquet(f"{tmp_path}/postings").select("term", "id", "places").collect()
    assert sorted(map(tuple, rows)) == [("a", 1, [1]), ("a", 4, [0]), ("b", 1, [0, 2])]
