"""A positional inverted index of texts: postings by term in buckets, written batch by batch, that keyword search reads alone.

A posting is a text's id and the places of a term in it.  A text's postings are made where it is read, and are dealt into
buckets by their term's code, a folder each, and sorted by code within, so a query reads the row groups of its own terms,
however large the corpus.  A batch adds folders of its own and may be written again with the same number: it replaces what it
wrote.  An id that comes again in a later batch is its new text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.search import cover_density, parse_query, tokens

BUCKETS = 64
#: Words whose postings a worker makes at once.
_AT_ONCE = 1 << 18
POSTINGS = "term string, id long, places array<int>, code long, batch long, bucket int"


def _bucket(code: Column) -> Column:
    """The first six bits of a term's code, so that a bucket is a range of codes."""
    return (F.shiftright(code, 58) + BUCKETS // 2).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text and distinct word of it, with the word's places; a bounded number of words is held at once, or one text."""
    for batch in batches:
        sizes = batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")))
            part, count = batch.slice(at, to - at), sizes[at:to]
            at = to
            words = part.column("words").flatten().dictionary_encode()
            row = np.repeat(np.arange(len(count)), count)
            if not len(row):
                continue
            place = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            key = row * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")  # places of a word stay in order
            first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order]))
            which = order[first]
            columns = [words.dictionary.take(words.indices.take(pa.array(which))), part.column("id").take(pa.array(row[which])), places]
            yield pa.RecordBatch.from_arrays(columns, ["term", "id", "places"])


def write_batch(texts: DataFrame, path: str, batch: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Adds the texts of a batch; ids are integers, and unique in it.  Null texts count as empty: they end an older text."""
    rows = texts.select(F.col(id_column).cast("long").alias("id"), tokens(F.col(text_column)).alias("words"))
    dealt = rows.mapInArrow(_postings, "term string, id long, places array<int>").withColumn("code", F.xxhash64("term")).withColumn("bucket", _bucket(F.col("code")))
    # A bucket holds the postings of many terms; a frequent term's are dealt over several files.  Sorted by one number, rows need not be compared.
    dealt = dealt.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("code")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    texts.select(F.col(id_column).cast("long").alias("id")).write.mode("overwrite").parquet(f"{path}/ids/batch={batch}")


def postings_of(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(term, id, places, batch) of some terms: the folders of their buckets, and there the row groups that hold them."""
    codes = spark.createDataFrame([(t,) for t in terms], "term string").select(F.xxhash64("term").alias("code"))
    asked = codes.select("code", _bucket(F.col("code")).alias("bucket")).distinct().collect()  # the query's own words
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("bucket").isin([r.bucket for r in asked]) & F.col("code").isin([r.code for r in asked]))
    return rows.where(F.col("term").isin(terms)).drop("bucket", "code")


def lexical(spark: SparkSession, path: str, query: str, limit: int | None, scope: DataFrame | None = None) -> DataFrame:
    """id and score as `search.lexical` gives them, from the index; with a scope (id), only those ids are ranked."""
    groups, excluded = parse_query(query)
    wanted = sorted({word for phrase in [*(p for g in groups for p in g), *excluded] for word in phrase})
    found = postings_of(spark, path, wanted)
    if scope is not None:
        found = found.join(scope.select("id").distinct(), "id", "left_semi")
    batches = spark.read.schema("id long, batch long").parquet(f"{path}/ids")
    # Texts of one batch alone are all new; otherwise an older batch's posting counts if no later one has the id.
    if batches.select("batch").distinct().count() > 1:
        ids = found.select("id").distinct()
        newest = batches.join(ids, "id", "left_semi").groupBy("id").agg(F.max("batch").alias("batch"))
        found = found.join(newest, ["id", "batch"], "left_semi")
    of = {word: f"w{k}" for k, word in enumerate(wanted)}
    rows = found.groupBy("id").agg(*(F.max(F.when(F.col("term") == word, F.col("places"))).alias(name) for word, name in of.items()))

    def starts(phrase: list[str]) -> Column:
        """Where a phrase starts: its first word's places, with the others right behind."""
        none = F.array().cast("array<int>")
        later = [F.coalesce(F.col(of[word]), none) for word in phrase[1:]]
        return F.filter(F.coalesce(F.col(of[phrase[0]]), none), lambda i: reduce(lambda a, b: a & b, (F.array_contains(p, i + k) for k, p in enumerate(later, 1)), F.lit(True)))

    for k, group in enumerate(groups):
        rows = rows.withColumn(f"p{k}", F.concat(*(starts(p) for p in group))).where(F.size(f"p{k}") > 0)
    for phrase in excluded:
        rows = rows.where(F.size(starts(phrase)) == 0)
    scored = rows.select("id", cover_density([f"p{k}" for k in range(len(groups))]).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)
