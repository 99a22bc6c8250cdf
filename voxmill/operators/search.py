"""Keyword, vector and fused retrieval, and the metrics of rankings."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.ranks import placed

POOL, RRF_K = 50, 60


def tokens(text: Column) -> Column:
    """Words of letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def parse_query(text: str) -> tuple[list[list[list[str]]], list[list[str]]]:
    """(alternatives of required phrases, excluded phrases): words and quoted phrases, `or` between, minus before."""
    groups, excluded, either = [], [], False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            either = bool(groups)
            continue
        parts = re.findall(r"\w+", (phrase or word).lower())
        if not parts:
            continue
        if minus:
            excluded.append(parts)
        elif either:
            groups[-1].append(parts)
        else:
            groups.append([parts])
        either = False
    if not groups:
        raise ValueError("a query needs a word to look for")
    return groups, excluded


def _places(words: Column, phrase: Sequence[str]) -> Column:
    """Where a phrase starts."""
    if len(phrase) == 1:
        return F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())
    everywhere = F.when(F.size(words) >= len(phrase), F.sequence(F.lit(0), F.size(words) - len(phrase))).otherwise(F.array().cast("array<int>"))
    return F.filter(everywhere, lambda i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))


def _marked(group: int):
    return lambda i: F.struct(i.alias("at"), F.lit(group).alias("g"))


def _covered(a: Column, m: Column, last: Column, start: Column, words: int) -> Column:
    """The state after a place: a cover is minimal if it starts later than the one before it."""
    more = F.when(start > a.before, 1.0 / (1.0 + F.greatest(m.at - start + 1 - words, F.lit(0)))).otherwise(0.0)
    return F.struct(last.alias("last"), F.greatest(a.before, start).alias("before"), (a.score + more).alias("score"))


def cover_density(places: list[str]) -> Column:
    """The score of covers from columns with the places of each required group."""
    marks = [F.transform(p, _marked(k)) for k, p in enumerate(places)]
    start = F.struct(F.array(*[F.lit(-1)] * len(places)).alias("last"), F.lit(-1).alias("before"), F.lit(0.0).alias("score"))

    def step(a: Column, m: Column) -> Column:
        last = F.transform(a.last, lambda x, g: F.when(g == m.g, m.at).otherwise(x))
        return F.get(F.transform(F.array(last), lambda held: _covered(a, m, held, F.array_min(held), len(places))), 0)

    return F.aggregate(F.array_sort(F.concat(*marks)), start, step, lambda a: a.score)


def lexical(documents: DataFrame, query: str, limit: int | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score of documents that hold all required words and none excluded, best first, by cover density.

    A cover is a stretch that holds every required word and no shorter such stretch; it counts 1 / (1 + words in it beyond
    the required ones).  Matching is one pass with column functions; matching rows are scored by one walk over their places.
    """
    groups, excluded = parse_query(query)
    # Texts without the letters of a required word need not be split; a null limit ranks them all.
    lowered = F.lower(F.col(text_column))
    hopeful = documents
    for group in groups:
        hopeful = hopeful.where(reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p[0])) for p in group)))
    rows = hopeful.select(F.col(id_column).alias("id"), tokens(F.col(text_column)).alias("w"))
    for parts in {p for g in groups if len(g) == 1 for p in g[0]}:
        rows = rows.where(F.array_contains("w", parts))
    for k, group in enumerate(groups):
        rows = rows.withColumn(f"p{k}", F.concat(*(_places(F.col("w"), p) for p in group))).where(F.size(f"p{k}") > 0)
    for phrase in excluded:
        rows = rows.where(F.size(_places(F.col("w"), phrase)) == 0)
    score = cover_density([f"p{k}" for k in range(len(groups))])
    scored = rows.select("id", score.alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if a length is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def semantic(vectors: DataFrame, query: Sequence[float], limit: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id and score of the nearest vectors: exact, a top-k of each task."""
    score = cosine(F.col(vector_column), F.array(*(F.lit(float(x)) for x in query)))
    return vectors.select(F.col(id_column).alias("id"), score.alias("score")).orderBy(F.desc_nulls_last("score"), "id").limit(limit)


def fuse(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (id, rank): score, best rank; an id counts once a list, where it comes first.

    Lists of any length are numbered anew by stretches of ranks.
    """
    if k < 1:
        raise ValueError("k is 1 at least")
    lists = None
    for r in ranked:
        first = r.groupBy("id").agg(F.min("rank").alias("first"))
        first = placed(first, F.floor(F.col("first") / 4096), "first", "id").select("id", "rank")
        lists = first if lists is None else lists.unionByName(first)
    return lists.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").cast("int").alias("best_rank"))


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """A retriever's first `limit` rows with ranks from 1: few enough for one task."""
    top = scored.orderBy(F.desc_nulls_last("score"), "id").limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "id")).alias("rank"))


def filtered_ids(reviews: DataFrame, stores: Sequence[str] = (), languages: Sequence[str] = (), min_rating: int | None = None, max_rating: int | None = None, since=None, id_column: str = "review_id") -> DataFrame:
    """(id) of the reviews that a search may return: what every retriever is given, so that its best are the filtered best."""
    for column, values in (("store", stores), ("language", languages)):
        reviews = reviews.where(F.col(column).isin(list(values))) if values else reviews
    for bound, test in ((min_rating, "rating >= {}"), (max_rating, "rating <= {}")):
        reviews = reviews if bound is None else reviews.where(test.format(int(bound)))
    if since is not None:
        reviews = reviews.where(F.col("reviewed_at") >= F.lit(since))
    return reviews.select(F.col(id_column).alias("id"))


def hybrid(documents: DataFrame | Callable[..., DataFrame], vectors: DataFrame, query: str, query_vector: Sequence[float], limit: int = 10, pool: int = POOL, k: int = RRF_K, scope: DataFrame | None = None, model: str | None = None, **columns: str) -> DataFrame:
    """Fused ranks of keyword and vector search.  documents: a table of texts, or search(query, limit, scope) over an index.

    A scope (id) and a model hold in both retrievers, before either ranks.
    """
    if not query.strip() or limit < 1:
        raise ValueError("a search needs a query and a limit of 1 at least")
    pool = max(limit, pool)
    names = {"id_column": "vec_id", "vector_column": "embedding"} | columns
    if model is not None:
        vectors = vectors.where(F.col("model") == model)
    if scope is not None:
        vectors = vectors.join(scope.select(F.col("id").alias(names["id_column"])), names["id_column"], "left_semi")
        documents = documents if callable(documents) else documents.join(scope.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    words = documents(query, pool, scope) if callable(documents) else lexical(documents, query, pool)
    both = fuse(ranked(words, pool), ranked(semantic(vectors, query_vector, pool, **names), pool), k=k)
    return both.orderBy(F.desc("score"), "best_rank", "id").limit(limit)


def nearest_examples(queries: DataFrame, examples: DataFrame, n: int, query_block: int = 4096, example_block: int = 16_384) -> DataFrame:
    """The n examples nearest to each query, most similar last.  Every query is held against every example.

    Both sides are dealt into blocks of about a bounded number of rows, by their place and not by their id, so that repeats
    crowd no block.  A task multiplies one block of queries with one of examples and returns its n best of each query; the
    best of all blocks are cut before they are shuffled.  A vector that is null, empty or zero is near to nothing.
    """
    vector = F.col("vector").cast("array<double>")
    q = queries.select(F.col("id").alias("query_id"), vector.alias("vector")).where("size(vector) > 0")
    e = examples.select(F.col("id").alias("example_id"), vector.alias("vector")).where("size(vector) > 0")
    n_q, n_e = (max(1, -(-side.count() // most)) for side, most in ((q, query_block), (e, example_block)))
    place = F.monotonically_increasing_id()
    # Places first: after the explosion, copies of a row would have different ones.
    q, e = q.withColumn("qb", place % n_q), e.withColumn("eb", place % n_e)
    q = q.select("*", F.explode(F.expr(f"sequence(0L, {n_e - 1}L)")).alias("eb"))
    e = e.select("*", F.explode(F.expr(f"sequence(0L, {n_q - 1}L)")).alias("qb"))
    schema = q.select("query_id").schema.add("example_id", e.schema["example_id"].dataType).add("similarity", "double")
    found = q.groupBy("qb", "eb").cogroup(e.groupBy("qb", "eb")).applyInArrow(_nearest_of(n), schema)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "example_id"))
    near = found.withColumn("place", best).where(F.col("place") <= n)
    return near.select("query_id", "example_id", "similarity", (F.count("*").over(Window.partitionBy("query_id")) - F.col("place") + 1).alias("position"))


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of this width without nulls, their vectors, their lengths) of a block; vectors of length zero are left out."""
    held = table.column("vector").combine_chunks()
    fine = [k for k, v in enumerate(held.to_pylist()) if len(v) == width and None not in v]
    x = np.array(held.take(pa.array(fine, pa.int64())).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    length = np.sqrt((x * x).sum(axis=1))
    return np.array(fine, np.int64)[length > 0], x[length > 0], length[length > 0]


def _nearest_of(n: int) -> Callable:
    def run(queries: pa.Table, examples: pa.Table) -> pa.Table:
        rows, others, scores = [], [], []
        ids = pa.compute.rank(examples.column("example_id"), "ascending", tiebreaker="dense").to_numpy()
        codes = {v: k for k, v in enumerate(dict.fromkeys(examples.column("example_id").to_pylist()))}
        own = np.array([codes.get(v, -1) for v in queries.column("query_id").to_pylist()], np.int64)
        theirs = np.array([codes[v] for v in examples.column("example_id").to_pylist()], np.int64)
        for width in {len(v) for v in queries.column("vector").to_pylist()}:
            (mine, a, la), (at, b, lb) = _matrix(queries, width), _matrix(examples, width)
            if not len(at):
                continue
            for k in range(0, len(mine), 256):
                similarity = a[k : k + 256] @ b.T / (la[k : k + 256, None] * lb)
                similarity[own[mine[k : k + 256], None] == theirs[at]] = -np.inf
                for row, told in zip(mine[k : k + 256].tolist(), similarity, strict=True):
                    hopeful = np.flatnonzero(told >= np.partition(told, len(told) - n)[len(told) - n]) if len(told) > n else np.arange(len(told))
                    order = hopeful[np.lexsort((ids[at[hopeful]], -told[hopeful]))][:n]
                    order = order[np.isfinite(told[order])]
                    rows += [row] * len(order)
                    others += at[order].tolist()
                    scores += told[order].tolist()
        return pa.table({"query_id": queries.column("query_id").take(pa.array(rows, pa.int64())), "example_id": examples.column("example_id").take(pa.array(others, pa.int64())), "similarity": pa.array(scores, pa.float64())})

    return run


def compare_modes(queries: list[tuple], modes: dict[str, Callable], limit: int, clock: Callable[[], float] = time.perf_counter) -> tuple[DataFrame, list[tuple[str, float]]]:
    """((mode, query_id, id, rank) of each query in each mode, one after the other; seconds of each mode).

    modes: name -> search(query text) returning (id, score), best `limit` of which count.
    """
    out, seconds = None, []
    for mode, search in modes.items():
        began = clock()
        for query_id, text in queries:
            rows = ranked(search(text), limit).select(F.lit(mode).alias("mode"), F.lit(query_id).alias("query_id"), "id", "rank")
            kept = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)  # `limit` rows, so that the time is the search's
            out = kept if out is None else out.unionByName(kept)
        seconds.append((mode, clock() - began))
    return out, seconds


def pool_candidates(*modes: DataFrame, depth: int = 10) -> DataFrame:
    """Every mode's first documents, once each, in order of id so that ranks stay hidden."""
    out = modes[0].where(F.col("rank") <= depth).select("query_id", "id")
    for m in modes[1:]:
        out = out.union(m.where(F.col("rank") <= depth).select("query_id", "id"))
    return out.distinct().orderBy("query_id", "id")


def ranking_metrics(rankings: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """nDCG, precision, reciprocal rank and judged share at k of each query; unjudged documents have grade 0."""
    top = rankings.where(F.col("rank") <= k).join(judgments, ["query_id", "id"], "left")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    grade = F.coalesce("grade", F.lit(0))
    found = top.groupBy("query_id").agg(
        F.sum(gain(grade, F.col("rank"))).alias("dcg"), (F.count_if(grade > 0) / k).alias("precision"), F.coalesce(1 / F.min(F.when(grade > 0, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), (F.count("grade") / k).alias("judged")
    )
    best = judgments.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))).where(F.col("place") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"))
    out = ideal.join(found, "query_id", "left")
    ndcg = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)
    return out.select("query_id", ndcg.alias("ndcg"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "reciprocal_rank", "judged")))


def mode_report(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("mode").agg(*(F.avg(c).alias(c) for c in ("ndcg", "precision", "reciprocal_rank", "judged")))


def by_mode(metrics: DataFrame, modes: list[str]) -> DataFrame:
    """nDCG of each query with a column for each mode."""
    return metrics.groupBy("query_id").pivot("mode", modes).agg(F.first("ndcg"))
