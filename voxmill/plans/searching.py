"""Retrieval, ranking metrics and topics over documents and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxmill.operators import search as S
from voxmill.operators import text_index as I
from voxmill.operators import topics as T
from voxmill.operators.ranks import placed
from voxmill.sources.shared import shared_dir
from voxmill.sources.views import star, table

QUERY = "the erly"
#: Words left out of the scores of terms.
_STOP = ["the", "erly", "nder"]


def _query_vector(spark, d):
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _semantic(spark, d, limit=10):
    return S.semantic(table(spark, d, "embeddings"), _query_vector(spark, d), limit)


def _lexical(spark, d, query, limit=None):
    return S.lexical(table(spark, d, "documents"), query, limit)


def _fused(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    lists = [placed(v.where(f"label = {k}").select("id"), (F.col("id") * 7919) % m, "id") for k, m in ((1, 101), (1, 211), (2, 307))]
    return S.fuse(*lists).withColumn("score", F.round("score", 10))


_FUSED = """with v as (select vec_id id, label from embeddings), l as (
  select id, row_number() over (order by (id * 7919) % 101, id) r from v where label = 1 union all select id, row_number() over (order by (id * 7919) % 211, id) from v where label = 1
  union all select id, row_number() over (order by (id * 7919) % 307, id) from v where label = 2) select id, round(sum(1.0 / (60 + r)), 10) score, min(r)::int best_rank from l group by 1"""


def _hybrid(spark, d):
    return S.hybrid(table(spark, d, "documents"), table(spark, d, "embeddings"), QUERY, _query_vector(spark, d)).withColumn("score", F.round("score", 10))


def _covers(one: str, two: str) -> str:
    """SQL for the cover density of two words: each place of one next to one of the other is a cover, 1 by their distance."""
    return rf"""with w as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') w from documents),
p as (select doc_id, unnest(w) word, generate_subscripts(w, 1) at_place from w where list_contains(w, '{one}') and list_contains(w, '{two}')),
q as (select *, lag(word) over o before, lag(at_place) over o start from p where word in ('{one}', '{two}') window o as (partition by doc_id order by at_place)),
scored as (select doc_id id, sum(case when word <> before then 1.0 / (at_place - start) else 0 end)::double score from q group by 1)"""


def _index(spark, d):
    """Documents as a first batch, and every tenth of them with two more words as a second."""
    path, docs = f"{shared_dir(spark)}/words-{uuid.uuid4().hex}", table(spark, d, "documents").select("doc_id", "text")
    I.write_batch(docs, path, 0)
    I.write_batch(docs.where("doc_id % 10 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" reindexed erly"))), path, 1)
    return path


def _scope(spark, d):
    """Reviews of one store with three stars at most."""
    s = star(spark, d)
    return S.filtered_ids(s["reviews"].join(s["listings"].select("listing_id", "store"), "listing_id"), stores=["app_store"], max_rating=3)


def _filtered_hybrid(spark, d):
    path = _index(spark, d)
    vectors = star(spark, d)["embedded"].withColumnRenamed("review_id", "vec_id")
    return S.hybrid(lambda query, limit, scope: I.lexical(spark, path, query, limit, scope), vectors, QUERY, _query_vector(spark, d), scope=_scope(spark, d), model="m1").withColumn("score", F.round("score", 10))


_INDEXED = "docs as (select doc_id, case when doc_id % 10 = 0 then coalesce(text, '') || ' reindexed erly' else text end as text from documents)"
_IN_SCOPE = "doc_id % 2 = 0 and doc_id % 5 + 1 <= 3"


def _indexed_covers(one: str, two: str) -> str:
    return f"with {_INDEXED}, " + _covers(one, two)[5:].replace("from documents)", f"from docs where {_IN_SCOPE})")


_FILTERED_HYBRID = _indexed_covers(*QUERY.split()) + f""",
v as (select embedding::double[] q from embeddings where vec_id = 0),
l as (select id, row_number() over (order by round(score, 12) desc, id) r from scored qualify r <= 50),
s as (select vec_id id, row_number() over (order by list_cosine_similarity(embedding::double[], q) desc, vec_id) r from embeddings, v
  where vec_id in (select doc_id from documents where {_IN_SCOPE}) qualify r <= 50),
f as (select id, sum(1.0 / (60 + r)) score, min(r)::int best_rank from (from l union all from s) group by 1)
select id, round(score, 10)::double score, best_rank from f order by f.score desc, best_rank, id limit 10"""


_HYBRID = _covers(*QUERY.split()) + """,
v as (select embedding::double[] q from embeddings where vec_id = 0),
l as (select id, row_number() over (order by round(score, 12) desc, id) r from scored qualify r <= 50),
s as (select vec_id id, row_number() over (order by list_cosine_similarity(embedding::double[], q) desc, vec_id) r from embeddings, v qualify r <= 50),
f as (select id, sum(1.0 / (60 + r)) score, min(r)::int best_rank from (from l union all from s) group by 1)
select id, round(score, 10)::double score, best_rank from f order by f.score desc, best_rank, id limit 10"""


def _examples(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.nearest_examples(e.where("id % 20 = 0"), e, 3).withColumn("similarity", F.round("similarity", 5)).select("query_id", "position", "similarity")


def _rankings(spark, d):
    l = table(spark, d, "labels").select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))  # noqa: E741
    r = table(spark, d, "documents").select((F.col("doc_id") % 7).alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    ranked = lambda *o: r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*o))).drop("n_chars")
    return l, ranked(F.desc("n_chars"), "id"), ranked("n_chars", "id")


_NAMES = ("ndcg", "precision", "reciprocal_rank", "judged")


def _metrics(spark, d):
    judged, long, _ = _rankings(spark, d)
    return S.ranking_metrics(long, judged).withColumns({c: F.round(c, 8) for c in _NAMES})


def _modes(spark, d):
    judged, long, short = _rankings(spark, d)
    return S.ranking_metrics(long, judged).withColumn("mode", F.lit("long")).union(S.ranking_metrics(short, judged).withColumn("mode", F.lit("short")))


_RANKED = """with l as (select doc_id % 7 query_id, doc_id id, case when quality = 0 then 0 when toxic = 1 then 1 else 2 end grade from labels),
r as (select 'long' as mode, doc_id % 7 query_id, doc_id id, row_number() over (partition by doc_id % 7 order by n_chars desc, doc_id) r from documents union all
  select 'short', doc_id % 7, doc_id, row_number() over (partition by doc_id % 7 order by n_chars, doc_id) from documents),
g as (select r.mode, r.query_id, r.r, grade from r left join l using (query_id, id) where r <= 10),
i as (select query_id, sum((pow(2, grade) - 1) / log2(p + 1)) ideal from (select *, row_number() over (partition by query_id order by grade desc, id) p from l) where p <= 10 group by 1),
m as (select mode, query_id, sum((pow(2, coalesce(grade, 0)) - 1) / log2(r + 1)) / any_value(ideal) ndcg, count_if(grade > 0) / 10 "precision", coalesce(1 / min(case when grade > 0 then r end), 0) reciprocal_rank, count(grade) / 10 judged
  from g join i using (query_id) group by 1, 2)
"""


def _stats(spark, d):
    rated = table(spark, d, "documents").withColumn("rating", (F.col("doc_id") % 5 + 1).cast("int"))
    return T.topic_stats(rated, "source").withColumns({c: F.round(c, 8) for c in ("average_rating", "negative_share")})


def _scores(spark, d):
    scores = T.term_scores(table(spark, d, "documents"), _STOP, topic="source", support=5)
    return scores.withColumn("score", F.round("score", 9))


_TERMS = r"""with d as (select source topic, list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '  ', 'g'), '(?:^| )([a-z][a-z]+)(?: |$)', 1), lambda w: w not in ('the', 'erly', 'nder')) w from documents),
t as (select topic, unnest(list_distinct(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])))) term from d),
c as (select topic, term, count(*) n from t group by 1, 2 having count(*) >= 5), a as (select topic, sum(n) topic_total from c group by 1), b as (select term, sum(n) term_total from c group by 1)
select c.topic, c.term, n, round(n / topic_total * ln(1 + (select sum(topic_total) from a) / (select count(distinct coalesce(source, '')) from documents) / term_total), 9) score from c join a using (topic) join b using (term)"""


def _stem(w: str) -> str:
    """SQL for the stem of a word, in the operator's three steps."""
    one = f"case when length({w}) > 4 and {w} like '%ies' then left({w}, -3) || 'y' when length({w}) > 2 and {w} like '%s' and not regexp_matches({w}, '(ss|us|is)$') then left({w}, -1) else {w} end"
    return f"regexp_replace(regexp_replace({one}, '^(.{{4,}})(?:ing|ed)$', '\\1'), '^(.{{4,}})e$', '\\1')"


def _greedy(keep: int = 6) -> str:
    """SQL for the diverse keywords: a step for each, the best term whose stems are all new."""
    out = "with c as (" + _TERMS + f"), s as (select topic, term, score, list_transform(string_split(term, ' '), lambda w: {_stem('w')}) stems from c where score > 0), " + """
t0 as (select topic, term, score, stems, []::varchar[] chosen, []::varchar[] covered from s where len(list_distinct(stems)) = len(stems))"""
    for k in range(1, keep + 1):
        out += f""",
b{k} as (select topic, arg_max(term, (score, term)) best, arg_max(stems, (score, term)) own from t{k - 1} where not list_has_any(stems, covered) group by 1),
t{k} as materialized (select topic, term, score, stems, case when best is null then chosen else list_append(chosen, best) end chosen,
  case when best is null then covered else list_concat(covered, own) end covered from t{k - 1} left join b{k} using (topic))"""
    return out + f" select topic, any_value(array_to_string(chosen, ', ')) keywords from t{keep} group by 1"


def _keywords(spark, d):
    scores = T.term_scores(table(spark, d, "documents"), _STOP, topic="source", support=5)
    return T.diverse_keywords(scores).select("topic", F.concat_ws(", ", "keywords").alias("keywords"))


def _closest(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic"), F.round(F.abs(F.get("embedding", 0).cast("double")), 6).alias("distance"))
    return T.closest(rows, 3).select("topic", "id", "place")


PLANS = {
    "cosine_topk": (lambda s, d: _semantic(s, d).select("id", F.round("score", 5).alias("score")), "select vec_id id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 5) score from embeddings order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) desc, vec_id limit 10"),
    "lexical_match": (lambda s, d: _lexical(s, d, f"{QUERY} -thereor").select("id"), r"""select doc_id id from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents) where list_contains(w, 'the') and list_contains(w, 'erly') and not list_contains(w, 'thereor')"""),
    "lexical_score1": (lambda s, d: _lexical(s, d, "erly").select("id", F.round("score", 6).alias("score")), r"""select doc_id id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w = 'erly'))::double score from documents where list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 'erly')"""),
    "lexical_two_words": (lambda s, d: _lexical(s, d, "erly nder", 20).select("id", F.round("score", 6).alias("score")), _covers("erly", "nder") + " select id, round(score, 6) score from scored order by score desc, id limit 20"),
    "rrf_lists": (_fused, _FUSED),
    "hybrid_topk": (_hybrid, _HYBRID),
    "indexed_phrases": (lambda s, d: I.lexical(s, _index(s, d), '"the erly" or reindexed -thereor', None).select("id"), f"with {_INDEXED}," + r""" w as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' t from docs)
        select doc_id id from w where (contains(t, ' the erly ') or contains(t, ' reindexed ')) and not contains(t, ' thereor ')"""),
    "indexed_scores": (lambda s, d: I.lexical(s, _index(s, d), "erly nder", 20, _scope(s, d)).select("id", F.round("score", 6).alias("score")), _indexed_covers("erly", "nder") + " select id, round(score, 6) score from scored order by score desc, id limit 20"),
    "filtered_hybrid": (_filtered_hybrid, _FILTERED_HYBRID),
    "nearest_examples": (_examples, """with p as (select a.vec_id query_id, b.vec_id example_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
        r as (select *, row_number() over (partition by query_id order by s desc, example_id) place from p) select query_id, (4 - place)::int "position", round(s, 5) similarity from r where place <= 3"""),
    "ir_metrics": (_metrics, _RANKED + """select query_id, round(ndcg, 8) ndcg, round("precision", 8) "precision", round(reciprocal_rank, 8) reciprocal_rank, round(judged, 8) judged from m where mode = 'long'"""),
    "mode_report": (lambda s, d: S.mode_report(_modes(s, d)).withColumns({c: F.round(c, 8) for c in _NAMES}), _RANKED + """select mode, round(avg(ndcg), 8) ndcg, round(avg("precision"), 8) "precision", round(avg(reciprocal_rank), 8) reciprocal_rank, round(avg(judged), 8) judged from m group by 1"""),
    "mode_pivot": (lambda s, d: S.by_mode(_modes(s, d), ["long", "short"]).withColumns({c: F.round(c, 8) for c in ("long", "short")}), _RANKED + """select query_id, round(max(case when mode = 'long' then ndcg end), 8) "long", round(max(case when mode = 'short' then ndcg end), 8) "short" from m group by 1"""),
    "pool_modes": (lambda s, d: S.pool_candidates(*_rankings(s, d)[1:]), _RANKED + "select distinct query_id, id from r where r <= 10"),
    "topic_stats": (_stats, "select source, count(*) size, round(avg(doc_id % 5 + 1), 8) average_rating, round(count_if(doc_id % 5 + 1 <= 2) / count(*), 8) negative_share from documents group by 1"),
    "topic_languages": (lambda s, d: T.topic_languages(table(s, d, "documents").withColumnRenamed("lang", "language"), "source"), "select source, coalesce(lang, 'unknown') as language, count(*) reviews from documents group by 1, 2"),
    "ctfidf_scores": (_scores, _TERMS),
    "ctfidf_top": (_keywords, _greedy()),
    "closest_members": (_closest, "select topic, id, place::int place from (select label topic, vec_id id, row_number() over (partition by label order by round(abs(embedding[1]::double), 6), vec_id) place from embeddings) where place <= 3"),
    "kmeans_topics": (lambda s, d: T.kmeans_topics(table(s, d, "embeddings"), k=10), None),
}
