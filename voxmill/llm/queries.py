"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import chat, packing, prefix_trie, ranked_search, token_codes, warc
from voxmill.llm._store import new_path
from voxmill.llm._tokens import VOCABULARY
from voxmill.llm.decontaminate import find_leaks
from voxmill.llm.embeddings import link_vectors
from voxmill.llm.html_extract import extract
from voxmill.llm.jaccard import link_documents
from voxmill.llm.passages import repeated_passages
from voxmill.llm.pii import pseudonymise
from voxmill.llm.quality import score_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pii_key(spark: SparkSession) -> str:
    """The key of surrogates, a setting of the session.  Where it is unset, a fresh one that the session keeps."""
    key = spark.conf.get("voxmill.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("voxmill.pii.key", key)
    return key


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "codes")
    token_codes.write_codes(_table(spark, sf_dir, "documents"), path, vocabulary())
    return token_codes.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.captures(spark, path)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), pii_key(spark))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 9).alias("similarity"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation opens with up to three turns of the one whose id is the multiple of 20 below."""
    conv = F.col("conv_id")
    _, nodes = prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"), base=conv - conv % 20, lead=F.crc32(conv.cast("string")) % 4)
    return nodes.drop("turn_id")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "index")
    ranked_search.build_index(_table(spark, sf_dir, "documents"), path)
    return ranked_search.search(spark, path, _table(spark, sf_dir, "benchmark"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for name, f in sorted(globals().items()) if name.startswith("op")}


def _words(text: str) -> str:
    """SQL for the words of a text; none where there is no text."""
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(words: str) -> str:
    """SQL for the runs of five words; fewer words are one run."""
    runs = f"list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' '))"
    return f"case when len({words}) >= 5 then {runs} when len({words}) > 0 then [array_to_string({words}, ' ')] else [] end"


def _terms(text: str) -> str:
    """SQL for the runs of letters and digits of a text."""
    return rf"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


ORACLE_SQL = {
    "op2_perspective_rotation": """
with t as (select conv_id, turn, coalesce(role, 'unknown') speaker, coalesce(text, '') said from conversations),
people as (select distinct conv_id, speaker perspective from t where speaker <> 'system'),
seen as (select t.*, perspective, case when speaker = 'system' then 'system' when speaker = perspective then 'assistant' else 'user' end as role,
    case when speaker not in ('system', perspective) then speaker end as name
  from t join people on t.conv_id is not distinct from people.conv_id),
written as (select *, '<|' || role || coalesce(' name=' || name, '') || '|>' || chr(10) as head from seen),
whole as (select *, head || said || '<|end|>' || chr(10) as text from written),
placed as (select *, coalesce(sum(length(text)) over (partition by conv_id, perspective order by turn nulls last, speaker, said rows between unbounded preceding and 1 preceding), 0)::bigint as start from whole)
select conv_id, perspective, turn, role, name, text, start, length(text)::bigint as length,
  case when role = 'assistant' then start + length(head) end as loss_start, case when role = 'assistant' then start + length(text) end as loss_end
from placed""",
    "op3_warc_transactions": """
with p as (select page_id, coalesce(html, '') html, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
h as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest, payload_bytes) end holder from p)
select page_id, payload_bytes, payload_digest, case when page_id < holder then 'revisit' else 'response' end as record_type, case when page_id < holder then holder end as refers_to from h""",
    "op5_embedding_near_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id a, b.vec_id b from v a join v b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
parts as (select a, min(b) part from reach group by a),
counts as (select a, count(*) n from links group by a)
select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(part, vec_id)) component_id,
  vec_id = least(vec_id, coalesce(part, vec_id)) kept
from embeddings left join counts on counts.a = vec_id left join parts on parts.a = vec_id""",
    "op8_benchmark_decontamination": f"""
with d as (select doc_id, w, len(w) words, greatest(len(w) - 4, 1) size from (select doc_id, {_words('text')} w from documents) where len(w) > 0),
i as (select item_id, w, len(w) words, greatest(len(w) - 4, 1) size from (select item_id, {_words('text')} w from benchmark) where len(w) > 0),
ds as (select doc_id, unnest(range(size)) pos, unnest({_shingles('w')}) sh from d),
im as (select item_id, sh, count(*) times from (select item_id, unnest({_shingles('w')}) sh from i) group by all),
hits as (select doc_id, item_id, pos from ds join im using (sh)),
pairs as (
  select doc_id, item_id, least(d.words, i.words) words, greatest(least(d.words, i.words) - 4, 1) have, d.size, i.size item_size
  from (select doc_id, item_id, count(*) n from hits group by all) join d using (doc_id) join i using (item_id)
  where i.words >= 5 and 4 * n >= 3 * greatest(least(d.words, i.words) - 4, 1)),
starts as (
  select distinct doc_id, item_id, unnest(range(greatest(0, pos - have + 1), least(pos, size - have) + 1)) start
  from hits join pairs using (doc_id, item_id)),
bags as (
  select doc_id, item_id, start, sh, count(*) n from starts join pairs using (doc_id, item_id) join ds using (doc_id)
  where pos between start and start + have - 1 group by all),
shared as (
  select doc_id, item_id, start, sum(least(n, times)) common from bags join im using (item_id, sh) group by all),
scored as (
  select doc_id, item_id, start, words, common / (have + item_size - common) similarity from shared join pairs using (doc_id, item_id)),
short as (
  select doc_id, item_id, unnest(range(d.words - i.words + 1)) start, i.words, d.w dw, i.w iw from d, i
  where i.words < 5 and d.words >= 5),
found as (
  select doc_id, item_id, start, words, similarity from scored where similarity >= 0.75
  union all select doc_id, item_id, start, words, 1.0 from short where dw[start + 1:start + words] = iw
  union all select doc_id, item_id, 0, d.words, 1.0 from d join i using (w) where d.words < 5)
select doc_id, item_id, arg_max(start, (similarity, -start)) start, arg_max(words, (similarity, -start)) n_words,
  round(max(similarity), 9) similarity
from found group by doc_id, item_id""",
    "op9_ngram_jaccard_join": f"""
with recursive w as (select doc_id, {_words('text')} w from documents),
sets as (select doc_id, list_distinct({_shingles('w')}) s from w),
flat as (select doc_id, unnest(s) sh from sets),
sizes as (select doc_id, len(s) n from sets),
common as (select a.doc_id a, b.doc_id b, count(*) n from flat a join flat b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * common.n >= 75 * (x.n + y.n - common.n)),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
parts as (select a, min(b) part from reach group by a)
select doc_id, n::bigint n_shingles, least(doc_id, coalesce(part, doc_id)) component_id
from sizes left join parts on a = doc_id""",
    "op12_ranked_search": f"""
with d as (select row_number() over () r, doc_id, {_terms('text')} w from documents),
i as (select row_number() over () q, item_id, {_terms('text')} w from benchmark),
corpus as (select count(*)::bigint n_docs, sum(len(w))::bigint n_terms from d where len(w) > 0),
lengths as (select r, doc_id, (75 + (25 * len(w) * n_docs) // n_terms)::bigint m from d, corpus where len(w) > 0),
postings as (select r, t, count(*)::bigint tf from (select r, unnest(w) t from d) group by all),
weights as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint weight from postings, corpus group by t, n_docs),
asked as (select q, item_id, t, count(*)::bigint times from (select q, item_id, unnest(w) t from i) group by all),
scored as (
  select q, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint score
  from asked join weights using (t) join postings using (t) join lengths using (r) group by all)
select item_id, row_number() over (partition by q order by score desc, doc_id, r)::int as rank, doc_id, score
from scored where score > 0 qualify row_number() over (partition by q order by score desc, doc_id, r) <= 20""",
}
