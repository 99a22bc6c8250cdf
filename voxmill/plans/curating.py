"""Texts and replies: redaction, fingerprints, checks and curation over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.functions import fingerprint as P
from voxmill.functions import language as L
from voxmill.functions import text as X
from voxmill.operators import replies as R
from voxmill.sources.views import table


def pairs(spark, d):
    """Reviews and replies: a user turn and the assistant turn that follows it."""
    c = table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"), F.col("role").alias("next_role"))
    return c.where("role = 'user'").join(nxt.where("next_role = 'assistant'"), ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("review"), "reply")


_PAIRS = "with p as (select u.conv_id, u.turn, u.text review, a.text reply from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and u.role = 'user' and a.role = 'assistant'), "


#: What the checks below are given: every review is in English, and a reply counts as English from its first letter on.
_BRANDS = ["erly", "Other Brand"]


def _checked(spark, d):
    detected = F.when(F.length(R.without_placeholders(F.col("reply"))) % 7 != 0, "en").otherwise("de")
    checks = R.check_reply(F.col("reply"), F.col("review"), F.lit("en"), detected, F.lit("App"), F.lit(None).cast("string"), _BRANDS)
    return pairs(spark, d).withColumns(checks)


def _curated(spark, d):
    rows = R.curate(pairs(spark, d), ["conv_id", "turn"], wanted=F.length("cleaned") % 5 != 0)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("replies"))


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _grams_of(x: str) -> str:
    """SQL for the runs of eight words of a text."""
    words = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - 6, 1)), lambda i: array_to_string({words}[i:i + 7], ' ')))"


_CONTACT = r"(?i)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+|\b(https?://|www\.)\S+"
_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"


def _enough(x: str, least: int) -> str:
    return f"coalesce(({_squeezed(x)} <> '' and len(string_split({_squeezed(x)}, ' ')) >= {least}) or len(regexp_extract_all({x}, '{_CJK}')) >= {3 * least}, false)"


_CHECKED = _PAIRS + rf"""w as (select *, regexp_replace(reply, '\{{[^{{}}]*\}}', '', 'g') bare from p),
g as (select *, {_grams_of('bare')} rg, {_grams_of('review')} vg from w)
select conv_id, turn, {_enough('reply', 3)} non_empty, coalesce(length(bare) % 7 <> 0, false) right_language,
  coalesce(length({_squeezed("replace(replace(reply, '{app_name}', 'App'), '{support_contact}', 'App support')")}) <= 350, false) within_limit,
  coalesce(not regexp_matches(bare, '{_CONTACT}') and not regexp_matches(lower(reply), '(^|[^\p{{L}}\p{{N}}_])(erly|other brand)($|[^\p{{L}}\p{{N}}_])'), false) no_foreign_brand_or_contact,
  coalesce(len(list_filter(regexp_extract_all(reply, '\{{[^{{}}]*\}}'), lambda x: x not in ('{{app_name}}', '{{support_contact}}'))) = 0, false) valid_placeholders,
  not coalesce(list_has_any(rg, vg), false) not_copied, coalesce(regexp_matches(rtrim(reply, chr(32) || chr(9) || chr(10) || chr(13)), '[.!?)"''…。！？」»]$'), false) complete
from g"""
#: Cleaning as far as these replies go: they hold no signature lines, names or closings, which the tests have.
_CLEANED = rf"""c as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(reply, '{_CONTACT}', '{{support_contact}}', 'g'), '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE0F}}\x{{200D}}]', '', 'g'),
  '\s+', ' ', 'g'), '\s+([,.!?:;])', '\1', 'g')) x, length(trim(reply)) >= 340 and regexp_matches(trim(reply), '(\.\.\.|…)$') cut_off from p),
k as (select *, case when not cut_off and {_enough('x', 5)} then upper(left(x, 1)) || substr(x, 2) end cleaned from c)"""
_CURATED = _PAIRS + _CLEANED + rf""",
g as (select *, lower(cleaned) normal, case when cleaned is null then 'unusable' when length(cleaned) > 350 then 'too long' when length(cleaned) % 5 = 0 then 'wrong language' end gate from k),
f as (select normal, min((conv_id, turn)) first from g where gate is null group by 1),
o as (select *, row_number() over (partition by array_to_string(string_split(normal, ' ')[1:6], ' ') order by first) place from f),
r as (select coalesce(gate, case when o.normal is null then 'template opening' when (conv_id, turn) <> o.first then 'duplicate' end, 'kept') reason
  from g left join (select * from o where place <= 5) o on g.normal = o.normal)
select reason, count(*) replies from r group by 1"""


def _benchmark(spark, d):
    p = pairs(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("key"), "review", "reply")
    examples = p.select("key", "review", F.lit("en").alias("language"), F.lit("App").alias("app_name"), F.lit(None).cast("string").alias("contact"), F.col("reply").alias("reference"))
    echo = p.select("key", F.lit("echo").alias("generator"), F.col("review").alias("reply"), F.lit(0.5).alias("seconds"))
    _, summary = R.benchmark(examples, echo, lambda bare: F.when(F.length(bare) % 7 != 0, "en").otherwise("de"), _BRANDS)
    return summary.select("generator", "replies", F.round("pass_rate", 8).alias("pass_rate"), F.round("not_copied_rate", 8).alias("not_copied_rate"), F.round("opening_diversity", 8).alias("opening_diversity"), "seconds_per_reply")


_OPENINGS = f"count(distinct array_to_string(string_split(lower({_squeezed('reply')}), ' ')[1:5], ' '))"
_RATES = ("non_empty", "right_language", "within_limit", "no_foreign_brand_or_contact", "valid_placeholders", "not_copied", "complete")
_PASSED = " and ".join(_RATES)


_ECHOED = _CHECKED.replace("a.text reply", "u.text reply")
_BENCHMARK = f"""with one as ({_CHECKED}), two as ({_ECHOED}),
r as (select 'reference' generator, {_PASSED} passed, not_copied from one union all select 'echo', {_PASSED}, not_copied from two),
o as (with {_PAIRS[5:]} x as (select 1) select 'reference' generator, {_OPENINGS} openings from p
  union all select 'echo', {_OPENINGS.replace('reply', 'review')} from p)
select generator, count(*) replies, round(avg(passed::int), 8) pass_rate, round(avg(not_copied::int), 8) not_copied_rate, round(any_value(openings) / count(*), 8) opening_diversity,
  case when generator = 'echo' then 0.5 else 0.0 end::double seconds_per_reply from r join o using (generator) group by generator"""


def _ngram_copies(spark, d):
    """Documents that share a run of eight words with the benchmark: hashed runs, semi-joined where the texts are read."""
    runs = table(spark, d, "documents").select("doc_id", F.explode(X.ngram_hashes(F.col("text"), 8)).alias("run"))
    known = table(spark, d, "benchmark").select(F.explode(X.ngram_hashes(F.col("text"), 8)).alias("run")).distinct()
    return X.kept_by_few(runs, known, "run").groupBy("doc_id").agg(F.count("*").alias("runs"))


def _grams(name: str, key: str) -> str:
    return rf"select {key}, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' ')))) run from (select {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') w from {name})"


def _split(spark, d):
    rows = table(spark, d, "documents").select(F.concat_ws(":", F.lit("app"), "source", "doc_id").alias("key"), F.when(F.col("doc_id") % 3 == 0, "written").otherwise("published").alias("kind"))
    return rows.select("key", F.round(P.split_position(F.col("key")), 9).alias("position"), P.split_of(F.col("key"), F.col("kind")).alias("split"))


def _languages(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("lang")).alias("candidate"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("hint"), F.when(F.col("doc_id") % 5 == 0, F.lit("en")).alias("market"))
    told = rows.select(L.resolve(F.col("text"), F.col("candidate"), F.col("confidence"), F.col("hint"), F.col("market")).alias("r")).select("r.*")
    return told.groupBy("language", "source").agg(F.count("*").alias("documents"))


def _redact(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("t"))
    count = lambda mark: ((F.length("t") - F.length(F.replace(F.col("t"), F.lit(mark), F.lit("")))) / len(mark)).cast("long")
    return rows.agg(*(F.sum(count(f"[{k}]")).alias(f"{k}s") for k in ("email", "phone", "url")))


def _batches(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("language"))
    return R.length_batches(rows, 16).groupBy("batch").agg(F.count("*").alias("texts"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))


def _pairs_for_training(spark, d):
    rows = pairs(spark, d).select(F.concat_ws(":", "conv_id", "turn").alias("key"), "review", "reply", F.lit("google_play").alias("store"), F.lit(3).alias("rating"), F.lit(None).cast("string").alias("language"), F.when(F.col("conv_id") % 2 == 0, "written").otherwise("published").alias("source"))
    made = R.training_pairs(rows, "Answer politely.")
    return made.select("key", "copy", F.size("prompt").alias("turns"), F.length(F.get("prompt", 1)["content"]).alias("chars"), F.length("completion").alias("reply_chars"))


def _summary(spark, d):
    out = R.summarise(_checked(spark, d).withColumn("generator", F.lit("references")))
    return out.select("generator", "replies", *(F.round(c, 8).alias(c) for c in ("pass_rate", *(f"{x}_rate" for x in R.CHECKS), "opening_diversity")), F.col("median_chars").cast("double").alias("median_chars"))


def _embedded(spark, d):
    made = L.embedded(table(spark, d, "documents").select("doc_id", "text"), L.HashingEmbedder())
    return made.select("doc_id", "model", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


def _completions(spark, d):
    """What a model might answer, asked for a name: the start of each document, some with a label, in quotes or with a dot."""
    k, said = F.col("doc_id"), F.substring(F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("ss")), 1, 45)
    told = F.when(k % 4 == 0, F.concat(F.lit('\n Topic name - "'), said, F.lit('"'))).when(k % 4 == 1, F.concat(F.lit("LABEL: "), said, F.lit("!."))).when(k % 4 == 2, F.concat(F.lit("other: "), said)).otherwise(said)
    return table(spark, d, "documents").select("doc_id", X.clean_topic_name(told).alias("name"))


_NAMES = r"""with c as (select doc_id, left(replace(coalesce(text, ''), 'ß', 'ss'), 45) said from documents),
t as (select doc_id, case doc_id % 4 when 0 then chr(10) || ' Topic name - "' || said || '"' when 1 then 'LABEL: ' || said || '!.' when 2 then 'other: ' || said else said end told from c),
l as (select doc_id, trim(list_filter(regexp_split_to_array(told, '\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]'), lambda x: length(trim(x)) > 0)[1]) line from t),
h as (select *, regexp_split_to_array(line, '[:\-–]')[1] head from l),
b as (select doc_id, case when lower(trim(regexp_replace(head, '\s+', ' ', 'g'))) in ('topic name', 'label', 'name', 'topic', 'title') and length(head) < length(line) then ltrim(substr(line, length(head) + 2)) else line end bare from h),
w as (select doc_id, trim(rtrim(trim(trim(trim(bare), '"''`*#“”‘’')), '.!')) x from b)
select doc_id, case when len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) between 2 and 7 and length(x) <= 60 and not regexp_matches(x, '[\[\]{}<>]')
  and len(list_filter(regexp_extract_all(x, '\p{L}'), lambda c: unicode(c) > 591)) = 0 then upper(left(x, 1)) || substr(x, 2) end as name from w"""


PLANS = {
    "has_words": (lambda s, d: table(s, d, "documents").groupBy(X.has_words(F.col("text")).alias("has_words")).agg(F.count("*").alias("documents")), r"select coalesce(regexp_matches(text, '[\p{L}\p{N}]'), false) has_words, count(*) documents from documents group by 1"),
    "compose_text": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(X.compose(F.col("source"), F.col("text"))).alias("digest")), r"""select doc_id, md5(concat_ws(chr(10), case when regexp_matches(source, '[\p{L}\p{N}]') then trim(regexp_replace(source, '\s+', ' ', 'g')) end, case when regexp_matches(text, '[\p{L}\p{N}]') then trim(regexp_replace(text, '\s+', ' ', 'g')) end)) digest from documents"""),
    "enough_words": (lambda s, d: table(s, d, "documents").groupBy(X.enough_words(F.col("text"), 50).alias("enough")).agg(F.count("*").alias("documents")), r"""select coalesce(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) >= 50, false) enough, count(*) documents from documents group by 1"""),
    "redact_counts": (_redact, r"""with a as (select regexp_replace(text, '(?i)\b(https?://|www\.)\S+', '[url]', 'g') t from documents),
        b as (select regexp_replace(t, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(\.[\p{L}\p{N}_-]+)+', '[email]', 'g') t from a),
        c as (select t, len(list_filter(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])(\+?[0-9][0-9\s().-]{7,}[0-9])(?:$|[^\p{L}\p{N}_])', 1), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 9)) phones from b)
        select sum((length(t) - length(replace(t, '[email]', ''))) // 7)::bigint emails, sum(phones)::bigint phones, sum((length(t) - length(replace(t, '[url]', ''))) // 5)::bigint urls from c"""),
    "content_hash": (lambda s, d: table(s, d, "documents").select("doc_id", P.content_hash((F.col("doc_id") % 5 + 1).cast("int"), F.col("source"), F.coalesce("text", F.lit("")), F.lit(None).cast("string")).alias("hash")), "select doc_id, sha256((doc_id % 5 + 1) || chr(31) || coalesce(source, '') || chr(31) || coalesce(text, '') || chr(31)) hash from documents"),
    "hash_split": (_split, """with k as (select 'app:' || source || ':' || doc_id as key, doc_id % 3 = 0 written from documents), h as (select *, ('0x' || left(sha256(key), 16))::ubigint / 18446744073709551616.0 x from k)
        select key, round(x, 9) "position", case when x < case when written then 0.35 else 0.1 end then 'eval' else 'train' end split from h"""),
    "resolve_language": (_languages, """with r as (select text, case when doc_id % 4 <> 0 then lang end c, (doc_id % 10) / 10.0 p, case when doc_id % 3 = 0 then lang end h, case when doc_id % 5 = 0 then 'en' end m from documents),
        s as (select *, coalesce(length(text) >= 20 and c is not null and (p >= 0.9 or (p >= 0.5 and (c is not distinct from h or c is not distinct from m))), false) sure from r)
        select case when sure then c else coalesce(h, m) end as language, case when sure then 'detected' when h is not null then 'store_hint' when m is not null then 'market_default' else 'unknown' end as source, count(*) documents from s group by 1, 2"""),
    "reply_checks": (lambda s, d: _checked(s, d).select("conv_id", "turn", *R.CHECKS), _CHECKED),
    "reply_summary": (_summary, "with q as (" + _CHECKED + "), " + _PAIRS[5:] + f"""o as (select {_OPENINGS} / count(*) opening_diversity, median(length(reply)) median_chars from p)
        select 'references' generator, count(*) replies, round(avg(({_PASSED})::int), 8) pass_rate, {', '.join(f'round(avg({c}::int), 8) {c}_rate' for c in _RATES)},
        round(any_value(opening_diversity), 8) opening_diversity, any_value(median_chars)::double median_chars from q cross join o"""),
    "reply_benchmark": (_benchmark, _BENCHMARK),
    "curation_reasons": (_curated, _CURATED),
    "ngram_copy": (_ngram_copies, f"with a as ({_grams('documents', 'doc_id')}), b as (select distinct run from ({_grams('benchmark', 'item_id')})) select doc_id, count(*) runs from a where run in (select run from b) group by 1"),
    "length_batches": (_batches, """with b as (select length(coalesce(text, '')) n, (row_number() over (order by length(coalesce(text, '')) desc, doc_id) - 1) // 16 batch from documents)
        select batch, count(*) texts, min(n)::int shortest, max(n)::int longest from b group by 1"""),
    "training_pairs": (_pairs_for_training, _PAIRS + """c as (select *, unnest(range(1, case when conv_id % 2 = 0 then 4 else 2 end)) as copy from p)
        select conv_id || ':' || turn as key, copy::int as copy, 2::int turns, length('Store: Google Play' || chr(10) || 'Rating: 3/5' || chr(10) || 'Language: unknown' || chr(10) || chr(10) || 'Review:' || chr(10)
        || case when length(review) <= 1500 then review else rtrim(left(review, 1499)) || '…' end || chr(10) || chr(10) || 'Write the developer reply.')::int chars, length(reply)::int reply_chars from c"""),
    "topic_names": (_completions, _NAMES),
    "clean_replies": (lambda s, d: pairs(s, d).select("conv_id", "turn", R.clean_reply(F.col("reply")).alias("cleaned")), _PAIRS + _CLEANED + " select conv_id, turn, cleaned from k"),
    "embed_documents": (_embedded, None),
}
