"""Surges of topics over the reviews at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.operators import anomalies as A
from voxmill.sources.views import REVIEWS_SQL, reviews

#: The tables at hand are near uniform: these rules are looser than the operators' own, so that rows exist.
LOOSE = "lift >= 1.1 and n >= 5"

_CELLS = REVIEWS_SQL + """, obs as (select * from reviews where rating <= 3),
daily as (select source, day, count(*) day_reviews, min(day) over (partition by source) a, max(day) over (partition by source) b from obs group by source, day),
days as (select source, day, day_reviews, count(*) over (partition by source) usable, sum(day_reviews) over (partition by source) all_reviews from daily where day > a and day < b),
c as (select o.source, o.topic, o.day, count(*) n, any_value(day_reviews) day_reviews, any_value(all_reviews) all_reviews from obs o join days using (source, day) where usable >= 5 group by 1, 2, 3),
e as (select *, (sum(n) over (partition by source, topic) - n + 0.5) / (all_reviews - day_reviews + 1.0) expected, n / day_reviews share, count(*) over () tests from c),
cells as (select *, share / expected lift, least(0.0, ln(list_sum(list_transform(range(n, day_reviews + 1), lambda i: exp(lgamma(day_reviews + 1.0) - (case when i = 0 then 0 else lgamma(i + 1.0) end) - lgamma(day_reviews - i + 1.0) + i * ln(expected) + (day_reviews - i) * ln(1 - expected)))))) ln_p from e)
"""
_INCIDENTS = _CELLS + f""", alerts as (select * from cells where {LOOSE}),
s as (select *, case when day - lag(day) over (partition by source, topic order by day) <= 2 then 0 else 1 end as new from alerts),
t as (select *, sum(new) over (partition by source, topic order by day)::bigint incident from s),
incidents as (select source, topic, incident, min(day) first_day, max(day) last_day, count(*) alert_days, sum(n)::bigint reviews, min(ln_p) peak_ln_p, arg_min(day, (round(ln_p, 9), -n, day)) peak_day from t group by 1, 2, 3)
"""


def _obs(spark, d):
    return A.observations(reviews(spark, d))


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _cells(spark, d):
    return _rounded(A.spike_cells(_obs(spark, d)), expected=9, share=9, lift=6, ln_p=6)


def _ranked(spark, d):
    obs = _obs(spark, d)
    top = A.with_top_version(A.spike_cells(obs).where(LOOSE), obs)
    return _rounded(top.select("source", "topic", "day", "n", "ln_p", "top_version", "top_share"), ln_p=6, top_share=9)


def _alerts(spark, d):
    return A.spike_cells(_obs(spark, d)).where(LOOSE).withColumn("ln_p", F.round("ln_p", 9))


def _islands(spark, d):
    return _rounded(A.incidents(_alerts(spark, d)), peak_ln_p=6)


def _release(spark, d):
    alerts = _alerts(spark, d)
    out = A.release_attribution(A.incidents(alerts), alerts, _obs(spark, d), prior_share=0.3, release_share=0.3)
    return _rounded(out.select("source", "topic", "incident", "top_version", "top_share", "prior_share", "release"), top_share=9, prior_share=9)


#: The replay's rules, looser than the operator's own.
_REPLAY = {"least_lift": 1.2, "alpha": 0.5}


def _monitor_alerts(spark, d):
    return A.monitor_backtest(_obs(spark, d), **_REPLAY).where("alert").select("source", "topic", "day", "n", F.round("ln_p", 9).alias("ln_p"))


def _match(spark, d):
    found = A.incidents(_monitor_alerts(spark, d))
    return A.match_spikes(A.spike_cells(_obs(spark, d)).where("lift >= 1.05 and n >= 5"), found, _obs(spark, d))


def _members(spark, d):
    alerts = _alerts(spark, d)
    out = A.incident_members(A.incidents(alerts), alerts, _obs(spark, d), F.col("value"))
    return out.where("place <= 5").select("source", "topic", "incident", "place", "review_id")


def _day_by_day() -> str:
    """The causal monitor in SQL, a step for each day of January 2024, as a day's baselines lack the days that alerted."""
    tail = "ln(list_sum(list_transform(range(n, total + 1), lambda i: exp(lgamma(total + 1.0) - (case when i = 0 then 0 else lgamma(i + 1.0) end) - lgamma(total - i + 1.0) + i * ln(x) + (total - i) * ln(1 - x)))))"
    out = REVIEWS_SQL + """, obs as (select * from reviews where rating <= 3),
m as (select source, day, topic, count(*) n from obs group by all),
u as (select source, day, sum(n) total from m group by all),
ends as (select source, min(day) a, max(day) b from u group by 1),
usable as materialized (select source, day, total::bigint total from u join ends using (source) where day > a and day < b),
a0 as (select null::varchar source, null::date as day, null::varchar topic, 0::bigint n, 0::bigint total, 0.0::double expected, 0.0::double lift, 0.0::double ln_p, 0::bigint baseline_days, 0::bigint tests, false alert where false)"""
    for k in range(1, 31):
        day = f"date '2024-01-{k:02d}'"
        out += f""",
p{k} as materialized (select source, count(*) n_days, sum(total) everything from usable where day < {day} and day >= {day} - 28
  and (source, day) not in (select (source, day) from a{k - 1} where alert) group by 1 having count(*) >= 5),
b{k} as (select m.source, m.topic, sum(m.n) seen from m join usable using (source, day) where m.day < {day} and m.day >= {day} - 28
  and (m.source, m.day) not in (select (source, day) from a{k - 1} where alert) group by all),
c{k} as (select m.source, m.day, m.topic, m.n, total, (coalesce(seen, 0) + 0.5) / (everything + 1) x, n_days from m join usable using (source, day) join p{k} using (source)
  left join b{k} on b{k}.source = m.source and b{k}.topic = m.topic where m.day = {day}),
t{k} as (select *, n / total / x lift, least(0.0, {tail}) ln_p, count(*) over () tests from c{k}),
a{k} as materialized (select * from a{k - 1} union all select source, day, topic, n, total, x, lift, ln_p, n_days, tests, n >= 5 and lift >= 1.2 and ln_p <= ln(0.5 / tests) from t{k})"""
    return out


_MONITOR = _day_by_day()
_MATCHED = _MONITOR + """,
s as (select *, case when day - lag(day) over (partition by source, topic order by day) <= 2 then 0 else 1 end as new from a30 where alert),
r as (select *, sum(new) over (partition by source, topic order by day)::bigint incident from s),
incidents as (select source, topic, incident, min(day) first_day, max(day) last_day from r group by 1, 2, 3),
daily as (select source, sum(total) all_reviews, count(*) n_days from usable group by 1),
k as (select m.source, m.topic, m.day, m.n, total, all_reviews, sum(m.n) over (partition by m.source, m.topic) own from m join usable using (source, day) join daily using (source) where n_days >= 5),
spikes as (select source, topic, day from k where n >= 5 and n / total / ((own - n + 0.5) / (all_reviews - total + 1.0)) >= 1.05),
e as (select s.source, s.topic, s.day, count(*) earlier from spikes s join usable u on u.source = s.source and u.day < s.day and u.day >= s.day - 28 group by all)
select s.source, s.topic, s.day, incident, (first_day - s.day)::int delay_days, coalesce(earlier, 0) earlier_days,
  case when incident is not null then 'matched' when coalesce(earlier, 0) < 5 then 'too little coverage' else 'not significant' end as outcome
from spikes s left join incidents i on i.source = s.source and i.topic = s.topic and s.day between first_day and last_day
left join e on e.source = s.source and e.topic = s.topic and e.day = s.day"""


def _samples(spark, d):
    obs = _obs(spark, d)
    return A.member_ids(A.spike_cells(obs).where(LOOSE), obs, F.col("value")).select("source", "topic", "day", F.concat_ws(",", "review_ids").alias("ids"))


def _backtest(spark, d):
    return _rounded(A.monitor_backtest(_obs(spark, d), **_REPLAY), expected=9, lift=6, ln_p=6)


def _summary(spark, d):
    return A.backtest_summary(A.monitor_backtest(_obs(spark, d), **_REPLAY))


PLANS = {
    "spike_cells": (_cells, _CELLS + "select source, topic, day, n, day_reviews, round(expected, 9) expected, round(share, 9) share, round(lift, 6) lift, round(ln_p, 6) ln_p, tests, n >= 5 and lift >= 3 and ln_p <= ln(0.01 / tests) spike from cells"),
    "spike_ranked": (_ranked, _CELLS + f""", v as (select source, topic, day, app_version, count(*) m from obs group by all), w as (select *, row_number() over (partition by source, topic, day order by m desc, app_version nulls last) place from v)
        select source, topic, day, n, round(ln_p, 6) ln_p, app_version top_version, round(m / n, 9) top_share from (select * from cells where {LOOSE}) join w using (source, topic, day) where place = 1"""),
    "spike_samples": (_samples, _CELLS + f""", m as (select source, topic, day, review_id, row_number() over (partition by source, topic, day order by value, review_id) place from obs)
        select source, topic, day, string_agg(review_id, ',' order by place) ids from (select source, topic, day from cells where {LOOSE}) join m using (source, topic, day) where place <= 3 group by 1, 2, 3"""),
    "source_coverage": (lambda s, d: A.source_coverage(_obs(s, d)), REVIEWS_SQL + """select source, min(day) first_day, max(day) last_day, greatest(count(distinct day) - 2, 0) usable_days, greatest(count(distinct day) - 2, 0) >= 5 tested from reviews where rating <= 3 group by 1"""),
    "incident_islands": (_islands, _INCIDENTS + "select * replace (round(peak_ln_p, 6) as peak_ln_p) from incidents"),
    "incident_release": (_release, _INCIDENTS + """, inside as (select i.source, i.topic, i.incident, o.app_version, count(*) m from incidents i join alerts a on a.source = i.source and a.topic = i.topic and a.day between first_day and last_day
          join obs o on o.source = a.source and o.topic = a.topic and o.day = a.day group by all),
        top as (select *, row_number() over (partition by source, topic, incident order by m desc, app_version nulls last) place, sum(m) over (partition by source, topic, incident) whole from inside),
        one as (select * from top where place = 1),
        prior as (select i.source, i.topic, i.incident, count_if(o.app_version is not distinct from one.app_version) / count(*) prior_share from incidents i join one using (source, topic, incident)
          join obs o on o.source = i.source and o.day < i.first_day and o.day >= i.first_day - 7 group by all)
        select source, topic, incident, app_version top_version, round(m / whole, 9) top_share, round(prior_share, 9) prior_share, coalesce(app_version is not null and m / whole >= 0.3 and prior_share <= 0.3, false) "release"
        from one left join prior using (source, topic, incident)"""),
    "spike_incident_match": (_match, _MATCHED),
    "incident_members": (_members, _INCIDENTS + """, m as (select i.source, i.topic, i.incident, review_id, row_number() over (partition by i.source, i.topic, i.incident order by round(a.ln_p, 9), a.day, value, review_id) place
        from incidents i join alerts a on a.source = i.source and a.topic = i.topic and a.day between first_day and last_day join obs o on o.source = a.source and o.topic = a.topic and o.day = a.day)
        select source, topic, incident, place::int place, review_id from m where place <= 5"""),
    "monitor_backtest": (_backtest, _MONITOR + """ select source, topic, day, n, total day_reviews, round(expected, 9) expected, round(lift, 6) lift, round(ln_p, 6) ln_p,
        baseline_days::int baseline_days, tests, alert from a30"""),
    "monitor_summary": (_summary, _MONITOR + " select count(*) tests, count(distinct day) judged_days, count(distinct case when alert then day end) alert_days from a30"),
}
