"""Queries on histories, eras, representations, audits and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from eraloom.catalog.shared import (
    BACKFILL, BACKFILL_LONG, BASE, CONTEXT, EV, HIST, LISTED, NO_BACKFILL, NO_BACKFILL_LONG, RAW, RAW_LONG,
    STRUCTURE_NULL, WINDOW, base_events, era_sql, events, last_n_sql, once, r, rounded, timeline,
)
from eraloom.functions.ordered import asof_backward
from eraloom.functions.scalar import count_bin, fractional_days, structural_pattern, whole_days, whole_hours
from eraloom.operators import audit, eras, history, persistence, sequences
from eraloom.plans.dataset import build_examples, represent, represent_audited, represent_packed
from eraloom.session import materialize
from eraloom.sources import adapters

CATALOG: dict = {}


def add(name: str, sql: str | None = None):
    def keep(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return keep


def hist(spark, d):
    return once(spark, d, "history", lambda: materialize(
        history.episode_history(adapters.episode_labels(spark, d), base_events(spark, d))
    ))


def spread_hist(spark, d):
    """The same for queries that go on by episode: nothing is written, and pairs stay where the join makes them."""
    marked = timeline(spark, d).ranked.drop("event_rank", "plain_rank")
    return history.spread_history(adapters.episode_labels(spark, d), marked)


def own_hist(spark, d):
    """The same for queries that read it once: only the columns that they need are made, and nothing is written."""
    return history.episode_history(adapters.episode_labels(spark, d), base_events(spark, d))


def packed_of(spark, d, spec):
    return once(spark, d, spec.name, lambda: materialize(represent_packed(timeline(spark, d), spec)))


def audited_of(spark, d, spec):
    return once(spark, d, f"audited {spec.name}", lambda: materialize(represent_audited(timeline(spark, d), spec)))


def long_of(spark, d, spec):
    return eras.unpack(packed_of(spark, d, spec))


def vocab_of(spark, d, spec):
    return once(spark, d, f"vocab {spec.name}", lambda: materialize(sequences.build_vocab(long_of(spark, d, spec))))


def examples_of(spark, d, spec):
    def make():
        return build_examples(timeline(spark, d), spec, packed=audited_of(spark, d, spec))

    return once(spark, d, f"examples {spec.name}", make)


# Order-sensitive fingerprint of a long table, one row per episode.
def fingerprint(long):
    pos = F.col("event_position")
    return long.groupBy("row_id").agg(
        F.count("*").alias("n"), F.sum(pos * F.col("order_anchor_id") % 1000003).cast("long").alias("order_sum"),
        F.sum(pos * F.length("code")).alias("code_sum"), F.sum(pos * F.col("role_order")).cast("long").alias("role_sum"),
        r(F.sum("days_before_prediction")).alias("days_sum"), r(F.sum("numeric_value")).alias("value_sum"),
        F.count("text_value").alias("n_text"), F.count_if("is_compression_token").alias("n_state"),
        F.max("code").alias("max_code"), F.min("time").alias("first_time"), F.max("time").alias("last_time"),
    )


FINGERPRINT = """
select row_id, count(*) as n, sum(pos * anchor % 1000003)::bigint as order_sum, sum(pos * length(code))::bigint as code_sum,
    sum(pos * role)::bigint as role_sum, round(sum(days_before_prediction), 6) as days_sum, round(sum(cast(numeric_value as double)), 6) as value_sum,
    count(text_value) as n_text, count(*) filter (where state) as n_state, max(code) as max_code, min(time) as first_time, max(time) as last_time
from {t} group by row_id
"""


@add("flagship_era_counts", "with " + HIST + era_sql("history") + """
select row_id, count(*) as n_eras, sum(cast(n_points > 1 as int))::bigint as n_compressed, max(n_points) as most_points,
    sum(n_mentions)::bigint as n_mentions, max(span)::bigint as longest_span from summary group by row_id""")
def flagship(spark, d):
    """Per-episode era counts: as-of buckets, point-in-time history, eras."""
    points = eras.first_mentions(history.mark_codes(hist(spark, d), adapters.code_list(spark)).filter("is_compressible"), ["row_id"])
    s = eras.era_summary(eras.era_days(points, ["row_id"], 90), ["row_id"])
    return s.groupBy("row_id").agg(
        F.count("*").alias("n_eras"), F.count_if(F.col("n_points") > 1).alias("n_compressed"),
        F.max("n_points").cast("long").alias("most_points"), F.sum("n_mentions").alias("n_mentions"),
        F.max("span_days").cast("long").alias("longest_span"),
    )


@add("src2_canonical_events", "with " + EV + """
select omop_table, count(*) as n, count(numeric_value) as n_numeric, count(text_value) as n_text, count(distinct source_event_id) as n_ids,
    round(sum(cast(numeric_value as double)), 4) as value_sum, sum(source_event_id % 1000003)::bigint as id_sum from ev group by omop_table""")
def canonical(spark, d):
    e = history.canonical_events(adapters.clinical_events(spark, d))
    return e.groupBy("omop_table").agg(
        F.count("*").alias("n"), F.count("numeric_value").alias("n_numeric"), F.count("text_value").alias("n_text"),
        F.countDistinct("source_event_id").alias("n_ids"), r(F.sum(F.col("numeric_value").cast("double")), 4).alias("value_sum"),
        F.sum(F.col("source_event_id") % 1000003).alias("id_sum"),
    )


@add("flt1_flt3_condition_rows", "with " + EV + """
select code, count(*) as n, count(distinct subject_id) as n_subjects from ev
where omop_table = 'condition_occurrence' and time is not null and code is not null group by code""")
def condition_rows(spark, d):
    e = adapters.clinical_events(spark, d).filter(F.col("omop_table") == "condition_occurrence").dropna(subset=["time", "code"])
    return e.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("n_subjects"))


@add("flt2_prefix_filter", "with " + BASE + """
select starts_with(compression_bucket, 'reconstructed_visit=')::int::bigint as in_visit, count(*) as n from base where starts_with(code, 'DX/') group by 1""")
def prefix(spark, d):
    b = base_events(spark, d).filter(F.col("code").startswith("DX/"))
    return b.groupBy(F.col("compression_bucket").startswith("reconstructed_visit=").cast("long").alias("in_visit")).agg(F.count("*").alias("n"))


@add("flt4_mark_codes", "with " + EV + f"""
select code in {LISTED} as listed, count(*) as n, count(distinct code) as n_codes from ev group by 1""".replace("select code in", "select (code in").replace(" as listed", ")::int::bigint as listed"))
def marked(spark, d):
    m = history.mark_codes(adapters.clinical_events(spark, d), adapters.code_list(spark), "listed")
    return m.groupBy(F.col("listed").cast("long").alias("listed")).agg(F.count("*").alias("n"), F.countDistinct("code").alias("n_codes"))


@add("flt5_strict_cutoff", "with " + BASE + """
select l.row_id, count(*) as n, max(b.time) as last_time from labels l join base b on l.subject_id = b.subject_id and b.time < l.prediction_time group by 1""")
def strict(spark, d):
    # Buckets are not read, so the events need no timeline.
    e = history.canonical_events(adapters.clinical_events(spark, d)).withColumn("compression_bucket", F.lit(None).cast("string"))
    h = history.episode_history(adapters.episode_labels(spark, d), e, inclusive=False)
    return h.groupBy("row_id").agg(F.count("*").alias("n"), F.max("time").alias("last_time"))


@add("flt6_split_filter", "with " + EV + " select split, count(*) as n, sum(label)::bigint as n_positive from labels where split = 'held_out' group by split")
def split_filter(spark, d):
    rows = adapters.episode_labels(spark, d).filter(F.col("split") == "held_out")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"))


@add("jn1_restrict_to_cohort", "with " + EV + """
select count(*) as n, count(distinct subject_id) as n_subjects, max(time) as last_time from ev where omop_table = 'condition_occurrence'
and subject_id in (select subject_id from splits where split = 'train')""")
def cohort(spark, d):
    e = persistence.condition_events(adapters.clinical_events(spark, d), adapters.subject_splits(spark, d))
    return e.agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("n_subjects"), F.max("time").alias("last_time"))


@add("jn3_asof_backward", """
with v as (select distinct user_id, ts as visit_time from events where event_type = 'view')
select e.event_id, v.visit_time from events e asof left join v on e.user_id = v.user_id and e.ts >= v.visit_time""")
def asof(spark, d):
    e = adapters.stream_events(spark, d)
    v = e.filter(F.col("code") == "Visit/view").select("subject_id", F.col("time").alias("visit_time")).distinct()
    m = asof_backward(e.select("subject_id", "time", "source_event_id"), v, "subject_id", "time", "visit_time", [])
    return m.select(F.col("source_event_id").alias("event_id"), "visit_time")


@add("jn4_history_pairs", "with " + HIST + " select subject_id, count(*) as n_pairs, count(distinct row_id) as n_episodes from history group by subject_id")
def pairs(spark, d):
    return own_hist(spark, d).groupBy("subject_id").agg(F.count("*").alias("n_pairs"), F.countDistinct("row_id").alias("n_episodes"))


@add("ag1_event_scope", "with " + EV + """
select count(*) as n_events, count(distinct subject_id) as n_subjects, count(distinct code) as n_codes, min(time) as first_time, max(time) as last_time
from ev where omop_table = 'condition_occurrence'""")
def scope(spark, d):
    return persistence.event_scope(adapters.clinical_events(spark, d).filter(F.col("omop_table") == "condition_occurrence"))


RECUR = EV + """,
cond as (select * from ev where omop_table = 'condition_occurrence' and subject_id in (select subject_id from splits where split = 'train')),
rec as (select *, (days >= 2 and span >= 90)::int as p90, (days >= 2 and span >= 180)::int as p180, (days >= 2 and span >= 365)::int as p365 from (
    select subject_id, code, count(*) as n, count(distinct cast(time as date)) as days, min(time) as t0, max(time) as t1,
        cast(date_sub('day', min(time), max(time)) as double) as span from cond group by subject_id, code))
"""


@add("ag2_code_recurrence", "with " + RECUR + """
select subject_id, code, n as n_events_for_code, days as n_days_with_code, t0 as first_code_time, t1 as last_code_time, span as code_span_days,
    n - 1 as n_duplicate_events_for_code, days - 1 as n_duplicate_days_for_code, (days >= 2)::int::bigint as is_repeated_across_days,
    p90::bigint as is_persistent_90d, p180::bigint as is_persistent_180d, p365::bigint as is_persistent_365d from rec""")
def recurrence(spark, d):
    e = persistence.condition_events(adapters.clinical_events(spark, d), adapters.subject_splits(spark, d))
    return rounded(persistence.code_recurrence(e))


STATS = RECUR + """,
q as (select code, measure, value, sum(w) over (partition by code, measure order by value) as hi, w, sum(w) over (partition by code, measure) as n from (
    select code, measure, value, count(*) as w from (
        select code, 'events' as measure, cast(n as double) as value from rec union all select code, 'days', cast(days as double) from rec
        union all select code, 'span', span from rec) group by code, measure, value)),
qq as (select code,
    (max(value) filter (where measure = 'events' and hi - w <= floor((n - 1) / 2.0) and floor((n - 1) / 2.0) < hi) + max(value) filter (where measure = 'events' and hi - w <= ceil((n - 1) / 2.0) and ceil((n - 1) / 2.0) < hi)) / 2 as median_events_per_subject,
    max(value) filter (where measure = 'events' and hi - w <= floor((n - 1) * 0.9::double + 0.5) and floor((n - 1) * 0.9::double + 0.5) < hi) as p90_events_per_subject,
    (max(value) filter (where measure = 'days' and hi - w <= floor((n - 1) / 2.0) and floor((n - 1) / 2.0) < hi) + max(value) filter (where measure = 'days' and hi - w <= ceil((n - 1) / 2.0) and ceil((n - 1) / 2.0) < hi)) / 2 as median_days_with_code,
    max(value) filter (where measure = 'days' and hi - w <= floor((n - 1) * 0.9::double + 0.5) and floor((n - 1) * 0.9::double + 0.5) < hi) as p90_days_with_code,
    (max(value) filter (where measure = 'span' and hi - w <= floor((n - 1) / 2.0) and floor((n - 1) / 2.0) < hi) + max(value) filter (where measure = 'span' and hi - w <= ceil((n - 1) / 2.0) and ceil((n - 1) / 2.0) < hi)) / 2 as median_span_days,
    max(value) filter (where measure = 'span' and hi - w <= floor((n - 1) * 0.75::double + 0.5) and floor((n - 1) * 0.75::double + 0.5) < hi) as p75_span_days,
    max(value) filter (where measure = 'span' and hi - w <= floor((n - 1) * 0.9::double + 0.5) and floor((n - 1) * 0.9::double + 0.5) < hi) as p90_span_days
    from q group by code),
stats as (select r.*, qq.* exclude (code), n_subjects_with_code / (select count(distinct subject_id) from rec)::double as subject_prevalence,
    n_duplicate_events_over_first / n_events::double as duplicate_event_share from (
    select code, count(*) as n_subjects_with_code, sum(n)::bigint as n_events, sum(n - 1)::bigint as n_duplicate_events_over_first, sum(days - 1)::bigint as n_duplicate_days_over_first,
        avg((days >= 2)::int) as repeat_day_subject_share, avg(p90) as persistent_90d_subject_share, avg(p180) as persistent_180d_subject_share, avg(p365) as persistent_365d_subject_share
    from rec group by code) r join qq on r.code = qq.code)
"""
STAT_DOUBLES = [
    "median_events_per_subject", "p90_events_per_subject", "median_days_with_code", "p90_days_with_code", "median_span_days",
    "p75_span_days", "p90_span_days", "repeat_day_subject_share", "persistent_90d_subject_share", "persistent_180d_subject_share",
    "persistent_365d_subject_share", "subject_prevalence", "duplicate_event_share",
]
STAT_SELECT = "code, n_subjects_with_code, n_events, n_duplicate_events_over_first, n_duplicate_days_over_first, " + ", ".join(
    f"round({c}, 6) as {c}" for c in STAT_DOUBLES
)


@add("ag3_code_stats", "with " + STATS + f" select {STAT_SELECT} from stats")
def stats(spark, d):
    e = persistence.condition_events(adapters.clinical_events(spark, d), adapters.subject_splits(spark, d))
    return rounded(persistence.code_stats(persistence.code_recurrence(e)))


@add("pip1_persistent_codes", "with " + STATS + f""", scored as (select *, 0.2::double * repeat_day_subject_share + 0.2::double * persistent_90d_subject_share + 0.25::double * persistent_180d_subject_share
    + 0.25::double * persistent_365d_subject_share + 0.1::double * (p90_span_days / (p90_span_days + 365)) as score from stats)
select {STAT_SELECT}, round(score, 6) as empirical_persistence_score, (n_subjects_with_code >= 50 and repeat_day_subject_share >= 0.5
    and (persistent_365d_subject_share >= 0.1 or p75_span_days >= 365))::int::bigint as strong_chronic_like from scored""")
def persistent(spark, d):
    return rounded(persistence.persistent_codes(adapters.clinical_events(spark, d), adapters.subject_splits(spark, d)))


@add("srt1_mixed_order", "with " + STATS + """
select code, n_events, row_number() over (order by repeat_day_subject_share desc, n_events desc, code asc) as place from stats""")
def mixed_order(spark, d):
    from eraloom.functions.ordered import global_row_number

    e = persistence.condition_events(adapters.clinical_events(spark, d), adapters.subject_splits(spark, d))
    s = persistence.code_stats(persistence.code_recurrence(e)).select("code", "n_events", "repeat_day_subject_share")
    return global_row_number(s, [F.desc("repeat_day_subject_share"), F.desc("n_events"), F.asc("code")], "place").select("code", "n_events", "place")


@add("src6_code_descriptions", "with " + RECUR + """, names as (select 'DX/' || p_type as code, min(p_name) as nm from part where p_type <> 'SMALL' group by 1)
select r.code, count(*) as n_subjects, coalesce(any_value(nm), r.code) as diagnosis_name from rec r left join names n on r.code = n.code group by r.code""")
def descriptions(spark, d):
    e = persistence.condition_events(adapters.clinical_events(spark, d), adapters.subject_splits(spark, d))
    per_code = persistence.code_recurrence(e).groupBy("code").agg(F.count("*").alias("n_subjects"))
    names = adapters.table(spark, d, "part").filter("p_type <> 'SMALL'").select(
        F.concat(F.lit("DX/"), "p_type").alias("code"), F.col("p_name").alias("description")
    )
    return persistence.add_code_descriptions(per_code, names)


@add("pip2_win1_visit_anchors", "with " + BASE + " select subject_id, visit_time, visit_index::bigint as visit_index from anchors")
def anchors(spark, d):
    return history.visit_anchors(adapters.clinical_events(spark, d)).withColumn("visit_index", F.col("visit_index").cast("long"))


@add("pip3_bucket_events", "with " + BASE + """
select subject_id, compression_bucket, count(*) as n, min(time) as first_time, count(distinct code) as n_codes, sum(source_event_id % 1000003)::bigint as id_sum
from base group by subject_id, compression_bucket""")
def buckets(spark, d):
    e = history.canonical_events(events(spark, d))
    b = history.bucket_events(e, history.visit_anchors(e))
    return b.groupBy("subject_id", "compression_bucket").agg(
        F.count("*").alias("n"), F.min("time").alias("first_time"), F.countDistinct("code").alias("n_codes"),
        F.sum(F.col("source_event_id") % 1000003).alias("id_sum"),
    )


@add("pip3_timeline_ranks", "with " + BASE + f""", rk as (select *, row_number() over (partition by subject_id order by time, source_event_id, code) as er,
    count(*) filter (where code not in {LISTED}) over (partition by subject_id order by time, source_event_id, code rows unbounded preceding) as pr from base)
select subject_id, compression_bucket, max(er) as last_rank, sum(er)::bigint as rank_sum, sum(pr)::bigint as plain_sum from rk group by 1, 2""")
def timeline_ranks(spark, d):
    t = history.timeline_events(history.canonical_events(events(spark, d)), adapters.code_list(spark))
    return t.groupBy("subject_id", "compression_bucket").agg(
        F.max("event_rank").alias("last_rank"), F.sum("event_rank").alias("rank_sum"), F.sum("plain_rank").alias("plain_sum")
    )


@add("win1_ranked_events", "with " + BASE + f""", rk as (select *, row_number() over (partition by subject_id order by time, source_event_id, code) as er,
    count(*) filter (where code not in {LISTED}) over (partition by subject_id order by time, source_event_id, code rows unbounded preceding) as pr from base)
select subject_id, max(er) as n_events, max(pr) as n_plain, sum(er * (source_event_id % 1000))::bigint as order_sum from rk group by 1""")
def ranked(spark, d):
    t = history.ranked_events(base_events(spark, d), adapters.code_list(spark))
    return t.groupBy("subject_id").agg(
        F.max("event_rank").alias("n_events"), F.max("plain_rank").alias("n_plain"), F.sum(F.col("event_rank") * (F.col("source_event_id") % 1000)).alias("order_sum")
    )


@add("pip3_bucket_stream_events", """
with ev as (select user_id as subject_id, ts as time, event_id, event_type from events),
anchors as (select subject_id, visit_time, row_number() over (partition by subject_id order by visit_time) - 1 as visit_index
    from (select distinct subject_id, time as visit_time from ev where event_type = 'view'))
select event_id, case when date_sub('hour', a.visit_time, e.time) / 24.0 <= 1 then 'reconstructed_visit=' || a.visit_index
    else 'day=' || strftime(e.time, '%Y-%m-%d') end as compression_bucket
from ev e asof left join anchors a on e.subject_id = a.subject_id and e.time >= a.visit_time""")
def stream_buckets(spark, d):
    e = history.canonical_events(adapters.stream_events(spark, d))
    return history.bucket_events(e, history.visit_anchors(e)).select(F.col("source_event_id").alias("event_id"), "compression_bucket")


@add("pip4_episode_history", "with " + HIST + """
select row_id, subject_id, label::bigint as label, split, count(*) as n, sum(days_before_prediction) as days_sum, min(time) as first_time, max(time) as last_time,
    sum(source_event_id % 1000003)::bigint as id_sum, count(distinct compression_bucket) as n_buckets from history group by all""")
def full_history(spark, d):
    return spread_hist(spark, d).groupBy("row_id", "subject_id", F.col("label").cast("long").alias("label"), "split", "part").agg(
        F.count("*").alias("n"), F.sum(F.col("days_before_prediction").cast("double")).alias("days_sum"), F.min("time").alias("first_time"),
        F.max("time").alias("last_time"), F.sum(F.col("source_event_id") % 1000003).alias("id_sum"),
        F.countDistinct("compression_bucket").alias("n_buckets"),
    ).drop("part")


@add("pip5_win2_raw_long", "with " + RAW_LONG + FINGERPRINT.format(t="raw_long"))
def raw_long(spark, d):
    return fingerprint(represent(timeline(spark, d), RAW))


@add("win2_last_n_by_history", "with " + WINDOW + " select row_id, count(*) as n, min(time) as first_time, sum(source_event_id % 1000003)::bigint as id_sum from win group by row_id")
def last_n(spark, d):
    w = history.last_n(own_hist(spark, d), CONTEXT, history.RAW_ORDER)
    return w.groupBy("row_id").agg(F.count("*").alias("n"), F.min("time").alias("first_time"), F.sum(F.col("source_event_id") % 1000003).alias("id_sum"))


@add("pip6_ag7_bucket_dedup", "with " + HIST + era_sql("history") + """
select row_id, code, count(*) as n_points, sum(n)::bigint as n_mentions, min(time) as first_time, sum(source_event_id % 1000003)::bigint as id_sum from points group by row_id, code""")
def dedup(spark, d):
    m = history.mark_codes(own_hist(spark, d), adapters.code_list(spark)).filter("is_compressible")
    p = eras.first_mentions(m, ["row_id"])
    return p.groupBy("row_id", "code").agg(
        F.count("*").alias("n_points"), F.sum("n_mentions").alias("n_mentions"), F.min("time").alias("first_time"),
        F.sum(F.col("source_event_id") % 1000003).alias("id_sum"),
    )


@add("win5_win6_era_index", "with " + HIST + era_sql("history") + """
select row_id, code, era::bigint as era, count(*) as n_points, min(time) as first_time, max(time) as last_time from eras group by row_id, code, era""")
def era_index(spark, d):
    m = history.mark_codes(hist(spark, d), adapters.code_list(spark)).filter("is_compressible")
    e = eras.era_index(eras.first_mentions(m, ["row_id"]), ["row_id"], 90)
    return e.groupBy("row_id", "code", F.col("era").cast("long").alias("era")).agg(
        F.count("*").alias("n_points"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


@add("ag8_era_summary", "with " + HIST + era_sql("history") + """
select row_id, code, era::bigint as era, n_points, n_mentions, n_mentions - n_points as n_visit_day_duplicates_removed, n_mentions - 1 as n_repeats_removed,
    n_points - 1 as n_era_repeat_mentions_removed, cast(span as double) as span_days, t0 as first_time, t1 as last_time, a0 as first_anchor, a1 as last_anchor from summary""")
def era_table(spark, d):
    m = history.mark_codes(own_hist(spark, d), adapters.code_list(spark)).filter("is_compressible")
    s = eras.era_summary(eras.era_days(eras.first_mentions(m, ["row_id"]), ["row_id"], 90), ["row_id"])
    return rounded(s.select(
        *[c for c in s.columns if c not in ("first", "last")], F.col("first.time").alias("first_time"), F.col("last.time").alias("last_time"),
        F.col("first.source_event_id").alias("first_anchor"), F.col("last.source_event_id").alias("last_anchor"),
    ))


@add("pip7_condition_era_90", "with " + HIST + era_sql("history") + """
select row_id, count(*) as n, count(*) filter (where state) as n_state, sum(role)::bigint as role_sum, sum(length(code))::bigint as code_sum,
    sum(anchor % 1000003)::bigint as anchor_sum, round(sum(cast(numeric_value as double)), 6) as value_sum, round(sum(days_before_prediction), 6) as days_sum,
    sum(a_persist)::bigint as audit_persistent_events, sum(a_rep)::bigint as audit_repeats_removed, sum(a_eras)::bigint as audit_condition_eras from tokens group by row_id""")
def condition_era(spark, d):
    t = eras.condition_era(spread_hist(spark, d), adapters.code_list(spark), 90, history.SPREAD_KEY)
    return t.groupBy("row_id").agg(
        F.count("*").alias("n"), F.count_if("is_compression_token").alias("n_state"), F.sum("role_order").alias("role_sum"),
        F.sum(F.length("code")).alias("code_sum"), F.sum(F.col("order_anchor_id") % 1000003).alias("anchor_sum"),
        r(F.sum("numeric_value")).alias("value_sum"), r(F.sum("days_before_prediction")).alias("days_sum"),
        F.sum("audit_persistent_events").alias("audit_persistent_events"), F.sum("audit_repeats_removed").alias("audit_repeats_removed"),
        F.sum("audit_condition_eras").alias("audit_condition_eras"),
    )


def gap_query(gap: int):
    def run(spark, d):
        t = eras.condition_era(spread_hist(spark, d), adapters.code_list(spark), gap, history.SPREAD_KEY)
        return t.groupBy("code").agg(F.count("*").alias("n"), r(F.sum("numeric_value")).alias("value_sum"))

    return run


for _gap in (30, 180):
    CATALOG[f"pip7_condition_era_{_gap}"] = (gap_query(_gap), "with " + HIST + era_sql("history", gap=_gap) +
                                             " select code, count(*) as n, round(sum(cast(numeric_value as double)), 6) as value_sum from tokens group by code")


@add("pip8_win3_backfill_long", "with " + BACKFILL_LONG + FINGERPRINT.format(t="long"))
def backfill(spark, d):
    return fingerprint(represent(timeline(spark, d), BACKFILL))


@add("pip8_no_backfill_long", "with " + NO_BACKFILL_LONG + FINGERPRINT.format(t="long_nb"))
def no_backfill(spark, d):
    return fingerprint(represent(timeline(spark, d), NO_BACKFILL))


@add("pip9_structure_null", "with " + BACKFILL_LONG + """,
nul as (select * replace (regexp_replace(code, '^DX_ERA90_(START/|END/|COUNT_BIN/[^/]+/)', '') as code, case when state then null else numeric_value end as numeric_value,
    case when state then null else text_value end as text_value, false as state) from long)""" + FINGERPRINT.format(t="nul"))
def null_control(spark, d):
    return fingerprint(eras.structure_null(long_of(spark, d, BACKFILL), 90))


@add("win3_win4_positions", "with " + HIST + era_sql("history") + last_n_sql("tokens", "long") + " select row_id, max(pos) as n, sum(pos * role)::bigint as role_sum from long group by row_id")
def positions(spark, d):
    t = eras.condition_era(spread_hist(spark, d), adapters.code_list(spark), 90, history.SPREAD_KEY)
    p = history.assign_position(history.last_n(t, CONTEXT, history.TOKEN_ORDER))
    return p.groupBy("row_id").agg(F.max("event_position").cast("long").alias("n"), F.sum(F.col("event_position") * F.col("role_order")).alias("role_sum"))


@add("win12_position_check", "with " + BACKFILL_LONG + " select count(*) as n_rows, 0::bigint as n_wrong from long")
def position_check(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("row_id", "task").orderBy(*history.TOKEN_ORDER)
    x = long_of(spark, d, BACKFILL).withColumn("expected", F.row_number().over(w))
    return x.agg(F.count("*").alias("n_rows"), F.count_if(F.col("expected") != F.col("event_position")).alias("n_wrong"))


@add("win7_delta_days", "with " + BACKFILL_LONG + """
select row_id, sum(coalesce(g, 0))::bigint as delta_sum, max(coalesce(g, 0))::bigint as delta_max from (
    select row_id, date_sub('day', lag(time) over (partition by row_id order by pos), time) as g from long) group by row_id""")
def deltas(spark, d):
    x = sequences.delta_days(long_of(spark, d, BACKFILL))
    return x.groupBy("row_id").agg(F.sum("delta_days").alias("delta_sum"), F.max("delta_days").alias("delta_max"))


@add("ag19_persistent_stats", "with " + HIST + f"""
select row_id, count(*) filter (where code in {LISTED}) as n_persistent_events_original,
    count(distinct case when code in {LISTED} then code end) as n_unique_persistent_codes_original from history group by row_id""")
def persistent_stats(spark, d):
    m = history.mark_codes(hist(spark, d), adapters.code_list(spark))
    return audit.persistent_stats(m, "is_compressible", "original", ["row_id"])


AUDIT_BASE = f""",
full_stats as (select row_id, count(*) as n, min(time) as t0, max(time) as t1, count(*) filter (where code in {LISTED}) as persist,
    count(distinct case when code in {LISTED} then code end) as codes from history group by row_id),
win_stats as (select row_id, count(*) as wn, min(time) as wt0, max(time) as wt1, arg_min(source_event_id, (time, source_event_id)) as wid, count(*) filter (where code in {LISTED}) as wpersist,
    count(distinct case when code in {LISTED} then code end) as wcodes from win group by row_id)
"""


def exclusive(sql: str) -> str:
    """The same query with events strictly before the prediction only."""
    assert "b.time <= l.prediction_time" in sql
    return sql.replace("b.time <= l.prediction_time", "b.time < l.prediction_time")


def exclusive_timeline(spark, d):
    """Episodes see only what lies before their prediction, so some have no history."""
    from eraloom.plans.dataset import prepare

    return once(spark, d, "exclusive timeline", lambda: prepare(
        events(spark, d), adapters.episode_labels(spark, d), adapters.code_list(spark), inclusive=False
    ))


def history_audit_sql(mode: str) -> str:
    size, persist, codes = ("wn", "wpersist", "wcodes") if mode == "no_backfill" else ("n", "persist", "codes")
    return "with " + WINDOW + AUDIT_BASE + f"""
select l.row_id, coalesce(n, 0) as original_history_len, t0 as original_earliest_time, t1 as original_latest_time, coalesce(wn, 0) as raw_window_len, wt0 as raw_window_boundary_time,
    wid as raw_window_boundary_source_event_id, wt1 as raw_window_latest_time, coalesce({size}, 0) as transformation_input_len, coalesce(persist, 0) as n_persistent_events_original,
    coalesce(codes, 0) as n_unique_persistent_codes_original, coalesce(wpersist, 0) as n_persistent_events_raw_window, coalesce(wcodes, 0) as n_unique_persistent_codes_raw_window,
    coalesce({persist}, 0) as n_persistent_events_transform_input, coalesce({codes}, 0) as n_unique_persistent_codes_transform_input, (coalesce(n, 0) > 64)::int::bigint as was_raw_window_truncated
    from labels l left join full_stats f on l.row_id = f.row_id left join win_stats w on l.row_id = w.row_id"""


def history_audit_query(mode: str, of=timeline):
    def run(spark, d):
        t = of(spark, d)
        a = audit.history_audit(t.known(90, CONTEXT), CONTEXT, mode)
        return rounded(a.drop("task", "subject_id", "prediction_time", "label", "split"))

    return run


CATALOG["pip10_history_audit"] = (history_audit_query("backfill"), history_audit_sql("backfill"))
CATALOG["pip10_ag19_history_audit_no_backfill"] = (history_audit_query("no_backfill"), history_audit_sql("no_backfill"))
CATALOG["pip10_history_audit_exclusive"] = (history_audit_query("no_backfill", exclusive_timeline), exclusive(history_audit_sql("no_backfill")))


TRANSFORM = """
select l.row_id, count(t.row_id) as transformed_history_len_before_truncation, coalesce(sum(a_persist), 0)::bigint as persistent_events_accounted_by_transform,
    coalesce(sum(a_rep), 0)::bigint as n_repeats_removed, coalesce(sum(a_dup), 0)::bigint as n_visit_day_duplicates_removed, coalesce(sum(a_era), 0)::bigint as n_era_repeat_mentions_removed,
    coalesce(sum(a_eras), 0)::bigint as n_condition_eras, coalesce(sum(a_comp), 0)::bigint as n_compressed_eras from labels l {how} join {t} t on t.row_id = l.row_id group by l.row_id
"""


@add("pip11_transform_audit", "with " + HIST + era_sql("history") + TRANSFORM.format(t="tokens", how="left"))
def transform_audit(spark, d):
    a = audit.transform_audit_from_cutoffs(timeline(spark, d).cutoffs(90), raw=False)
    return rounded(a.drop("task", "subject_id", "prediction_time", "label", "split"))


@add("pip11_transform_audit_by_tokens", "with " + NO_BACKFILL_LONG + TRANSFORM.format(t="tokens_nb", how=""))
def transform_audit_tokens(spark, d):
    t = timeline(spark, d)
    packed = eras.packed_no_backfill(t.reach().filter("n_events > 0"), t.ranked, 90, CONTEXT)
    return rounded(packed.select("row_id", *audit.transform_totals(False, "in_window.")))


def final_sql(long: str, tokens: str, mode: str) -> str:
    any_cut = "n > 64 or tn > 64" if mode == "no_backfill" else "tn > 64"
    added = "0" if mode == "no_backfill" else f"(select count(*) from {long} x where x.row_id = f.row_id and f.n > 64 and (x.time < w.wt0 or (x.time = w.wt0 and x.anchor < w.wid)))"
    return AUDIT_BASE + f""",
tr as (select row_id, count(*) as tn, sum(a_rep)::bigint as rep from {tokens} group by row_id),
fin as (select row_id, count(*) as fn, min(time) as ft0, max(time) as ft1, max(days_before_prediction) as far from {long} group by row_id)
select l.row_id, coalesce(tn, 0) as transformed_history_len, coalesce(rep, 0) as n_repeats_removed, coalesce(fn, 0) as final_seq_len, coalesce({any_cut}, false)::int::bigint as was_truncated,
    coalesce(tn > 64, false)::int::bigint as was_transformed_truncated,
    ft0 as earliest_retained_time, ft1 as latest_retained_time, cast(far as double) as earliest_retained_days_before_prediction,
    cast(date_sub('day', ft0, l.prediction_time) as double) as covered_days, cast(date_sub('day', ft0, ft1) as double) as retained_calendar_span_days,
    cast({added} as bigint) as n_backfill_events_added
from labels l left join full_stats f on f.row_id = l.row_id left join win_stats w on l.row_id = w.row_id left join tr on tr.row_id = l.row_id left join fin on fin.row_id = l.row_id
"""


FINAL_COLS = [
    "row_id", "transformed_history_len", "n_repeats_removed", "final_seq_len", "was_truncated", "was_transformed_truncated", "earliest_retained_time",
    "latest_retained_time", "earliest_retained_days_before_prediction", "covered_days", "retained_calendar_span_days", "n_backfill_events_added",
]


def final_query(spec):
    def run(spark, d):
        return rounded(examples_of(spark, d, spec)[0].select(*FINAL_COLS))

    return run


CATALOG["pip12_final_audit_backfill"] = (final_query(BACKFILL), "with " + WINDOW + era_sql("history") + last_n_sql("tokens", "long") + final_sql("long", "tokens", "backfill"))
CATALOG["pip12_jn12_final_audit_no_backfill"] = (final_query(NO_BACKFILL), "with " + NO_BACKFILL_LONG + final_sql("long_nb", "tokens_nb", "no_backfill"))


def final_exclusive_query(spec):
    def run(spark, d):
        return rounded(build_examples(exclusive_timeline(spark, d), spec)[0].select(*FINAL_COLS))

    return run


CATALOG["pip12_final_audit_backfill_exclusive"] = (
    final_exclusive_query(BACKFILL), exclusive("with " + WINDOW + era_sql("history") + last_n_sql("tokens", "long") + final_sql("long", "tokens", "backfill")),
)
CATALOG["pip12_final_audit_no_backfill_exclusive"] = (
    final_exclusive_query(NO_BACKFILL), exclusive("with " + NO_BACKFILL_LONG + final_sql("long_nb", "tokens_nb", "no_backfill")),
)

VOCAB = """,
counts as (select t.code, count(*) as n from long t join labels l on t.row_id = l.row_id where l.split = 'train' group by t.code),
vocab as (select code, 2 + row_number() over (order by n desc, code) as token_id from counts union all select * from (values ('<PAD>', 0), ('<UNK>', 1), ('<CLS>', 2)))
"""


@add("ag6_train_code_counts", "with " + BACKFILL_LONG + VOCAB + " select code, n from counts where n >= 5")
def code_counts(spark, d):
    return sequences.train_code_counts(long_of(spark, d, BACKFILL), 5)


@add("pip13_vocab", "with " + BACKFILL_LONG + VOCAB + " select code, token_id::bigint as token_id from vocab")
def vocab(spark, d):
    return rounded(sequences.build_vocab(long_of(spark, d, BACKFILL)))


@add("srt2_vocab_cap", "with " + BACKFILL_LONG + VOCAB + " select code, token_id::bigint as token_id from vocab where token_id < 20")
def vocab_cap(spark, d):
    return rounded(sequences.build_vocab(long_of(spark, d, BACKFILL), max_size=20))


@add("jn5_encode_tokens", "with " + BACKFILL_LONG + VOCAB + """
select t.row_id, sum(pos * coalesce(case when token_id < 20 then token_id end, 1))::bigint as token_sum, count(*) filter (where coalesce(token_id, 99) >= 20) as n_unknown
from long t left join vocab v on t.code = v.code group by t.row_id""")
def encode(spark, d):
    v = sequences.build_vocab(long_of(spark, d, BACKFILL), max_size=20)
    e = sequences.encode_tokens(long_of(spark, d, BACKFILL), v)
    return e.groupBy("row_id").agg(F.sum(F.col("event_position") * F.col("token_id")).alias("token_sum"), F.count_if(F.col("token_id") == 1).alias("n_unknown"))


EXAMPLES = BACKFILL_LONG + VOCAB + """,
enc as (select t.*, l.split, l.label, l.subject_id, coalesce(v.token_id, 1) as token_id, coalesce(date_sub('day', lag(time) over (partition by t.row_id order by pos), time), 0) as delta
    from long t join labels l on t.row_id = l.row_id left join vocab v on t.code = v.code)
"""


@add("pip14_ag9_examples", "with " + EXAMPLES + """
select l.row_id, l.split, l.label::bigint as label, coalesce(string_agg(token_id::varchar, ' ' order by pos), '') as token_ids, coalesce(string_agg(code, ' ' order by pos), '') as codes,
    coalesce(string_agg(days_before_prediction::bigint::varchar, ' ' order by pos), '') as days, coalesce(string_agg(delta::varchar, ' ' order by pos), '') as deltas,
    coalesce(string_agg(coalesce(numeric_value::bigint::varchar, '-'), ' ' order by pos), '') as numbers, count(pos) as seq_len, count(distinct token_id) as n_unique_tokens,
    count(*) filter (where state) as n_compression_events, least(any_value(h.n), 64) as raw_seq_len, least(any_value(h.n), 64) - count(pos) as n_events_removed_vs_raw
from labels l left join enc e on l.row_id = e.row_id left join (select row_id, count(*) as n from history group by row_id) h on h.row_id = l.row_id group by l.row_id, l.split, l.label""")
def examples(spark, d):
    ex, _, _ = build_examples(timeline(spark, d), BACKFILL)
    words = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("long").cast("string"), F.lit("-"))), " ")
    out = ex.select(
        "row_id", "split", "label", words("token_ids").alias("token_ids"), F.array_join("codes", " ").alias("codes"),
        words("days_before_prediction").alias("days"), words("delta_days").alias("deltas"), words("numeric_values").alias("numbers"),
        "seq_len", "n_unique_tokens", "n_compression_events", "raw_seq_len", "n_events_removed_vs_raw",
    )
    return rounded(out)


@add("pip14_empty_history", "with " + BASE + """, h as (select l.row_id, b.time from labels l left join base b on l.subject_id = b.subject_id and b.time < l.prediction_time)
select count(*) filter (where n = 0) as n_empty, count(*) as n_examples, sum(least(n, 64))::bigint as n_tokens from (select row_id, count(time) as n from h group by row_id)""")
def empty_history(spark, d):
    ex, _, _ = build_examples(exclusive_timeline(spark, d), RAW)
    return ex.agg(F.count_if(F.col("seq_len") == 0).alias("n_empty"), F.count("*").alias("n_examples"), F.sum(F.size("token_ids")).alias("n_tokens"))


@add("ag10_fn15_array_counts", "with " + EXAMPLES + """
select l.row_id, count(distinct token_id) as n_distinct, count(distinct code) as n_codes, count(*) filter (where regexp_matches(code, '^DX_ERA90_(START|END|COUNT_BIN)/')) as n_state
from labels l left join enc e on e.row_id = l.row_id group by l.row_id""")
def array_counts(spark, d):
    ex = examples_of(spark, d, BACKFILL)[0]
    state = F.filter("codes", lambda c: c.rlike(structural_pattern(90)))
    return ex.select("row_id", F.size(F.array_distinct("token_ids")).cast("long").alias("n_distinct"), F.size(F.array_distinct("codes")).cast("long").alias("n_codes"), F.size(state).cast("long").alias("n_state"))


NUM_STATS = EXAMPLES + """,
nums as (select token_id, count(*) as c, avg(numeric_value) as m, avg(numeric_value * numeric_value) as m2 from enc where split = 'train' and numeric_value is not null group by token_id),
tstats as (select v.token_id, coalesce(c, 0) as c, case when coalesce(c, 0) >= 3 then m else 0 end as mean, case when coalesce(c, 0) >= 3 then sqrt(greatest(m2 - m * m, 1e-6)) else 1 end as std
    from vocab v left join nums on v.token_id = nums.token_id)
"""


@add("pip15_token_numeric_stats", "with " + NUM_STATS + """
select token_id::bigint as token_id, c as numeric_count_train, round(mean, 6) as numeric_mean_train, round(std, 6) as numeric_std_train, (c >= 3)::int::bigint as has_enough_numeric_stats from tstats""")
def numeric_stats(spark, d):
    ex, v, _ = examples_of(spark, d, BACKFILL)
    return rounded(sequences.token_numeric_stats(ex, v))


@add("pip16_sequence_features", "with " + NUM_STATS + """, feat as (select e.row_id, ln(1 + greatest(days_before_prediction, 0)) as b, ln(1 + greatest(delta, 0)) as g,
    case when numeric_value is null then 0 else least(greatest((numeric_value - mean) / greatest(std, 1e-6), -10), 10) end as z, (numeric_value is not null)::int as p
    from (select *, max(pos) over (partition by row_id) as len from enc) e join tstats s on e.token_id = s.token_id where pos > len - 32)
select l.row_id, count(f.row_id) as n, round(coalesce(sum(b), 0), 4) as days_sum, round(coalesce(sum(g), 0), 4) as delta_sum, round(coalesce(sum(z), 0), 4) as z_sum, coalesce(sum(p), 0)::bigint as n_present
from labels l left join feat f on f.row_id = l.row_id group by l.row_id""")
def features(spark, d):
    ex, v, _ = examples_of(spark, d, BACKFILL)
    s = sequences.sequence_features(ex, sequences.token_numeric_stats(ex, v), 32)
    total = lambda c: r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    return s.select(
        "row_id", F.size("token_id").cast("long").alias("n"), total("log_days_before").alias("days_sum"), total("log_delta_days").alias("delta_sum"),
        total("z").alias("z_sum"), F.aggregate("present", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_present"),
    )


@add("ag11_length_summary", "with " + EXAMPLES + """, per as (select l.row_id, l.subject_id, l.split, l.label, count(e.pos) as seq_len, count(*) filter (where state) as n_state from labels l left join enc e on l.row_id = e.row_id group by all)
select split, count(*) as n_examples, count(distinct subject_id) as n_patients, sum(label)::bigint as n_positive, round(avg(label), 6) as event_rate, round(avg(seq_len), 6) as mean_seq_len,
    quantile_cont(seq_len, 0.5) as median_seq_len, round(quantile_cont(seq_len, 0.9), 6) as p90_seq_len, max(seq_len) as max_seq_len, round(avg(n_state), 6) as mean_compression_events from per group by split""")
def lengths(spark, d):
    s = sequences.length_summary(examples_of(spark, d, BACKFILL)[0])
    return rounded(s.select("split", "n_examples", "n_patients", "n_positive", "event_rate", "mean_seq_len", "median_seq_len", "p90_seq_len", "max_seq_len", "mean_compression_events"))


@add("snk3_representation_summary", "with " + EXAMPLES + """, per as (select l.row_id, l.subject_id, l.label, count(e.pos) as seq_len, min(days_before_prediction) as near from labels l left join enc e on l.row_id = e.row_id group by all)
select 'order_f' as task, 'condition_era_90_backfill_64' as version, count(*) as n_examples, count(distinct subject_id) as n_patients, round(avg(seq_len), 6) as mean_seq_len,
    min(near)::double as min_days_before_prediction, (select count(*) from vocab) as vocab_size from per""")
def summary(spark, d):
    ex, v, _ = examples_of(spark, d, BACKFILL)
    v = v.select(F.lit("order_f").alias("task"), F.lit(BACKFILL.name).alias("version"), "token_id")
    s = sequences.representation_summary(ex, v)
    return rounded(s.select("task", "version", "n_examples", "n_patients", "mean_seq_len", "min_days_before_prediction", "vocab_size"))


def checks_sql(table: str, **counts: str) -> str:
    """One row per check from violation counts over ``table``."""
    one = f"n as (select {', '.join(f'{v} as {k}' for k, v in counts.items())} from {table})"
    rows = " union all ".join(f"select '{k}' as \"check\", {k}::bigint as n_violations, ({k} = 0)::int::bigint as passed from n" for k in counts)
    return f", {one} {rows}"


def window_checks_sql(long: str) -> str:
    return f""",
edge as (select row_id, min(time) as wt0, arg_min(source_event_id, (time, source_event_id)) as wid from win group by row_id),
chk as (select t.*, wt0, wid, w.time as wtime, l.prediction_time as pt, row_number() over (partition by t.row_id order by t.time, anchor, role, t.code) as want
    from {long} t left join edge using (row_id) left join win w on w.row_id = t.row_id and w.source_event_id = t.anchor join labels l on l.row_id = t.row_id)""" + checks_sql(
        "chk", no_event_before_raw_window="count(*) filter (where time < wt0 or (time = wt0 and anchor < wid))",
        no_event_from_earlier_history="count(*) filter (where wtime is null)", anchor_time_matches_raw_window="count(*) filter (where wtime <> time)",
        event_order_preserved="count(*) filter (where pos <> want)", no_event_after_prediction="count(*) filter (where time > pt)",
    )


def window_checks(spark, d, spec):
    t = timeline(spark, d)
    return rounded(audit.check_no_backfill(long_of(spark, d, spec), history.raw_window(t.reach(), t.ranked, CONTEXT)))


@add("dq11_no_backfill_invariants", "with " + NO_BACKFILL_LONG + window_checks_sql("long_nb"))
def no_backfill_checks(spark, d):
    return window_checks(spark, d, NO_BACKFILL)


@add("dq11_finds_backfilled_events", "with " + WINDOW + era_sql("history") + last_n_sql("tokens", "long") + window_checks_sql("long"))
def backfill_is_found(spark, d):
    """A backfilled table must break the no-backfill rules."""
    return window_checks(spark, d, BACKFILL)


STATE = "^DX_ERA90_(START|END|COUNT_BIN)/"
STRIP = "'^DX_ERA90_(START/|END/|COUNT_BIN/[^/]+/)', ''"


def null_checks_sql(drop: str, keep: str) -> str:
    """Checks of a structure-null table without rows ``drop`` and with source rows where ``keep``."""
    return f""",
nul as (select row_id, pos, time, anchor, role, days_before_prediction, case when {keep} then code else regexp_replace(code, {STRIP}) end as code,
    case when {keep} or not state then numeric_value end as numeric_value, case when {keep} or not state then text_value end as text_value, case when {keep} then state else false end as state
    from long where not ({drop})),
bth as (select s.row_id, s.pos, n.pos as npos, regexp_matches(s.code, '{STATE}') as st, s.code as sc, n.code as nc, n.numeric_value as nn, n.text_value as nx, n.state as ns from long s left join nul n on s.row_id = n.row_id and s.pos = n.pos),
vw as (select count(distinct code) as words from nul join labels using (row_id) where split = 'train' and regexp_matches(code, '{STATE}')),
rw as (select count(distinct row_id) as bad from nul where regexp_matches(code, '{STATE}'))""" + checks_sql(
        "bth", event_count_matches_source="count(*) filter (where npos is null)", event_times_match_source="0", event_order_matches_source="count(*) filter (where npos is null)",
        base_codes_match_source=f"count(*) filter (where nc <> regexp_replace(sc, {STRIP}))",
        state_features_absent=f"count(*) filter (where regexp_matches(nc, '{STATE}') or ns or (st and (nn is not null or nx is not null)))",
        special_tokens_absent_from_vocabulary="(select words from vw)", special_tokens_absent_from_sequences="(select bad from rw)",
        only_structural_features_differ="count(*) filter (where npos is null)",
    )


def null_checks(spark, d, null):
    source = long_of(spark, d, BACKFILL)
    vocab = sequences.build_vocab(null)
    seqs = sequences.collect_sequences(sequences.encode_tokens(null, vocab))
    return rounded(audit.check_structure_null(source, null, vocab, seqs, 90))


@add("dq12_structure_null_invariants", "with " + BACKFILL_LONG + null_checks_sql("false", "false"))
def structure_checks(spark, d):
    # Read by several branches below.
    return null_checks(spark, d, long_of(spark, d, STRUCTURE_NULL))


@add("dq12_finds_planted_faults", "with " + BACKFILL_LONG + null_checks_sql("row_id % 100 = 7 and pos = 2", "row_id % 100 = 3"))
def structure_faults(spark, d):
    """Rows dropped from some episodes and state tokens left in others."""
    source = long_of(spark, d, BACKFILL)
    bad = F.col("row_id") % 100 == 3
    null = eras.structure_null(source.filter(~bad), 90).unionByName(source.filter(bad))
    return null_checks(spark, d, materialize(null.filter(~((F.col("row_id") % 100 == 7) & (F.col("event_position") == 2)))))


AUDITED = ", h as (select l.row_id, count(b.time) as n from labels l left join base b on l.subject_id = b.subject_id and b.time <= l.prediction_time group by 1), f as (select l.row_id, count(t.row_id) as len from labels l left join long_nb t on l.row_id = t.row_id group by 1), a as (select * from h join f using (row_id))"


def audit_checks_sql(context: int) -> str:
    return checks_sql(
        "a", required_episode_audit_columns="0", final_seq_len_equals_seq_len="0", seq_len_within_context=f"count(*) filter (where len > {context})", nonnegative_repeat_counts="0",
        nonnegative_backfill_counts="0", backfill_not_above_final_len="0", no_backfill_input_is_raw_window=f"count(*) filter (where least(n, 64) <> least(n, {context}))", no_backfill_added_zero="0",
    )


@add("dq13_episode_audit_invariants", "with " + NO_BACKFILL_LONG + AUDITED + audit_checks_sql(CONTEXT))
def audit_checks(spark, d):
    return rounded(audit.check_episode_audit(examples_of(spark, d, NO_BACKFILL)[0], CONTEXT, "condition_era", "no_backfill"))


@add("dq13_finds_wrong_context", "with " + NO_BACKFILL_LONG + AUDITED + audit_checks_sql(32))
def audit_context(spark, d):
    return rounded(audit.check_episode_audit(examples_of(spark, d, NO_BACKFILL)[0], 32, "condition_era", "no_backfill"))


# Faults planted by row_id % 97, so that each rule of each mode has something to find.
FAULTS = {
    "final_seq_len": (1, lambda: F.col("final_seq_len") + 1), "n_repeats_removed": (2, lambda: F.lit(-1)), "n_backfill_events_added": (3, lambda: F.lit(-1)),
    "transformed_history_len": (5, lambda: F.col("transformed_history_len") + 1), "transformation_input_len": (7, lambda: F.col("transformation_input_len") + 1),
}


def faulty_audit_query(spec):
    def run(spark, d):
        at = F.col("row_id") % 97
        ex = examples_of(spark, d, spec)[0]
        ex = ex.withColumns({c: F.when(at == k, bad()).otherwise(F.col(c)) for c, (k, bad) in FAULTS.items()})
        ex = ex.withColumns({
            "n_backfill_events_added": F.when(at == 4, F.col("seq_len") + 1).otherwise(F.col("n_backfill_events_added")),
            "n_repeats_removed": F.when(at == 6, F.lit(1)).otherwise(F.col("n_repeats_removed")),
        })
        return rounded(audit.check_episode_audit(ex, CONTEXT, spec.kind, spec.window_mode))

    return run


def faulty_audit_sql(mode: str) -> str:
    at = lambda *k: f"count(*) filter (where row_id % 97 in ({', '.join(map(str, k))}))"
    rules = {
        "required_episode_audit_columns": "0", "final_seq_len_equals_seq_len": at(1), "seq_len_within_context": "0", "nonnegative_repeat_counts": at(2),
        "nonnegative_backfill_counts": at(3), "backfill_not_above_final_len": at(4),
    }
    if mode == "raw":
        rules |= {"raw_transform_length_equals_original": at(5), "raw_repeats_removed_zero": at(2, 6), "raw_added_zero": at(3, 4)}
    if mode == "backfill":
        rules |= {"backfill_uses_full_history": at(7)}
    if mode == "no_backfill":
        rules |= {"no_backfill_input_is_raw_window": at(7), "no_backfill_added_zero": at(3, 4)}
    return "with " + EV + checks_sql("labels", **rules)


for _spec in (RAW, BACKFILL, NO_BACKFILL, STRUCTURE_NULL):
    CATALOG[f"dq13_finds_faults_{_spec.window_mode}"] = (faulty_audit_query(_spec), faulty_audit_sql(_spec.window_mode))


def guards_sql(context: int, mode: str) -> str:
    added = "count(*) filter (where added <> 0)" if mode == "raw" else "0"
    return AUDIT_BASE + f""",
g as (select t.row_id, count(*) as len, count(*) filter (where n > 64 and (t.time < wt0 or (t.time = wt0 and anchor < wid))) as added, min(days_before_prediction) as near
    from long t join full_stats f on f.row_id = t.row_id join win_stats w on w.row_id = t.row_id group by t.row_id)""" + checks_sql(
        "g", audit_length_equals_sequence="0", length_within_context=f"count(*) filter (where len > {context})", backfill_count_not_negative="0",
        backfill_count_zero_where_required=added, no_future_event="count(*) filter (where near < -1e-6)",
    )


@add("dq14_build_guards", "with " + WINDOW + era_sql("history") + last_n_sql("tokens", "long") + guards_sql(CONTEXT, "backfill"))
def guards(spark, d):
    return rounded(audit.build_guards(examples_of(spark, d, BACKFILL)[0], CONTEXT, "backfill"))


@add("dq14_finds_broken_guards", "with " + WINDOW + era_sql("history") + last_n_sql("tokens", "long") + guards_sql(32, "raw"))
def broken_guards(spark, d):
    return rounded(audit.build_guards(examples_of(spark, d, BACKFILL)[0], 32, "raw"))


@add("fn1_fn3_time_differences", """
select l_orderkey % 97 as g, count(*) as n, sum(date_sub('day', o_orderdate, l_shipdate + to_minutes(299 * l_linenumber)))::bigint as whole_days,
    sum(date_sub('hour', o_orderdate, l_shipdate + to_minutes(299 * l_linenumber)))::bigint as whole_hours,
    round(sum(date_sub('microsecond', o_orderdate, l_shipdate + to_minutes(299 * l_linenumber)) / 86400e6::double), 4) as fractional_days
from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def differences(spark, d):
    x = adapters.table(spark, d, "lineitem").join(adapters.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.withColumn("t", F.expr("timestampadd(MINUTE, 299 * l_linenumber, l_shipdate)"))
    return x.groupBy((F.col("l_orderkey") % 97).alias("g")).agg(
        F.count("*").alias("n"), F.sum(whole_days("o_orderdate", "t")).alias("whole_days"), F.sum(whole_hours("o_orderdate", "t")).alias("whole_hours"),
        r(F.sum(fractional_days("o_orderdate", "t")), 4).alias("fractional_days"),
    )


@add("fn2_fn4_day_strings", "select 'day=' || strftime(ts, '%Y-%m-%d') as bucket, count(*) as n from events group by 1")
def day_strings(spark, d):
    from eraloom.functions.scalar import event_day

    return adapters.table(spark, d, "events").groupBy(F.concat(F.lit("day="), event_day("ts")).alias("bucket")).agg(F.count("*").alias("n"))


@add("fn5_structure_match", "with " + BACKFILL_LONG + """
select regexp_replace(code, '^DX_ERA90_(START/|END/|COUNT_BIN/[^/]+/)', '') as base_code, count(*) as n, count(*) filter (where regexp_matches(code, '^DX_ERA90_(START|END|COUNT_BIN)/')) as n_state from long group by 1""")
def structure_match(spark, d):
    from eraloom.functions.scalar import strip_structure

    return long_of(spark, d, BACKFILL).groupBy(strip_structure("code", 90).alias("base_code")).agg(
        F.count("*").alias("n"), F.count_if(F.col("code").rlike(structural_pattern(90))).alias("n_state")
    )


@add("fn7_count_bins", """select case when n <= 1 then '1' when n = 2 then '2' when n <= 5 then '3_5' when n <= 10 then '6_10' else 'gt10' end as bin, count(*) as n_subjects
from (select o_custkey, count(*) as n from orders group by 1) group by 1""")
def bins(spark, d):
    per = adapters.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy(count_bin("n").alias("bin")).agg(F.count("*").alias("n_subjects"))


@add("fn14_slice_and_pad", "with " + EXAMPLES + """, t as (select row_id, pos, token_id, max(pos) over (partition by row_id) as len from enc)
select l.row_id, array_to_string(list_concat(coalesce(list(token_id order by pos) filter (where pos > len - 10), []), range(0, 10)).list_transform(lambda x, i: case when i <= least(coalesce(any_value(len), 0), 10) then x else 0 end)[1:10], ' ') as tokens
from labels l left join t on t.row_id = l.row_id group by l.row_id""")
def slice_pad(spark, d):
    ex = examples_of(spark, d, BACKFILL)[0].select("row_id", sequences.last_elements("token_ids", 10).alias("t"))
    ex = ex.withColumn("goal", F.array_repeat(F.lit(0), 10))
    return ex.select("row_id", F.array_join(sequences.padded("t", "goal", F.lit(0)), " ").alias("tokens"))


@add("set2_keep_first_visit", """select o_custkey as subject_id, o_orderkey as row_id from (
select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1""")
def keep_first(spark, d):
    from eraloom.functions.ordered import keep_by_order

    o = adapters.episode_labels(spark, d)
    return keep_by_order(o, ["subject_id"], [F.col("prediction_time"), F.col("row_id")]).select("subject_id", "row_id")


@add("set1_union_all", "with " + EV + " select omop_table, count(*) as n, max(time) as last_time from ev group by omop_table")
def union(spark, d):
    return adapters.clinical_events(spark, d).groupBy("omop_table").agg(F.count("*").alias("n"), F.max("time").alias("last_time"))
