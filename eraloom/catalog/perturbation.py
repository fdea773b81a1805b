"""Queries on copy-forward plans, perturbed sequences and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from eraloom.catalog.dataset import BACKFILL, vocab_of
from eraloom.catalog.evaluation import A, B, REPS, draws_sql, metrics_sql
from eraloom.catalog.shared import HIST, LISTED, SCORES, base_events, era_sql, last_n_sql, once, r, rounded, timeline
from eraloom.operators import history, metrics, perturb, robustness
from eraloom.operators.predictions import with_baseline
from eraloom.session import materialize
from eraloom.sources import adapters

CATALOG: dict = {}


def add(name: str, sql: str | None = None):
    def keep(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return keep


def plan_of(spark, d):
    def make():
        e, v = perturb.candidate_plan(timeline(spark, d))
        return materialize(e), materialize(v)

    return once(spark, d, "plan", make)


PLAN = HIST + f""",
vr as (select * from history where split = 'held_out' and starts_with(compression_bucket, 'reconstructed_visit=')),
cv as (select row_id, code, compression_bucket, count(*) as n, min(time) as t from vr where code in {LISTED} group by all),
cs as (select row_id, code, count(*) as n_existing_visits, sum(n)::bigint as n_existing_mentions, min(t) as first_diagnosis_time from cv group by all having count(*) >= 2),
vt as (select row_id, compression_bucket, min(time) as visit_time from vr group by all),
el as (select cs.*, vt.compression_bucket, vt.visit_time from cs join vt on cs.row_id = vt.row_id and vt.visit_time > cs.first_diagnosis_time
    where not exists (select 1 from cv where cv.row_id = cs.row_id and cv.code = cs.code and cv.compression_bucket = vt.compression_bucket)),
cnt as (select row_id, code, any_value(n_existing_visits) as n_existing_visits, any_value(n_existing_mentions) as n_existing_mentions, any_value(first_diagnosis_time) as first_diagnosis_time, count(*) as n_eligible_visits from el group by 1, 2),
ep as (select * exclude (rn) from (select *, row_number() over (partition by row_id order by n_existing_visits desc, n_existing_mentions desc, n_eligible_visits desc, first_diagnosis_time, code) as rn from cnt) where rn = 1),
vp as (select el.row_id, el.code, el.compression_bucket, el.visit_time, ep.n_eligible_visits,
    row_number() over (partition by el.row_id order by sha256(concat_ws('|', '20260722', 'order_f', el.row_id::varchar, el.code, el.compression_bucket)), el.visit_time, el.compression_bucket) - 1 as eligible_rank
    from el join ep on el.row_id = ep.row_id and el.code = ep.code),
fr as (select * from (values (0.0::double), (0.25::double), (0.5::double), (1.0::double)) as f(f)),
sel as (select vp.*, f from vp cross join fr where eligible_rank < ceil(n_eligible_visits * f))
"""


@add("cf1_candidate_stats", "with " + PLAN + " select * from cs")
def stats(spark, d):
    t = timeline(spark, d)
    s = perturb.candidate_stats(t, perturb.code_visits(t))
    return s.select("row_id", "code", "n_existing_visits", "n_existing_mentions", "first_diagnosis_time")


@add("cf2_eligible_counts", "with " + PLAN + " select row_id, code, n_eligible_visits from cnt")
def counts(spark, d):
    t = timeline(spark, d)
    c = perturb.count_eligible(t, perturb.candidate_stats(t, perturb.code_visits(t)))
    return c.select("row_id", "code", "n_eligible_visits")


@add("cf2_eligible_visits", "with " + PLAN + " select row_id, code as candidate_code, compression_bucket, visit_time from vp")
def visits(spark, d):
    t = timeline(spark, d)
    v = perturb.eligible_visits(t, plan_of(spark, d)[0], perturb.code_visits(t))
    return v.select("row_id", "candidate_code", "compression_bucket", "visit_time")


@add("cf3_win10_candidate_plan", "with " + PLAN + " select row_id, code as candidate_code, n_existing_visits, n_existing_mentions, first_diagnosis_time, n_eligible_visits from ep")
def plan(spark, d):
    e, _ = perturb.candidate_plan(timeline(spark, d))
    return e.select("row_id", "candidate_code", "n_existing_visits", "n_existing_mentions", "first_diagnosis_time", "n_eligible_visits")


@add("cf3_win11_fn11_visit_ranks", "with " + PLAN + " select row_id, compression_bucket, eligible_rank, n_eligible_visits from vp")
def ranks(spark, d):
    return plan_of(spark, d)[1].select("row_id", "compression_bucket", "eligible_rank", "n_eligible_visits")


@add("cf4_fn16_select_fraction", "with " + PLAN + " select f as requested_copy_fraction, row_id, count(*) as n_copied, max(eligible_rank) as last_rank from sel group by 1, 2")
def selection(spark, d):
    s = perturb.select_fraction(plan_of(spark, d)[1])
    return s.groupBy("requested_copy_fraction", "row_id").agg(F.count("*").alias("n_copied"), F.max("eligible_rank").alias("last_rank"))


def injected(spark, d):
    e, v = plan_of(spark, d)
    return perturb.inject_planned(history.episode_history(e, base_events(spark, d)), perturb.select_fraction(v))


INJECTED = PLAN + """,
inj as (select h.row_id, h.prediction_time, h.time, h.code, h.numeric_value, h.text_value, h.compression_bucket, h.source_event_id, h.days_before_prediction, f from history h join ep using (row_id) cross join fr
    union all select sel.row_id, l.prediction_time, visit_time, sel.code, null, null, compression_bucket, 7000000000000000 + sel.row_id * 100000 + eligible_rank,
    cast(date_sub('microsecond', visit_time, l.prediction_time) / 86400e6::double as float)::double, f from sel join labels l using (row_id))
"""


@add("cf5_inject", "with " + INJECTED + """ select row_id, f as requested_copy_fraction, count(*) as n, count(*) filter (where source_event_id >= 7000000000000000) as n_copied, round(sum(days_before_prediction), 4) as days_sum,
    sum(source_event_id % 1000003)::bigint as id_sum from inj group by 1, 2""")
def inject(spark, d):
    i = injected(spark, d)
    return i.groupBy("row_id", "requested_copy_fraction").agg(
        F.count("*").alias("n"), F.count_if(F.col("source_event_id") >= perturb.COPY_ID_BASE).alias("n_copied"),
        r(F.sum(F.col("days_before_prediction").cast("double")), 4).alias("days_sum"), F.sum(F.col("source_event_id") % 1000003).alias("id_sum"),
    )


VOCAB_TAIL = """,
counts as (select t.code, count(*) as n from long t join labels l on t.row_id = l.row_id where l.split = 'train' group by t.code),
vocab as (select code, 2 + row_number() over (order by n desc, code) as token_id from counts union all select * from (values ('<PAD>', 0), ('<UNK>', 1), ('<CLS>', 2)))
"""
PERTURBED_OUT = """
select t.row_id, t.f as requested_copy_fraction, count(*) as seq_len, sum(pos * coalesce(v.token_id, 1))::bigint as token_sum, count(*) filter (where state) as n_compression_events,
    round(sum(days_before_prediction), 4) as days_sum from plong t left join vocab v on t.code = v.code group by 1, 2
"""


def perturbed(spark, d, gap):
    e, v = plan_of(spark, d)
    s = perturb.perturbed_sequences(timeline(spark, d), e, perturb.select_fraction(v), vocab_of(spark, d, BACKFILL), 64, gap)
    tokens = F.aggregate(F.transform("token_ids", lambda x, i: x * (i + 1)), F.lit(0).cast("int"), lambda a, x: a + x)
    days = F.aggregate(F.transform("days_before_prediction", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return s.select(
        "row_id", "requested_copy_fraction", F.col("seq_len").cast("long").alias("seq_len"), tokens.cast("long").alias("token_sum"),
        F.col("n_compression_events").cast("long").alias("n_compression_events"), r(days, 4).alias("days_sum"),
    )


@add("cf6_perturbed_era_sequences", "with " + INJECTED + era_sql("history") + last_n_sql("tokens", "long") + VOCAB_TAIL + era_sql("inj", "_p", "row_id, f") + last_n_sql("tokens_p", "plong", "row_id, f") + PERTURBED_OUT)
def perturbed_era(spark, d):
    return perturbed(spark, d, 90)


@add("cf6_perturbed_raw_sequences", "with " + INJECTED + era_sql("history") + last_n_sql("tokens", "long") + VOCAB_TAIL
     + ", ptok as (select row_id, f, time, code, days_before_prediction, false as state, source_event_id as anchor, 0 as role from inj)" + last_n_sql("ptok", "plong", "row_id, f") + PERTURBED_OUT)
def perturbed_raw(spark, d):
    return perturbed(spark, d, None)


@add("cf7_injection_summary", "with " + PLAN + """ select f as requested_copy_fraction, count(*) as n_eligible_episodes, sum(n)::bigint as n_copied_visits_total, count(*) filter (where n > 0) as n_episodes_with_at_least_one_copy,
    round(avg(n), 6) as mean_copied_visits_per_episode, round(avg(n / n_eligible_visits::double), 6) as mean_realized_fraction
    from (select ep.row_id, fr.f, ep.n_eligible_visits, (select count(*) from sel where sel.row_id = ep.row_id and sel.f = fr.f) as n from ep cross join fr) group by 1""")
def injection(spark, d):
    e, v = plan_of(spark, d)
    return rounded(perturb.injection_summary(e, perturb.select_fraction(v)).drop("task"))


@add("ag18_plan_summary", "with " + PLAN + """ select count(*) as n_episodes, count(distinct l.subject_id) as n_patients, sum(label)::bigint as n_positive, round(avg(n_existing_visits), 6) as mean_existing_visits,
    round(avg(n_eligible_visits), 6) as mean_eligible_visits, quantile_cont(n_eligible_visits, 0.5) as median_eligible_visits from ep join labels l using (row_id)""")
def plan_summary(spark, d):
    return rounded(perturb.plan_summary(plan_of(spark, d)[0]).drop("task"))


SEED_KEYS = ["task", "compression_version", "seed", "row_id"]
DELTAS = SCORES + """,
hs as (select * from scores where split = 'held_out'), z as (select compression_version, seed, row_id, logit as l0, risk_calibrated as p0 from hs where requested_copy_fraction = 0),
dl as (select hs.*, l0, p0, risk_calibrated - p0 as d, y_true as y, risk_calibrated as p, 1.0::double as w from hs join z using (compression_version, seed, row_id))
"""


def held_scores(spark, d):
    """Scores follow row by row from orders, so only the held-out ones are worked out, where they are read."""
    return adapters.scores(spark, d).filter("split = 'held_out'")


def seed_deltas(spark, d):
    return perturb.delta_vs_zero(held_scores(spark, d), SEED_KEYS, ["logit", "risk_calibrated"])


@add("cf8_jn9_delta_vs_zero", "with " + DELTAS + """ select compression_version, seed::bigint as seed, requested_copy_fraction, count(*) as n, round(sum(logit - l0), 6) as logit_delta, round(sum(d), 6) as risk_delta, round(max(abs(d)), 6) as max_delta from dl group by 1, 2, 3""")
def deltas(spark, d):
    x = seed_deltas(spark, d)
    return rounded(x.groupBy("compression_version", "seed", "requested_copy_fraction").agg(
        F.count("*").alias("n"), F.sum("delta_logit_vs_0").alias("logit_delta"), F.sum("delta_risk_calibrated_vs_0").alias("risk_delta"),
        F.max(F.abs("delta_risk_calibrated_vs_0")).alias("max_delta"),
    ))


@add("cf9_baseline_agreement", "with " + DELTAS + """ select compression_version, seed::bigint as seed, count(*) as n_compared, round(max(abs(logit - l0)), 6) as max_abs_logit_difference, round(max(abs(d)), 6) as max_abs_calibrated_risk_difference,
    (max(abs(logit - l0)) <= 0.1)::int::bigint as within_tolerance from dl where requested_copy_fraction = 0.25 group by 1, 2""")
def agreement(spark, d):
    h = held_scores(spark, d)
    a = perturb.baseline_agreement(
        h.filter("requested_copy_fraction = 0.25"), h.filter("requested_copy_fraction = 0.0"), ["compression_version", "seed"], 0.1
    )
    return rounded(a)


SPEAR = """, sr as (select {by}, corr(ra, rb) as spearman from (select *, rank() over (partition by {by} order by p) + (count(*) over (partition by {by}, p) - 1) / 2.0::double as ra,
    rank() over (partition by {by} order by p0) + (count(*) over (partition by {by}, p0) - 1) / 2.0::double as rb from {src}) group by {by})"""


@add("cf10_perturbation_metrics_by_seed", "with " + DELTAS + metrics_sql("dl", "compression_version, seed, requested_copy_fraction", "m") + SPEAR.format(by="compression_version, seed, requested_copy_fraction", src="dl") + """
select compression_version, seed::bigint as seed, requested_copy_fraction, round(any_value(auroc), 6) as auroc, round(any_value(top_10pct_precision), 6) as top_10pct_precision, round(avg(d), 6) as mean_delta_risk_vs_0, round(avg(abs(d)), 6) as mean_abs_delta_risk_vs_0,
    round(quantile_cont(abs(d), 0.5), 6) as median_abs_delta_risk_vs_0, round(quantile_cont(abs(d), 0.95), 6) as p95_abs_delta_risk_vs_0, round(any_value(spearman), 6) as spearman_risk_vs_0
from dl join m using (compression_version, seed, requested_copy_fraction) join sr using (compression_version, seed, requested_copy_fraction) group by 1, 2, 3""")
def seed_metrics(spark, d):
    by = ["compression_version", "seed", "requested_copy_fraction"]
    # Read by several branches below.
    rows = materialize(seed_deltas(spark, d).select(*by, "row_id", "y_true", "risk_calibrated", "risk_calibrated_at_0", "delta_risk_calibrated_vs_0"))
    m = perturb.perturbation_metrics(rows, by)
    return rounded(m.select(*by, "auroc", "top_10pct_precision", "mean_delta_risk_vs_0", "mean_abs_delta_risk_vs_0", "median_abs_delta_risk_vs_0", "p95_abs_delta_risk_vs_0", "spearman_risk_vs_0"))


def perturbed_ensemble(spark, d):
    def make():
        keys = ["task", "compression_version", "requested_copy_fraction", "row_id", "subject_id", "y_true"]
        e = metrics.ensemble(held_scores(spark, d), keys, {"risk_calibrated": "risk_calibrated"}, "risk_calibrated")
        return materialize(e.select(*keys, F.round("risk_calibrated", 9).alias("risk_calibrated")))

    return once(spark, d, "perturbed ensemble", make)


PENS = SCORES + """,
pe as (select task, compression_version, requested_copy_fraction, row_id, subject_id, y_true, y_true as y, round(avg(risk_calibrated), 9) as risk, round(avg(risk_calibrated), 9) as p, 1.0::double as w from scores where split = 'held_out' group by 1, 2, 3, 4, 5, 6),
pz as (select a.*, b.risk as p0, a.risk - b.risk as d from pe a join pe b using (compression_version, row_id) where b.requested_copy_fraction = 0)
"""
GRP = "compression_version, requested_copy_fraction"


@add("cf10_ensemble_metrics", "with " + PENS + metrics_sql("pe", GRP, "m") + f" select {GRP}, round(auroc, 6) as auroc, round(auprc, 6) as auprc, round(top_10pct_lift, 6) as top_10pct_lift, round(top_10pct_capture, 6) as top_10pct_capture from m")
def ens_metrics(spark, d):
    m = metrics.risk_metrics(perturbed_ensemble(spark, d), GRP.split(", "))
    return rounded(m.select(*GRP.split(", "), "auroc", "auprc", "top_10pct_lift", "top_10pct_capture"))


METRIC_PART = metrics_sql("pe", GRP, "m", clip=1e-8).replace("1e-6::double", "1e-8::double") + """,
ms as (select a.compression_version, a.requested_copy_fraction, a.n_episodes, a.n_positive, a.top_10pct_k::bigint as n_top10, a.auprc, a.logloss, a.brier, a.top_10pct_precision as t, b.auprc as auprc0, b.logloss as ll0, b.brier as br0, b.top_10pct_precision as t0
    from m a join m b using (compression_version) where b.requested_copy_fraction = 0)
"""


@add("cf11_metric_stability", "with " + PENS + METRIC_PART + f""" select {GRP}, n_episodes, n_positive, n_top10, round(auprc, 6) as auprc, round(auprc - auprc0, 6) as delta_auprc_vs_0, round(auprc0 - auprc, 6) as auprc_degradation_vs_0, round(logloss, 6) as logloss,
    round(logloss - ll0, 6) as logloss_degradation_vs_0, round(brier, 6) as brier, round(abs(brier - br0), 6) as abs_brier_shift_vs_0, round(t, 6) as top10_precision, round(t0 - t, 6) as top10_precision_degradation_vs_0 from ms""")
def metric_stability(spark, d):
    m = robustness.metric_stability(perturbed_ensemble(spark, d))
    return rounded(m.select(
        *GRP.split(", "), "n_episodes", "n_positive", "n_top10", "auprc", "delta_auprc_vs_0", "auprc_degradation_vs_0", "logloss", "logloss_degradation_vs_0", "brier",
        "abs_brier_shift_vs_0", "top10_precision", "top10_precision_degradation_vs_0",
    ))


PROB_PART = SPEAR.format(by=GRP, src="pz") + f""",
pp as (select {GRP}, count(*) as n_episodes, count(distinct subject_id) as n_patients, avg(d) as mean_d, avg(abs(d)) as mean_a, quantile_cont(abs(d), 0.5) as med, quantile_cont(abs(d), 0.95) as p95, max(abs(d)) as mx, any_value(spearman) as sp
    from pz join sr using ({GRP}) group by {GRP})
"""


@add("cf11_probability_stability", "with " + PENS + PROB_PART + f""" select {GRP}, n_episodes, n_patients, round(mean_d, 6) as mean_delta_probability, round(mean_a, 6) as mean_abs_delta_probability, round(med, 6) as median_abs_delta_probability,
    round(p95, 6) as p95_abs_delta_probability, round(mx, 6) as max_abs_delta_probability, round(sp, 6) as spearman_risk_vs_0 from pp""")
def probability_stability(spark, d):
    return rounded(robustness.probability_stability(perturbed_ensemble(spark, d)).drop("task"))


TOP_PART = f""",
rk as (select *, row_number() over (partition by {GRP} order by p0 desc, row_id) <= greatest(1, ceil(count(*) over (partition by {GRP}) * 0.1::double)) as b, row_number() over (partition by {GRP} order by p desc, row_id) <= greatest(1, ceil(count(*) over (partition by {GRP}) * 0.1::double)) as a from pz),
mb as (select *, case when a and b then 'retained' when b then 'exited' when a then 'entered' else 'outside' end as top10_status from rk),
ts as (select {GRP}, count(*) filter (where b) as n_top_at_0, count(*) filter (where a) as n_top_perturbed, count(*) filter (where a and b) as n_overlap, count(*) filter (where a and b) / greatest(1, count(*) filter (where b))::double as retention_fraction,
    count(*) filter (where a and b) / greatest(1, count(*) filter (where a or b))::double as jaccard, count(*) filter (where a and not b) / greatest(1, count(*) filter (where b))::double as churn_fraction,
    sum(y) filter (where a and b)::bigint as rp, coalesce(sum(y) filter (where a and not b), 0)::bigint as np, coalesce(sum(y) filter (where b and not a), 0)::bigint as xp, avg(y) filter (where b) as e0, avg(y) filter (where a) as e1 from mb group by {GRP})
"""


@add("cf12_fn17_top_membership", "with " + PENS + TOP_PART + f" select {GRP}, row_id, top10_status from mb")
def membership(spark, d):
    return robustness.top_membership(perturbed_ensemble(spark, d)).select(*GRP.split(", "), "row_id", "top10_status")


@add("cf13_fn20_top_stability", "with " + PENS + TOP_PART + f""" select {GRP}, n_top_at_0, n_top_perturbed, n_overlap, round(retention_fraction, 6) as retention_fraction, round(jaccard, 6) as jaccard, round(churn_fraction, 6) as churn_fraction, rp as n_retained_positive,
    np as n_entered_positive, xp as n_exited_positive, round(e0, 6) as top10_event_rate_at_0, round(e1, 6) as top10_event_rate_perturbed from ts""")
def top_stability(spark, d):
    return rounded(robustness.top_stability(robustness.top_membership(perturbed_ensemble(spark, d))).drop("task", "n_entered", "n_exited"))


@add("cf14_direct_summary", "with " + PENS + METRIC_PART + PROB_PART + TOP_PART + f""", al as (select * from ms join (select {GRP}, mean_a, p95 from pp) using ({GRP}) join (select {GRP}, retention_fraction, jaccard, churn_fraction from ts) using ({GRP}))
select r.requested_copy_fraction, round(r.mean_a, 6) as raw_mean_abs_delta_probability, round(c.mean_a, 6) as compressed_mean_abs_delta_probability, round(r.mean_a - c.mean_a, 6) as mean_abs_delta_probability_advantage_raw_minus_compressed,
    round((r.auprc0 - r.auprc) - (c.auprc0 - c.auprc), 6) as auprc_degradation_advantage_raw_minus_compressed, round(abs(r.logloss - r.ll0) - abs(c.logloss - c.ll0), 6) as logloss_absolute_shift_advantage_raw_minus_compressed,
    round(c.retention_fraction - r.retention_fraction, 6) as top10_retention_advantage_compressed_minus_raw, round(r.churn_fraction - c.churn_fraction, 6) as top10_churn_advantage_raw_minus_compressed
from al r join al c using (requested_copy_fraction) where r.compression_version = '{B}' and c.compression_version = '{A}' and requested_copy_fraction > 0""")
def direct(spark, d):
    e = perturbed_ensemble(spark, d)
    s = robustness.direct_summary(robustness.metric_stability(e), robustness.probability_stability(e), robustness.top_stability(robustness.top_membership(e)), B, A)
    return rounded(s.select(
        "requested_copy_fraction", "raw_mean_abs_delta_probability", "compressed_mean_abs_delta_probability", "mean_abs_delta_probability_advantage_raw_minus_compressed",
        "auprc_degradation_advantage_raw_minus_compressed", "logloss_absolute_shift_advantage_raw_minus_compressed", "top10_retention_advantage_compressed_minus_raw",
        "top10_churn_advantage_raw_minus_compressed",
    ))


@add("cf15_set3_cross_overlap", "with " + PENS + TOP_PART + f""", x as (select requested_copy_fraction, row_id, max((a and compression_version = '{B}')::int) as r, max((a and compression_version = '{A}')::int) as c from mb group by 1, 2)
select requested_copy_fraction, sum(r)::bigint as n_raw_top10, sum(c)::bigint as n_compressed_top10, sum(r * c)::bigint as n_common, round(sum(r * c) / sum(r)::double, 6) as common_fraction_of_raw_top10, round(sum(r * c) / sum(c)::double, 6) as common_fraction_of_compressed_top10,
    round(sum(r * c) / sum(greatest(r, c))::double, 6) as jaccard_raw_vs_compressed, sum(r - r * c)::bigint as n_raw_only, sum(c - r * c)::bigint as n_compressed_only from x group by 1""")
def overlap(spark, d):
    return rounded(robustness.cross_overlap(perturbed_ensemble(spark, d), B, A).drop("task"))


@add("cf16_robustness_bootstrap", "with " + PENS + f""", wd as (select requested_copy_fraction, row_id, any_value(subject_id) as subject_id, max(abs(d)) filter (where compression_version = '{B}') - max(abs(d)) filter (where compression_version = '{A}') as adv from pz where requested_copy_fraction > 0 group by 1, 2),
subj as (select distinct subject_id from wd)""" + draws_sql("subj") + """, per as (select requested_copy_fraction as f, subject_id, sum(adv) as s, count(*) as c from wd group by 1, 2), rp as (select f, rep, sum(mult * s) / sum(mult * c) as delta from per join draws using (subject_id) group by 1, 2)
select f as requested_copy_fraction, round(any_value(pm), 6) as point_mean, round(avg(delta), 6) as bootstrap_mean_delta, round(quantile_cont(delta, 0.025), 6) as ci_low, round(quantile_cont(delta, 0.975), 6) as ci_high, round(avg((delta > 0)::int), 6) as fraction_bootstrap_positive, any_value(ne) as n_episodes
from rp join (select f, sum(s) / sum(c) as pm, sum(c)::bigint as ne from per group by 1) using (f) group by 1""")
def robust(spark, d):
    b = robustness.robustness_bootstrap(perturbed_ensemble(spark, d), B, A, REPS)
    return rounded(b.select("requested_copy_fraction", "point_mean", "bootstrap_mean_delta", "ci_low", "ci_high", "fraction_bootstrap_positive", "n_episodes"))


@add("jn9_with_baseline", "with " + PENS + " select compression_version, requested_copy_fraction, row_id, round(p0, 6) as risk_calibrated_at_0 from pz where requested_copy_fraction = 1")
def baseline(spark, d):
    x = with_baseline(perturbed_ensemble(spark, d), ["task", "compression_version", "row_id"], ["risk_calibrated"])
    return rounded(x.filter("requested_copy_fraction = 1").select("compression_version", "requested_copy_fraction", "row_id", "risk_calibrated_at_0"))


