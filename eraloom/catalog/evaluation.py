"""Queries on risk scores: metrics, ensembles, bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from eraloom.catalog.dataset import BACKFILL, NO_BACKFILL, RAW, examples_of
from eraloom.catalog.shared import SCORES, WINDOW, era_sql, last_n_sql, once, r, rounded, scores
from eraloom.functions.ordered import average_ranks, exact_percentiles
from eraloom.operators import bootstrap, metrics
from eraloom.schemas import HISTORY_METRICS
from eraloom.session import materialize
from eraloom.sources import adapters

CATALOG: dict = {}
BY = ["compression_version", "seed"]
A, B = "condition_era_90_backfill_64", "raw_64"
COMPARISONS = [{"name": "Full64", "task": "order_f", "model_a": A, "model_b": B}]
REPS = 20


def add(name: str, sql: str | None = None):
    def keep(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return keep


def held(spark, d):
    """Unperturbed held-out scores; the split filter reaches the scan of the orders."""
    return once(spark, d, "held", lambda: materialize(adapters.scores(spark, d, [0.0]).filter("split = 'held_out'")))


def ens(spark, d):
    def make():
        e = metrics.ensemble(
            held(spark, d), ["task", "compression_version", "split", "row_id", "subject_id", "prediction_time", "y_true"],
            {"risk_calibrated": "risk_calibrated", "risk_raw": "risk_raw", "logit_mean": "logit"}, "risk_calibrated",
        )
        return materialize(e.withColumn("risk_calibrated", F.round("risk_calibrated", 9)))

    return once(spark, d, "ensemble", make)


HELD = SCORES + """,
held as (select *, risk_calibrated as p, 1.0::double as w, y_true as y from scores where split = 'held_out' and requested_copy_fraction = 0)
"""
ENS = HELD + """,
ens as (select task, compression_version, split, row_id, subject_id, prediction_time, y_true, y_true as y, round(avg(risk_calibrated), 9) as risk_calibrated, round(avg(risk_calibrated), 9) as p,
    coalesce(stddev_samp(risk_calibrated), 0) as sd, avg(risk_raw) as risk_raw, avg(logit) as logit_mean, count(distinct seed) as n_seeds, 1.0::double as w from held group by all)
"""


def metrics_sql(src: str, by: str, out: str, weighted_top: bool = False, fracs=(0.1,), clip: float = 0.0) -> str:
    """CTE ``out`` with the metric bundle of ``src`` (columns p, y, w, row_id)."""
    part = f"partition by {by}"
    rank_p = f"greatest(least(p, 1 - {clip}), {clip})" if clip else "p"
    q = "greatest(least(p, 1 - 1e-6::double), 1e-6::double)"
    tops, joins, picks = "", "", ""
    for f in fracs:
        i = int(round(f * 100))
        k = f"{f}::double * tot" if weighted_top else f"greatest(1, ceil(tot * {f}::double))"
        tops += f""",
{out}_t{i} as (select {by}, any_value(k) as k{i}, sum(greatest(0, least(w, k - (cw - w))) * y) as ev{i} from (
    select *, {k} as k from (select *, sum(w) over ({part} order by p desc, row_id rows unbounded preceding) as cw, sum(w) over ({part}) as tot from {out}_s)) group by {by})"""
        joins += f" join {out}_t{i} using ({by})"
        picks += f", k{i} as top_{i}pct_k, ev{i} as top_{i}pct_events, ev{i} / k{i} as top_{i}pct_precision, case when pos > 0 then ev{i} / k{i} / (pos / tot) end as top_{i}pct_lift, case when pos > 0 then ev{i} / pos end as top_{i}pct_capture"
    return f""",
{out}_s as (select * replace ({rank_p} as p) from {src}),
{out}_h as (select {by}, p, sum(w) as w, sum(w * y) as wp, count(*) as n, sum(y) as np from {out}_s group by {by}, p),
{out}_c as (select *, sum(w) over ({part} order by p) as cw, sum(wp) over ({part} order by p) as cwp, sum(w) over ({part}) as tot, sum(wp) over ({part}) as pos from {out}_h),
{out}_b as (select {by}, any_value(tot) as tot, any_value(pos) as pos, sum(n)::bigint as n_episodes, sum(np)::bigint as n_positive, any_value(pos) / any_value(tot) as event_rate,
    case when any_value(pos) > 0 and any_value(tot) > any_value(pos) then sum(wp * (cw - cwp - 0.5 * (w - wp))) / (any_value(pos) * (any_value(tot) - any_value(pos))) end as auroc,
    case when any_value(pos) > 0 and any_value(tot) > any_value(pos) then sum(wp * ((pos - cwp + wp) / (tot - cw + w))) / any_value(pos) end as auprc,
    sum(wp * (1 - {q}) * (1 - {q}) + (w - wp) * {q} * {q}) / any_value(tot) as brier, -sum(wp * ln({q}) + (w - wp) * ln(1 - {q})) / any_value(tot) as logloss from {out}_c group by {by}){tops},
{out} as (select *{picks} from {out}_b{joins})
"""


def pick(by: str, *cols: str, ints: tuple[str, ...] = ("n_episodes", "n_positive")) -> str:
    return f"select {by}, " + ", ".join(c if c in ints else f"round({c}, 6) as {c}" for c in cols)


BUNDLE = ["n_episodes", "n_positive", "event_rate", "auroc", "auprc", "brier", "logloss", "top_10pct_precision", "top_10pct_lift", "top_10pct_capture"]
CORE = "compression_version, seed::bigint as seed"


@add("ev1_auroc", "with " + HELD + metrics_sql("held", "compression_version, seed", "m") + pick(CORE, "auroc") + " from m")
def auroc(spark, d):
    return rounded(metrics.auroc(held(spark, d), BY))


@add("ev2_auprc", "with " + HELD + metrics_sql("held", "compression_version, seed", "m") + pick(CORE, "auprc") + " from m")
def auprc(spark, d):
    return rounded(metrics.auprc(held(spark, d), BY))


@add("ev3_binary_metrics", "with " + HELD + metrics_sql("held", "compression_version, seed", "m") + pick(CORE, "n_episodes", "n_positive", "event_rate", "brier", "logloss") + " from m")
def binary(spark, d):
    return rounded(metrics.binary_metrics(held(spark, d), BY))


FRACS = (0.01, 0.05, 0.10, 0.20)
TOPK = "with " + SCORES + """, rk as (select *, row_number() over (partition by compression_version, seed order by risk_calibrated desc, row_id) as rn, count(*) over (partition by compression_version, seed) as n,
    sum(y_true) over (partition by compression_version, seed) as pos from scores where split = 'held_out' and requested_copy_fraction = 0),
t as (select compression_version, seed, top_frac, greatest(1, ceil(any_value(n) * top_frac)) as top_k, sum(y_true) filter (where rn <= greatest(1, ceil(n * top_frac))) as ev, any_value(pos) as pos, any_value(n) as n
    from rk cross join (values (0.01::double), (0.05::double), (0.1::double), (0.2::double)) as f(top_frac) group by 1, 2, 3)
select compression_version, seed::bigint as seed, top_frac, top_k::double as top_k, ev::double as events_in_top_k, round(ev / top_k, 6) as top_k_event_rate, round(ev / top_k / (pos / n), 6) as top_k_lift,
    round(ev / pos::double, 6) as event_capture, round(pos / n::double, 6) as base_event_rate, n as n_episodes, pos::bigint as n_positive from t"""


@add("ev4_ev7_topk_by_seed", TOPK)
def topk(spark, d):
    return rounded(metrics.topk_by_seed(held(spark, d), ["compression_version"], FRACS))


@add("ev5_wide_topk", "with " + HELD + metrics_sql("held", "compression_version, seed", "m", fracs=(0.05, 0.1, 0.2)) + pick(CORE, *[f"top_{i}pct_{c}" for i in (5, 10, 20) for c in ("precision", "lift", "capture")]) + " from m")
def wide_topk(spark, d):
    m = metrics.risk_metrics(held(spark, d), BY, fracs=(0.05, 0.10, 0.20))
    return rounded(m.select(*BY, *[f"top_{i}pct_{c}" for i in (5, 10, 20) for c in ("precision", "lift", "capture")]))


@add("ev5_named_metric", "with " + HELD + metrics_sql("held", "compression_version, seed", "m", fracs=(0.05,)) + "select compression_version, seed::bigint as seed, 'top_5pct_lift' as metric, round(top_5pct_lift, 6) as value from m")
def named(spark, d):
    return rounded(metrics.metric(held(spark, d), "top_5pct_lift", BY))


@add("ev6_metrics_by_seed", "with " + HELD + metrics_sql("held", "compression_version, seed", "m") + pick(CORE, *BUNDLE) + ", (select count(distinct subject_id) from held) as n_patients from m")
def by_seed(spark, d):
    return rounded(metrics.metrics_by(held(spark, d), BY).select(*BY, *BUNDLE, "n_patients"))


@add("ev6_ensemble_metrics", "with " + ENS + metrics_sql("ens", "task, compression_version", "m") + pick("task, compression_version", *BUNDLE) + " from m")
def ens_metrics(spark, d):
    return rounded(metrics.metrics_by(ens(spark, d), ["task", "compression_version"]).select("task", "compression_version", *BUNDLE))


EQUAL = HELD + """,
eqw as (select * replace (1.0::double / count(*) over (partition by compression_version, seed, subject_id) as w) from held)
"""


@add("win8_equal_subject_weights", "with " + EQUAL + " select compression_version, seed::bigint as seed, row_id, round(w, 6) as weight from eqw")
def weights(spark, d):
    return rounded(metrics.equal_subject_weights(held(spark, d), BY).select(*BY, "row_id", "weight"))


@add("ev8_equal_weight_metrics", "with " + EQUAL + metrics_sql("eqw", "compression_version, seed", "m", True, clip=1e-6) + pick(CORE, *BUNDLE) + ", round(tot, 6) as total_weight from m")
def equal_weight(spark, d):
    return rounded(metrics.metrics_equal_weight(held(spark, d), BY).select(*BY, *BUNDLE, "total_weight"))


@add("ev9_win14_weighted_top", "with " + EQUAL + metrics_sql("eqw", "compression_version, seed", "m", True, (0.25,)) + pick(CORE, "top_25pct_precision", "top_25pct_lift", "top_25pct_capture") + " from m")
def weighted_top(spark, d):
    return rounded(metrics.weighted_top(metrics.equal_subject_weights(held(spark, d), BY), BY, 0.25))


@add("srt3_top_fraction", "with " + HELD + """ select compression_version, seed::bigint as seed, row_id from (select *, row_number() over (partition by compression_version, seed order by risk_calibrated desc, row_id) as rn,
    count(*) over (partition by compression_version, seed) as n from held) where rn <= greatest(1, ceil(n * 0.1::double))""")
def top_rows(spark, d):
    return rounded(metrics.top_fraction(held(spark, d), BY, 0.10).filter("in_top").select(*BY, "row_id"))


@add("win13_average_rank", "with " + HELD + """ select compression_version, seed::bigint as seed, row_id, rank() over (partition by compression_version, seed order by risk_calibrated) + (count(*) over (partition by compression_version, seed, risk_calibrated) - 1) / 2.0::double as avg_rank from held""")
def avg_rank(spark, d):
    return rounded(average_ranks(held(spark, d), BY, "risk_calibrated", "avg_rank").select(*BY, "row_id", "avg_rank"))


@add("ev20_spearman", "with " + SCORES + """, w as (select compression_version, seed, row_id, max(risk_calibrated) filter (where requested_copy_fraction = 0) as p0, max(risk_calibrated) filter (where requested_copy_fraction = 1) as p1
    from scores where split = 'held_out' group by 1, 2, 3),
rk as (select compression_version, seed, rank() over (partition by compression_version, seed order by p0) + (count(*) over (partition by compression_version, seed, p0) - 1) / 2.0::double as r0,
    rank() over (partition by compression_version, seed order by p1) + (count(*) over (partition by compression_version, seed, p1) - 1) / 2.0::double as r1 from w)
select compression_version, seed::bigint as seed, round(corr(r0, r1), 6) as spearman from rk group by 1, 2""")
def spearman(spark, d):
    s = scores(spark, d).filter("split = 'held_out'").groupBy(*BY, "row_id").agg(
        F.max(F.when(F.col("requested_copy_fraction") == 0, F.col("risk_calibrated"))).alias("p0"),
        F.max(F.when(F.col("requested_copy_fraction") == 1, F.col("risk_calibrated"))).alias("p1"),
    )
    return rounded(metrics.spearman(s, "p0", "p1", BY))


@add("ag12_ensemble", "with " + ENS + " select compression_version, row_id, round(risk_calibrated, 6) as risk_calibrated, round(sd, 6) as risk_calibrated_std, round(logit_mean, 6) as logit_mean, n_seeds from ens")
def ensemble(spark, d):
    e = metrics.require_equal_seeds(ens(spark, d))
    return rounded(e.select("compression_version", "row_id", "risk_calibrated", "risk_calibrated_std", "logit_mean", "n_seeds"))


@add("ag13_seed_summary", "with " + HELD + metrics_sql("held", "compression_version, seed", "m") + """ select compression_version, count(distinct seed) as n_seeds, round(avg(auroc), 6) as auroc_mean, round(stddev_samp(auroc), 6) as auroc_std,
    round(min(auroc), 6) as auroc_min, round(max(auroc), 6) as auroc_max, round(avg(brier), 6) as brier_mean, round(stddev_samp(brier), 6) as brier_std, round(min(brier), 6) as brier_min, round(max(brier), 6) as brier_max from m group by 1""")
def seed_summary(spark, d):
    return rounded(metrics.summarize_seeds(metrics.risk_metrics(held(spark, d), BY), ["compression_version"], ["auroc", "brier"]))


@add("ag14_prediction_stability", "with " + ENS + """ select compression_version, count(*) as n_examples, count(distinct subject_id) as n_patients, sum(y_true)::bigint as n_positive, round(avg(sd), 6) as mean_prediction_std, round(max(sd), 6) as max_prediction_std,
    round(quantile_cont(sd, 0.5), 6) as median_prediction_std, round(quantile_cont(sd, 0.9), 6) as p90_prediction_std, round(quantile_cont(sd, 0.95), 6) as p95_prediction_std from ens group by 1""")
def stability(spark, d):
    return rounded(metrics.stability_summary(ens(spark, d), ["compression_version"], "risk_calibrated_std"))


@add("ev22_flt10_value_summary", """with v as (select l_returnflag, case when l_linenumber = 7 then null else l_extendedprice / nullif(l_quantity, 1) end as x from lineitem)
select l_returnflag, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std, count(x) as n_valid, round(quantile_cont(x, 0.025), 4) as ci_low, round(quantile_cont(x, 0.975), 4) as ci_high from v group by 1""")
def values(spark, d):
    x = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).when(F.col("l_quantity") != 1, F.col("l_extendedprice") / F.col("l_quantity"))
    rows = adapters.table(spark, d, "lineitem").select("l_returnflag", x.alias("x"))
    return rounded(metrics.summarize_values(rows, "x", ["l_returnflag"]), 4)


@add("quantiles_whole_lineitem", """select l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) as median_price, round(quantile_cont(l_extendedprice, 0.99), 4) as p99_price from lineitem group by 1""")
def big_quantiles(spark, d):
    return rounded(exact_percentiles(adapters.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"median_price": 0.5, "p99_price": 0.99}), 4)


@add("win9_ev19_last_episode", "with " + ENS + """, last as (select * exclude (rn) from (select *, row_number() over (partition by task, compression_version, subject_id order by prediction_time desc, row_id desc) as rn from ens) where rn = 1)"""
     + metrics_sql("last", "task, compression_version", "m") + pick("task, compression_version", *BUNDLE) + " from m")
def last(spark, d):
    return rounded(metrics.risk_metrics(metrics.last_episode(ens(spark, d)), ["task", "compression_version"]).select("task", "compression_version", *BUNDLE))


@add("win9_last_episode_rows", "with " + ENS + " select compression_version, subject_id, max_by(row_id, (prediction_time, row_id)) as row_id from ens group by 1, 2")
def last_rows(spark, d):
    return metrics.last_episode(ens(spark, d)).select("compression_version", "subject_id", "row_id")


@add("flt8_select_version", "with " + ENS + " select row_id, round(risk_calibrated, 6) as risk_calibrated from ens where compression_version = 'raw_64' and task = 'order_f'")
def one_version(spark, d):
    from eraloom.operators.predictions import select_version

    return rounded(select_version(ens(spark, d), "order_f", "raw_64").select("row_id", "risk_calibrated"))


@add("jn7_paired_join", "with " + ENS + """ select a.row_id, a.subject_id, a.y_true::bigint as y_true, round(a.risk_calibrated, 6) as pred_a, round(b.risk_calibrated, 6) as pred_b from ens a join ens b using (row_id)
where a.compression_version = 'condition_era_90_backfill_64' and b.compression_version = 'raw_64'""")
def paired(spark, d):
    side = lambda v, n: ens(spark, d).filter(F.col("compression_version") == v).select(*bootstrap.PAIR_KEY, F.col("risk_calibrated").alias(n))
    return rounded(bootstrap.paired_join(side(A, "pred_a"), side(B, "pred_b")))


@add("jn8_paired_join_many", "with " + HELD + """ select row_id, subject_id, y_true::bigint as y_true, round(max(p) filter (where seed = 42), 6) as s42, round(max(p) filter (where seed = 43), 6) as s43, round(max(p) filter (where seed = 44), 6) as s44,
    round(max(p) filter (where seed = 45), 6) as s45 from held where compression_version = 'raw_64' group by 1, 2, 3""")
def four(spark, d):
    h = held(spark, d).filter(F.col("compression_version") == "raw_64").withColumn("s", F.col("seed").cast("string"))
    return rounded(bootstrap.paired_join_many(h, bootstrap.PAIR_KEY, "s", {str(n): f"s{n}" for n in (42, 43, 44, 45)}, "risk_calibrated"))


def draws_sql(clusters: str, reps: int = REPS) -> str:
    """CTE ``draws`` over table ``clusters`` with one ``subject_id`` each."""
    return f""",
idx as (select subject_id, row_number() over (order by subject_id) - 1 as ci from {clusters}),
draws as (select rep, subject_id, mult from (select rep, ci, count(*) as mult from (
    select rep, cast('0x' || substr(sha256(concat_ws('|', '42', rep::varchar, i::varchar)), 1, 8) as bigint) % (select count(*) from idx) as ci
    from range({reps}) r(rep) cross join range((select count(*) from idx)) g(i)) group by rep, ci) join idx using (ci))
"""


@add("ev10_cluster_draws", "with subj as (select distinct o_custkey as subject_id from orders where o_custkey % 10 > 7)" + draws_sql("subj") + " select rep, subject_id, mult from draws")
def draws(spark, d):
    rows = adapters.episode_labels(spark, d).filter("split = 'held_out'")
    return bootstrap.subject_draws(rows, REPS, 42)


METRIC_LIST = ["auroc", "auprc", "brier", "logloss", "top_10pct_precision"]
UNPIVOT = " union all ".join(f"select {{keys}}, '{m}' as metric, {m} as value from {{src}}" for m in METRIC_LIST)


def boot_sql(pairs: str, equal: bool = False) -> str:
    """Summary of replicate deltas of ``pairs`` (side, row_id, subject_id, y, p, w)."""
    return (
        metrics_sql(pairs, "side", "pt", equal, clip=1e-6 if equal else 0.0)
        + f", rs as (select * replace (w * mult as w) from {pairs} join draws using (subject_id))"
        + metrics_sql("rs", "rep, side", "rm", equal, clip=1e-6 if equal else 0.0)
        + ", pl as (" + UNPIVOT.format(keys="side", src="pt") + "), rl as (" + UNPIVOT.format(keys="rep, side", src="rm") + ")"
        + """, point as (select metric, max(value) filter (where side = 'a') as va, max(value) filter (where side = 'b') as vb, max(value) filter (where side = 'a') - max(value) filter (where side = 'b') as pd from pl group by 1),
dl as (select rep, metric, max(value) filter (where side = 'a') - max(value) filter (where side = 'b') as delta from rl group by 1, 2),
j as (select *, case when metric in ('brier', 'logloss') then -1 else 1 end as sg from dl join point using (metric) where delta is not null)
select metric, round(any_value(va), 6) as model_a_value, round(any_value(vb), 6) as model_b_value, round(any_value(pd), 6) as point_delta_a_minus_b, round(avg(delta), 6) as bootstrap_mean_delta, round(stddev_samp(delta), 6) as bootstrap_std_delta,
    round(quantile_cont(delta, 0.025), 6) as ci_low, round(quantile_cont(delta, 0.975), 6) as ci_high, round(avg((delta * sg > 1e-12)::int), 6) as fraction_bootstrap_model_a_better,
    round(avg((delta * sg < -1e-12)::int), 6) as fraction_bootstrap_model_b_better, round(any_value(pd * sg), 6) as benefit_delta, count(*) as n_bootstrap_valid from j group by metric"""
    )


PAIRS = ENS + f""",
prs as (select case when compression_version = '{A}' then 'a' else 'b' end as side, row_id, subject_id, y, p, w from ens),
subj as (select distinct subject_id from prs)
"""
BOOT_COLS = [
    "metric", "model_a_value", "model_b_value", "point_delta_a_minus_b", "bootstrap_mean_delta", "bootstrap_std_delta", "ci_low", "ci_high",
    "fraction_bootstrap_model_a_better", "fraction_bootstrap_model_b_better", "benefit_delta", "n_bootstrap_valid",
]


def boot(spark, d):
    return once(spark, d, "boot", lambda: materialize(bootstrap.run_comparisons(ens(spark, d), COMPARISONS, REPS)))


@add("ev12_ev15_paired_bootstrap", "with " + PAIRS + draws_sql("subj") + boot_sql("prs"))
def paired_boot(spark, d):
    return rounded(bootstrap.run_comparisons(ens(spark, d), COMPARISONS, REPS).select(*BOOT_COLS))


@add("ev13_equal_weight_bootstrap", "with " + PAIRS + ", eqp as (select * replace (1.0::double / count(*) over (partition by side, subject_id) as w) from prs)" + draws_sql("subj") + boot_sql("eqp", True))
def equal_boot(spark, d):
    return rounded(bootstrap.run_comparisons(ens(spark, d), COMPARISONS, REPS, equal_weight=True).select(*BOOT_COLS))


def directions(spark, d):
    return rounded(boot(spark, d).select(
        "metric", "point_effect_direction", F.col("fraction_bootstrap_matching_point_direction").alias("matching"), F.col("fraction_bootstrap_equal").alias("share_equal")
    ))


CATALOG["ev14_direction_fields"] = (directions, "with " + PAIRS + draws_sql("subj") + boot_sql("prs").rsplit("select metric, round(any_value(va), 6)", 1)[0] + """select metric,
    case when any_value(pd * sg) > 1e-12 then 'model_a_better' when any_value(pd * sg) < -1e-12 then 'model_b_better' else 'equal' end as point_effect_direction,
    round(avg(case when pd * sg > 1e-12 then (delta * sg > 1e-12)::int when pd * sg < -1e-12 then (delta * sg < -1e-12)::int else (abs(delta) <= 1e-12)::int end), 6) as matching,
    round(avg((abs(delta) <= 1e-12)::int), 6) as share_equal from j group by metric""")


@add("ev11_bootstrap_ci", "with " + ENS + ", mods as (select *, compression_version as side from ens), subj as (select distinct subject_id from ens)" + draws_sql("subj") + metrics_sql("mods", "side", "pt")
     + ", rs as (select * replace (w * mult as w) from mods join draws using (subject_id))" + metrics_sql("rs", "rep, side", "rm") + ", pl as (" + UNPIVOT.format(keys="side", src="pt") + "), rl as (" + UNPIVOT.format(keys="rep, side", src="rm") + """)
select side as compression_version, metric, round(any_value(o), 6) as observed, round(avg(value), 6) as bootstrap_mean, round(stddev_samp(value), 6) as bootstrap_std, round(quantile_cont(value, 0.025), 6) as ci_low, round(quantile_cont(value, 0.975), 6) as ci_high
from rl join (select side, metric, value as o from pl) using (side, metric) group by 1, 2""")
def ci(spark, d):
    return rounded(bootstrap.bootstrap_ci(ens(spark, d), ["compression_version"], REPS).select(
        "compression_version", "metric", "observed", "bootstrap_mean", "bootstrap_std", "ci_low", "ci_high"
    ))


@add("ev16_seed_directions", "with " + ENS + f""", sp as (select case when compression_version = '{A}' then 'a' else 'b' end as side, seed, row_id, subject_id, y, p, w from held), es as (select case when compression_version = '{A}' then 'a' else 'b' end as side, row_id, y, p, w from ens)"""
     + metrics_sql("sp", "seed, side", "sm") + metrics_sql("es", "side", "em") + ", sl as (" + UNPIVOT.format(keys="seed, side", src="sm") + "), el as (" + UNPIVOT.format(keys="side", src="em") + """),
eb as (select metric, (max(value) filter (where side = 'a') - max(value) filter (where side = 'b')) * case when metric in ('brier', 'logloss') then -1 else 1 end as e from el group by 1),
det as (select seed, metric, (max(value) filter (where side = 'a') - max(value) filter (where side = 'b')) * case when metric in ('brier', 'logloss') then -1 else 1 end as b from sl group by 1, 2)
select metric, count(*) as n_seeds, count(*) filter (where b > 1e-12) as n_seeds_model_a_better, count(*) filter (where b < -1e-12) as n_seeds_model_b_better, round(avg(b), 6) as mean_benefit_delta, round(stddev_samp(b), 6) as std_benefit_delta,
    round(min(b), 6) as min_benefit_delta, round(max(b), 6) as max_benefit_delta, count(*) filter (where (b > 1e-12) = (e > 1e-12) and (b < -1e-12) = (e < -1e-12)) as n_seeds_matching_ensemble from det join eb using (metric) group by 1""")
def seed_dirs(spark, d):
    s = bootstrap.seed_direction_summary(bootstrap.seed_directions(held(spark, d), COMPARISONS, boot(spark, d)))
    return rounded(s.select(
        "metric", "n_seeds", "n_seeds_model_a_better", "n_seeds_model_b_better", "mean_benefit_delta", "std_benefit_delta", "min_benefit_delta", "max_benefit_delta", "n_seeds_matching_ensemble",
    ))


HIST_BOOT = "with " + WINDOW + era_sql("history") + last_n_sql("tokens", "long") + era_sql("win", "_nb") + last_n_sql("tokens_nb", "long_nb") + """,
hl as (select row_id, subject_id, prediction_time from labels where split = 'held_out'),
wb as (select row_id, min(time) as wt0, arg_min(source_event_id, (time, source_event_id)) as wid from win group by 1), nn as (select row_id, count(*) as n from history group by 1),
fa as (select 'a' as side, l.row_id, subject_id, count(*)::double as final_seq_len, max(days_before_prediction)::double as far, date_sub('day', min(time), any_value(l.prediction_time))::double as covered,
    sum(case when n > 64 and (time < wt0 or (time = wt0 and anchor < wid)) then 1 else 0 end)::double as added, (select sum(a_rep) from tokens t where t.row_id = l.row_id)::double as rep from hl l join long using (row_id) join wb using (row_id) join nn using (row_id) group by 2, 3),
fb as (select 'b' as side, l.row_id, subject_id, count(*)::double as final_seq_len, max(days_before_prediction)::double as far, date_sub('day', min(time), any_value(l.prediction_time))::double as covered, 0::double as added,
    (select sum(a_rep) from tokens_nb t where t.row_id = l.row_id)::double as rep from hl l join long_nb using (row_id) group by 2, 3),
hd as (select row_id, a.subject_id, unnest([struct_pack(m := 'final_seq_len', a := a.final_seq_len, b := b.final_seq_len), struct_pack(m := 'earliest_retained_days_before_prediction', a := a.far, b := b.far), struct_pack(m := 'covered_days', a := a.covered, b := b.covered),
    struct_pack(m := 'n_backfill_events_added', a := a.added, b := b.added), struct_pack(m := 'n_repeats_removed', a := a.rep, b := b.rep)]) as u from fa a join fb b using (row_id)),
subj as (select distinct subject_id from hl)""" + draws_sql("subj") + """,
per as (select u.m as m, subject_id, sum(u.a - u.b) as s, count(*) as c, sum(u.a) as sa, sum(u.b) as sb from hd group by 1, 2),
rp as (select m, rep, sum(mult * s) / sum(mult * c) as delta from per join draws using (subject_id) group by 1, 2)
select m as history_metric, round(any_value(pm), 6) as point_mean, round(any_value(ma), 6) as model_a_mean, round(any_value(mb), 6) as model_b_mean, any_value(md) as median_paired_delta, round(avg(delta), 6) as bootstrap_mean_delta, round(stddev_samp(delta), 6) as bootstrap_std_delta,
    round(quantile_cont(delta, 0.025), 6) as ci_low, round(quantile_cont(delta, 0.975), 6) as ci_high, any_value(ne) as n_episodes, any_value(np) as n_patients
from rp join (select m, sum(s) / sum(c) as pm, sum(sa) / sum(c) as ma, sum(sb) / sum(c) as mb, sum(c)::bigint as ne, count(*) as np from per group by 1) using (m) join (select u.m as m, quantile_cont(u.a - u.b, 0.5) as md from hd group by 1) using (m) group by m"""


def audits(spark, d, *specs):
    out = None
    for spec in specs:
        a = examples_of(spark, d, spec)[0].filter("split = 'held_out'").select(
            "task", F.col("version").alias("compression_version"), "row_id", "subject_id", *HISTORY_METRICS
        )
        out = a if out is None else out.unionByName(a)
    return out


@add("ev17_history_bootstrap", HIST_BOOT)
def history_boot(spark, d):
    comparison = [{"name": "Backfill64", "task": "order_f", "model_a": BACKFILL.name, "model_b": NO_BACKFILL.name}]
    b = bootstrap.history_bootstrap(audits(spark, d, BACKFILL, NO_BACKFILL), comparison, HISTORY_METRICS, REPS)
    return rounded(b.select(
        "history_metric", "point_mean", "model_a_mean", "model_b_mean", "median_paired_delta", "bootstrap_mean_delta", "bootstrap_std_delta", "ci_low", "ci_high", "n_episodes", "n_patients",
    ))


ROLES = {"a1": (A, 0.0), "b1": (B, 0.0), "a2": (A, 1.0), "b2": (B, 1.0)}


@add("ev18_interaction_bootstrap", "with " + SCORES + """, four as (select compression_version || '@' || requested_copy_fraction::int as side, row_id, subject_id, y_true as y, round(avg(risk_calibrated), 9) as p, 1.0::double as w from scores
    where split = 'held_out' and requested_copy_fraction in (0, 1) group by 1, 2, 3, 4), subj as (select distinct subject_id from four)""" + draws_sql("subj") + metrics_sql("four", "side", "pt")
     + ", rs as (select * replace (w * mult as w) from four join draws using (subject_id))" + metrics_sql("rs", "rep, side", "rm") + ", pl as (" + UNPIVOT.format(keys="0 as rep, side", src="pt") + "), rl as (" + UNPIVOT.format(keys="rep, side", src="rm") + ")" + f""",
pi as (select metric, (max(value) filter (where side = '{A}@1') - max(value) filter (where side = '{B}@1')) - (max(value) filter (where side = '{A}@0') - max(value) filter (where side = '{B}@0')) as pd from pl group by 1),
ri as (select rep, metric, (max(value) filter (where side = '{A}@1') - max(value) filter (where side = '{B}@1')) - (max(value) filter (where side = '{A}@0') - max(value) filter (where side = '{B}@0')) as delta from rl group by 1, 2)
select metric, round(any_value(pd), 6) as point_interaction, round(avg(delta), 6) as bootstrap_mean_delta, round(stddev_samp(delta), 6) as bootstrap_std_delta, round(quantile_cont(delta, 0.025), 6) as ci_low, round(quantile_cont(delta, 0.975), 6) as ci_high from ri join pi using (metric) group by 1""")
def interaction(spark, d):
    s = scores(spark, d).filter("split = 'held_out' and requested_copy_fraction in (0.0, 1.0)")
    version = F.concat("compression_version", F.lit("@"), F.col("requested_copy_fraction").cast("int").cast("string"))
    e = metrics.ensemble(s.withColumn("compression_version", version), ["task", "compression_version", *bootstrap.PAIR_KEY], {"risk_calibrated": "risk_calibrated"}, "risk_calibrated")
    e = e.withColumn("risk_calibrated", F.round("risk_calibrated", 9))
    b = bootstrap.interaction_bootstrap(e, {k: f"{v}@{int(f)}" for k, (v, f) in ROLES.items()}, REPS)
    return rounded(b.select("metric", "point_interaction", "bootstrap_mean_delta", "bootstrap_std_delta", "ci_low", "ci_high"))


CALIBRATED = """with """ + ENS + """, l as (select row_id, subject_id, y_true, risk_calibrated - risk_raw as shift from ens where compression_version = 'raw_64'), subj as (select distinct subject_id from l)""" + draws_sql("subj") + """,
per as (select subject_id, sum(shift) as s, count(*) as c from l group by 1), rp as (select rep, sum(mult * s) / sum(mult * c) as delta from per join draws using (subject_id) group by 1)
select 'raw_64' as compression_version, round((select sum(s) / sum(c) from per), 6) as point_mean, round(avg(delta), 6) as bootstrap_mean_delta, round(quantile_cont(delta, 0.025), 6) as ci_low, round(quantile_cont(delta, 0.975), 6) as ci_high,
    round(avg((delta > 0)::int), 6) as fraction_bootstrap_positive from rp"""


@add("ev21_mean_bootstrap", CALIBRATED)
def mean_boot(spark, d):
    e = ens(spark, d).filter("compression_version = 'raw_64'").withColumn("shift", F.col("risk_calibrated") - F.col("risk_raw"))
    b = bootstrap.mean_bootstrap(e, ["compression_version"], "shift", REPS)
    return rounded(b.select("compression_version", "point_mean", "bootstrap_mean_delta", "ci_low", "ci_high", "fraction_bootstrap_positive"))


@add("fn9_fn10_sigmoid_logit", "with " + SCORES + """ select compression_version, round(sum(risk_raw), 4) as raw_sum, round(sum(ln(risk_calibrated / (1 - risk_calibrated))), 4) as logit_sum, round(sum(1 / (1 + exp(-least(greatest(logit * 100, -30), 30)))), 4) as clipped_sum from scores group by 1""")
def sigmoid_logit(spark, d):
    from eraloom.functions.scalar import logit, sigmoid

    return scores(spark, d).groupBy("compression_version").agg(
        r(F.sum("risk_raw"), 4).alias("raw_sum"), r(F.sum(logit("risk_calibrated")), 4).alias("logit_sum"), r(F.sum(sigmoid(F.col("logit") * 100)), 4).alias("clipped_sum")
    )
