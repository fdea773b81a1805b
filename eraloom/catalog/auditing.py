"""Queries on split audits, prediction checks, reports and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from eraloom.catalog.dataset import BACKFILL, EXAMPLES, NO_BACKFILL, RAW, examples_of, long_of
from eraloom.catalog.evaluation import A, B, BOOT_COLS, HELD, PAIRS, boot, boot_sql, draws_sql, ens, held
from eraloom.catalog.perturbation import held_scores, perturbed_ensemble
from eraloom.catalog.shared import EV, SCORES, once, r, rounded, scores, timeline
from eraloom.operators import audit, history, metrics, models, perturb, predictions, report, splits
from eraloom.session import materialize
from eraloom.sources import adapters

CATALOG: dict = {}


def add(name: str, sql: str | None = None):
    def keep(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return keep


def core(spark, d):
    return once(spark, d, "core", lambda: materialize(adapters.audit_sources(spark, d)))


def _copy(kind: str, name: str, where: str = "true", split: str = "split", subject: str = "subject_id", time: str = "strftime(prediction_time, '%Y-%m-%d %H:%M:%S')") -> str:
    return f"select '{kind}' as source_type, '{name}' as source_name, task, 'v1' as version, row_id, {subject} as subject_id, {time} as prediction_time, label, {split} as split, '/{name}' as path from labels where {where}"


CORE = EV + """,
core as (""" + " union all ".join([
    _copy("label_reference", "labels"),
    _copy("sequence", "moved", split="case when subject_id % 100 = 3 and row_id % 2 = 0 then 'held_out' else split end"),
    _copy("sequence", "repeated"), _copy("sequence", "repeated", "row_id % 200 = 7"),
    _copy("sequence", "missing", "row_id % 100 <> 5", time="null"),
    _copy("tabular", "odd_split", split="case when row_id % 500 = 9 then 'valid' else split end"),
    _copy("tabular", "no_subject", subject="case when row_id % 400 <> 11 then subject_id end"),
]) + ")"


@add("prj2_core_rows", "with " + CORE + " select source_name, split, count(*) as n, count(subject_id) as n_subject, count(prediction_time) as n_time, sum(label)::bigint as n_positive from core group by 1, 2")
def core_counts(spark, d):
    return core(spark, d).groupBy("source_name", "split").agg(
        F.count("*").alias("n"), F.count("subject_id").alias("n_subject"), F.count("prediction_time").alias("n_time"), F.sum("label").alias("n_positive")
    )


@add("dq1_ag4_split_values", "with " + CORE + " select source_type, source_name, split, count(*) as n_rows, (split in ('train', 'tuning', 'held_out'))::int::bigint as is_expected_split from core group by 1, 2, 3")
def values(spark, d):
    return rounded(splits.split_values(core(spark, d)).drop("task", "version", "time_rule"))


@add("ag4_count_by", "with " + CORE + " select source_name, label::bigint as label, count(*) as n_rows from core group by 1, 2")
def count_by(spark, d):
    return rounded(splits.count_by(core(spark, d), ["source_name", "label"]))


@add("ag5_split_summary", "with " + CORE + """ select source_name, split, count(*) as n_examples, count(distinct row_id) as n_unique_row_id, count(distinct subject_id) as n_subjects, sum(label)::bigint as n_positive, round(avg(label), 6) as event_rate,
    count(*) - count(subject_id) as n_missing_subject_id, count(*) - count(label) as n_missing_label, count(*) - count(prediction_time) as n_missing_prediction_time from core group by 1, 2""")
def summary(spark, d):
    return rounded(splits.split_summary(core(spark, d)).drop("source_type", "task", "version", "time_rule"))


@add("dq2_duplicate_examples", "with " + CORE + """ select source_name, row_id, count(*) as n_rows, count(distinct subject_id) as n_subjects, string_agg(distinct split, '|' order by split) as splits, string_agg(distinct label::varchar, '|' order by label::varchar) as labels from core group by 1, 2 having count(*) > 1""")
def duplicates(spark, d):
    return rounded(splits.duplicate_examples(core(spark, d)).select("source_name", "row_id", "n_rows", "n_subjects", "splits", "labels"))


SPLIT_ORDER = "case {s} when 'train' then 1 when 'tuning' then 2 when 'held_out' then 3 else 4 end"


@add("dq3_set4_subject_overlap", "with " + CORE + f""", ss as (select distinct source_name, subject_id, split from core where split is not null), sz as (select source_name, split, count(subject_id) as n, {SPLIT_ORDER.format(s='split')} as o from ss group by 1, 2),
pr as (select a.source_name, a.split as split_a, b.split as split_b, a.n as n_subjects_split_a, b.n as n_subjects_split_b from sz a join sz b on a.source_name = b.source_name and (a.o, a.split) < (b.o, b.split)),
sh as (select x.source_name, x.split as split_a, y.split as split_b, x.subject_id from ss x join ss y on x.source_name = y.source_name and x.subject_id = y.subject_id and x.split <> y.split where x.subject_id is not null),
smp as (select source_name, split_a, split_b, count(*) as n, string_agg(subject_id::varchar, '|' order by subject_id::varchar) filter (where rn <= 20) as ids from (select *, row_number() over (partition by source_name, split_a, split_b order by subject_id::varchar) as rn from sh) group by 1, 2, 3)
select pr.*, coalesce(n, 0) as n_overlapping_subjects, ids as overlapping_subject_ids_sample from pr left join smp using (source_name, split_a, split_b)""")
def overlap(spark, d):
    o = splits.subject_overlap(core(spark, d))
    return rounded(o.select("source_name", "split_a", "split_b", "n_subjects_split_a", "n_subjects_split_b", "n_overlapping_subjects", "overlapping_subject_ids_sample"))


@add("dq4_subject_multi_split", "with " + CORE + """, i as (select source_name, subject_id, count(distinct split) as n_splits, count(*) as n_examples, string_agg(distinct split, '|' order by split) as splits from core where subject_id is not null group by 1, 2 having count(distinct split) > 1),
rr as (select source_name, subject_id, string_agg(row_id::varchar, '|' order by row_id::varchar) filter (where rn <= 10) as ids, count(*) as k from (select *, row_number() over (partition by source_name, subject_id order by row_id::varchar) as rn from (select distinct source_name, subject_id, row_id from core)) group by 1, 2)
select i.*, ids || case when k > 10 then '|...(+' || (k - 10) || ')' else '' end as row_ids_sample from i join rr using (source_name, subject_id)""")
def subject_multi(spark, d):
    return rounded(splits.subject_multi_split(core(spark, d)).select("source_name", "subject_id", "n_splits", "n_examples", "splits", "row_ids_sample"))


@add("dq5_row_multi_split", "with " + CORE + """ select source_name, row_id, count(distinct split) as n_splits, count(distinct subject_id) as n_subjects, string_agg(distinct split, '|' order by split) as splits from (select * from core union all select source_type, source_name, task, version, row_id, subject_id, prediction_time, label, 'valid', path from core where source_name = 'repeated' and row_id % 200 = 7)
group by 1, 2 having count(distinct split) > 1""")
def row_multi(spark, d):
    c = core(spark, d)
    extra = c.filter("source_name = 'repeated' and row_id % 200 = 7").withColumn("split", F.lit("valid"))
    return rounded(splits.row_multi_split(c.unionByName(extra)).select("source_name", "row_id", "n_splits", "n_subjects", "splits"))


@add("dq6_jn10_official_mismatch", "with " + CORE + """ select source_name, row_id, c.subject_id, c.split, s.split as official_split, (s.split is not null)::int::bigint as has_official_split, coalesce(c.split = s.split, false)::int::bigint as split_matches_official
from core c left join splits s on c.subject_id is not distinct from s.subject_id where s.split is null or c.split <> s.split""")
def official(spark, d):
    m = splits.official_mismatch(core(spark, d), adapters.subject_splits(spark, d))
    return rounded(m.drop("source_type", "task", "version", "path"))


@add("jn10_null_safe_join", "with " + CORE + """, per as (select subject_id, count(*) as n from core where source_name = 'no_subject' group by 1) select c.source_name, count(*) as n_rows, sum(per.n)::bigint as n_pairs from core c join per on c.subject_id is not distinct from per.subject_id group by 1""")
def null_safe(spark, d):
    from eraloom.schemas import join_null_safe

    per = core(spark, d).filter("source_name = 'no_subject'").groupBy("subject_id").agg(F.count("*").alias("n"))
    return join_null_safe(core(spark, d), per, ["subject_id"], "inner").groupBy("source_name").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_pairs"))


@add("dq7_cross_source_subjects", "with " + CORE + """ select subject_id, count(distinct split) as n_splits, count(distinct source_name) as n_sources, string_agg(distinct split, '|' order by split) as splits, string_agg(distinct source_name, '|' order by source_name) as sources
from core where subject_id is not null and split is not null group by 1 having count(distinct split) > 1""")
def cross(spark, d):
    return rounded(splits.cross_source_subjects(core(spark, d)).drop("task", "versions"))


@add("dq8_row_mapping", "with " + CORE + """ select row_id, count(distinct source_name) as n_sources, count(distinct subject_id) as n_subject_ids, count(distinct label) as n_labels, count(distinct split) as n_splits, count(distinct prediction_time) as n_prediction_times_non_null,
    string_agg(distinct split, '|' order by split) as splits from core group by 1 having greatest(count(distinct subject_id), count(distinct label), count(distinct split), count(distinct prediction_time)) > 1""")
def mapping(spark, d):
    return rounded(splits.row_mapping(core(spark, d)).drop("task", "sources", "subject_ids"))


@add("dq9_jn11_coverage", "with " + CORE + """, lk as (select distinct row_id, subject_id from core where source_type = 'label_reference'), sk as (select distinct source_name, row_id, subject_id from core where source_type <> 'label_reference'), sn as (select distinct source_name from sk),
mis as (select sn.source_name, lk.row_id from sn cross join lk where not exists (select 1 from sk where sk.source_name = sn.source_name and sk.row_id = lk.row_id and sk.subject_id is not distinct from lk.subject_id)),
ext as (select source_name, row_id from sk where not exists (select 1 from lk where sk.row_id = lk.row_id and sk.subject_id is not distinct from lk.subject_id))
select source_name, (select count(*) from lk) as n_label_examples, (select count(*) from sk where sk.source_name = sn.source_name) as n_source_examples, (select count(*) from mis where mis.source_name = sn.source_name) as n_missing_label_examples_in_source,
    (select count(*) from ext where ext.source_name = sn.source_name) as n_extra_source_examples_not_in_labels, (select string_agg(row_id, '|' order by row_id) from (select row_id::varchar as row_id from mis where mis.source_name = sn.source_name order by 1 limit 10)) as missing_row_ids_sample from sn""")
def coverage(spark, d):
    return rounded(splits.coverage(core(spark, d)).drop("extra_row_ids_sample"))


@add("dq10_audit_status", "with " + CORE + f""", ss as (select distinct source_name, subject_id, split from core where split is not null and subject_id is not null),
n as (select 'split_values_are_expected' as check_name, 'FAIL' as worst, count(*) as n_issues from (select distinct source_name, split from core where split not in ('train', 'tuning', 'held_out'))
union all select 'duplicate_prediction_examples_inside_source', 'FAIL', count(*) from (select 1 from core group by source_name, row_id having count(*) > 1)
union all select 'patient_overlap_between_splits_inside_source', 'FAIL', count(*) from ss x join ss y on x.source_name = y.source_name and x.subject_id = y.subject_id and x.split < y.split
union all select 'subject_single_split_inside_source', 'FAIL', count(*) from (select 1 from ss group by source_name, subject_id having count(*) > 1)
union all select 'row_id_single_split_inside_source', 'FAIL', count(*) from (select 1 from core group by source_name, row_id having count(distinct split) > 1)
union all select 'source_split_matches_official_subject_splits', 'FAIL', count(*) from core c left join splits s on c.subject_id = s.subject_id where s.split is null or s.split <> c.split
union all select 'cross_source_subject_split_consistency', 'FAIL', count(*) from (select 1 from ss group by subject_id having count(distinct split) > 1)
union all select 'cross_source_row_mapping_consistency', 'FAIL', count(*) from (select 1 from core group by row_id having greatest(count(distinct subject_id), count(distinct label), count(distinct split), count(distinct prediction_time)) > 1)
union all select 'coverage_against_label_reference', 'WARN', count(*) from (select source_name from (select distinct source_name, row_id, subject_id from core where source_type <> 'label_reference') group by 1
    having count(*) filter (where subject_id is not null) <> (select count(*) from labels) or count(*) filter (where subject_id is null) > 0))
select check_name, case when n_issues = 0 then 'OK' else worst end as status, n_issues from n""")
def status(spark, d):
    return splits.audit_status(core(spark, d), adapters.subject_splits(spark, d))


@add("ag15_joined_values", "with " + CORE + """, v as (select distinct source_name, subject_id::varchar as s from core where subject_id is not null), n as (select *, row_number() over (partition by source_name order by s) as rn, count(*) over (partition by source_name) as k from v)
select source_name, string_agg(s, '|' order by s) || case when any_value(k) > 20 then '|...(+' || (any_value(k) - 20) || ')' else '' end as subjects from n where rn <= 20 group by 1""")
def joined(spark, d):
    j = splits.joined_values(core(spark, d), ["source_name"], {"subjects": ("subject_id", 20)})
    return j.select("k.source_name", "subjects")


@add("src5_normalize_label", """with t as (select o_orderkey, case o_orderkey % 6 when 0 then 'TRUE' when 1 then 'false' when 2 then '1' when 3 then '0' when 4 then ' yes ' else 'n/a' end as raw from orders)
select raw, count(*) as n, case lower(trim(raw)) when 'true' then 1 when '1' then 1 when 'yes' then 1 when 'false' then 0 when '0' then 0 end::bigint as label from t group by raw""")
def label_texts(spark, d):
    from eraloom.functions.scalar import normalize_label

    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "TRUE").when(k == 1, "false").when(k == 2, "1").when(k == 3, "0").when(k == 4, " yes ").otherwise("n/a")
    t = adapters.table(spark, d, "orders").select(raw.alias("raw"))
    return t.groupBy("raw").agg(F.count("*").alias("n")).withColumn("label", normalize_label("raw").cast("long"))


@add("prj3_safe_bool", """select lang, count(*) as n, coalesce(lower(trim(lang)) in ('1', 'true', 'yes', 'y'), false)::int::bigint as parsed from (select case when doc_id % 3 = 0 then ' Yes' when doc_id % 3 = 1 then '0' end as lang from documents) group by 1""")
def bools(spark, d):
    from eraloom.functions.scalar import safe_bool

    text = F.when(F.col("doc_id") % 3 == 0, " Yes").when(F.col("doc_id") % 3 == 1, "0")
    t = adapters.table(spark, d, "documents").select(text.alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))
    return t.withColumn("parsed", safe_bool("lang").cast("long"))


def old_files(spark, d):
    """Held-out scores under the old column names, without family columns."""
    return held(spark, d).select(
        "task", F.lit("sequence").alias("family"), F.col("model"), F.col("compression_version").alias("version"), "seed", "row_id", "subject_id",
        "y_true", F.col("risk_raw").alias("risk"),
    )


@add("prj1_normalize_predictions", "with " + HELD + """ select task, 'sequence' as model_family, 'scorer' as model_name, 'code_sequence_time2vec' as representation, compression_version, 0::bigint as numeric_on, 'raw' as calibration, seed::bigint as seed, 'held_out' as split,
    count(*) as n, sum(row_id)::bigint as id_sum, round(sum(risk_raw), 4) as risk_sum from held group by task, compression_version, seed""")
def normalized(spark, d):
    n = predictions.normalize_predictions(old_files(spark, d))
    keys = ["task", "model_family", "model_name", "representation", "compression_version", "numeric_on", "calibration", "seed", "split"]
    return rounded(n.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("example_id").alias("id_sum"), F.sum("pred_proba").alias("risk_sum")), 4)


@add("flt7_filter_by_configs", "with " + HELD + " select compression_version, count(*) as n from held where compression_version = 'raw_64' or (task = 'order_f' and compression_version = 'condition_era_90_backfill_64') group by 1")
def configs(spark, d):
    wanted = [{"compression_version": B}, {"task": "order_f", "compression_version": A, "model_name": None}]
    return predictions.filter_by_configs(held(spark, d), wanted).groupBy("compression_version").agg(F.count("*").alias("n"))


@add("flt9_null_safe_equality", """with t as (select l_returnflag, case when l_linenumber = 3 then null when l_linenumber = 4 then 'nan'::double else l_quantity end as a, case when l_linenumber in (3, 5) then null when l_linenumber = 4 then 'nan'::double else l_quantity end as b from lineitem)
select l_returnflag, count(*) filter (where a is not distinct from b) as n_equal, count(*) filter (where a is distinct from b) as n_different from t group by 1""")
def equality(spark, d):
    from eraloom.functions.scalar import null_safe_eq

    n, nan = F.col("l_linenumber"), F.lit(float("nan"))
    a = F.when(n == 3, None).when(n == 4, nan).otherwise(F.col("l_quantity"))
    b = F.when(n.isin(3, 5), None).when(n == 4, nan).otherwise(F.col("l_quantity"))
    t = adapters.table(spark, d, "lineitem").select("l_returnflag", a.alias("a"), b.alias("b"))
    return t.groupBy("l_returnflag").agg(F.count_if(null_safe_eq("a", "b")).alias("n_equal"), F.count_if(~null_safe_eq("a", "b")).alias("n_different"))


def legacy(spark, d):
    rows = held(spark, d)
    both = F.array(
        F.struct(F.lit("raw").alias("c"), F.col("risk_raw").alias("p")), F.struct(F.lit("platt").alias("c"), F.col("risk_calibrated").alias("p"))
    )
    return rows.select("*", F.explode(both).alias("x")).select(
        "task", "model_family", F.col("model").alias("model_name"), "representation", "compression_version", "numeric_on", F.col("x.c").alias("calibration"),
        "seed", "split", F.col("row_id").alias("example_id"), "subject_id", "y_true", F.col("x.p").alias("pred_proba"), "logit",
    )


@add("ag16_jn13_fn6_to_wide", "with " + HELD + """ select compression_version, seed::bigint as seed, row_id, prediction_time, try_cast(nullif(regexp_extract(compression_version, 'condition_era_(\\d+)_', 1), '') as bigint) as era_gap, 64::bigint as max_len, round(logit, 6) as logit, round(risk_raw, 6) as risk_raw,
    round(risk_calibrated, 6) as risk_calibrated from held""")
def wide(spark, d):
    lens = spark.createDataFrame([("order_f", v, 64) for v, _ in adapters.VERSIONS], "task string, compression_version string, max_len int")
    meta = held(spark, d).select("task", "compression_version", "row_id", "subject_id", "split", "y_true", "prediction_time")
    w = predictions.to_wide(legacy(spark, d), meta, lens)
    return rounded(w.select("compression_version", "seed", "row_id", "prediction_time", "era_gap", "max_len", "logit", "risk_raw", "risk_calibrated"))


@add("dq18_logit_conflicts", "with " + HELD + " select compression_version, seed::bigint as seed, row_id as example_id, 0.5::double as max_difference from held where row_id % 50 = 7")
def logit_conflicts(spark, d):
    bent = F.when((F.col("calibration") == "platt") & (F.col("example_id") % 50 == 7), F.col("logit") + 0.5).otherwise(F.col("logit"))
    c = predictions.logit_conflicts(legacy(spark, d).withColumn("logit", bent))
    return rounded(c.select("compression_version", "seed", "example_id", "max_difference"))


def runs(spark, d):
    """Two runs: the second repeats part of the first, some of it with other scores."""
    first = held(spark, d).withColumn("source_run_tag", F.lit("run_a"))
    again = held(spark, d).filter("row_id % 10 = 4").withColumn("source_run_tag", F.lit("run_b"))
    return first.unionByName(again)


@add("dq15_duplicate_conflicts", "with " + HELD + " select compression_version, seed::bigint as seed, row_id, 2::bigint as n_rows, 'risk_calibrated' as conflicting_column from held where row_id % 10 = 4 and row_id % 3 = 0")
def conflicts(spark, d):
    bent = F.when((F.col("source_run_tag") == "run_b") & (F.col("row_id") % 3 == 0), F.col("risk_calibrated") * 0.9).otherwise(F.col("risk_calibrated"))
    c = predictions.duplicate_conflicts(runs(spark, d).withColumn("risk_calibrated", bent))
    return rounded(c.select("compression_version", "seed", "row_id", "n_rows", "conflicting_column"))


def pair_list(spark):
    return spark.createDataFrame([("order_f", v) for v, _ in adapters.VERSIONS], "task string, compression_version string")


@add("dq16_merge_runs", "with " + HELD + " select compression_version, 'run_a' as source_run_tag, count(*) as n, count(distinct seed) as n_seeds, round(sum(risk_raw), 4) as risk_sum from held group by 1")
def merged(spark, d):
    m = predictions.merge_runs(runs(spark, d), pair_list(spark), adapters.SEEDS)
    return m.groupBy("compression_version", "source_run_tag").agg(F.count("*").alias("n"), F.countDistinct("seed").alias("n_seeds"), r(F.sum("risk_raw"), 4).alias("risk_sum"))


@add("dq17_validate_predictions", "with " + SCORES + """, h as (select *, case when row_id % 1000 = 3 then risk_raw + 1 else risk_raw end as rr from scores where split = 'held_out' and requested_copy_fraction = 0),
n as (select count(*) filter (where abs(rr - 1 / (1 + exp(-logit))) > 1e-6) as off, count(*) filter (where rr < 0 or rr > 1) as outside, count(*) - count(distinct (compression_version, seed, row_id)) as dup from h)
select 'risk_raw_is_sigmoid_of_logit' as "check", off as n_violations, (off = 0)::int::bigint as passed from n union all select 'prediction_probabilities_in_unit_interval', outside, (outside = 0)::int from n union all select 'unique_held_out_key', dup, (dup = 0)::int from n
union all select 'complete_seed_coverage', (2 - count(*))::bigint, (count(*) = 2)::int from (select compression_version from h group by 1 having count(distinct seed) = 5) union all select 'has_held_out_rows', (count(*) = 0)::int, (count(*) > 0)::int from h""")
def validation(spark, d):
    bent = F.when(F.col("row_id") % 1000 == 3, F.col("risk_raw") + 1).otherwise(F.col("risk_raw"))
    return rounded(predictions.validate_predictions(held(spark, d).withColumn("risk_raw", bent), pair_list(spark), adapters.SEEDS))


@add("pip22_recover_platt", "with " + SCORES + " select compression_version, seed::bigint as seed, round(regr_slope(ln(risk_calibrated / (1 - risk_calibrated)), logit), 6) as platt_coef, round(regr_intercept(ln(risk_calibrated / (1 - risk_calibrated)), logit), 6) as platt_intercept, 0.0::double as max_abs_error from scores group by 1, 2")
def platt(spark, d):
    return rounded(predictions.recover_platt(scores(spark, d), ["compression_version", "seed"]))


def newton_sql(steps: int) -> str:
    out = ", p0 as (select compression_version, seed, 0.0::double as a, 0.0::double as b from t group by 1, 2)"
    for i in range(steps):
        out += f""", s{i} as (select compression_version, seed, a, b, sum((q - y_true) * logit) + a as g1, sum(q - y_true) as g2, sum(q * (1 - q) * logit * logit) + 1 as h11, sum(q * (1 - q) * logit) as h12, sum(q * (1 - q)) as h22 from (
    select t.*, a, b, 1 / (1 + exp(-(a * logit + b))) as q from t join p{i} using (compression_version, seed)) group by compression_version, seed, a, b),
p{i + 1} as (select compression_version, seed, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) as a, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) as b from s{i})"""
    return out


PLATT = SCORES + ", t as (select * from scores where split = 'tuning' and requested_copy_fraction = 0)" + newton_sql(12)


def platt_params(spark, d):
    return models.fit_platt(scores(spark, d).filter("requested_copy_fraction = 0.0"), ["compression_version", "seed"])


@add("pip21_fit_platt", "with " + PLATT + " select compression_version, seed::bigint as seed, round(a, 5) as platt_coef, round(b, 5) as platt_intercept from p12")
def fit_platt(spark, d):
    return rounded(platt_params(spark, d), 5)


@add("pip21_apply_platt", "with " + PLATT + """ select compression_version, seed::bigint as seed, count(*) as n, round(sum(1 / (1 + exp(-(a * logit + b)))), 3) as risk_sum from scores join p12 using (compression_version, seed) where split = 'held_out' and requested_copy_fraction = 0 group by 1, 2""")
def apply_platt(spark, d):
    by = ["compression_version", "seed"]
    a = models.apply_platt(held(spark, d).drop("risk_calibrated"), platt_params(spark, d), by)
    return rounded(a.groupBy(*by).agg(F.count("*").alias("n"), F.sum("risk_calibrated").alias("risk_sum")), 3)


def all_examples(spark, d, *specs):
    out = None
    for spec in specs:
        e = examples_of(spark, d, spec)[0]
        out = e if out is None else out.unionByName(e)
    return out


REPEAT = EXAMPLES + """,
per as (select l.row_id, l.subject_id, l.split, l.label as y, least(coalesce(h.n, 0), 64) as raw_len, coalesce(e.n, 0) as len, coalesce(e.ns, 0) as ns from labels l left join (select row_id, count(*) as n from history group by 1) h on h.row_id = l.row_id
    left join (select row_id, count(*) as n, count(*) filter (where state) as ns from enc group by 1) e on e.row_id = l.row_id),
hr as (select *, raw_len - len as rem, quantile_cont(raw_len - len, 0.9) over () as thr from per where split = 'held_out')
"""


def repeat(spark, d):
    return predictions.high_repeat(examples_of(spark, d, RAW)[0], examples_of(spark, d, BACKFILL)[0])


@add("pip17_high_repeat", "with " + REPEAT + """ select round(any_value(thr), 6) as repeat_removed_threshold, count(*) as n_heldout_examples, count(distinct subject_id) as n_heldout_patients, count(*) filter (where rem >= thr) as n_high_repeat_examples,
    count(distinct case when rem >= thr then subject_id end) as n_high_repeat_patients, count(*) filter (where rem < thr) as n_other_examples, sum(y) filter (where rem >= thr)::bigint as n_high_repeat_positive, round(avg(y) filter (where rem >= thr), 6) as high_repeat_event_rate, round(avg(y) filter (where rem < thr), 6) as other_event_rate from hr""")
def high_repeat(spark, d):
    return rounded(repeat(spark, d)[1].drop("task"))


@add("ag17_subgroup_patients", "with " + REPEAT + " select subject_id, count(*) as n_high_repeat_examples, max(rem)::double as max_repeat_removed, quantile_cont(rem, 0.5) as median_repeat_removed from hr where rem >= thr group by 1")
def subgroup_patients(spark, d):
    return rounded(predictions.subgroup_patients(repeat(spark, d)[0]).drop("task"))


@add("jn14_add_subgroup", "with " + REPEAT + ", " + SCORES.strip() + " select compression_version, case when rem >= thr then 'high_repeat_top10' else 'other_90' end as group_name, count(*) as n, round(avg(risk_raw), 6) as mean_risk from scores s join hr using (row_id) where requested_copy_fraction = 0 group by 1, 2")
def subgroup(spark, d):
    s = predictions.add_subgroup(held(spark, d), repeat(spark, d)[0])
    return s.groupBy("compression_version", "group_name").agg(F.count("*").alias("n"), r(F.avg("risk_raw")).alias("mean_risk"))


@add("pip18_sequence_cost", "with " + REPEAT + """, tagged as (select 'all' as slice, row_id, subject_id, len, raw_len, ns from per union all select 'held_out', row_id, subject_id, len, raw_len, ns from per where split = 'held_out' union all select 'held_out_high_repeat', row_id, subject_id, len, raw_len, ns from hr where rem >= thr)
select slice, count(*) as n_examples, count(distinct subject_id) as n_patients, round(avg(len), 6) as mean_seq_len, quantile_cont(len, 0.5) as median_seq_len, round(quantile_cont(len, 0.9), 6) as p90_seq_len, max(len) as max_seq_len, round(avg(raw_len - len), 6) as mean_events_removed_vs_raw,
    round(avg(ns), 6) as mean_synthetic_events from tagged group by 1""")
def cost(spark, d):
    c = predictions.sequence_cost(examples_of(spark, d, BACKFILL)[0], repeat(spark, d)[0])
    return rounded(c.select("slice", "n_examples", "n_patients", "mean_seq_len", "median_seq_len", "p90_seq_len", "max_seq_len", "mean_events_removed_vs_raw", "mean_synthetic_events"))


BOOT = "with bt as (with " + PAIRS + draws_sql("subj") + boot_sql("prs") + "), o as (select *, case when metric in ('brier', 'logloss') then -ci_high else ci_low end as lo, case when metric in ('brier', 'logloss') then -ci_low else ci_high end as hi from bt)"


def boot_rows(spark, d):
    return rounded(boot(spark, d).select(*BOOT_COLS, "higher_is_better")).withColumn("higher_is_better", F.col("higher_is_better") == 1)


@add("rp2_fn19_table_comparisons", BOOT + """ select metric, benefit_delta as benefit_point, lo as benefit_ci_low, hi as benefit_ci_high, (ci_low > 0 or ci_high < 0)::int::bigint as ci_excludes_zero,
    case when lo > 0 then 'model_a_better' when hi < 0 then 'model_a_worse' else 'difference_not_established' end as conclusion from o""")
def conclusions(spark, d):
    t = report.table_comparisons(boot_rows(spark, d))
    return rounded(t.select("metric", "benefit_point", "benefit_ci_low", "benefit_ci_high", "ci_excludes_zero", "conclusion"))


@add("rp3_relative_benefit", BOOT + " select metric, round(100 * benefit_delta / abs(model_b_value), 4) as relative_benefit_pct, round(100 * lo / abs(model_b_value), 4) as relative_ci_low_pct, round(100 * hi / abs(model_b_value), 4) as relative_ci_high_pct from o")
def relative(spark, d):
    return rounded(report.relative_benefit(boot_rows(spark, d)).select("metric", "relative_benefit_pct", "relative_ci_low_pct", "relative_ci_high_pct"), 4)


INTEGRITY = "with " + HELD + """, pr as (select compression_version, count(distinct seed) as s from held group by 1), gr as (select compression_version, requested_copy_fraction, count(distinct seed) as s from scores where split = 'held_out' group by 1, 2),
v as (select 'split_leakage_audit_all_checks_ok' as "check", (select count(*) from (""" + CATALOG["dq10_audit_status"][1] + """) where status <> 'OK')::bigint as n_violations union all select 'all_representation_invariants_pass', 0
union all select 'wide_predictions_have_no_duplicate_keys', (select count(*) - count(distinct (compression_version, seed, row_id)) from held) union all select 'predictions_cover_all_pairs', abs((select count(*) from pr) - 2)
union all select 'predictions_cover_all_seeds', (select count(*) from pr where s <> 5) union all select 'wide_predictions_only_held_out', (select count(*) from held where split <> 'held_out')
union all select 'risk_raw_matches_sigmoid_logit', (select count(*) from held where abs(risk_raw - 1 / (1 + exp(-logit))) > 1e-10) union all select 'prediction_probabilities_in_unit_interval', (select count(*) from held where not (risk_raw between 0 and 1 and risk_calibrated between 0 and 1))
union all select 'ensemble_metrics_cover_all_pairs', abs((select count(*) from pr) - 2) union all select 'perturbed_groups_complete', abs((select count(*) from gr) - 8) union all select 'perturbed_ensemble_uses_all_seeds', (select count(*) from gr where s <> 5)
union all select 'zero_percent_baseline_agreement_was_recorded', abs((select sum(s)::bigint from pr) - 10)) select *, case when n_violations = 0 then 'PASS' else 'FAIL' end as status from v"""


@add("dq19_integrity_checks", INTEGRITY)
def integrity(spark, d):
    t = timeline(spark, d)
    window = history.raw_window(t.cutoffs(90), t.ranked, 64)
    zero = held(spark, d)
    # The shared ensemble keeps no seed counts, which are checked here.
    ens_rows = metrics.ensemble(
        held_scores(spark, d), ["task", "compression_version", "requested_copy_fraction", "row_id", "subject_id", "y_true"],
        {"risk_calibrated": "risk_calibrated"}, "risk_calibrated",
    )
    return report.integrity_checks(
        splits.audit_status(core(spark, d), adapters.subject_splits(spark, d)), audit.check_no_backfill(long_of(spark, d, NO_BACKFILL), window),
        zero, metrics.risk_metrics(ens(spark, d), ["task", "compression_version"]), ens_rows,
        perturb.baseline_agreement(zero, zero, ["task", "compression_version", "seed"]), 2, 5, 8,
    )


@add("pip19_score", "with " + EXAMPLES + """ select l.row_id, round(1 / (1 + exp(-(coalesce(sum(token_id % 7), 0) / 100.0::double - 1))), 6) as risk from labels l left join enc e on l.row_id = e.row_id group by l.row_id""")
def scored(spark, d):
    def predict(batch):
        import numpy as np

        x = batch["token_ids"].map(lambda t: float(np.sum(np.asarray(t, dtype="int64") % 7)) if t is not None else 0.0)
        batch["risk"] = 1 / (1 + np.exp(-(x / 100 - 1)))
        return batch[["row_id", "risk"]]

    return rounded(models.score(examples_of(spark, d, BACKFILL)[0].select("row_id", "token_ids"), predict, "row_id long, risk double"))


@add("pip20_fit_risk_models")
def risk_models(spark, d):
    pred = models.fit_risk_models(all_examples(spark, d, RAW, BACKFILL), [RAW.name, BACKFILL.name], [42, 43], (0.01, 0.1))
    h = materialize(pred).filter("split = 'held_out'")
    return rounded(metrics.risk_metrics(h, ["compression_version", "seed"], score="risk_raw").select("compression_version", "seed", "n_episodes", "auroc", "auprc"))


@add("fn11_blake2b_digest")
def digest(spark, d):
    from eraloom.functions.scalar import blake2b_hash

    o = adapters.table(spark, d, "orders").select("o_orderkey", blake2b_hash(perturb.SELECTION_SEED, F.lit("order_f"), "o_orderkey").alias("digest"))
    return o.groupBy(F.substring("digest", 1, 1).alias("first")).agg(F.count("*").alias("n"), F.min("digest").alias("least"))


@add("fn8_fn18_clip_and_saturate", """select l_returnflag, round(sum(least(greatest(l_quantity, 5), 40)), 4) as clipped, round(sum(l_quantity / (l_quantity + 365)), 4) as saturated, round(sum(l_quantity / greatest(1, l_linenumber - 1)), 4) as ratio from lineitem group by 1""")
def arithmetic(spark, d):
    from eraloom.functions.scalar import clip, safe_ratio, saturating

    return adapters.table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        r(F.sum(clip("l_quantity", 5.0, 40.0)), 4).alias("clipped"), r(F.sum(saturating("l_quantity")), 4).alias("saturated"),
        r(F.sum(safe_ratio("l_quantity", F.col("l_linenumber") - 1)), 4).alias("ratio"),
    )


