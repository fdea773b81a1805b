"""Queries that write derived tables in users' layouts and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eraloom.catalog.dataset import BACKFILL, examples_of
from eraloom.catalog.evaluation import HELD, held
from eraloom.catalog.perturbation import PENS, perturbed_ensemble
from eraloom.catalog.shared import BACKFILL_LONG, EV, LISTED, SCORES, r, rounded, scores
from eraloom.operators import report
from eraloom.session import work_dir
from eraloom.sources import adapters, readers, writers

CATALOG: dict = {}


def add(name: str, sql: str | None = None):
    def keep(fn):
        CATALOG[name] = (fn, sql)
        return fn

    return keep


def folder(spark, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/files/{uuid.uuid4().hex}/{name}"


@add("src1_snk1_read_events", "with " + EV + " select omop_table, count(*) as n, count(distinct code) as n_codes, round(sum(cast(numeric_value as double)), 4) as value_sum from ev group by 1")
def events(spark, d):
    path = folder(spark, "events")
    writers.write_table(adapters.clinical_events(spark, d), path, "lz4", ["omop_table"])
    e = readers.read_events(spark, path)
    return e.groupBy("omop_table").agg(F.count("*").alias("n"), F.countDistinct("code").alias("n_codes"), r(F.sum(F.col("numeric_value").cast("double")), 4).alias("value_sum"))


@add("src3_read_splits", "with " + EV + " select split, count(*) as n from splits group by 1")
def read_splits(spark, d):
    path = folder(spark, "splits")
    writers.write_table(adapters.subject_splits(spark, d).withColumnRenamed("split", "data_split"), path)
    return readers.read_splits(spark, path).groupBy("split").agg(F.count("*").alias("n"))


@add("src4_jn2_read_labels", "with " + EV + " select split, count(*) as n, sum(label)::bigint as n_positive, max(prediction_time) as last_time from labels group by 1")
def read_labels(spark, d):
    path = folder(spark, "labels")
    made = adapters.episode_labels(spark, d).select(
        "row_id", "subject_id", "prediction_time", F.lit(None).cast("boolean").alias("boolean_value"), F.when(F.col("label") == 1, "true").otherwise("false").alias("categorical_value")
    )
    writers.write_table(made, path)
    rows = readers.read_labels(spark, path, adapters.subject_splits(spark, d), "order_f")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"), F.max("prediction_time").alias("last_time"))


@add("src7_read_code_list", f"select distinct 'DX/' || p_type as code from part where 'DX/' || p_type in {LISTED}")
def read_list(spark, d):
    path = folder(spark, "codes")
    codes = adapters.table(spark, d, "part").select(F.concat(F.lit("DX/"), "p_type").alias("code"), "p_brand")
    writers.write_csv(codes.join(adapters.code_list(spark), "code", "left_semi"), path)
    return readers.read_code_list(spark, path)


@add("src8_snk2_read_prediction_runs", "with " + HELD + " select 'run_' || seed as source_run_tag, compression_version, count(*) as n, round(sum(risk_raw), 4) as risk_sum from held group by 1, 2")
def read_runs(spark, d):
    root = folder(spark, "runs")
    rows = held(spark, d).select("task", "compression_version", "seed", "row_id", "subject_id", "y_true", "risk_raw")
    for s in adapters.SEEDS:
        writers.write_csv(rows.filter(F.col("seed") == s), f"{root}/run_{s}")
    back = readers.read_prediction_runs(spark, root, [f"run_{s}" for s in adapters.SEEDS], rows.schema.simpleString()[7:-1].replace(":", " "))
    return back.groupBy("source_run_tag", "compression_version").agg(F.count("*").alias("n"), r(F.sum("risk_raw"), 4).alias("risk_sum"))


@add("src9_read_perturbed", "with " + PENS + " select compression_version, requested_copy_fraction, count(*) as n, round(sum(risk), 4) as risk_sum from pe group by 1, 2")
def read_perturbed(spark, d):
    path = folder(spark, "perturbed")
    writers.write_csv(perturbed_ensemble(spark, d).drop("risk_calibrated_std", "n_seeds"), path)
    back = readers.read_perturbed_predictions(spark, path, "csv")
    return back.groupBy("compression_version", "requested_copy_fraction").agg(F.count("*").alias("n"), r(F.sum("risk_calibrated"), 4).alias("risk_sum"))


@add("src10_read_examples", "with " + BACKFILL_LONG + " select split, count(*) as n, sum(least(n, 64))::bigint as n_tokens from (select l.row_id, l.split, count(t.row_id) as n from labels l left join long t on l.row_id = t.row_id group by 1, 2) group by 1")
def read_examples(spark, d):
    root = folder(spark, "examples")
    writers.write_examples(examples_of(spark, d, BACKFILL)[0].withColumnRenamed("label", "y_true"), root)
    e = readers.read_examples(spark, root, "order_f", BACKFILL.name)
    return e.groupBy("split").agg(F.count("label").alias("n"), F.sum(F.size("token_ids")).alias("n_tokens"))


@add("src11_read_tabular_sources", "with " + EV + """ select 'tabular__order_f__tabular_' || k || '_prediction_time' as source_name, 'event_time ' || case k when 'lt' then '<' else '<=' end || ' prediction_time' as time_rule, split, count(*) as n, sum(label)::bigint as n_positive
from labels cross join (values ('lt'), ('leq')) as v(k) group by all""")
def tabular(spark, d):
    root = folder(spark, "cache")
    rows = adapters.episode_labels(spark, d).withColumn("n_prior", F.col("row_id") % 7)
    writers.write_table(rows.drop("task"), f"{root}/order_f_features_top500.parquet")
    writers.write_table(rows.drop("task"), f"{root}/order_f_lt_prediction_time_features_top500.parquet")
    core = readers.read_tabular_sources(spark, root, ["order_f", "other"])
    return core.groupBy("source_name", "time_rule", "split").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"))


@add("src12_read_vocab", "with " + BACKFILL_LONG + """, counts as (select t.code, count(*) as n from long t join labels l on t.row_id = l.row_id where l.split = 'train' group by t.code)
select code, 2 + row_number() over (order by n desc, code) as token_id from counts union all select * from (values ('<PAD>', 0), ('<UNK>', 1), ('<CLS>', 2))""")
def read_vocab(spark, d):
    path = folder(spark, "vocab")
    writers.write_table(examples_of(spark, d, BACKFILL)[1], path)
    return rounded(readers.read_vocab(spark, path))


@add("snk4_file_manifest", "with " + EV + ", t as (select split, split || ':' || count(*) || ':' || sum(label)::bigint as line from labels group by 1) select 'split=' || split as folder, length(line) + 1 as size_bytes, sha256(line || chr(10)) as sha256, line as header from t")
def manifest(spark, d):
    """One text file per split, hashed where it lies."""
    root = folder(spark, "report")
    rows = adapters.episode_labels(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    rows.select("split", F.concat_ws(":", "split", "n", "p").alias("value")).write.partitionBy("split").text(root)
    m = report.file_manifest(spark, root, "part-*")
    return m.select(F.substring_index("file", "/", 1).alias("folder"), "size_bytes", "sha256", "header")


@add("dq20_safety_scan", "with " + HELD + """, rep as (select 'metrics_by_seed.csv' as folder, 0 as f, '' as c, count(distinct (compression_version, seed)) as n from held union all select 'wide_prediction_rows.csv', 1, 'logit,row_id,subject_id', count(*) from held
union all select 'table_rows.csv', 0, 'row_id', count(distinct row_id) from held)
select folder, f::bigint as forbidden_name_pattern, c as forbidden_columns, (f = 0 and c = '')::int::bigint as safe, n as n_rows from rep""")
def scan(spark, d):
    """Reports written from scores, then scanned as files."""
    h, root = held(spark, d), folder(spark, "public")
    tables = {
        "metrics_by_seed.csv": h.groupBy("compression_version", "seed").agg(F.count("*").alias("n")),
        "wide_prediction_rows.csv": h.select("row_id", "subject_id", "logit"), "table_rows.csv": h.select("row_id", "y_true").distinct(),
    }
    for name, df in tables.items():
        writers.write_csv(df, f"{root}/{name}")
    s = report.safety_scan(report.file_manifest(spark, root, "part-*")).withColumn("folder", F.substring_index("file", "/", 1))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text(root).select(
        F.substring_index(F.substring_index("_metadata.file_path", "/public/", -1), "/", 1).alias("folder"), "value"
    ).filter(F.col("value").rlike("[0-9]")).groupBy("folder").agg(F.count("*").alias("n_rows"))
    worst = s.groupBy("folder").agg(
        F.max(F.col("forbidden_name_pattern")).alias("forbidden_name_pattern"), F.max("forbidden_columns").alias("forbidden_columns"), F.min("safe").alias("safe")
    )
    return rounded(worst.join(lines, "folder"))


@add("srt4_head_sample", "with " + SCORES + " select row_id, count(*) as n from scores where split = 'held_out' and risk_raw > 0.7 group by 1 order by n desc, row_id limit 20")
def head(spark, d):
    issues = scores(spark, d).filter("split = 'held_out' and risk_raw > 0.7").groupBy("row_id").agg(F.count("*").alias("n"))
    return report.head_sample(issues, [F.desc("n"), F.asc("row_id")])


@add("jn6_key_difference", "with " + SCORES + """ select 'only_a' as side, count(*) as n from (select row_id from scores where seed = 42 and row_id % 3 <> 0 except select row_id from scores where seed = 43 and row_id % 5 <> 0)
union all select 'only_b', count(*) from (select row_id from scores where seed = 43 and row_id % 5 <> 0 except select row_id from scores where seed = 42 and row_id % 3 <> 0)""")
def key_difference(spark, d):
    from eraloom.operators.predictions import key_diff

    o = adapters.episode_labels(spark, d).select("row_id")
    diff = key_diff(o.filter("row_id % 3 <> 0"), o.filter("row_id % 5 <> 0"), ["row_id"])
    return diff.groupBy("side").agg(F.count("*").alias("n"))


