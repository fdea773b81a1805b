"""Planted faults: odd labels and ids, uncovered pairs, NULL group keys, wide headers, fits that cannot end."""

import pytest
from pyspark.sql import functions as F

from eraloom.functions.ordered import average_ranks, exact_percentiles
from eraloom.functions.scalar import normalize_label
from eraloom.operators import bootstrap, metrics, models, report, robustness, splits
from eraloom.schemas import DataContractError


def test_labels_that_are_not_0_or_1_are_null(spark):
    texts = spark.createDataFrame([(x,) for x in ("1", "0", "1.0", " TRUE ", "no", "NaN", "10000000000", "0.7", "-1", "x", None)], "x string")
    assert [r.y for r in texts.select(normalize_label("x").alias("y")).collect()] == [1, 0, 1, 1, 0] + [None] * 6
    numbers = spark.createDataFrame([(x,) for x in (1.0, 0.0, float("nan"), 1e10, 0.7, None)], "x double")
    assert [r.y for r in numbers.select(normalize_label("x").alias("y")).collect()] == [1, 0] + [None] * 4


def test_whole_doubles_stay_ids(spark):
    df = spark.createDataFrame([(5.0, 7.0, 1, "train"), (5.5, float("nan"), 0, "train"), (1e300, None, 0, "train")], "row_id double, subject_id double, label int, split string")
    got = splits.core_rows(df, "label", "s", "t", "v", "r", "p").select("row_id", "subject_id").collect()
    assert [tuple(r) for r in got] == [(5, 7), (None, None), (None, None)]


COMPARISON = [{"name": "c", "task": "t", "model_a": "a", "model_b": "b"}]


def test_history_deltas_need_both_sides(spark):
    rows = [("t", v, i, i % 5, float(i)) for v in "ab" for i in range(20)]
    schema = "task string, compression_version string, row_id long, subject_id long, m double"
    full = spark.createDataFrame(rows, schema)
    assert bootstrap.history_bootstrap(full, COMPARISON, ["m"], 5).count() == 1
    with pytest.raises(DataContractError):
        bootstrap.history_bootstrap(spark.createDataFrame(rows[:-3], schema), COMPARISON, ["m"], 5)


def test_interaction_uses_common_rows(spark):
    def rows(missing):
        return spark.createDataFrame(
            [("t", v, i, i % 7, int(i % 3 == 0), ((i * 37 + k * 11) % 50) / 50) for k, v in enumerate(("v1", "v2", "v3", "v4")) for i in range(60) if (v, i) not in missing],
            "task string, compression_version string, row_id long, subject_id long, y_true int, risk_calibrated double",
        )

    roles = {"a1": "v1", "b1": "v2", "a2": "v3", "b2": "v4"}
    run = lambda df: sorted((r["metric"], round(r["point_interaction"], 12)) for r in bootstrap.interaction_bootstrap(df, roles, 3).collect())
    gone = {("v1", i) for i in range(20)}
    assert run(rows(gone)) == run(rows({(v, i) for v in ("v1", "v2", "v3", "v4") for i in range(20)}))
    with pytest.raises(DataContractError):
        bootstrap.interaction_bootstrap(rows({("v1", i) for i in range(30)} | {("v2", i) for i in range(30, 60)}), roles, 3)


def test_robustness_needs_both_versions(spark):
    rows = [("t", v, f, i, i % 4, 0, 0.1 + f * 0.1 + i / 100) for v in ("raw", "era") for f in (0.0, 0.5) for i in range(12)]
    schema = "task string, compression_version string, requested_copy_fraction double, row_id long, subject_id long, y_true int, risk_calibrated double"
    assert robustness.robustness_bootstrap(spark.createDataFrame(rows, schema), "raw", "era", 4).count() == 1
    with pytest.raises(DataContractError):
        robustness.robustness_bootstrap(spark.createDataFrame(rows[:-1], schema), "raw", "era", 4)


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(g, float(i)) for g in ("a", None) for i in range(11)], "g string, x double")
    assert {r.g: r.m for r in exact_percentiles(df, ["g"], "x", {"m": 0.5}).collect()} == {"a": 5.0, None: 5.0}
    assert average_ranks(df, ["g"], "x", "r").filter("r is null").count() == 0
    assert {r.g: r.n_valid for r in metrics.summarize_values(df, "x", ["g"]).collect()} == {"a": 11, None: 11}


def test_a_wide_header_hides_no_column(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(",".join(["filler_column"] * 8000 + ["subject_id"]) + "\n1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "with space.csv").write_text("a,b\r\n1,2\n")
    found = {r["file"]: r for r in report.safety_scan(report.file_manifest(spark, str(tmp_path))).collect()}
    assert set(found) == {"wide.csv", "with space.csv"} and not found["wide.csv"]["safe"] and found["with space.csv"]["header"].strip() == "a,b"


def test_calibration_reaches_its_optimum_or_fails(spark):
    df = spark.createDataFrame([("g", "tuning", (i % 40) / 10 - 2, int((i * 7) % 10 < 3 + (i % 40) / 10)) for i in range(400)], "g string, split string, logit double, y_true int")
    p = models.fit_platt(df, ["g"]).first()
    risk = 1 / (1 + F.exp(-(p["platt_coef"] * F.col("logit") + p["platt_intercept"])))
    g = df.agg(F.sum((risk - F.col("y_true")) * F.col("logit")).alias("a"), F.sum(risk - F.col("y_true")).alias("b")).first()
    assert abs(g["a"] + p["platt_coef"]) < 1e-6 and abs(g["b"]) < 1e-6
    with pytest.raises(DataContractError):
        models.fit_platt(df.withColumn("y_true", F.lit(1)), ["g"], most_steps=8)


def test_audit_cube_counts_what_the_single_audits_find(spark):
    """Random core rows with planted faults, nulls and repeats: nine counts, each against its own operator."""
    import random

    rng = random.Random(6)
    pick = lambda *v: rng.choice(v)
    rows = [
        (
            "label_reference" if name == "labels" else "other", name, pick("t", "u"), pick("v1", "v2"), "r", pick(None, *range(30)), pick(None, *range(12)),
            pick(None, "2024-01-01", "2024-01-02"), pick(None, 0, 1), pick("train", "train", "tuning", "held_out", "odd", None), "p",
        )
        for name in ("labels", "a", "b", "c") for _ in range(60)
    ]
    core = spark.createDataFrame(rows, "source_type string, source_name string, task string, version string, time_rule string, row_id long, subject_id long, prediction_time string, label int, split string, path string")
    official = spark.createDataFrame([(i, "train") for i in range(9)], "subject_id long, split string")
    got = {r.check_name: (r.status, r.n_issues) for r in splits.audit_status(core, official).collect()}
    cover = splits.coverage(core).filter("n_missing_label_examples_in_source > 0 or n_extra_source_examples_not_in_labels > 0").count()
    want = {
        "split_values_are_expected": splits.split_values(core).filter("not is_expected_split").count(),
        "duplicate_prediction_examples_inside_source": core.groupBy(*splits.ROW).count().filter("count > 1").count(),
        "patient_overlap_between_splits_inside_source": splits.subject_overlap(core).agg({"n_overlapping_subjects": "sum"}).first()[0],
        "subject_single_split_inside_source": splits.subject_multi_split(core).count(),
        "row_id_single_split_inside_source": splits.row_multi_split(core).count(),
        "source_split_matches_official_subject_splits": splits.official_mismatch(core, official).count(),
        "cross_source_subject_split_consistency": splits.cross_source_subjects(core).count(),
        "cross_source_row_mapping_consistency": splits.row_mapping(core).count(),
        "coverage_against_label_reference": cover,
    }
    assert got == {k: ("OK" if n == 0 else "WARN" if k.startswith("coverage") else "FAIL", n) for k, n in want.items()}
    empty = splits.audit_status(core.limit(0), official).collect()
    assert len(empty) == 9 and all(r.status == "OK" for r in empty)
