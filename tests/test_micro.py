"""Small inputs with answers worked out by hand."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from eraloom.functions.ordered import exact_percentiles
from eraloom.functions.scalar import blake2b_hash
from eraloom.operators import bootstrap, eras, history, metrics, perturb, robustness
from eraloom.plans.dataset import Representation, build_examples, prepare
from eraloom.schemas import DataContractError, require_unique

EVENT = "subject_id long, time timestamp_ntz, code string, omop_table string, numeric_value float, text_value string, source_event_id long"


def at(text):
    return dt.datetime.fromisoformat(text)


def events(spark, rows):
    return spark.createDataFrame([(1, at(t), c, k, v, None, i) for t, c, k, v, i in rows], EVENT)


def labels(spark, rows):
    return spark.createDataFrame(
        [("t", r, s, at(p), y, split) for r, s, p, y, split in rows],
        "task string, row_id long, subject_id long, prediction_time timestamp_ntz, label int, split string",
    )


A_CODE = [
    ("2024-01-01 08:00", "A", "condition_occurrence", None, 1), ("2024-01-01 20:00", "A", "condition_occurrence", None, 2),
    ("2024-03-31 07:00", "A", "condition_occurrence", None, 3), ("2024-06-30 06:00", "A", "condition_occurrence", None, 4),
    ("2024-10-01 00:00", "A", "condition_occurrence", None, 5), ("2024-02-01 00:00", "B", "measurement", 5.0, 6),
]


@pytest.fixture(scope="module")
def built(spark):
    codes = spark.createDataFrame([("A",)], "code string")
    t = prepare(events(spark, A_CODE), labels(spark, [(7, 1, "2024-12-31", 1, "train")]), codes)
    return t, build_examples(t, Representation("b", "condition_era", "backfill", 16, 90))


def test_eras_use_whole_days(built):
    _, (_, _, long) = built
    got = [
        (r.event_position, r.code, r.time, r.numeric_value, r.days_before_prediction, r.order_anchor_id, r.role_order)
        for r in long.orderBy("event_position").collect()
    ]
    assert got == [
        (1, "DX_ERA90_START/A", at("2024-01-01 08:00"), 0.0, 364.0, 1, 10), (2, "B", at("2024-02-01 00:00"), 5.0, 334.0, 6, 0),
        (3, "DX_ERA90_END/A", at("2024-06-30 06:00"), 180.0, 183.0, 4, 20),
        (4, "DX_ERA90_COUNT_BIN/3_5/A", at("2024-06-30 06:00"), 3.0, 183.0, 4, 30), (5, "A", at("2024-10-01 00:00"), None, 91.0, 5, 0),
    ]


def test_era_audit_counts(built):
    _, (examples, _, _) = built
    r = examples.first()
    assert (r.transformation_input_len, r.transformed_history_len, r.n_condition_eras, r.n_compressed_eras) == (6, 5, 2, 1)
    assert (r.n_repeats_removed, r.n_visit_day_duplicates_removed, r.n_era_repeat_mentions_removed) == (3, 1, 2)
    assert r.persistent_events_accounted_by_transform == 5


def test_structure_null_keeps_positions(built):
    _, (_, _, long) = built
    got = eras.structure_null(long, 90).orderBy("event_position").collect()
    assert [(r.event_position, r.code, r.numeric_value) for r in got] == [
        (1, "A", None), (2, "B", 5.0), (3, "A", None), (4, "A", None), (5, "A", None)
    ]


def test_huge_gap_gives_one_era(spark, built):
    t, _ = built
    h = history.episode_history(t.labels, t.ranked.drop("is_compressible", "event_rank", "plain_rank"))
    tokens = eras.condition_era(h, t.codes, 100000)
    assert tokens.filter("is_compression_token").count() == 3 and tokens.count() == 4


def test_visit_covers_hours_cut_to_whole(spark):
    rows = [
        ("2024-01-01 00:00", "Visit/x", "visit_occurrence", None, 1), ("2024-01-01 00:00", "A", "condition_occurrence", None, 2),
        ("2024-01-02 00:59", "A", "condition_occurrence", None, 3), ("2024-01-02 01:00", "A", "condition_occurrence", None, 4),
        ("2023-12-31 23:59", "A", "condition_occurrence", None, 5),
    ]
    e = history.canonical_events(events(spark, rows))
    want = {2: "reconstructed_visit=0", 3: "reconstructed_visit=0", 4: "day=2024-01-02", 5: "day=2023-12-31"}
    for b in (history.bucket_events(e, history.visit_anchors(e)), history.timeline_events(e, spark.createDataFrame([("A",)], "code string"))):
        assert {r.source_event_id: r.compression_bucket for r in b.filter("code = 'A'").collect()} == want


def test_empty_history_keeps_the_example(spark):
    codes = spark.createDataFrame([("A",)], "code string")
    t = prepare(events(spark, A_CODE), labels(spark, [(7, 1, "2020-01-01", 1, "train"), (8, 99, "2024-12-31", 0, "train")]), codes)
    for spec in (Representation("r"), Representation("b", "condition_era", "backfill", 16, 90), Representation("n", "condition_era", "no_backfill", 16, 90)):
        ex, _, _ = build_examples(t, spec)
        assert [(r.seq_len, r.token_ids, r.codes, r.covered_days) for r in ex.collect()] == [(0, [], [], None)] * 2


def scored(spark, rows):
    return spark.createDataFrame(rows, "g string, row_id long, subject_id long, y_true int, p double, weight double")


def test_metrics_with_ties(spark):
    rows = [("g", 1, 1, 1, 0.9, 1.0), ("g", 2, 2, 0, 0.9, 1.0), ("g", 3, 3, 1, 0.4, 1.0), ("g", 4, 4, 0, 0.1, 1.0)]
    m = metrics.risk_metrics(scored(spark, rows), ["g"], score="p").first()
    assert m.auroc == pytest.approx(0.625) and m.auprc == pytest.approx(0.5833333)
    assert m.brier == pytest.approx(0.2975) and m.logloss == pytest.approx(0.857400, abs=1e-6)
    assert (m.top_10pct_k, m.top_10pct_precision, m.top_10pct_lift, m.top_10pct_capture) == (1, 1, 2, 0.5)


def test_one_class_group_has_no_ranking(spark):
    m = metrics.risk_metrics(scored(spark, [("g", 1, 1, 0, 0.9, 1.0), ("g", 2, 2, 0, 0.1, 1.0)]), ["g"], score="p").first()
    assert m.auroc is None and m.auprc is None and m.top_10pct_lift is None and m.brier == pytest.approx(0.41)


def test_weighted_top_cuts_the_boundary_row(spark):
    rows = [("g", 1, 1, 1, 0.9, 0.5), ("g", 2, 1, 0, 0.8, 0.5), ("g", 3, 2, 1, 0.1, 1.0)]
    m = metrics.weighted_top(scored(spark, rows), ["g"], 0.5, score="p").first()
    assert m.top_50pct_precision == pytest.approx(0.5) and m.top_50pct_capture == pytest.approx(1 / 3) and m.top_50pct_lift == pytest.approx(2 / 3)


def test_quantile_flavours(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 10)], "g string, v double")
    assert exact_percentiles(df, ["g"], "v", {"q": 0.9}, "nearest").first().q == 10
    assert exact_percentiles(df, ["g"], "v", {"q": 0.9}).first().q == pytest.approx(7.9)


def test_fractions_are_nested(spark):
    plan = spark.createDataFrame([("t", 1, i, 3) for i in range(3)], "task string, row_id long, eligible_rank long, n_eligible_visits long")
    got = perturb.select_fraction(plan).groupBy("requested_copy_fraction").agg(F.sort_array(F.collect_list("eligible_rank")).alias("r"))
    assert {r.requested_copy_fraction: r.r for r in got.collect()} == {0.25: [0], 0.5: [0, 1], 1.0: [0, 1, 2]}


def test_top_membership_shares(spark):
    rows = []
    for i in range(1, 21):
        rows.append(("t", "v", 0.0, i, i, 0, 1.0 if i in (1, 2) else 0.1))
        rows.append(("t", "v", 1.0, i, i, 0, 1.0 if i in (2, 3) else 0.1))
    pred = spark.createDataFrame(rows, "task string, compression_version string, requested_copy_fraction double, row_id long, subject_id long, y_true int, risk_calibrated double")
    s = robustness.top_stability(robustness.top_membership(pred)).filter("requested_copy_fraction = 1").first()
    assert (s.retention_fraction, s.churn_fraction, s.n_entered, s.n_exited) == (0.5, 0.5, 1, 1) and s.jaccard == pytest.approx(1 / 3)
    zero = robustness.top_stability(robustness.top_membership(pred)).filter("requested_copy_fraction = 0").first()
    assert (zero.retention_fraction, zero.churn_fraction) == (1.0, 0.0)


def test_single_seed_has_zero_spread(spark):
    df = spark.createDataFrame([(1, 42, 0.3)], "row_id long, seed int, p double")
    assert metrics.ensemble(df, ["row_id"], {"p": "p"}, "p").first().p_std == 0.0


def test_draws_sum_to_the_number_of_clusters(spark):
    d = bootstrap.cluster_draws(spark, 17, 30, 42).groupBy("rep").agg(F.sum("mult").alias("n"))
    assert [r.n for r in d.collect()] == [17] * 30


def test_digest_matches_hashlib(spark):
    got = spark.range(3).select(blake2b_hash(5, F.lit("t"), "id").alias("h")).collect()
    assert [r.h for r in got] == [hashlib.blake2b(f"5|t|{i}".encode(), digest_size=8).hexdigest() for i in range(3)]


def test_guard_reports_repeated_keys(spark):
    with pytest.raises(DataContractError):
        require_unique(spark.createDataFrame([(1,), (1,)], "subject_id long"), ["subject_id"])


def test_interval_of_nan_free_values(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (math.inf,), (None,)], "x double")
    r = metrics.summarize_values(df, "x").first()
    assert (r.mean, r.n_valid) == (2.0, 2) and r.ci_low == pytest.approx(1.05)


def test_no_copies_is_the_plain_rebuild(spark):
    """Fraction 0 of a perturbed history equals the unperturbed representation."""
    rows = [("2024-01-%02d 00:00" % k, "Visit/x", "visit_occurrence", None, 100 + k) for k in range(1, 20)]
    rows += [("2024-01-%02d 01:00" % k, "A", "condition_occurrence", None, k) for k in (2, 5, 9)]
    rows += [("2024-01-%02d 02:00" % k, "B", "condition_occurrence", None, 50 + k) for k in (3, 4, 17)]
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    t = prepare(events(spark, rows), labels(spark, [(7, 1, "2024-12-31", 1, "held_out")]), codes)
    h = history.episode_history(t.labels, t.ranked.drop("is_compressible", "event_rank", "plain_rank"))
    plan, visits = perturb.candidate_plan(t)
    assert plan.count() == 1 and visits.count() == plan.first().n_eligible_visits > 1
    long = perturb.perturbed_long(t, plan, perturb.select_fraction(visits), 30, 3).select("requested_copy_fraction", "event_position", "code")
    plain = history.cap_and_place(eras.condition_era(h, codes, 3), 30).select("event_position", "code")
    zero = long.filter("requested_copy_fraction = 0").drop("requested_copy_fraction")
    assert zero.count() == plain.count() and not zero.exceptAll(plain).count()
    assert long.filter("requested_copy_fraction = 1").drop("requested_copy_fraction").exceptAll(plain).count()
