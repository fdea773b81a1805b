"""A subject's events lie in one place unless they are very many."""

from pyspark.sql import functions as F

from eraloom.operators import eras, history
from tests.test_growth import made, prepare, same  # noqa: F401


def with_visits(events):
    visit = F.pmod(F.xxhash64("source_event_id"), F.lit(7)) == 0
    twice = events.filter(visit & (F.col("source_event_id") % 3 == 0)).withColumn("source_event_id", F.col("source_event_id") + 100_000)
    return events.unionByName(twice).withColumn("omop_table", F.when(visit, "visit_occurrence").otherwise(F.col("omop_table"))).withColumn(
        "code", F.when(visit, F.concat(F.lit("Visit/"), "code")).otherwise(F.col("code"))
    )


def test_busy_subjects_are_cut_into_days_without_a_difference(made):  # noqa: F811
    events, _, codes = made
    e = history.canonical_events(with_visits(events))
    want = history.ranked_events(history.bucket_events(e, history.visit_anchors(e)), codes)
    whole = history.timeline_events(e, codes)
    assert same(whole.select(*want.columns), want)
    for alone in (0, 30):
        assert same(history.timeline_events(e, codes, alone=alone).select(*want.columns), want)


def test_events_move_once_into_the_timeline(made):  # noqa: F811
    events, _, codes = made
    t = history.timeline_events(history.canonical_events(events), codes)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(subject_id") == 1, plan


def test_points_and_cutoffs_of_busy_subjects_are_the_same(made, monkeypatch):  # noqa: F811
    events, labels, codes = made
    t = prepare(with_visits(events), labels, codes)
    labels = labels.unionByName(labels.limit(3)).unionByName(labels.limit(2).withColumn("prediction_time", F.lit(None).cast("timestamp_ntz")))
    made_in_one_place = {}
    for alone in (eras.ALONE, 0):
        monkeypatch.setattr(eras, "ALONE", alone)
        points = eras.subject_points(t.ranked, 90)
        cuts = [eras.episode_cutoffs(labels, t.ranked, p, inclusive) for p in (points, None) for inclusive in (True, False)]
        made_in_one_place[alone] = [points, *cuts]
        assert (points._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1) == (alone > 0)
    for got, want in zip(*made_in_one_place.values()):
        assert got.dtypes == want.dtypes and same(got, want)
