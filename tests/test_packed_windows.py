"""Representations and audits that are worked out inside each episode's own row."""

import re

from pyspark.sql import functions as F

from eraloom.operators import audit, eras, history
from eraloom.plans.dataset import Representation, build_examples, represent
from tests.test_growth import BACKFILL, made, prepare, same  # noqa: F401

RAW = Representation("r", "raw", "raw", 16)
NO_BACKFILL = Representation("n", "condition_era", "no_backfill", 16, 90)
STRUCTURE_NULL = Representation("s", "condition_era", "structure_null", 16, 90)


def test_eras_inside_a_row_are_those_of_the_window(made):  # noqa: F811
    t = prepare(*made)
    window = history.raw_window(t.reach(), t.ranked, 16)
    for gap in (3, 90):
        tokens = eras.condition_era(window, t.codes, gap)
        want = history.cap_and_place(tokens, 16).select(*eras.LONG)
        spec = Representation("n", "condition_era", "no_backfill", 16, gap)
        assert same(represent(t, spec).select(*eras.LONG), want)
        totals = audit.transform_audit(tokens, ["row_id", "task"])
        packed = eras.packed_no_backfill(t.reach().filter("n_events > 0"), t.ranked, gap, 16)
        assert same(packed.select("row_id", "task", *audit.transform_totals(False, "in_window.")), totals)


def test_structure_null_inside_a_row(made):  # noqa: F811
    t = prepare(*made)
    want = eras.structure_null(represent(t, BACKFILL), 90)
    got = represent(t, STRUCTURE_NULL)
    assert got.filter("role_order > 0").count() and same(got.select(*want.columns), want)


def test_examples_meet_their_audits_without_moving(made):  # noqa: F811
    """Once the packed tokens are written, an example is read off its own row."""
    t = prepare(*made)
    n = t.labels.count()
    for spec in (RAW, BACKFILL, NO_BACKFILL, STRUCTURE_NULL):
        examples, _, _ = build_examples(t, spec)
        assert not re.search(r"hashpartitioning\((row_id|subject_id|task)|SortMergeJoin", examples._jdf.queryExecution().executedPlan().toString())
        rows = examples.agg(F.count("*").alias("n"), F.count_if(F.col("seq_len") == 0).alias("empty"), F.count_if(F.col("seq_len") != F.col("final_seq_len")).alias("bad")).first()
        assert (rows.n, rows.bad) == (n, 0) and rows.empty
