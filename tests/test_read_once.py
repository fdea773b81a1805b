"""Checks read what is written once and ask the timeline for no more than they need."""

from eraloom.catalog import dataset, shared
from eraloom.plans.dataset import Timeline


def test_structure_null_tokens_are_worked_out_once(spark, sf_dir, monkeypatch):
    shared.forget()
    seen = []
    make = dataset.represent_packed
    monkeypatch.setattr(dataset, "represent_packed", lambda t, spec, *a: seen.append(spec.window_mode) or make(t, spec, *a))
    assert dataset.structure_checks(spark, sf_dir).columns == ["check", "n_violations", "passed"]
    assert sorted(seen) == ["backfill", "structure_null"]


def test_raw_windows_need_no_points(spark, sf_dir, monkeypatch):
    shared.forget()
    monkeypatch.setattr(Timeline, "points", lambda *_: 1 / 0)
    assert dataset.no_backfill_checks(spark, sf_dir).columns == ["check", "n_violations", "passed"]
