import os

from eraloom.catalog import perturbation, shared
from eraloom.session import materialize


def test_intermediates_are_written_with_zstd(spark):
    df = materialize(spark.range(100).selectExpr("id", "cast(id as string) as text"))
    assert df.count() == 100
    assert all(".zstd." in os.path.basename(f) for f in df.inputFiles())


def test_held_out_scores_write_no_table_of_all_scores(spark, sf_dir):
    shared.forget()
    held = perturbation.held_scores(spark, sf_dir)
    assert set(r["split"] for r in held.select("split").distinct().collect()) == {"held_out"}
    assert not [name for _, _, name in shared._made if name == "scores"]


def test_ensemble_keeps_what_its_readers_need(spark, sf_dir):
    shared.forget()
    assert not {"risk_calibrated_std", "n_seeds"} & set(perturbation.perturbed_ensemble(spark, sf_dir).columns)
