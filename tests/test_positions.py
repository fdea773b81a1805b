"""Positions go on where the join makes the pairs."""

from eraloom.catalog import dataset


def test_positions_write_no_history(spark, sf_dir, monkeypatch):
    def hist(*_):
        raise AssertionError("the full history is written")

    monkeypatch.setattr(dataset, "hist", hist)
    assert dataset.positions(spark, sf_dir).filter("n > 64 or n < 1").isEmpty()
