"""Rows of packed episodes: the steps that make the arrays run once."""

from eraloom.operators import eras
from eraloom.plans.dataset import Representation, represent
from tests.test_growth import made, prepare, same  # noqa: F401


def test_unpacking_does_not_ask_for_the_size_of_an_array_still_to_be_made(made):  # noqa: F811
    t = prepare(*made)
    spec = Representation("n", "condition_era", "no_backfill", 16, 90)
    long = represent(t, spec)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert "(size(" not in "".join(line for line in plan.splitlines() if "Filter" in line)
    empty = eras.packed_no_backfill(t.reach(), t.ranked, 90, 16)
    assert empty.filter("size(s) = 0").count() and same(eras.unpack(empty), long)
