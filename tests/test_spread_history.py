"""Histories for steps that go on by episode: nothing lost at busy subjects, and pairs stay where the join makes them."""

import pytest
from pyspark.sql import functions as F

from eraloom.operators import eras, history
from eraloom.schemas import EPISODE_KEY


@pytest.fixture(scope="module")
def tables(spark):
    day = F.expr("timestampadd(DAY, n, timestamp_ntz'2020-01-01')")
    # Subject 0 has half of the events and of the episodes.
    subject = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("subject_id")
    events = spark.range(400).withColumn("n", (F.col("id") * 37 % 600).cast("int")).select(
        subject.cast("long"), day.alias("time"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("id") % 3 + 1).cast("int")).alias("code"),
        F.col("id").cast("float").alias("numeric_value"), F.lit(None).cast("string").alias("text_value"),
        F.concat(F.lit("day="), F.col("n")).alias("compression_bucket"), F.col("id").alias("source_event_id"),
    ).withColumn("is_compressible", F.col("code").isin("A", "B"))
    labels = spark.range(60).withColumn("n", (F.col("id") * 11 % 500 + 50).cast("int")).select(
        F.col("id").alias("row_id"), F.lit("t").alias("task"), subject.cast("long"), day.alias("prediction_time"),
        F.lit(1).alias("label"), F.lit("train").alias("split"),
    )
    return labels, events


@pytest.mark.parametrize("together", [4, 2048])
@pytest.mark.parametrize("inclusive", [True, False])
def test_spread_history_equals_episode_history(spark, tables, together, inclusive):
    labels, events = tables
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    full = history.episode_history(labels, events, inclusive)
    spread = history.spread_history(labels, events, inclusive, together)
    assert full.count() > 1000 and not full.exceptAll(spread.select(*history.HISTORY)).count() and spread.count() == full.count()
    assert (spread.select("part").distinct().count() > 1) == (together == 4)
    want = eras.condition_era(full, codes, 30)
    got = eras.condition_era(spread, codes, 30, history.SPREAD_KEY).select(*want.columns)
    assert not want.exceptAll(got).count() and not got.exceptAll(want).count()


@pytest.mark.parametrize("together", [4, 2048])
def test_eras_of_spread_histories_move_no_pairs(spark, tables, together):
    """Only episodes and events are exchanged, on both sides of the joins."""
    labels, events = tables
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        spread = history.spread_history(labels, events, together=together)
        days = eras.era_days(eras.first_mentions(spread.filter("is_compressible"), history.SPREAD_KEY), history.SPREAD_KEY, 30)
        plan = eras.era_summary(days, history.SPREAD_KEY)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") <= 2 and EPISODE_KEY[0] in plan
