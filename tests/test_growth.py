"""What travels grows with events and episodes, not with their pairs."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from eraloom.operators import eras, history, metrics, sequences
from eraloom.plans.dataset import Representation, build_examples, prepare, represent, represent_packed

BACKFILL = Representation("b", "condition_era", "backfill", 16, 90)


@pytest.fixture(scope="module")
def made(spark):
    """Subjects with few and many events, listed and plain, episodes with and without history."""
    rng = np.random.default_rng(11)
    n = 3000
    start = pd.Timestamp("2001-01-01")
    subject = np.where(rng.random(n) < 0.4, 0, np.where(rng.random(n) < 0.3, 1, rng.integers(2, 60, n)))
    listed = rng.random(n) < np.where(subject == 1, 0.98, 0.4)
    pdf = pd.DataFrame({
        "subject_id": subject, "time": start + pd.to_timedelta(rng.integers(0, 3 * 365 * 4, n) * 6, unit="h"),
        "code": np.where(listed, rng.choice(["A", "B"], n), rng.choice(["C", "D", "E"], n)), "omop_table": "condition_occurrence",
        "numeric_value": rng.integers(0, 9, n).astype(float), "source_event_id": rng.permutation(n),
    })
    ask = pd.DataFrame({
        "task": "t", "row_id": range(300), "subject_id": rng.integers(0, 62, 300) * (rng.random(300) < 0.6),
        "prediction_time": start + pd.to_timedelta(rng.integers(-9, 1200, 300) * 24, unit="h"), "label": 0, "split": rng.choice(["train", "held_out"], 300),
    })
    events = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")).withColumn("text_value", F.lit("x"))
    labels = spark.createDataFrame(ask).withColumn("prediction_time", F.col("prediction_time").cast("timestamp_ntz"))
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    return events, labels, codes


def same(a, b):
    return a.count() == b.count() and not a.exceptAll(b).count()


@pytest.mark.parametrize("crowded", [4096, 20])
@pytest.mark.parametrize("inclusive", [True, False])
def test_backfill_by_chunks_equals_the_full_history(spark, made, monkeypatch, crowded, inclusive):
    monkeypatch.setattr(eras, "CROWDED", crowded)
    events, labels, codes = made
    t = prepare(events, labels, codes, inclusive=inclusive)
    full = history.episode_history(t.labels, t.ranked.drop("is_compressible", "event_rank", "plain_rank"), inclusive)
    want = history.cap_and_place(eras.condition_era(full, codes, 90), 16).select(*eras.LONG)
    assert same(represent(t, BACKFILL).select(*eras.LONG), want)
    window = history.raw_window(t.cutoffs(90), t.ranked, 16)
    assert same(window.select(*history.HISTORY), history.last_n(full, 16, history.RAW_ORDER).select(*history.HISTORY))


def test_no_pairs_of_episode_and_token_are_moved(made):
    t = prepare(*made)
    for spec in (BACKFILL, Representation("r", "raw", "raw", 16)):
        plan = represent(t, spec)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(row_id", plan)


def test_packed_tokens_are_encoded_like_long_ones(spark, made):
    t = prepare(*made)
    packed = represent_packed(t, BACKFILL)
    long = eras.unpack(packed)
    vocab = sequences.build_vocab(long).filter("code not like '%COUNT_BIN%'")
    want = sequences.collect_sequences(sequences.encode_tokens(long, vocab))
    assert same(sequences.encode_packed(packed, vocab).select(*want.columns), want)
    examples, _, _ = build_examples(t, BACKFILL)
    assert examples.count() == 300 and examples.filter("seq_len = 0").count() and not examples.filter("seq_len <> final_seq_len").count()


def test_top_fraction_never_broadcasts_its_rows(spark, tmp_path):
    """A score table that is small on disk may still have too many rows for the driver."""
    df = spark.range(60_000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"), (F.rand(3) * 500).cast("int").cast("double").alias("p"))
    df.write.parquet(f"{tmp_path}/scores")
    df = spark.read.parquet(f"{tmp_path}/scores")
    out = metrics.top_fraction(df, ["g"], 0.1, "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan
    first = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("p"), "row_id"))
    want = df.withColumn("n", first).select("row_id", "g", "p", (F.col("n") <= 2000).alias("in_top"))
    assert same(out, want)
    assert metrics.top_fraction(df, ["g"], 1.5, "p").filter("in_top").count() == 60_000


def test_events_move_once_into_the_timeline(spark, made, tmp_path):
    """By subject and day; visits at one time are one, and count for events of that time whatever their order."""
    events, _, codes = made
    events = events.withColumn("code", F.when(F.col("source_event_id") % 7 == 0, "Visit/x").otherwise(F.col("code")))
    events = events.withColumn("omop_table", F.when(F.col("source_event_id") % 7 == 0, "visit_occurrence").otherwise(F.col("omop_table")))
    events = history.canonical_events(events.unionByName(events.withColumn("source_event_id", F.col("source_event_id") + 3000)))
    out = history.timeline_events(events, codes)
    want = history.ranked_events(history.bucket_events(events, history.visit_anchors(events)), codes)
    assert same(out.select(*want.columns), want)
    events.write.parquet(f"{tmp_path}/events")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = history.timeline_events(spark.read.parquet(f"{tmp_path}/events"), codes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(subject_id#\d+L?, time#", plan)
