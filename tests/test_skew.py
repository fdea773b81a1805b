"""One key holds a large share of the rows: results stay exact and tasks stay small."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eraloom.functions.ordered import add_segment, asof_backward, calendar_day, exact_percentiles, fit_splits, global_row_number, running
from eraloom.operators import bootstrap, eras, history, metrics, resample
from eraloom.plans.dataset import Representation, prepare, represent
from eraloom.schemas import EPISODE_KEY


@pytest.fixture(scope="module")
def hot_events(spark):
    """Subject 0 owns two thirds of all events, over years and with many repeats."""
    rng = np.random.default_rng(3)
    n = 3000
    subject = np.where(rng.random(n) < 0.67, 0, rng.integers(1, 40, n))
    start = pd.Timestamp("2020-01-01")
    code = rng.choice(["A", "B", "C", "Visit/x"], n, p=[0.35, 0.25, 0.3, 0.1])
    pdf = pd.DataFrame({
        "subject_id": subject, "time": start + pd.to_timedelta(rng.integers(0, 3 * 365 * 24, n), unit="h"), "code": code,
        "omop_table": np.where(code == "Visit/x", "visit_occurrence", "condition_occurrence"), "numeric_value": rng.random(n).astype("float32"),
        "source_event_id": rng.permutation(n),
    })
    return spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")), pdf


@pytest.fixture(scope="module")
def hot_labels(spark):
    rng = np.random.default_rng(4)
    n = 120
    pdf = pd.DataFrame({
        "row_id": np.arange(n), "task": "t", "subject_id": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n)),
        "prediction_time": pd.Timestamp("2020-06-01") + pd.to_timedelta(rng.integers(0, 2 * 365 * 24, n), unit="h"),
        "label": rng.integers(0, 2, n), "split": rng.choice(["train", "held_out"], n),
    })
    return spark.createDataFrame(pdf).withColumn("prediction_time", F.col("prediction_time").cast("timestamp_ntz"))


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("gap", [1, 30])
def test_validity_tokens_equal_rebuilt_histories(spark, hot_events, hot_labels, inclusive, gap):
    codes = spark.createDataFrame([("A",), ("B",)], "code string")
    t = prepare(hot_events[0], hot_labels, codes, inclusive=inclusive)
    fast = represent(t, Representation("b", "condition_era", "backfill", 40, gap))
    full = history.episode_history(t.labels, t.ranked.drop("is_compressible", "event_rank", "plain_rank"), inclusive)
    slow = history.cap_and_place(eras.condition_era(full, codes, gap), 40)
    text = [F.col(c).cast("string").alias(c) for c in eras.LONG]
    a, b = fast.select(*text), slow.select(*text)
    assert a.count() > 1000 and not a.exceptAll(b).count() and not b.exceptAll(a).count()


def test_raw_window_equals_last_n(spark, hot_events, hot_labels):
    codes = spark.createDataFrame([("A",)], "code string")
    t = prepare(hot_events[0], hot_labels, codes)
    full = history.episode_history(t.labels, t.ranked.drop("is_compressible", "event_rank", "plain_rank"))
    want = history.last_n(full, 25, history.RAW_ORDER).select("row_id", "source_event_id")
    got = history.raw_window(t.cutoffs(None), t.ranked, 25).select("row_id", "source_event_id")
    assert got.count() == want.count() and not got.exceptAll(want).count()


def test_asof_matches_pandas(spark, hot_events):
    df, pdf = hot_events
    visits = df.filter("code = 'Visit/x'").select("subject_id", F.col("time").alias("visit_time")).distinct()
    got = asof_backward(df.select("subject_id", "time", "source_event_id"), visits, "subject_id", "time", "visit_time", []).toPandas()
    right = pdf[pdf.code == "Visit/x"][["subject_id", "time"]].drop_duplicates().rename(columns={"time": "visit_time"}).sort_values("visit_time")
    want = pd.merge_asof(pdf.sort_values("time"), right, left_on="time", right_on="visit_time", by="subject_id")
    joined = got.merge(want, on="source_event_id", suffixes=("", "_w"))
    assert len(joined) == len(pdf) and (joined.visit_time.fillna(pd.Timestamp(0)) == joined.visit_time_w.fillna(pd.Timestamp(0))).all()


def test_segments_of_a_hot_group_are_small(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("g"), (F.rand(5) ** 8).alias("v"))
    splits = fit_splits(df, ["v"], 32)["v"]
    largest = add_segment(df, "v", splits, "s").groupBy("g", "s").count().agg(F.max("count")).first()[0]
    assert largest < 30000 / 32 * 1.2


def test_running_and_percentiles_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(rng.random(4000) < 0.7, 0, rng.integers(1, 9, 4000)), "v": rng.integers(0, 300, 4000).astype(float), "id": range(4000)})
    df = spark.createDataFrame(pdf)
    splits = fit_splits(df, ["id"], 16)["id"]
    got = running(add_segment(df, "id", splits, "s"), ["g"], ["id"], "s", ["v"], totals=True).toPandas().sort_values("id")
    assert np.allclose(got.cum_v, pdf.groupby("g").v.cumsum()) and np.allclose(got.tot_v, pdf.groupby("g").v.transform("sum"))
    q = exact_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.95}).toPandas().set_index("g").sort_index()
    assert np.allclose(q.a, pdf.groupby("g").v.quantile(0.25)) and np.allclose(q.b, pdf.groupby("g").v.quantile(0.95))


def test_global_rank_is_dense(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    r = global_row_number(df.repartition(7), [F.col("k")]).toPandas().sort_values("row_number")
    assert list(r.row_number) == list(range(1, 5001)) and r.k.is_monotonic_increasing


def brute(y, p, ident, w):
    """Metrics by definition, over all pairs and a sorted list."""
    order = sorted(range(len(y)), key=lambda i: (-p[i], ident[i]))
    pos, neg = [i for i in range(len(y)) if y[i] == 1], [i for i in range(len(y)) if y[i] == 0]
    wins = sum(w[i] * w[j] * (1.0 if p[i] > p[j] else 0.5 if p[i] == p[j] else 0.0) for i in pos for j in neg)
    auc = wins / (sum(w[i] for i in pos) * sum(w[j] for j in neg))
    ap, total_pos = 0.0, sum(w[i] for i in pos)
    for s in sorted(set(p), reverse=True):
        tp = sum(w[i] for i in pos if p[i] >= s)
        seen = sum(w[i] for i in range(len(y)) if p[i] >= s)
        here = sum(w[i] for i in pos if p[i] == s)
        ap += here / total_pos * tp / seen if seen else 0.0
    k = max(1, np.ceil(0.1 * sum(w)))
    left, hit = k, 0.0
    for i in order:
        take = min(w[i], left)
        hit, left = hit + take * y[i], left - take
    return auc, ap, hit / k


def test_metrics_match_brute_force_with_hot_ties(spark):
    rng = np.random.default_rng(7)
    n = 400
    y = rng.integers(0, 2, n)
    p = np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n), 2))  # one score holds 40 % of the rows
    w = rng.integers(1, 4, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "row_id": range(n), "y_true": y, "p": p, "w": w}))
    m = metrics.risk_metrics(df, ["g"], score="p", weight="w").first()
    want = brute(list(y), list(p), list(range(n)), list(w))
    assert (m.auroc, m.auprc, m.top_10pct_precision) == pytest.approx(want)
    order = np.lexsort((np.arange(n), -p))
    total, pos = w.sum(), w @ y
    nothing = {k: np.zeros(1) for k in ("above_w", "above_p", "level_w", "level_p", "prior_w")} | {"all_w": np.array([total]), "all_p": np.array([pos])}
    b = resample.segment_sums(p[order], y[order].astype(float), w[order][:, None], False, nothing, False)
    assert (b["auc"][0] / pos / (total - pos), b["ap"][0] / pos, b["top"][0] / np.ceil(0.1 * total)) == pytest.approx(want)


def sided_rows(spark, n=300, levels=100, seed=9):
    """Both sides of a comparison; one subject holds a third of the rows."""
    rng = np.random.default_rng(seed)
    base = pd.DataFrame({"row_id": range(n), "subject_id": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 60, n)), "y_true": rng.integers(0, 2, n)})
    return pd.concat([base.assign(side=s, score=np.floor(rng.random(n) * levels) / levels, comparison="c", task="t") for s in "ab"])


@pytest.mark.parametrize("levels, cells, equal", [(100, 8_000_000, False), (100, 2000, True), (3, 2000, False), (1, 2000, False)])
def test_replicates_equal_weighted_score_tables(spark, monkeypatch, levels, cells, equal):
    """Merged ranking states give what the score tables of the drawn rows give, in one segment and in many, with heavy ties."""
    monkeypatch.setattr(resample, "SEGMENT_CELLS", cells)
    df = spark.createDataFrame(sided_rows(spark, levels=levels))
    keys, n_rep = ["comparison", "task"], 70
    rows = metrics.equal_subject_weights(df, [*keys, "side"]) if equal else df
    got = resample.replicate_metrics(rows, keys, n_rep, 42, "weight" if equal else None, equal, 1e-6 if equal else None).toPandas()
    assert len(got) == 2 * (n_rep + 1)
    drawn = rows.join(bootstrap.comparison_draws(df, n_rep, 42), [*keys, "subject_id"])
    observed = rows.withColumn("rep", F.lit(-1).cast("long")).withColumn("mult", F.lit(1).cast("long"))
    both = drawn.unionByName(observed.select(*drawn.columns)).withColumn("mw", F.col("mult") * F.col("weight") if equal else F.col("mult").cast("double"))
    want = metrics.risk_metrics(
        both, [*keys, "rep", "side"], score="score", weight="mw", weighted_top=equal, rank_clip=1e-6 if equal else None
    ).toPandas()
    got, want = (x.sort_values(["rep", "side"]).reset_index(drop=True) for x in (got, want))
    for m in metrics.PREDICTIVE_METRICS:
        assert np.allclose(got[m], want[m], equal_nan=True), m


def test_segments_are_bounded_when_one_score_holds_all_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "SEGMENT_CELLS", 2000)
    df = spark.createDataFrame(sided_rows(spark, levels=1))
    scores, heavy, ids = resample._cuts(df, 70)
    assert heavy and len(ids) >= 600 * 70 // 2000 - 2


def test_top_fraction_flags_each_row_once(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("row_id"), F.when(F.col("id") < 400, 0.9).otherwise(0.1).alias("p"))
    out = metrics.top_fraction(df, ["g"], 0.1, "p")
    assert out.count() == 1000 and sorted(r.row_id for r in out.filter("in_top").collect()) == list(range(100))


def test_no_cross_product_in_headline_plans(spark, hot_events, hot_labels):
    codes = spark.createDataFrame([("A",)], "code string")
    t = prepare(hot_events[0], hot_labels, codes)
    for mode, kind in (("raw", "raw"), ("backfill", "condition_era"), ("no_backfill", "condition_era")):
        plan = represent(t, Representation("x", kind, mode, 32, 30))._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_day_blocks_of_a_range_hold_exactly_its_days(spark):
    rng = np.random.default_rng(2)
    top = (1 << eras.DAY_LEVELS) - 1
    ends = [(0, top), (0, 0), (top, top), (5, 5), (1, top)] + [tuple(sorted(rng.integers(0, top + 1, 2).tolist())) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ends)], "i int, a long, b long")
    blocks = df.select("i", F.explode(eras.day_nodes(F.col("a"), F.col("b"))).alias("node"))
    assert blocks.groupBy("i").count().agg(F.max("count")).first()[0] <= 2 * eras.DAY_LEVELS
    near = sorted({d for a, b in ends for d in (a - 1, a, (a + b) // 2, b, b + 1) if 0 <= d <= top})
    days = spark.createDataFrame([(d,) for d in near], "d long").select("d", F.explode(eras.nodes_of_day(F.col("d"))).alias("node"))
    met = {}
    for r in days.join(blocks, "node").select("i", "d").collect():
        met[r.i, r.d] = met.get((r.i, r.d), 0) + 1
    assert met == {(i, d): 1 for i, (a, b) in enumerate(ends) for d in near if a <= d <= b}


def test_episodes_of_a_listed_heavy_subject_meet_held_tokens_only(spark):
    """A subject with half of all rows, 99 in 100 of them mentions of listed codes: pairs grow with eras, not with mentions."""
    rng = np.random.default_rng(5)
    n = 8000
    start = pd.Timestamp("2000-01-01")
    heavy = rng.random(n) < 0.5
    pdf = pd.DataFrame({
        "subject_id": np.where(heavy, 0, rng.integers(1, 200, n)), "time": start + pd.to_timedelta(rng.integers(0, 10 * 365 * 24, n), unit="h"),
        "code": np.where(rng.random(n) < 0.99, rng.choice(["A", "B"], n), "C"), "omop_table": "condition_occurrence",
        "numeric_value": 0.0, "source_event_id": rng.permutation(n),
    })
    ask = pd.DataFrame({"task": "t", "row_id": range(100), "subject_id": 0, "prediction_time": start + pd.to_timedelta(rng.integers(365, 3650, 100), unit="D"), "label": 0, "split": "held_out"})
    events = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz")).withColumn("text_value", F.lit(None).cast("string"))
    labels = spark.createDataFrame(ask).withColumn("prediction_time", F.col("prediction_time").cast("timestamp_ntz"))
    t = prepare(events, labels, spark.createDataFrame([("A",), ("B",)], "code string"))
    held = eras.held_tokens(t.bounds(90, 64), eras.validity_tokens(t.ranked, t.points(90), 90), 64)
    assert held.groupBy("row_id").count().agg(F.max("count")).first()[0] < 64 + 64
    full = history.episode_history(t.labels, t.ranked.drop("is_compressible", "event_rank", "plain_rank"))
    want = history.cap_and_place(eras.condition_era(full, t.codes, 90), 64).select(*eras.LONG)
    got = represent(t, Representation("x", "condition_era", "backfill", 64, 90)).select(*eras.LONG)
    assert got.count() == want.count() and not got.exceptAll(want).count()


def test_subject_day_is_the_widest_ordered_group(hot_events):
    df, pdf = hot_events
    largest = df.groupBy("subject_id", calendar_day("time")).count().agg(F.max("count")).first()[0]
    assert largest < len(pdf) / 100
    assert EPISODE_KEY[0] == "row_id"
