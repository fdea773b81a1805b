"""Risk-score metrics from score tables, for any grouping at once.

Rows are first reduced to (group, score) counts on the map side. Ranking
metrics are sums over that table with running weights that never need a whole
group in one task. Only rows tied at a top-fraction boundary are looked at
again, to break the tie by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eraloom.functions.ordered import (
    add_segment, average_ranks, exact_percentiles, fit_splits, running,
)
from eraloom.functions.scalar import clip
from eraloom.schemas import join_null_safe, require_none
from eraloom.session import broadcast_checked, materialize

LOWER_IS_BETTER = ["brier", "logloss"]
PREDICTIVE_METRICS = ["auroc", "auprc", "brier", "logloss", "top_10pct_precision"]


def pct(frac: float) -> int:
    return int(round(frac * 100))


def score_splits(df: DataFrame, score: str = "risk_calibrated", ident: str = "row_id", n: int | None = None) -> dict:
    """Cut points for :func:`risk_metrics`; reuse them for resampled copies."""
    found = fit_splits(df, [score, ident], n)
    return {"score": found[score], "id": found[ident]}


def _score_table(df: DataFrame, splits: Sequence[float]) -> DataFrame:
    counts = df.groupBy("__g", "__p").agg(
        F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__y")).alias("wp"),
        F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("__y")).alias("np"),
    )
    return running(
        add_segment(counts, "__p", splits, "__seg"), ["__g"], ["__p"], "__seg", ["w", "wp", "n", "np"], totals=True
    )


def _target(frac: float, weighted: bool) -> Column:
    share = F.col("tot_w") * F.lit(float(frac))
    return share if weighted else F.greatest(F.lit(1), F.ceil(share)).cast("double")


def _prepared(df: DataFrame, by, y, score, ident, weight, rank_clip) -> DataFrame:
    p = F.col(score).cast("double")
    return df.select(
        F.struct(*by).alias("__g") if by else F.struct(F.lit(0).alias("__all")).alias("__g"),
        (clip(p, rank_clip, 1 - rank_clip) if rank_clip else p).alias("__p"),
        F.col(y).cast("double").alias("__y"), F.col(ident).alias("__id"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"), F.lit(1).alias("__n"),
    )


def risk_metrics(
    df: DataFrame, by: Sequence[str], y: str = "y_true", score: str = "risk_calibrated", ident: str = "row_id",
    weight: str | None = None, weighted_top: bool = False, rank_clip: float | None = None,
    loss_clip: float = 1e-6, fracs: Sequence[float] = (0.10,), splits: dict | None = None,
) -> DataFrame:
    """AUROC, AUPRC, Brier, log-loss and top-fraction metrics per group.

    ``weight`` may be a resampling multiplicity (a copy counts as a row) or a
    fractional weight; ``weighted_top`` then cuts the boundary row so that the
    selection holds exactly ``frac`` of the weight. One-class groups get NULL
    ranking metrics. Ties at the boundary go to the smaller id.
    """
    by = list(by)
    rows = _prepared(df, by, y, score, ident, weight, rank_clip)
    if splits is None:
        found = fit_splits(rows, ["__p", "__id"])
        splits = {"score": found["__p"], "id": found["__id"]}
    table = _score_table(rows, splits["score"])

    w, wp, total, pos = (F.col(c) for c in ("w", "wp", "tot_w", "tot_wp"))
    neg_below = F.col("cum_w") - F.col("cum_wp") - 0.5 * (w - wp)
    hits = pos - F.col("cum_wp") + wp
    taken = total - F.col("cum_w") + w
    above = total - F.col("cum_w")
    q = clip("__p", loss_clip, 1 - loss_clip)
    sq = wp * (1 - q) * (1 - q) + (w - wp) * q * q
    ll = -(wp * F.log(q) + (w - wp) * F.log(1 - q))
    sums = [
        F.max("tot_w").alias("total_weight"), F.max("tot_wp").alias("__pos"), F.max("tot_n").alias("__n"),
        F.max("tot_np").alias("__np"), F.sum(wp * neg_below).alias("__auc"),
        F.sum(wp * hits / taken).alias("__ap"), F.sum(sq).alias("__sq"), F.sum(ll).alias("__ll"),
    ]
    for f in fracs:
        k = _target(f, weighted_top)
        sums += [F.max(k).alias(f"__k{pct(f)}"), F.sum(F.when(above + w <= k, wp)).alias(f"__full{pct(f)}")]
    out = table.groupBy("__g").agg(*sums)

    # Scores that straddle a boundary: one per group and fraction at most.
    cuts = F.array(*[
        F.struct(F.lit(pct(f)).alias("pct"), (_target(f, weighted_top) - above).alias("need")) for f in fracs
    ])
    edge = table.select("__g", "__p", "w", F.explode(cuts).alias("c")).filter(
        (F.col("c.need") > 0) & (F.col("c.need") < F.col("w"))
    ).select("__g", "__p", "c.pct", "c.need")
    tied = add_segment(rows.join(edge, ["__g", "__p"]), "__id", splits["id"], "__seg")
    placed = running(tied, ["__g", "pct"], ["__id"], "__seg", ["__w"])
    part = F.greatest(F.lit(0.0), F.least(F.col("__w"), F.col("need") - (F.col("cum___w") - F.col("__w"))))
    split_ties = placed.groupBy("__g").agg(*[
        F.sum(F.when(F.col("pct") == pct(f), part * F.col("__y"))).alias(f"__part{pct(f)}") for f in fracs
    ])
    out = out.join(split_ties, "__g", "left")

    neg = F.col("total_weight") - F.col("__pos")
    two = (F.col("__pos") > 0) & (neg > 0)
    cols = [
        F.col("__n").cast("long").alias("n_episodes"), F.col("__np").cast("long").alias("n_positive"),
        (F.col("__pos") / F.col("total_weight")).alias("event_rate"),
        F.when(two, F.col("__auc") / (F.col("__pos") * neg)).alias("auroc"),
        F.when(two, F.col("__ap") / F.col("__pos")).alias("auprc"),
        (F.col("__sq") / F.col("total_weight")).alias("brier"),
        (F.col("__ll") / F.col("total_weight")).alias("logloss"),
    ]
    for f in fracs:
        i, k = pct(f), F.col(f"__k{pct(f)}")
        events = F.coalesce(f"__full{i}", F.lit(0.0)) + F.coalesce(f"__part{i}", F.lit(0.0))
        rate = events / k
        cols += [
            k.alias(f"top_{i}pct_k"), events.alias(f"top_{i}pct_events"), rate.alias(f"top_{i}pct_precision"),
            F.when(F.col("__pos") > 0, rate / (F.col("__pos") / F.col("total_weight"))).alias(f"top_{i}pct_lift"),
            F.when(F.col("__pos") > 0, events / F.col("__pos")).alias(f"top_{i}pct_capture"),
        ]
    groups = [F.col(f"__g.{c}").alias(c) for c in by]
    return out.select(*groups, *cols, "total_weight")


def auroc(df: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    return risk_metrics(df, by, **kw).select(*by, "auroc")


def auprc(df: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    return risk_metrics(df, by, **kw).select(*by, "auprc")


def binary_metrics(df: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    """Calibration-side metrics; needs no ordering, one partial aggregation."""
    p = clip(kw.get("score", "risk_calibrated"), 1e-6, 1 - 1e-6)
    y = F.col(kw.get("y", "y_true"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n_episodes"), F.sum(y).alias("n_positive"), F.avg(y).alias("event_rate"),
        F.avg((y - p) * (y - p)).alias("brier"),
        F.avg(-F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("logloss"),
    )


def topk_table(df: DataFrame, by: Sequence[str], fracs: Sequence[float] = (0.01, 0.05, 0.10, 0.20), **kw) -> DataFrame:
    """Long top-fraction table: size, events, rate, lift and capture."""
    wide = risk_metrics(df, by, fracs=fracs, **kw)
    names = {"k": "top_k", "events": "events_in_top_k", "precision": "top_k_event_rate", "lift": "top_k_lift", "capture": "event_capture"}
    items = F.array(*[
        F.struct(F.lit(float(f)).alias("top_frac"), *[F.col(f"top_{pct(f)}pct_{a}").alias(b) for a, b in names.items()])
        for f in fracs
    ])
    return wide.select(*by, F.col("event_rate").alias("base_event_rate"), "n_episodes", "n_positive", F.explode(items).alias("t")).select(
        *by, "t.*", "base_event_rate", "n_episodes", "n_positive"
    )


def metric(df: DataFrame, name: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """One named metric, such as ``auroc`` or ``top_5pct_lift``."""
    fracs = (int(name.split("_")[1].removesuffix("pct")) / 100,) if name.startswith("top_") else (0.10,)
    column = name.replace("event_capture", "capture")
    table = risk_metrics(df, by, fracs=fracs, **kw)
    if column not in table.columns:
        raise ValueError(f"unknown metric {name}")
    return table.select(*by, F.lit(name).alias("metric"), F.col(column).alias("value"))


def metrics_by(df: DataFrame, by: Sequence[str], subject: str = "subject_id", **kw) -> DataFrame:
    """Metric bundle with the number of subjects per group."""
    patients = df.groupBy(F.struct(*by).alias("__k")).agg(F.countDistinct(subject).alias("n_patients"))
    m = risk_metrics(df, by, **kw)
    return m.withColumn("__k", F.struct(*by)).join(patients, "__k").drop("__k")


def topk_by_seed(df: DataFrame, by: Sequence[str], fracs: Sequence[float] = (0.01, 0.05, 0.10, 0.20), **kw) -> DataFrame:
    return topk_table(df, [*by, "seed"], fracs, **kw)


def equal_subject_weights(df: DataFrame, by: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """Weight 1/n for each of a subject's n episodes.

    Counts are aggregated first and joined back, so a busy subject is never one
    window partition.
    """
    keyed = df.withColumn("__k", F.struct(*by, subject))
    sizes = keyed.groupBy("__k").agg(F.count("*").alias("__size"))
    return keyed.join(sizes, "__k").withColumn("weight", F.lit(1.0) / F.col("__size")).drop("__k", "__size")


def metrics_equal_weight(df: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    """Metrics in which every subject counts once; scores are clipped first."""
    return risk_metrics(
        equal_subject_weights(df, by), by, weight="weight", weighted_top=True, rank_clip=1e-6, **kw
    )


def top_fraction(
    df: DataFrame, by: Sequence[str], frac: float, score: str = "risk_calibrated", ident: str = "row_id",
    out: str = "in_top",
) -> DataFrame:
    """Flag the top ``ceil(n * frac)`` rows of each group, smaller id first on ties."""
    by = list(by)
    rows = df.withColumn("__g", F.struct(*by)).withColumn("__p", F.col(score).cast("double"))
    found = fit_splits(rows, ["__p", ident])
    counts = rows.groupBy("__g", "__p").agg(F.count("*").alias("w"))
    table = running(add_segment(counts, "__p", found["__p"], "__seg"), ["__g"], ["__p"], "__seg", ["w"], totals=True)
    size = F.least(F.col("tot_w"), F.greatest(F.lit(1), F.ceil(F.col("tot_w") * F.lit(float(frac)))))
    need = size - (F.col("tot_w") - F.col("cum_w"))
    # One row per group: the score at which it is full and how many rows of that score it still takes.
    cut = materialize(table.select("__g", F.col("__p").alias("__cut"), "w", need.alias("__need")).filter("0 < __need and __need <= w"))
    known = rows.filter("__p is not null").join(broadcast_checked(cut), "__g")
    tied = (F.col("__p") == F.col("__cut")) & (F.col("__need") < F.col("w"))
    edge = known.filter(tied).withColumn("one", F.lit(1))
    placed = running(add_segment(edge, ident, found[ident], "__seg"), ["__g"], [ident], "__seg", ["one"])
    inside = known.filter(~tied)
    return inside.select(*df.columns, (F.col("__p") >= F.col("__cut")).alias(out)).unionByName(
        placed.select(*df.columns, (F.col("cum_one") <= F.col("__need")).alias(out))
    )


def weighted_top(df: DataFrame, by: Sequence[str], frac: float, weight: str = "weight", **kw) -> DataFrame:
    i = pct(frac)
    m = risk_metrics(df, by, weight=weight, weighted_top=True, fracs=(frac,), **kw)
    return m.select(*by, *[F.col(f"top_{i}pct_{c}") for c in ("precision", "lift", "capture")])


def ensemble(pred: DataFrame, keys: Sequence[str], values: dict[str, str], spread: str) -> DataFrame:
    """Seed average per example; the deviation of a single seed is 0."""
    out = pred.groupBy(*keys).agg(
        *[F.avg(c).alias(n) for n, c in values.items()],
        F.coalesce(F.stddev_samp(spread), F.lit(0.0)).alias(f"{spread}_std"), F.countDistinct("seed").alias("n_seeds"),
    )
    return out


def require_equal_seeds(ens: DataFrame) -> DataFrame:
    seen = ens.agg(F.min("n_seeds").alias("lo"), F.max("n_seeds").alias("hi"))
    require_none(seen, F.col("lo") != F.col("hi"), "ensemble rows differ in seed count")
    return ens


def summarize_seeds(by_seed: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, deviation, minimum and maximum of each metric over seeds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return by_seed.groupBy(*keys).agg(F.countDistinct("seed").alias("n_seeds"), *aggs)


def stability_summary(ens: DataFrame, keys: Sequence[str], spread: str) -> DataFrame:
    """How far seeds disagree per example: mean, median, p90, p95 and maximum."""
    base = ens.groupBy(*keys).agg(
        F.count("*").alias("n_examples"), F.countDistinct("subject_id").alias("n_patients"),
        F.sum("y_true").alias("n_positive"), F.avg(spread).alias("mean_prediction_std"), F.max(spread).alias("max_prediction_std"),
    )
    marks = exact_percentiles(ens, keys, spread, {
        "median_prediction_std": 0.5, "p90_prediction_std": 0.9, "p95_prediction_std": 0.95,
    })
    return join_null_safe(base, marks, list(keys))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    ranked = average_ranks(average_ranks(df, by, a, "__ra"), by, b, "__rb")
    return ranked.groupBy(*by).agg(F.corr("__ra", "__rb").alias("spearman"))


def summarize_values(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation and 95 % interval of the finite values."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    groups = list(by)
    if not groups:
        rows, groups = rows.withColumn("__all", F.lit(0)), ["__all"]
    base = rows.groupBy(*groups).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count("*").alias("n_valid")
    )
    return join_null_safe(base, exact_percentiles(rows, groups, value, {"ci_low": 0.025, "ci_high": 0.975}), groups).drop("__all")


def last_episode(df: DataFrame, keys: Sequence[str] = ("task", "compression_version", "subject_id")) -> DataFrame:
    """Latest episode of each subject; a maximum, so it combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct("prediction_time", "row_id", F.struct(*[c for c in rest]).alias("r")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.r.*").select(*df.columns)


