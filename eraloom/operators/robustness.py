"""Robustness tables of perturbed ensembles: metrics, probabilities, top groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eraloom.functions.ordered import exact_percentiles
from eraloom.functions.scalar import safe_ratio
from eraloom.operators.bootstrap import mean_bootstrap
from eraloom.operators.metrics import risk_metrics, spearman, top_fraction
from eraloom.operators.predictions import with_baseline
from eraloom.schemas import join_null_safe, require_none
from eraloom.session import materialize

GROUP = ["task", "compression_version", "requested_copy_fraction"]
VERSION = ["task", "compression_version"]
# Metrics compared with the unperturbed run; for the losses more is worse.
METRICS = {"auprc": 1, "logloss": -1, "brier": -1, "top10_precision": 1}


def metric_stability(pred: DataFrame, top: float = 0.10) -> DataFrame:
    """Metrics per fraction with change, degradation and absolute shift against zero."""
    m = risk_metrics(pred, GROUP, rank_clip=1e-8, loss_clip=1e-8, fracs=(top,))
    i = int(round(top * 100))
    m = m.select(
        *GROUP, "auprc", "logloss", "brier", F.col(f"top_{i}pct_precision").alias("top10_precision"), "n_episodes", "n_positive",
        F.col(f"top_{i}pct_k").cast("long").alias("n_top10"),
    )
    out = with_baseline(m, VERSION, list(METRICS))
    for name, sign in METRICS.items():
        delta = F.col(name) - F.col(f"{name}_at_0")
        out = (
            out.withColumn(f"delta_{name}_vs_0", delta)
            .withColumn(f"{name}_degradation_vs_0", delta * F.lit(-sign))
            .withColumn(f"abs_{name}_shift_vs_0", F.abs(delta))
            .withColumnRenamed(f"{name}_at_0", f"baseline_{name}")
        )
    return out


def paired_with_zero(pred: DataFrame) -> DataFrame:
    """Rows that exist unperturbed too, with both risks."""
    keys = [*VERSION, "row_id", "subject_id", "y_true"]
    out = with_baseline(pred.select(*GROUP, *keys[2:], "risk_calibrated"), keys, ["risk_calibrated"])
    return out.withColumnsRenamed({"risk_calibrated_at_0": "risk_at_0", "risk_calibrated": "risk_perturbed"}).filter(
        "risk_at_0 is not null"
    )


def probability_stability(pred: DataFrame) -> DataFrame:
    rows = paired_with_zero(pred).withColumn("d", F.col("risk_perturbed") - F.col("risk_at_0")).withColumn("a", F.abs("d"))
    base = rows.groupBy(*GROUP).agg(
        F.count("*").alias("n_episodes"), F.countDistinct("subject_id").alias("n_patients"), F.avg("d").alias("mean_delta_probability"),
        F.avg("a").alias("mean_abs_delta_probability"), F.max("a").alias("max_abs_delta_probability"),
    )
    marks = exact_percentiles(rows, GROUP, "a", {"median_abs_delta_probability": 0.5, "p95_abs_delta_probability": 0.95})
    order = spearman(rows, "risk_at_0", "risk_perturbed", GROUP).withColumnRenamed("spearman", "spearman_risk_vs_0")
    return join_null_safe(join_null_safe(base, marks, list(GROUP)), order, list(GROUP))


def top_membership(pred: DataFrame, top: float = 0.10) -> DataFrame:
    """Who is in the top group before and after: retained, exited, entered or outside."""
    # Each ranking reads its rows several times; the pairing and the first ranking are done once.
    rows = materialize(top_fraction(materialize(paired_with_zero(pred)), GROUP, top, "risk_at_0", out="in_top10_at_0"))
    rows = top_fraction(rows, GROUP, top, "risk_perturbed", out="in_top10_perturbed")
    before, after = F.col("in_top10_at_0"), F.col("in_top10_perturbed")
    status = F.when(before & after, "retained").when(before, "exited").when(after, "entered").otherwise("outside")
    return rows.withColumn("top10_status", status)


def top_stability(membership: DataFrame) -> DataFrame:
    s, y = F.col("top10_status"), F.col("y_true")
    n = lambda *names: F.count_if(s.isin(*names))
    hits = lambda name: F.sum(F.when(s == name, y).otherwise(0))
    return membership.groupBy(*GROUP).agg(
        n("retained", "exited").alias("n_top_at_0"), n("retained", "entered").alias("n_top_perturbed"), n("retained").alias("n_overlap"),
        safe_ratio(n("retained"), n("retained", "exited")).alias("retention_fraction"),
        safe_ratio(n("retained"), n("retained", "exited", "entered")).alias("jaccard"), n("entered").alias("n_entered"),
        n("exited").alias("n_exited"), safe_ratio(n("entered"), n("retained", "exited")).alias("churn_fraction"),
        hits("retained").alias("n_retained_positive"), hits("entered").alias("n_entered_positive"), hits("exited").alias("n_exited_positive"),
        F.avg(F.when(F.col("in_top10_at_0"), y)).alias("top10_event_rate_at_0"),
        F.avg(F.when(F.col("in_top10_perturbed"), y)).alias("top10_event_rate_perturbed"),
    )


# (column, prefix of the output, side that is better when larger)
DIRECT = [
    ("mean_abs_delta_probability", "mean_abs_delta_probability", "raw"), ("p95_abs_delta_probability", "p95_abs_delta_probability", "raw"),
    ("delta_auprc_vs_0", "delta_auprc", None), ("auprc_degradation_vs_0", "auprc_degradation", "raw"), ("abs_auprc_shift_vs_0", "auprc_absolute_shift", "raw"),
    ("delta_logloss_vs_0", "delta_logloss", None), ("logloss_degradation_vs_0", "logloss_degradation", "raw"), ("abs_logloss_shift_vs_0", "logloss_absolute_shift", "raw"),
    ("delta_brier_vs_0", "delta_brier", None), ("brier_degradation_vs_0", "brier_degradation", "raw"), ("abs_brier_shift_vs_0", "brier_absolute_shift", "raw"),
    ("delta_top10_precision_vs_0", "delta_top10_precision", None), ("top10_precision_degradation_vs_0", "top10_precision_degradation", "raw"),
    ("retention_fraction", "top10_retention", "compressed"), ("jaccard", "top10_jaccard", "compressed"), ("churn_fraction", "top10_churn", "raw"),
]


def direct_summary(
    metric_table: DataFrame, probability_table: DataFrame, top_table: DataFrame, raw: str, compressed: str,
) -> DataFrame:
    """Raw next to compressed per fraction, with the advantage of the compressed form.

    The inputs hold one row per task, version and fraction.
    """
    columns = [c for c, _, _ in DIRECT]

    def keep(df: DataFrame) -> DataFrame:
        return df.select(*GROUP, *[c for c in df.columns if c in columns])

    both = keep(metric_table).join(keep(probability_table), GROUP).join(keep(top_table), GROUP)
    at = lambda v, c: F.max(F.when(F.col("compression_version") == v, F.col(c)))
    aggs = []
    for column, name, larger in DIRECT:
        r, c = at(raw, column), at(compressed, column)
        aggs += [r.alias(f"raw_{name}"), c.alias(f"compressed_{name}")]
        if larger == "raw":
            aggs.append((r - c).alias(f"{name}_advantage_raw_minus_compressed"))
        elif larger == "compressed":
            aggs.append((c - r).alias(f"{name}_advantage_compressed_minus_raw"))
    return both.filter("requested_copy_fraction > 0").groupBy("task", "requested_copy_fraction").agg(*aggs)


def cross_overlap(pred: DataFrame, raw: str, compressed: str, top: float = 0.10) -> DataFrame:
    """How far the two representations choose the same top rows."""
    flagged = top_fraction(pred, GROUP, top)
    inside = lambda v: F.max(F.when(F.col("compression_version") == v, F.col("in_top").cast("int")).otherwise(0))
    rows = flagged.filter("in_top").groupBy("task", "requested_copy_fraction", "row_id").agg(inside(raw).alias("r"), inside(compressed).alias("c"))
    out = rows.groupBy("task", "requested_copy_fraction").agg(
        F.sum("r").alias("n_raw_top10"), F.sum("c").alias("n_compressed_top10"), F.sum(F.col("r") * F.col("c")).alias("n_common"),
        F.sum(F.greatest("r", "c")).alias("__union"),
    )
    return out.select(
        "*", safe_ratio("n_common", "n_raw_top10").alias("common_fraction_of_raw_top10"),
        safe_ratio("n_common", "n_compressed_top10").alias("common_fraction_of_compressed_top10"),
        safe_ratio("n_common", "__union").alias("jaccard_raw_vs_compressed"),
        (F.col("n_raw_top10") - F.col("n_common")).alias("n_raw_only"), (F.col("n_compressed_top10") - F.col("n_common")).alias("n_compressed_only"),
    ).drop("__union")


def robustness_bootstrap(pred: DataFrame, raw: str, compressed: str, n_rep: int, seed: int = 42) -> DataFrame:
    """Mean absolute change of raw minus that of compressed, with cluster intervals; both must cover the same examples."""
    rows = paired_with_zero(pred).withColumn("a", F.abs(F.col("risk_perturbed") - F.col("risk_at_0")))
    keys = ["task", "requested_copy_fraction", "row_id", "subject_id", "y_true"]
    at = lambda v: F.max(F.when(F.col("compression_version") == v, F.col("a")))
    wide = rows.filter("requested_copy_fraction > 0").groupBy(*keys).agg(
        at(raw).alias("abs_delta_raw"), at(compressed).alias("abs_delta_compressed")
    )
    require_none(wide, F.col("abs_delta_raw").isNull() | F.col("abs_delta_compressed").isNull(), "raw and compressed do not cover the same perturbed examples")
    wide = wide.withColumn("advantage", F.col("abs_delta_raw") - F.col("abs_delta_compressed"))
    by = ["task", "requested_copy_fraction"]
    means = wide.groupBy(*by).agg(F.avg("abs_delta_raw").alias("mean_abs_delta_raw"), F.avg("abs_delta_compressed").alias("mean_abs_delta_compressed"))
    return mean_bootstrap(wide, by, "advantage", n_rep, seed).join(means, by)


