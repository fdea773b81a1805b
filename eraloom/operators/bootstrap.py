"""Subject-cluster bootstrap as joins and grouped sums.

A draw is a hash of (seed, replicate, place), so draws can be repeated anywhere
and a lost task redraws the same subjects. Replicates are an ordinary grouping
key and spread over the executors. Nothing is resampled row by row: each
subject carries a multiplicity that acts as a weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eraloom.functions.ordered import exact_percentiles, global_row_number
from eraloom.functions.scalar import direction_label
from eraloom.operators.metrics import (
    LOWER_IS_BETTER, PREDICTIVE_METRICS, equal_subject_weights, risk_metrics,
)
from eraloom.operators.resample import cluster_indexes, replicate_metrics
from eraloom.schemas import DataContractError, duplicate_keys
from eraloom.session import materialize

PAIR_KEY = ["row_id", "subject_id", "y_true"]


def cluster_index(df: DataFrame, cluster: str = "subject_id") -> DataFrame:
    """Zero-based index of the distinct clusters in id order."""
    placed = global_row_number(df.select(cluster).distinct(), [F.col(cluster)])
    return placed.select(cluster, (F.col("row_number") - 1).alias("cluster_index"))


def draw_hash(seed: int, rep, place, n_clusters) -> Column:
    """The cluster that a place of a replicate draws, from a hash of (seed, replicate, place)."""
    rep, place, n = (F.col(c) if isinstance(c, str) else c for c in (rep, place, n_clusters))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), place.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def cluster_draws(spark, n_clusters: int, n_rep: int, seed: int) -> DataFrame:
    """Multiplicity of each cluster in each replicate.

    One flat range numbers all draws; replicate and place are its quotient and
    remainder, so nothing is crossed.
    """
    rep, place = F.expr(f"id div {int(n_clusters)}"), F.col("id") % n_clusters
    return (
        spark.range(n_rep * n_clusters).select(rep.alias("rep"), draw_hash(seed, rep, place, F.lit(n_clusters)).alias("cluster_index"))
        .groupBy("rep", "cluster_index").agg(F.count("*").alias("mult"))
    )


def subject_draws(df: DataFrame, n_rep: int, seed: int, cluster: str = "subject_id") -> DataFrame:
    index = materialize(cluster_index(df, cluster))
    n = index.count()
    return cluster_draws(df.sparkSession, n, n_rep, seed).join(index, "cluster_index").select("rep", cluster, "mult")


def paired_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = PAIR_KEY, check: bool = True) -> DataFrame:
    """One-to-one inner join that must cover both sides."""
    if check:
        for side in (a, b):
            if duplicate_keys(side, list(keys)).limit(1).count():
                raise DataContractError(f"a paired side repeats {keys}")
        missing = a.join(b, list(keys), "left_anti").limit(1).count() + b.join(a, list(keys), "left_anti").limit(1).count()
        if missing:
            raise DataContractError("paired sides do not cover the same examples")
    return a.join(b, list(keys))


def paired_join_many(
    df: DataFrame, keys: Sequence[str], column: str, names: dict[str, str], value: str,
) -> DataFrame:
    """Several versions side by side from one grouped pass; incomplete rows go."""
    wide = df.filter(F.col(column).isin(*names)).groupBy(*keys).agg(
        *[F.max(F.when(F.col(column) == v, F.col(value))).alias(n) for v, n in names.items()]
    )
    return wide.dropna(subset=list(names.values()))


def comparison_pairs(pred: DataFrame, comparisons: Sequence[dict], score: str = "risk_calibrated", by: Sequence[str] = ()) -> DataFrame:
    """Long pairs (comparison, side, example) for a whole list of comparisons.

    The list is a few rows of run configuration, so it joins as a broadcast.
    """
    sides = pred.sparkSession.createDataFrame(
        [(c["name"], c["task"], c[f"model_{s}"], s) for c in comparisons for s in ("a", "b")],
        "comparison string, task string, compression_version string, side string",
    )
    return pred.join(F.broadcast(sides), ["task", "compression_version"]).select(
        "comparison", "task", "side", *by, *PAIR_KEY, F.col(score).alias("score")
    )


def require_paired(pairs: DataFrame, by: Sequence[str] = (), key: Sequence[str] = PAIR_KEY) -> DataFrame:
    """Both sides of every comparison hold the same examples once."""
    odd = pairs.groupBy("comparison", *by, *key).agg(
        F.count("*").alias("n"), F.countDistinct("side").alias("s")
    ).filter((F.col("n") != 2) | (F.col("s") != 2))
    if odd.limit(1).count():
        raise DataContractError("paired comparison does not cover all examples")
    return pairs


def _unpivot(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    return metrics.select(*keys, F.explode(items).alias("m")).select(*keys, "m.metric", "m.value")


def _sides(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "a", F.col("value"))).alias("model_a_value"),
        F.max(F.when(F.col("side") == "b", F.col("value"))).alias("model_b_value"),
    )


def higher_is_better(metric: str = "metric") -> Column:
    return ~F.col(metric).isin(*LOWER_IS_BETTER)


def direction_fields(value: Column, point: Column, tol: float = 1e-12, names: tuple[str, str] = ("model_a_better", "model_b_better")) -> list[Column]:
    """Aggregates: share of replicates above, below and at zero, and agreeing with the point."""
    up, down = value > tol, value < -tol
    same = F.when(point > tol, up).when(point < -tol, down).otherwise(~(up | down))
    share = lambda c: F.avg(c.cast("int"))
    return [
        share(up).alias(f"fraction_bootstrap_{names[0]}"), share(down).alias(f"fraction_bootstrap_{names[1]}"),
        share(~(up | down)).alias("fraction_bootstrap_equal"),
        share(same).alias("fraction_bootstrap_matching_point_direction"),
    ]


def interval(value: str = "delta") -> list[Column]:
    """Summary aggregates over replicates; their number is set by the caller."""
    return [
        F.avg(value).alias("bootstrap_mean_delta"), F.stddev_samp(value).alias("bootstrap_std_delta"),
        F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"),
        F.count(value).alias("n_bootstrap_valid"),
    ]


def paired_bootstrap(
    pairs: DataFrame, n_rep: int, seed: int = 42, equal_weight: bool = False,
    metrics: Sequence[str] = PREDICTIVE_METRICS, check: bool = True,
) -> DataFrame:
    """Benefit of A over B per comparison and metric with a 95 % interval.

    Draws are shared by both sides and all metrics of a comparison.
    """
    if check:
        require_paired(pairs)
    pairs = materialize(pairs)
    keys = ["comparison", "task"]
    rows = equal_subject_weights(pairs, [*keys, "side"]) if equal_weight else pairs
    scored = materialize(replicate_metrics(
        rows, keys, n_rep, seed, "weight" if equal_weight else None, equal_weight, 1e-6 if equal_weight else None
    ))
    values = _sides(_unpivot(scored, [*keys, "rep", "side"], metrics), [*keys, "rep", "metric"])
    point = values.filter("rep < 0").drop("rep")
    reps = values.filter("rep >= 0").withColumn("delta", F.col("model_a_value") - F.col("model_b_value"))
    return _delta_summary(point, reps, keys).join(_pair_sizes(pairs, keys), keys)


def _pair_sizes(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.filter("side = 'a'").groupBy(*keys).agg(
        F.count("*").alias("n_paired_examples"), F.countDistinct("subject_id").alias("n_paired_patients"),
        F.sum("y_true").alias("n_paired_positive"),
    )


def comparison_draws(pairs: DataFrame, n_rep: int, seed: int, keys: Sequence[str] = ("comparison", "task")) -> DataFrame:
    """Draws for each comparison over its own subjects.

    Subjects are indexed inside their comparison and each place draws once per
    replicate, so one plan serves any number of comparisons and cohort sizes;
    comparisons with the same subjects get the same draws.
    """
    keys = list(keys)
    index = cluster_indexes(pairs, keys)
    cohorts = index.select("n_clusters", "cluster_index").distinct()
    reps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rep - 1).cast("long")))
    drawn = cohorts.select("cluster_index", "n_clusters", reps.alias("rep"))
    hits = drawn.groupBy("n_clusters", "rep", draw_hash(seed, "rep", "cluster_index", "n_clusters").alias("cluster_index")).agg(F.count("*").alias("mult"))
    return index.join(hits, ["n_clusters", "cluster_index"]).select(*keys, "subject_id", "rep", "mult")


def _delta_summary(point: DataFrame, reps: DataFrame, keys: Sequence[str]) -> DataFrame:
    point = point.withColumn("point_delta_a_minus_b", F.col("model_a_value") - F.col("model_b_value"))
    # Point rows: one per comparison and metric.
    both = reps.select(*keys, "metric", "delta").join(point, [*keys, "metric"])
    sign = F.when(higher_is_better(), 1.0).otherwise(-1.0)
    valid = both.filter(F.col("delta").isNotNull())
    out = valid.groupBy(*keys, "metric").agg(
        F.max("model_a_value").alias("model_a_value"), F.max("model_b_value").alias("model_b_value"),
        F.max("point_delta_a_minus_b").alias("point_delta_a_minus_b"), *interval(),
        *direction_fields(F.col("delta") * sign, F.col("point_delta_a_minus_b") * sign),
    )
    benefit = F.col("point_delta_a_minus_b") * sign
    return out.select(
        *out.columns, higher_is_better().alias("higher_is_better"), benefit.alias("benefit_delta"),
        direction_label(benefit).alias("point_effect_direction"),
    )


def run_comparisons(
    ens: DataFrame, comparisons: Sequence[dict], n_rep: int, seed: int = 42, equal_weight: bool = False,
    check: bool = True,
) -> DataFrame:
    """All configured comparisons in one plan."""
    return paired_bootstrap(comparison_pairs(ens, comparisons), n_rep, seed, equal_weight, check=check)


def bootstrap_ci(
    df: DataFrame, by: Sequence[str], n_rep: int, seed: int = 42, metrics: Sequence[str] = PREDICTIVE_METRICS,
    score: str = "risk_calibrated",
) -> DataFrame:
    """Observed value and bootstrap interval of each metric per model."""
    df = materialize(df.select(*by, *PAIR_KEY, score))
    sided = df.select(*by, *PAIR_KEY, F.col(score).alias("score"), F.lit("a").alias("side"))
    values = _unpivot(materialize(replicate_metrics(sided, by, n_rep, seed)), [*by, "rep"], metrics)
    observed = values.filter("rep < 0").drop("rep").withColumnRenamed("value", "observed")
    reps = values.filter("rep >= 0")
    stats = reps.filter(F.col("value").isNotNull()).groupBy(*by, "metric").agg(
        F.avg("value").alias("bootstrap_mean"), F.stddev_samp("value").alias("bootstrap_std"),
        F.percentile("value", F.lit(0.025)).alias("ci_low"), F.percentile("value", F.lit(0.975)).alias("ci_high"),
        F.count("*").alias("n_bootstrap_valid"),
    )
    sizes = df.groupBy(*by).agg(
        F.count("*").alias("n_examples"), F.countDistinct("subject_id").alias("n_patients"), F.sum("y_true").alias("n_positive")
    )
    return observed.join(stats, [*by, "metric"], "left").join(sizes, list(by)).withColumn("higher_is_better", higher_is_better())


def mean_bootstrap(df: DataFrame, by: Sequence[str], value: str, n_rep: int, seed: int = 42) -> DataFrame:
    """Cluster bootstrap of a mean from per-subject sums and counts only."""
    per = materialize(df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, "subject_id").agg(
        F.sum(value).alias("s"), F.count(value).alias("c")
    ))
    draws = comparison_draws(per, n_rep, seed, by)
    reps = per.join(draws, [*by, "subject_id"]).groupBy(*by, "rep").agg(
        (F.sum(F.col("mult") * F.col("s")) / F.sum(F.col("mult") * F.col("c"))).alias("delta")
    )
    point = per.groupBy(*by).agg(
        (F.sum("s") / F.sum("c")).alias("point_mean"), F.count("*").alias("n_patients"), F.sum("c").alias("n_episodes")
    )
    joined = reps.join(point, list(by))
    stats = joined.groupBy(*by).agg(
        F.max("point_mean").alias("point_mean"), F.max("n_patients").alias("n_patients"), F.max("n_episodes").alias("n_episodes"),
        *interval(), F.avg((F.col("delta") > 0).cast("int")).alias("fraction_bootstrap_positive"),
        *direction_fields(F.col("delta"), F.col("point_mean"), names=("delta_positive", "delta_negative")),
    )
    return stats


def history_bootstrap(
    audits: DataFrame, comparisons: Sequence[dict], metrics: Sequence[str], n_rep: int, seed: int = 42,
) -> DataFrame:
    """Paired history-coverage deltas with cluster bootstrap intervals.

    ``audits`` holds task, compression_version, row_id, subject_id and the
    metrics. Means need per-subject sums only, so replicates never touch rows.
    """
    sides = audits.sparkSession.createDataFrame(
        [(c["name"], c["task"], c[f"model_{s}"], s) for c in comparisons for s in ("a", "b")],
        "comparison string, task string, compression_version string, side string",
    )
    items = F.array(*[F.struct(F.lit(m).alias("history_metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = audits.join(F.broadcast(sides), ["task", "compression_version"]).select(
        "comparison", "task", "side", "row_id", "subject_id", F.explode(items).alias("m")
    ).select("comparison", "task", "side", "row_id", "subject_id", "m.*")
    keys = ["comparison", "task", "history_metric"]
    sided = audits.join(F.broadcast(sides), ["task", "compression_version"]).select("comparison", "task", "side", "row_id", "subject_id")
    require_paired(sided, key=["task", "row_id", "subject_id"])
    pairs = materialize(
        _sides(long, [*keys, "row_id", "subject_id"])
        .withColumn("d", F.col("model_a_value") - F.col("model_b_value")).filter(F.col("d").isNotNull())
    )
    boot = mean_bootstrap(pairs, keys, "d", n_rep, seed)
    close = F.abs("d") <= 1e-8
    shape = pairs.groupBy(*keys).agg(
        F.avg("model_a_value").alias("model_a_mean"), F.avg("model_b_value").alias("model_b_mean"),
        F.avg((F.col("d") > 0).cast("int")).alias("fraction_delta_positive"),
        F.avg(close.cast("int")).alias("fraction_delta_zero"), F.avg((F.col("d") < 0).cast("int")).alias("fraction_delta_negative"),
    )
    median = exact_percentiles(pairs, keys, "d", {"median_paired_delta": 0.5})
    return boot.join(shape, keys).join(median, keys)


def interaction_bootstrap(
    ens: DataFrame, versions: dict[str, str], n_rep: int, seed: int = 42, metrics: Sequence[str] = PREDICTIVE_METRICS,
) -> DataFrame:
    """(A2 - B2) - (A1 - B1) per metric; ``versions`` maps a1, b1, a2, b2 to versions.

    All four are scored on the examples that they have in common; having none
    is an error.
    """
    wide = paired_join_many(ens, ["task", *PAIR_KEY], "compression_version", {v: r for r, v in versions.items()}, "risk_calibrated")
    each = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("score")) for r in versions])
    rows = materialize(wide.select("task", *PAIR_KEY, F.explode(each).alias("r")).select("task", "r.role", *PAIR_KEY, "r.score"))
    if not rows.limit(1).count():
        raise DataContractError("the four versions have no example in common")
    def effect(m: DataFrame, keys: list[str]) -> DataFrame:
        at = lambda r: F.max(F.when(F.col("role") == r, F.col("value")))
        return _unpivot(m, [*keys, "role"], metrics).groupBy(*keys, "metric").agg(
            ((at("a2") - at("b2")) - (at("a1") - at("b1"))).alias("delta")
        )

    scored = materialize(replicate_metrics(rows.withColumnRenamed("role", "side"), ["task"], n_rep, seed))
    values = effect(scored.withColumnRenamed("side", "role"), ["task", "rep"])
    point = values.filter("rep < 0").select("task", "metric", F.col("delta").alias("point_interaction"))
    reps = values.filter("rep >= 0")
    both = reps.join(point, ["task", "metric"]).filter(F.col("delta").isNotNull())
    return both.groupBy("task", "metric").agg(
        F.max("point_interaction").alias("point_interaction"), *interval(),
        *direction_fields(F.col("delta"), F.col("point_interaction"), names=("delta_positive", "delta_negative")),
    ).withColumn("higher_is_better", higher_is_better())


def seed_directions(pred: DataFrame, comparisons: Sequence[dict], paired: DataFrame, metrics: Sequence[str] = PREDICTIVE_METRICS) -> DataFrame:
    """Benefit per seed and whether it points the way of the ensemble."""
    pairs = comparison_pairs(pred, comparisons, by=["seed"])
    keys = ["comparison", "task", "seed"]
    per = _sides(_unpivot(risk_metrics(pairs, [*keys, "side"], score="score"), [*keys, "side"], metrics), [*keys, "metric"])
    sign = F.when(higher_is_better(), 1.0).otherwise(-1.0)
    raw = F.col("model_a_value") - F.col("model_b_value")
    ens = paired.select("comparison", "task", "metric", F.col("benefit_delta").alias("ensemble_benefit_delta"))
    out = per.join(ens, ["comparison", "task", "metric"]).select(
        *keys, "metric", "model_a_value", "model_b_value", raw.alias("raw_delta_a_minus_b"), (raw * sign).alias("benefit_delta"),
        "ensemble_benefit_delta",
    )
    return out.withColumn("direction", direction_label("benefit_delta")).withColumn(
        "ensemble_direction", direction_label("ensemble_benefit_delta")
    ).withColumn("matches_ensemble_direction", F.col("direction") == F.col("ensemble_direction"))


def seed_direction_summary(detail: DataFrame) -> DataFrame:
    b, hit = F.col("benefit_delta"), F.col("matches_ensemble_direction").cast("int")
    return detail.groupBy("comparison", "task", "metric").agg(
        F.count("*").alias("n_seeds"), F.count_if(F.col("direction") == "model_a_better").alias("n_seeds_model_a_better"),
        F.count_if(F.col("direction") == "model_b_better").alias("n_seeds_model_b_better"),
        F.count_if(F.col("direction") == "equal").alias("n_seeds_equal"), F.avg(b).alias("mean_benefit_delta"),
        F.coalesce(F.stddev_samp(b), F.lit(0.0)).alias("std_benefit_delta"), F.min(b).alias("min_benefit_delta"),
        F.max(b).alias("max_benefit_delta"), F.max("ensemble_benefit_delta").alias("ensemble_benefit_delta"),
        (F.countDistinct("direction") == 1).alias("all_seeds_same_direction"),
        F.sum(hit).alias("n_seeds_matching_ensemble"), (F.avg(hit) > 0.5).alias("majority_matches_ensemble"),
    )


