"""Prediction tables: schema, merging, validation, calibration layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eraloom.functions.scalar import era_gap_of, logit, safe_bool, sigmoid
from eraloom.schemas import LONG_PREDICTION, WIDE_PREDICTION, DataContractError, require_columns, require_none
from eraloom.session import broadcast_checked

# Older column names and the representation each family implies.
OLD_NAMES = {
    "family": "model_family", "model": "model_name", "version": "compression_version", "row_id": "example_id", "risk": "pred_proba",
}
FAMILY_REPRESENTATION = {
    "tabular": "tabular_all_features", "numeric_sequence": "numeric_sequence_time2vec", "sequence": "code_sequence_time2vec",
}
CONFIG_FIELDS = ["task", "model_family", "model_name", "representation", "compression_version", "numeric_on"]
RUN_KEY = ["task", "compression_version", "model", "seed", "split", "row_id", "subject_id"]
SCORE_COLUMNS = ["logit", "risk_raw", "risk_calibrated"]


def normalize_predictions(df: DataFrame, default_family: str | None = None, source: str | None = None) -> DataFrame:
    """Bring old and new prediction files to one schema."""
    for old, new in OLD_NAMES.items():
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    have = set(df.columns)
    if "model_family" not in have and default_family is None:
        raise DataContractError("predictions name no model family")
    family = F.col("model_family") if "model_family" in have else F.lit(default_family)
    df = df.withColumn("model_family", family.cast("string"))
    tabular = F.col("model_family") == "tabular"
    version = F.col("compression_version") if "compression_version" in have else F.when(tabular, "none").otherwise("unknown")
    df = df.withColumn(
        "compression_version", F.when(tabular & (version == "tabular_all_features"), "none").otherwise(version)
    )
    if "representation" not in have:
        named = F.create_map(*[F.lit(x) for pair in FAMILY_REPRESENTATION.items() for x in pair])
        df = df.withColumn("representation", F.coalesce(named[F.col("model_family")], F.lit("unknown")))
    fill = {
        "numeric_on": F.col("model_family").isin("tabular", "numeric_sequence"), "calibration": F.lit("raw"),
        "split": F.lit("held_out"), "seed": F.lit(-1),
    }
    for name, value in fill.items():
        if name not in have:
            df = df.withColumn(name, value)
    if source is not None:
        df = df.withColumn("prediction_source", F.lit(source))
    require_columns(df, LONG_PREDICTION, "predictions")
    kinds = {"seed": "int", "example_id": "long", "subject_id": "long", "y_true": "int", "pred_proba": "double"}

    def typed(c: str) -> Column:
        return (safe_bool(c) if c == "numeric_on" else F.col(c).cast(kinds.get(c, "string"))).alias(c)

    return df.select(*[typed(c) for c in LONG_PREDICTION], *[c for c in df.columns if c not in LONG_PREDICTION])


def filter_by_configs(pred: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """Rows that match any model config; a missing field matches everything.

    Configs are a few rows of run setup, so they become one predicate that the
    scan can use.
    """
    if not configs:
        return pred
    anyone: Column | None = None
    for cfg in configs:
        one = F.lit(True)
        for c in CONFIG_FIELDS:
            if cfg.get(c) is not None:
                one = one & (F.col(c) == F.lit(cfg[c]))
        anyone = one if anyone is None else anyone | one
    return pred.filter(anyone)


def select_version(df: DataFrame, task: str, version: str, seed: int | None = None) -> DataFrame:
    out = df.filter((F.col("task") == task) & (F.col("compression_version") == version))
    if seed is not None:
        out = out.filter(F.col("seed") == seed)
    if not out.limit(1).count():
        raise DataContractError(f"no rows for {task}, {version}, seed {seed}")
    return out


def logit_conflicts(long: DataFrame, rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Examples whose calibrations carry different logits."""
    key = [c for c in LONG_PREDICTION if c not in ("calibration", "pred_proba")]
    span = long.groupBy(*key).agg(F.min("logit").alias("lo"), F.max("logit").alias("hi"))
    return span.filter(F.col("hi") - F.col("lo") > F.lit(atol) + F.lit(rtol) * F.abs("lo")).withColumn(
        "max_difference", F.col("hi") - F.col("lo")
    )


def to_wide(long: DataFrame, metadata: DataFrame, max_lens: DataFrame) -> DataFrame:
    """One row per example and seed, with both calibrations side by side."""
    key = [c for c in LONG_PREDICTION if c not in ("calibration", "pred_proba")]
    require_none(logit_conflicts(long), F.lit(True), "raw and calibrated rows carry different logits")
    wide = long.groupBy(*key).pivot("calibration", ["raw", "platt"]).agg(
        F.max("pred_proba").alias("p"), F.max("logit").alias("l")
    ).select(
        *key, F.coalesce("raw_l", "platt_l").alias("logit"), F.col("raw_p").alias("risk_raw"), F.col("platt_p").alias("risk_calibrated"),
        era_gap_of("compression_version").alias("era_gap"),
    )
    wide = wide.withColumnsRenamed({"model_name": "model", "example_id": "row_id"}).join(max_lens, ["task", "compression_version"], "left")
    return attach_prediction_time(wide, metadata).select(*WIDE_PREDICTION)


def attach_prediction_time(wide: DataFrame, metadata: DataFrame, check: bool = True) -> DataFrame:
    keys = ["task", "compression_version", "row_id", "subject_id", "split", "y_true"]
    times = metadata.select(*keys, "prediction_time").distinct()
    out = wide.join(times, keys, "left")
    return require_none(out, F.col("prediction_time").isNull(), "some predictions have no prediction time") if check else out


def duplicate_conflicts(pred: DataFrame, key: Sequence[str] = RUN_KEY, rtol: float = 1e-9) -> DataFrame:
    """Repeated keys whose values disagree, with the column that does.

    Score columns may differ by ``rtol``; labels and times must be equal.
    """
    exact = [c for c in ("y_true", "prediction_time") if c in pred.columns]
    near = [c for c in SCORE_COLUMNS if c in pred.columns]
    spans = pred.groupBy(*key).agg(
        F.count("*").alias("n_rows"), *[F.min(c).alias(f"lo_{c}") for c in exact + near], *[F.max(c).alias(f"hi_{c}") for c in exact + near]
    ).filter("n_rows > 1")
    wrong = [F.when(F.col(f"lo_{c}") != F.col(f"hi_{c}"), c) for c in exact] + [
        F.when(F.col(f"hi_{c}") - F.col(f"lo_{c}") > F.lit(1e-12) + F.lit(rtol) * F.abs(f"lo_{c}"), c) for c in near
    ]
    return spans.withColumn("conflicting_column", F.coalesce(*wrong)).filter("conflicting_column is not null").select(
        *key, "n_rows", "conflicting_column"
    )


def merge_runs(pred: DataFrame, pairs: DataFrame, seeds: Sequence[int], order: str = "source_run_tag", check: bool = True) -> DataFrame:
    """Runs merged to one row per key; the first run in ``order`` wins."""
    if check:
        require_none(duplicate_conflicts(pred), F.lit(True), "runs repeat predictions with other values")
    rest = [c for c in pred.columns if c not in RUN_KEY]
    first = F.min(F.struct(order, *[c for c in rest if c != order])).alias("r")
    merged = pred.groupBy(*RUN_KEY).agg(first).select(*RUN_KEY, *[F.col(f"r.{c}").alias(c) for c in rest])
    if check:
        require_none(seed_coverage(merged, pairs, seeds), ~F.col("complete"), "a task and version lacks seeds")
    return merged


def seed_coverage(pred: DataFrame, pairs: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Per required (task, version): seeds found, rows per seed, completeness."""
    per_seed = pred.filter(F.col("split") == "held_out").groupBy("task", "compression_version", "seed").agg(
        F.countDistinct("row_id").alias("n")
    )
    found = per_seed.groupBy("task", "compression_version").agg(
        F.count("*").alias("n_seeds"), F.count_if(F.col("seed").isin(*seeds)).alias("n_expected"),
        F.min("n").alias("min_rows"), F.max("n").alias("max_rows"),
    )
    out = pairs.join(found, ["task", "compression_version"], "left").fillna(0)
    whole = (F.col("n_seeds") == len(seeds)) & (F.col("n_expected") == len(seeds)) & (F.col("min_rows") == F.col("max_rows"))
    return out.withColumn("complete", whole).drop("n_expected")


def validate_predictions(pred: DataFrame, pairs: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Violation counts of a wide prediction table, one row per check."""
    require_columns(pred, [c for c in WIDE_PREDICTION if c not in ("model_family", "numeric_on")], "wide predictions")
    held = pred.filter(F.col("split") == "held_out")
    expected = sigmoid("logit")
    off = F.abs(expected - F.col("risk_raw")) > F.lit(1e-9) + F.lit(1e-7) * F.abs("risk_raw")
    outside = ~(F.col("risk_raw").between(0, 1) & F.col("risk_calibrated").between(0, 1))
    rows = held.agg(F.count_if(off).alias("a"), F.count_if(outside).alias("b"), F.count("*").alias("n"))
    repeats = held.groupBy(*[k for k in RUN_KEY if k != "split"]).count().agg(F.count_if(F.col("count") > 1).alias("c"))
    gaps = seed_coverage(held, pairs, seeds).agg(F.count_if(~F.col("complete")).alias("d"))
    row = rows.join(F.broadcast(repeats)).join(F.broadcast(gaps))  # one row each
    # Check ids that readers of the result look up.
    items = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("long").alias("n_violations")) for n, v in {
        "risk_raw_is_sigmoid_of_logit": F.col("a"), "prediction_probabilities_in_unit_interval": F.col("b"), "unique_held_out_key": F.col("c"),
        "complete_seed_coverage": F.col("d"), "has_held_out_rows": (F.col("n") == 0).cast("int"),
    }.items()])
    return row.select(F.explode(items).alias("i")).select("i.*", (F.col("i.n_violations") == 0).alias("passed"))


def recover_platt(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Slope and intercept behind calibrated risks, with the largest residual."""
    rows = df.select(*by, F.col("logit").alias("x"), logit("risk_calibrated").alias("t"))
    fit = rows.groupBy(*by).agg(F.regr_slope("t", "x").alias("platt_coef"), F.regr_intercept("t", "x").alias("platt_intercept"))
    error = F.abs(F.col("platt_coef") * F.col("x") + F.col("platt_intercept") - F.col("t"))
    return rows.join(broadcast_checked(fit), list(by)).groupBy(*by).agg(
        F.max("platt_coef").alias("platt_coef"), F.max("platt_intercept").alias("platt_intercept"), F.max(error).alias("max_abs_error")
    )


def high_repeat(raw: DataFrame, reference: DataFrame, q: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Held-out examples with the most removed events, and the threshold table."""
    from eraloom.functions.ordered import exact_percentiles

    keys = ["task", "row_id", "subject_id", "split"]
    held = lambda df: df.filter(F.col("split") == "held_out")
    both = held(raw).select(*keys, F.col("label").alias("y_true"), F.col("seq_len").alias("raw_seq_len")).join(
        held(reference).select(*keys, F.col("seq_len").alias("ref_seq_len"), F.col("n_events_removed_vs_raw").alias("__removed")), keys
    ).withColumn("repeat_removed", F.coalesce("__removed", F.col("raw_seq_len") - F.col("ref_seq_len")).cast("double")).drop("__removed")
    cut = exact_percentiles(both, ["task"], "repeat_removed", {"repeat_removed_threshold": q})
    flagged = both.join(broadcast_checked(cut), "task").withColumn("high_repeat_group", F.col("repeat_removed") >= F.col("repeat_removed_threshold"))
    flagged = flagged.withColumn("group_name", F.when(F.col("high_repeat_group"), "high_repeat_top10").otherwise("other_90"))
    top = F.col("high_repeat_group")
    thresholds = flagged.groupBy("task").agg(
        F.max("repeat_removed_threshold").alias("repeat_removed_threshold"), F.count("*").alias("n_heldout_examples"),
        F.countDistinct("subject_id").alias("n_heldout_patients"), F.count_if(top).alias("n_high_repeat_examples"),
        F.countDistinct(F.when(top, F.col("subject_id"))).alias("n_high_repeat_patients"), F.count_if(~top).alias("n_other_examples"),
        F.sum(F.when(top, F.col("y_true"))).alias("n_high_repeat_positive"), F.avg(F.when(top, F.col("y_true"))).alias("high_repeat_event_rate"),
        F.avg(F.when(~top, F.col("y_true"))).alias("other_event_rate"),
    )
    return flagged, thresholds


def subgroup_patients(flagged: DataFrame) -> DataFrame:
    """Subjects with at least one flagged example. Removed counts are whole numbers."""
    return flagged.filter("high_repeat_group").groupBy("task", "subject_id").agg(
        F.countDistinct("row_id").alias("n_high_repeat_examples"), F.max("repeat_removed").alias("max_repeat_removed"),
        F.percentile("repeat_removed", F.lit(0.5)).alias("median_repeat_removed"),
    )


def add_subgroup(pred: DataFrame, flagged: DataFrame, check: bool = True) -> DataFrame:
    cols = ["high_repeat_group", "group_name", "repeat_removed", "repeat_removed_threshold"]
    out = pred.join(flagged.select("task", "row_id", "subject_id", *cols), ["task", "row_id", "subject_id"])
    if check and not out.limit(1).count():
        raise DataContractError("no prediction belongs to a subgroup")
    return out


def sequence_cost(examples: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Length and removal summary for all, held-out and held-out high-repeat examples.

    Each example is tagged with its slices and all slices are one aggregation.
    """
    rows = examples.select(
        "task", "version", "split", "row_id", "subject_id", "seq_len", "n_events_removed_vs_raw", "n_synthetic_events", "n_compressible_chronic_events_raw"
    )
    tags = [F.lit("all"), F.when(F.col("split") == "held_out", "held_out")]
    if flagged is not None:
        top = flagged.filter("high_repeat_group").select("task", "row_id", "subject_id", F.lit(True).alias("__top"))
        rows = rows.join(top, ["task", "row_id", "subject_id"], "left")
        tags.append(F.when(F.col("__top"), "held_out_high_repeat"))
    tagged = rows.withColumn("slice", F.explode(F.array_compact(F.array(*tags))))
    removed = "n_events_removed_vs_raw"
    return tagged.groupBy("task", "version", "slice").agg(
        F.count("*").alias("n_examples"), F.countDistinct("subject_id").alias("n_patients"), F.avg("seq_len").alias("mean_seq_len"),
        F.percentile("seq_len", F.lit(0.5)).alias("median_seq_len"), F.percentile("seq_len", F.lit(0.9)).alias("p90_seq_len"),
        F.max("seq_len").alias("max_seq_len"), F.avg(removed).alias("mean_events_removed_vs_raw"),
        F.percentile(removed, F.lit(0.5)).alias("median_events_removed_vs_raw"), F.percentile(removed, F.lit(0.9)).alias("p90_events_removed_vs_raw"),
        F.avg("n_synthetic_events").alias("mean_synthetic_events"), F.avg("n_compressible_chronic_events_raw").alias("mean_compressible_events_raw"),
    )


def with_baseline(df: DataFrame, keys: Sequence[str], columns: Sequence[str], at: str = "requested_copy_fraction") -> DataFrame:
    """Each row next to its zero-fraction row.

    The baseline is an aggregate that is joined back: one row per key, however
    many fractions or seeds there are. It has as many rows as there are keys,
    so it is not sent through the driver.
    """
    base = df.filter(F.col(at) == 0).groupBy(*keys).agg(*[F.max(c).alias(f"{c}_at_0") for c in columns])
    return df.join(base.hint("merge"), list(keys), "left")




def key_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, tagged ``only_a`` or ``only_b``."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    only_a = ka.join(kb, list(keys), "left_anti").withColumn("side", F.lit("only_a"))
    return only_a.unionByName(kb.join(ka, list(keys), "left_anti").withColumn("side", F.lit("only_b")))
