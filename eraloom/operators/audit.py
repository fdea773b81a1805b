"""Episode audits and representation invariants, as aggregate queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from eraloom.functions.scalar import strip_structure, structural_pattern, whole_days
from eraloom.operators.eras import AUDIT_COUNTERS, LONG
from eraloom.operators.history import TOKEN_ORDER
from eraloom.schemas import EPISODE_AUDIT_REQUIRED, EPISODE_KEY

TRANSFORM_TOTALS = {
    "audit_persistent_events": "persistent_events_accounted_by_transform",
    "audit_repeats_removed": "n_repeats_removed",
    "audit_visit_day_duplicates_removed": "n_visit_day_duplicates_removed",
    "audit_era_repeat_mentions_removed": "n_era_repeat_mentions_removed",
    "audit_condition_eras": "n_condition_eras",
    "audit_compressed_eras": "n_compressed_eras",
}


def persistent_stats(history: DataFrame, flag: str, suffix: str, keys: list[str] | None = None) -> DataFrame:
    """Listed events and distinct listed codes per episode."""
    per_code = history.groupBy(*(keys or EPISODE_KEY), "code").agg(F.sum(F.col(flag).cast("int")).alias("n"))
    return per_code.groupBy(*(keys or EPISODE_KEY)).agg(
        F.sum("n").alias(f"n_persistent_events_{suffix}"),
        F.count_if(F.col("n") > 0).alias(f"n_unique_persistent_codes_{suffix}"),
    )


def history_audit(known: DataFrame, context: int, window_mode: str, carried: Sequence[str] = ()) -> DataFrame:
    """Lengths, boundary event and listed counts, read off the cutoffs; other ``carried`` columns come along.

    ``known`` has the columns of :func:`eras.window_bounds` and
    :func:`eras.window_codes`. An episode without events has zeros, and no times.
    """
    n, listed = F.col("n_events"), F.col("n_events") - F.col("n_plain")
    window = F.least(n, F.lit(context))
    only_window = window_mode == "no_backfill"
    in_window = F.col("n_codes_in_window")
    return known.select(
        *EPISODE_KEY, *carried, n.cast("int").alias("original_history_len"), "original_earliest_time", "original_latest_time",
        window.cast("int").alias("raw_window_len"),
        F.when(n > 0, F.col("raw_window_boundary_time")).alias("raw_window_boundary_time"),
        F.when(n > 0, F.col("raw_window_boundary_source_event_id")).alias("raw_window_boundary_source_event_id"),
        F.when(n > 0, F.col("original_latest_time")).alias("raw_window_latest_time"),
        (window if only_window else n).cast("int").alias("transformation_input_len"),
        listed.cast("int").alias("n_persistent_events_original"),
        F.col("n_codes").cast("int").alias("n_unique_persistent_codes_original"),
        F.when(n > 0, F.col("n_listed_in_window")).otherwise(0).cast("int").alias("n_persistent_events_raw_window"),
        in_window.cast("int").alias("n_unique_persistent_codes_raw_window"),
        F.when(n > 0, F.col("n_listed_in_window") if only_window else listed).otherwise(0).cast("int")
        .alias("n_persistent_events_transform_input"),
        (in_window if only_window else F.col("n_codes")).cast("int").alias("n_unique_persistent_codes_transform_input"),
        (n > context).alias("was_raw_window_truncated"),
    )


def transform_audit(transformed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of the audit counters over the tokens before the final cap."""
    return transformed.groupBy(*(keys or EPISODE_KEY)).agg(
        F.count("*").cast("int").alias("transformed_history_len_before_truncation"),
        *[F.sum(c).cast("int").alias(TRANSFORM_TOTALS[c]) for c in AUDIT_COUNTERS],
    )


def transform_audit_from_cutoffs(cutoffs: DataFrame, raw: bool) -> DataFrame:
    """The same sums for raw and backfill, without building any token."""
    return cutoffs.select(*EPISODE_KEY, *transform_totals(raw))


def transform_totals(raw: bool, of: str = "") -> list[Column]:
    """Those sums from the counts of a timeline or, with the prefix ``of``, of a window."""
    n = lambda name: F.col(f"{of}{name}")
    listed, points, eras, compressed = n("n_events") - n("n_plain"), n("n_points"), n("n_eras"), n("n_compressed")
    length = n("n_events") if raw else n("n_plain") + eras + 2 * compressed
    values = [listed, listed - eras, listed - points, points - eras, eras, compressed]
    return [
        length.cast("int").alias("transformed_history_len_before_truncation"),
        *[(F.lit(0) if raw else v).cast("int").alias(TRANSFORM_TOTALS[c]) for c, v in zip(AUDIT_COUNTERS, values)],
    ]


def final_audit(
    known: DataFrame, raw: bool, context: int, window_mode: str,
    code_list_id: str = "", code_list_sha256: str = "", carried: Sequence[str] = (),
) -> DataFrame:
    """Full audit per episode, read off its own row; other ``carried`` columns come along.

    ``known`` holds what :func:`history_audit` reads and the arrays of
    :func:`sequences.encode_packed`, and for the no-backfill mode the counts of
    the window as ``in_window``.
    """
    totals = ["transformed_history_len_before_truncation", *TRANSFORM_TOTALS.values()]
    arrays = ["__times", "__anchors", "__kept", "__far", *carried]
    df = known.select(
        "*", *transform_totals(raw, "in_window." if window_mode == "no_backfill" else ""),
        F.col("seq_len").alias("__kept"), F.array_max("days_before_prediction").alias("__far"),
    )
    df = history_audit(df, context, window_mode, [*totals, *arrays])
    own = [c for c in df.columns if c not in [*totals, *arrays]]
    first, last = F.array_min("__times"), F.array_max("__times")
    bound_t, bound_id = F.col("raw_window_boundary_time"), F.col("raw_window_boundary_source_event_id")
    early = F.size(F.filter(
        F.arrays_zip(F.col("__times").alias("t"), F.col("__anchors").alias("a")),
        lambda x: (x["t"] < bound_t) | ((x["t"] == bound_t) & (x["a"] < bound_id)),
    ))
    if window_mode in ("backfill", "structure_null"):
        added = F.when((F.col("original_history_len") > context) & F.col("__times").isNotNull(), early).otherwise(0)
    else:
        added = F.lit(0)
    length = F.col("transformed_history_len_before_truncation")
    cut = length > context
    any_cut = (F.col("was_raw_window_truncated") | cut) if window_mode == "no_backfill" else cut
    return df.select(
        *own, *totals, length.alias("transformed_history_len"),
        F.coalesce("__kept", F.lit(0)).alias("final_seq_len"),
        (F.col("transformation_input_len") - length).alias("n_net_events_removed_by_transform"),
        cut.alias("was_transformed_truncated"), any_cut.alias("was_truncated_by_max_len"),
        any_cut.alias("was_truncated"),
        first.alias("earliest_retained_time"), last.alias("latest_retained_time"),
        F.col("__far").alias("earliest_retained_days_before_prediction"),
        whole_days(first, F.col("prediction_time")).cast("float").alias("covered_days"),
        whole_days(first, last).cast("float").alias("retained_calendar_span_days"),
        added.alias("n_backfill_events_added"),
        F.col("n_unique_persistent_codes_original").alias("n_unique_persistent_codes_full_history"),
        F.col("n_unique_persistent_codes_original").alias("n_persistent_diagnoses"),
        F.lit(code_list_id).alias("persistent_code_list_id"),
        F.lit(code_list_sha256).alias("persistent_code_list_sha256"),
        *carried,
    )


def _checks(row: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """Turn a table of violation counts into (check, n_violations, passed) rows."""
    items = F.array(*[
        F.struct(F.lit(name).alias("check"), F.coalesce(bad, F.lit(0)).cast("long").alias("n_violations"))
        for name, bad in checks.items()
    ])
    return row.select(*keys, F.explode(items).alias("c")).select(
        *keys, "c.check", "c.n_violations", (F.col("c.n_violations") == 0).alias("passed")
    )


def check_no_backfill(long: DataFrame, window: DataFrame) -> DataFrame:
    """Five invariants of a no-backfill table against its raw windows.

    ``window`` is the raw window table with ``source_event_id`` and
    ``event_position``; both sides are capped per episode.
    """
    keys = ["row_id", "task"]
    anchors = window.select(*keys, F.col("source_event_id").alias("order_anchor_id"), F.col("time").alias("__at"))
    edge = window.filter("event_position = 1").select(
        *keys, F.col("time").alias("__edge"), F.col("source_event_id").alias("__edge_id")
    )
    order = Window.partitionBy(*keys).orderBy(*TOKEN_ORDER)
    rows = long.withColumn("__expected", F.row_number().over(order)).join(edge, keys, "left").join(
        anchors, [*keys, "order_anchor_id"], "left"
    )
    t, edge_t = F.col("time"), F.col("__edge")
    counted = rows.agg(
        F.count_if((t < edge_t) | ((t == edge_t) & (F.col("order_anchor_id") < F.col("__edge_id")))).alias("before"),
        F.count_if(F.col("__at").isNull()).alias("unanchored"),
        F.count_if(F.col("__at") != t).alias("moved"),
        F.count_if(F.col("event_position") != F.col("__expected")).alias("order"),
        F.count_if(t > F.col("prediction_time")).alias("late"),
    )
    return _checks(counted, [], {
        "no_event_before_raw_window": F.col("before"),
        "no_event_from_earlier_history": F.col("unanchored"),
        "anchor_time_matches_raw_window": F.col("moved"),
        "event_order_preserved": F.col("order"),
        "no_event_after_prediction": F.col("late"),
    })


def check_structure_null(
    source: DataFrame, null: DataFrame, vocab: DataFrame, sequences: DataFrame, gap_days: int,
) -> DataFrame:
    """Eight invariants of a structure-null table against its source table."""
    keys = ["task", "row_id", "event_position"]
    same = [c for c in LONG if c not in keys]
    a = source.select(*keys, F.struct(*same).alias("a"))
    b = null.select(*keys, F.struct(*same).alias("b"))
    pattern = structural_pattern(gap_days)
    state = F.col("a.code").rlike(pattern)
    base = strip_structure(F.col("a.code"), gap_days)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    any_of = lambda cols: reduce(lambda x, y: x | y, cols)
    fixed = [c for c in EPISODE_KEY if c not in keys] + ["days_before_prediction"]
    kept_features = F.col("b.numeric_value").isNotNull() | F.col("b.text_value").isNotNull()
    counted = a.join(b, keys, "full").agg(
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
        F.count_if(both & differs("time")).alias("time"),
        F.count_if(both & (differs("order_anchor_id") | differs("role_order"))).alias("order"),
        F.count_if(both & (F.col("b.code") != base)).alias("base"),
        F.count_if(F.col("b.code").rlike(pattern) | F.col("b.is_compression_token") | (both & state & kept_features)).alias("features"),
        F.count_if(both & ~state & any_of([differs(c) for c in ["code", "numeric_value", "text_value", "is_compression_token"]])).alias("other"),
        F.count_if(both & any_of([differs(c) for c in fixed])).alias("fixed"),
    )
    words = vocab.agg(F.count_if(F.col("code").rlike(pattern)).alias("words"), F.count("*").alias("size"))
    bad_id = lambda x: (x < 0) | (x >= F.col("size"))
    tokens = sequences.select("codes", "token_ids").join(F.broadcast(words)).agg(  # words is one row
        F.count_if(F.exists("codes", lambda c: c.rlike(pattern)) | F.exists("token_ids", bad_id)).alias("tokens")
    )
    row = counted.join(F.broadcast(words)).join(F.broadcast(tokens))  # one row each
    return _checks(row, [], {
        "event_count_matches_source": F.col("unmatched"),
        "event_times_match_source": F.col("time"),
        "event_order_matches_source": F.col("unmatched") + F.col("order"),
        "base_codes_match_source": F.col("base"),
        "state_features_absent": F.col("features"),
        "special_tokens_absent_from_vocabulary": F.col("words"),
        "special_tokens_absent_from_sequences": F.col("tokens"),
        "only_structural_features_differ": F.col("unmatched") + F.col("other") + F.col("fixed"),
    })


def check_episode_audit(examples: DataFrame, context: int, kind: str, window_mode: str) -> DataFrame:
    """Six common invariants plus those of the window mode."""
    missing = [c for c in EPISODE_AUDIT_REQUIRED if c not in examples.columns]
    c = F.col
    # The names of the checks, here and below.
    rules = {
        "required_episode_audit_columns": F.lit(not missing),
        "final_seq_len_equals_seq_len": c("final_seq_len") == c("seq_len"),
        "seq_len_within_context": c("seq_len") <= context,
        "nonnegative_repeat_counts": c("n_repeats_removed") >= 0,
        "nonnegative_backfill_counts": c("n_backfill_events_added") >= 0,
        "backfill_not_above_final_len": c("n_backfill_events_added") <= c("seq_len"),
    }
    if kind == "raw":
        rules["raw_transform_length_equals_original"] = c("transformed_history_len") == c("original_history_len")
        rules["raw_repeats_removed_zero"] = c("n_repeats_removed") == 0
        rules["raw_added_zero"] = c("n_backfill_events_added") == 0
    if window_mode == "backfill":
        rules["backfill_uses_full_history"] = c("transformation_input_len") == c("original_history_len")
    if window_mode == "no_backfill":
        rules["no_backfill_input_is_raw_window"] = c("transformation_input_len") == F.least(c("original_history_len"), F.lit(context))
        rules["no_backfill_added_zero"] = c("n_backfill_events_added") == 0
    names = list(rules)
    row = examples.agg(*[F.count_if(~rules[n]).alias(n) for n in names])
    return _checks(row, [], {n: F.col(n) for n in names})


def build_guards(examples: DataFrame, context: int, window_mode: str) -> DataFrame:
    """Length, cap, sign and future-event guards of a finished example table."""
    n_added = F.col("n_backfill_events_added")
    wrong_zero = (n_added != 0) if window_mode in ("raw", "no_backfill") else F.lit(False)
    row = examples.agg(
        F.count_if(F.col("final_seq_len") != F.col("seq_len")).alias("length"),
        F.count_if(F.col("seq_len") > context).alias("cap"), F.count_if(n_added < 0).alias("sign"),
        F.count_if(wrong_zero).alias("zero"),
        F.count_if(F.exists("days_before_prediction", lambda d: d < F.lit(-1e-6))).alias("future"),
    )
    return _checks(row, [], {
        "audit_length_equals_sequence": F.col("length"), "length_within_context": F.col("cap"),
        "backfill_count_not_negative": F.col("sign"), "backfill_count_zero_where_required": F.col("zero"),
        "no_future_event": F.col("future"),
    })
