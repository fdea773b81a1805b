"""Gap-bounded eras: per-episode compression and per-subject validity tokens.

Two points of one code on the same calendar day can never be split by a gap of
whole days. Eras are therefore found on a table with one row per (key, code,
day), so the ordered step of even the busiest key is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from eraloom.functions.ordered import calendar_day, running
from eraloom.functions.scalar import (
    count_bin, era_prefix, strip_structure, structural_pattern, whole_days,
)
from eraloom.operators.history import ALONE, CHUNK, blocks, chunk_arrays, chunk_of, chunks_of, mark_codes, window_arrays
from eraloom.schemas import EPISODE_KEY
from eraloom.session import broadcast_checked

AUDIT_COUNTERS = [
    "audit_persistent_events", "audit_repeats_removed", "audit_visit_day_duplicates_removed",
    "audit_era_repeat_mentions_removed", "audit_condition_eras", "audit_compressed_eras",
]
TOKEN = [
    "time", "code", "numeric_value", "text_value", "days_before_prediction", "is_compression_token",
    "order_anchor_id", "role_order",
]
TRANSFORMED = EPISODE_KEY + TOKEN + AUDIT_COUNTERS
LONG = EPISODE_KEY + TOKEN + ["event_position"]


def first_mentions(mentions: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """One point per (key, code, bucket): mention count and the earliest mention."""
    first = F.min(F.struct("time", "source_event_id", *(extra or []), "numeric_value", "text_value"))
    return mentions.groupBy(*keys, "code", "compression_bucket").agg(
        F.count("*").alias("n_mentions"), first.alias("first")
    ).select(*keys, "code", "compression_bucket", "n_mentions", "first.*")


def era_days(points: DataFrame, keys: list[str], gap_days: int, extra: list[str] | None = None, gathered: Sequence[str] = ()) -> DataFrame:
    """One row per (key, code, day) with its era number and place in the era; the first point brings its ``extra`` columns.

    With ``gathered`` columns, ``day_all`` has them of all points of the day, in order.
    """
    days = points.withColumn("day", calendar_day("time")).groupBy(*keys, "code", "day").agg(
        F.count("*").alias("day_points"), F.sum("n_mentions").alias("day_mentions"),
        F.min(F.struct("time", "source_event_id", *(extra or []), "numeric_value", "text_value")).alias("day_first"),
        F.max(F.struct("time", "source_event_id")).alias("day_last"),
        *([F.sort_array(F.collect_list(F.struct(*gathered))).alias("day_all")] if gathered else []),
    )
    timeline = Window.partitionBy(*keys, "code").orderBy("day")
    previous = F.lag("day_last.time").over(timeline)
    starts = F.when(
        previous.isNull() | (whole_days(previous, F.col("day_first.time")) > gap_days), 1
    ).otherwise(0)
    return days.withColumn("__new", starts).withColumn("era", F.sum("__new").over(timeline) - 1).drop("__new")


def era_index(points: DataFrame, keys: list[str], gap_days: int) -> DataFrame:
    """Points with their zero-based era number."""
    days = era_days(points, keys, gap_days).select(*keys, "code", "day", "era")
    return points.withColumn("day", calendar_day("time")).join(days, [*keys, "code", "day"]).drop("day")


def era_summary(days: DataFrame, keys: list[str]) -> DataFrame:
    """Points, mentions, ends and removals per era."""
    return days.groupBy(*keys, "code", "era").agg(
        F.sum("day_points").cast("int").alias("n_points"),
        F.sum("day_mentions").cast("int").alias("n_mentions"),
        F.min("day_first").alias("first"),
        F.max("day_last").alias("last"),
    ).select(
        *keys, "code", "era", "n_points", "n_mentions",
        (F.col("n_mentions") - F.col("n_points")).alias("n_visit_day_duplicates_removed"),
        (F.col("n_mentions") - 1).alias("n_repeats_removed"),
        (F.col("n_points") - 1).alias("n_era_repeat_mentions_removed"),
        whole_days(F.col("first.time"), F.col("last.time")).cast("float").alias("span_days"),
        "first", "last",
    )


def token(time, code, number, text, state: bool, anchor, role: int, **more) -> Column:
    fields = {
        "time": time, "code": code, "numeric_value": number.cast("float"),
        "text_value": text.cast("string"), "is_compression_token": F.lit(state),
        "order_anchor_id": anchor.cast("long"), "role_order": F.lit(role), **more,
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def state_code(gap_days: int, kind: str, code: Column, n_points: Column | None = None) -> Column:
    # Token names are START/code, END/code and COUNT_BIN/bin/code.
    head = F.lit(f"{era_prefix(gap_days)}_{kind}/")
    return F.concat(head, code) if n_points is None else F.concat(head, count_bin(n_points), F.lit("/"), code)


def plain_tokens(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(
        *keys, "time", "code", "numeric_value", "text_value", "days_before_prediction",
        F.lit(False).alias("is_compression_token"), F.col("source_event_id").alias("order_anchor_id"),
        F.lit(0).alias("role_order"), *[F.lit(0).alias(c) for c in AUDIT_COUNTERS],
    )


def raw_tokens(history: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The raw representation: one plain token per event."""
    return plain_tokens(history, keys or EPISODE_KEY)


def compress_eras(days: DataFrame, keys: list[str], gap_days: int) -> DataFrame:
    """Tokens of each era: the event itself, or START, END and COUNT_BIN.

    Audit counters sit on one token per era so that sums count each era once.
    """
    s = era_summary(days, keys)
    none = F.lit(None)
    counts = [
        F.col("n_mentions"), F.col("n_repeats_removed"), F.col("n_visit_day_duplicates_removed"),
        F.col("n_era_repeat_mentions_removed"), F.lit(1),
    ]
    zero = dict.fromkeys(AUDIT_COUNTERS, F.lit(0))

    def carried(compressed: int) -> dict[str, Column]:
        return {n: c.cast("int") for n, c in zip(AUDIT_COUNTERS, [*counts, F.lit(compressed)])}

    code, first, last = F.col("code"), F.col("first"), F.col("last")
    single = token(first["time"], code, first["numeric_value"], first["text_value"], False,
                   first["source_event_id"], 0, **carried(0))
    start = token(first["time"], state_code(gap_days, "START", code), F.lit(0.0), none, True,
                  first["source_event_id"], 10, **carried(1))
    end = token(last["time"], state_code(gap_days, "END", code), F.col("span_days"), none, True,
                last["source_event_id"], 20, **zero)
    count = token(last["time"], state_code(gap_days, "COUNT_BIN", code, F.col("n_points")),
                  F.col("n_points"), none, True, last["source_event_id"], 30, **zero)
    emitted = F.when(F.col("n_points") == 1, F.array(single)).otherwise(F.array(start, end, count))
    return s.select(*keys, F.explode(emitted).alias("t")).select(
        *keys, "t.time", "t.code", "t.numeric_value", "t.text_value",
        whole_days(F.col("t.time"), F.col("prediction_time")).cast("float").alias("days_before_prediction"),
        "t.is_compression_token", "t.order_anchor_id", "t.role_order",
        *[f"t.{c}" for c in AUDIT_COUNTERS],
    )


def condition_era(
    history: DataFrame, codes: DataFrame, gap_days: int, keys: list[str] | None = None,
    cluster: list[str] | None = None,
) -> DataFrame:
    """Compress listed codes of each episode history into eras; a history with ``is_compressible`` is marked already.

    With ``cluster`` the listed rows are shuffled once by those columns and every
    later step stays in place. Use it only when each cluster is bounded, as it is
    for capped windows.
    """
    keys = keys or EPISODE_KEY
    marked = history if "is_compressible" in history.columns else mark_codes(history, codes)
    listed = marked.filter("is_compressible")
    points = first_mentions(listed.repartition(*cluster) if cluster else listed, keys)
    states = compress_eras(era_days(points, keys, gap_days), keys, gap_days)
    return plain_tokens(marked.filter(~F.col("is_compressible")), keys).unionByName(states)


def subject_points(ranked: DataFrame, gap_days: int) -> DataFrame:
    """Points of a whole subject timeline with place, era and next point in the era.

    Era borders depend on earlier points only, so one pass per subject serves
    every episode of that subject at any prediction time.
    """
    keys = ["subject_id"]
    listed = ranked.filter("is_compressible")
    if not any_busy(ranked):  # mentions move once and all steps stay where a subject's code lies
        listed = listed.repartition("subject_id", "code")
    points = first_mentions(listed, keys, ["event_rank", "plain_rank"])
    days = era_days(points, keys, gap_days, ["plain_rank"], ["time", "source_event_id", "event_rank", "plain_rank", "numeric_value", "text_value"])
    inside = Window.partitionBy("subject_id", "code", "era").orderBy("day")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(
        "subject_id", "code", "era", "day_all",
        F.coalesce(F.sum("day_points").over(before), F.lit(0)).alias("__before"),
        F.lead("day_first").over(inside).alias("__next_day_first"),
        F.first("day_first.time").over(inside).alias("era_start"),
    )

    def following(name: str) -> Column:
        return F.coalesce(F.get("day_all", F.col("__at") + 1)[name], F.col("__next_day_first")[name])

    return days.select("*", F.posexplode("day_all").alias("__at", "p")).select(
        "subject_id", "code", "era", "p.*", "era_start", (F.col("__before") + F.col("__at") + 1).cast("int").alias("place"),
        following("time").alias("next_time"), following("plain_rank").alias("next_plain"),
    )


def any_busy(ranked: DataFrame) -> bool:
    """Whether a subject has so many events that its steps are cut into days."""
    return not ranked.filter(F.col("event_rank") > ALONE).isEmpty()


def validity_tokens(ranked: DataFrame, points: DataFrame, gap_days: int) -> DataFrame:
    """Tokens of a subject with the prediction times at which they hold.

    A token holds when ``valid_from`` is legal and ``valid_to`` is not yet. The
    first point of an era is an event until its second point arrives, then a
    START; each later point carries END and COUNT_BIN until the next one.
    ``plain_at``, ``plain_from`` and ``plain_to`` count the plain events up to
    the token's event and to both ends of its time.
    """
    none = F.lit(None)

    def held(since: Column, until: Column) -> dict[str, Column]:
        later = since is nxt
        return {
            "valid_from": since, "valid_to": until.cast("timestamp_ntz"),
            "event_rank": F.col("event_rank"), "base_code": F.col("code"), "plain_rank": F.lit(None).cast("long"),
            "plain_at": F.col("plain_rank").cast("long"), "plain_from": F.col("next_plain" if later else "plain_rank").cast("long"),
            "plain_to": (none if later else F.col("next_plain")).cast("long"),
        }

    code, time, nxt, anchor = F.col("code"), F.col("time"), F.col("next_time"), F.col("source_event_id")
    single = token(time, code, F.col("numeric_value"), F.col("text_value"), False, anchor, 0, **held(time, nxt))
    start = token(time, state_code(gap_days, "START", code), F.lit(0.0), none, True, anchor, 10, **held(nxt, none))
    end = token(time, state_code(gap_days, "END", code), whole_days(F.col("era_start"), time), none, True,
                anchor, 20, **held(time, nxt))
    count = token(time, state_code(gap_days, "COUNT_BIN", code, F.col("place")), F.col("place"), none, True,
                  anchor, 30, **held(time, nxt))
    emitted = (
        F.when((F.col("place") == 1) & nxt.isNull(), F.array(single))
        .when(F.col("place") == 1, F.array(single, start)).otherwise(F.array(end, count))
    )
    states = points.select("subject_id", F.explode(emitted).alias("t")).select("subject_id", "t.*")
    plain = ranked.filter(~F.col("is_compressible")).select(
        "subject_id", "time", "code", "numeric_value", "text_value",
        F.lit(False).alias("is_compression_token"), F.col("source_event_id").alias("order_anchor_id"),
        F.lit(0).alias("role_order"), F.col("time").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), "event_rank", F.col("code").alias("base_code"),
        *[F.col("plain_rank").cast("long").alias(c) for c in ("plain_rank", "plain_at", "plain_from")],
        F.lit(None).cast("long").alias("plain_to"),
    )
    return plain.unionByName(states)


def episode_cutoffs(
    labels: DataFrame, ranked: DataFrame, points: DataFrame | None, inclusive: bool = True,
) -> DataFrame:
    """Counts of a subject's timeline as of each prediction time.

    Every counter of the history and transform audits is a running sum over the
    timeline, so it is read off at the prediction time; no history is built.
    Events and episodes of a subject meet in one place, unless a subject has
    very many events: then each day is looked at on its own.
    """
    counters = ["n_events", "n_plain", "n_points", "n_eras", "n_compressed", "n_codes"]
    if not any_busy(ranked):
        return _cutoffs_in_one_place(labels, ranked, points, inclusive, counters)

    def steps(df: DataFrame, **made: Column) -> DataFrame:
        return df.select(
            "subject_id", "time", *[made.get(c, F.lit(0)).cast("long").alias(c) for c in counters]
        )

    grown = steps(ranked, n_events=F.lit(1), n_plain=(~F.col("is_compressible")).cast("int"))
    if points is not None:
        first = (F.col("place") == 1).cast("int")
        grown = grown.unionByName(steps(
            points, n_points=F.lit(1), n_eras=first, n_compressed=(F.col("place") == 2).cast("int"),
            n_codes=F.when(F.col("era") == 0, first).otherwise(0),
        ))
    day, keys = calendar_day("time").alias("day"), ["subject_id", "day"]
    asked = labels.select("subject_id", F.col("prediction_time").alias("time"), calendar_day("prediction_time").alias("day")).distinct()
    asked_days = asked.select(*keys).distinct()
    zero = [F.lit(0).cast("long").alias(c) for c in counters]

    # Whole days before the prediction day: one row per subject and day.
    days = grown.select("*", day).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], F.max("time").alias("latest"))
    none = F.lit(None).cast("timestamp_ntz").alias("latest")
    before = Window.partitionBy("subject_id").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.withColumn("asked", F.lit(1)).unionByName(asked_days.select("*", *zero, none, F.lit(0).alias("asked"))).select(
        *keys, "asked", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in counters],
        F.max("latest").over(before).alias("b_latest"),
    ).filter("asked = 0").drop("asked")

    # Inside the prediction day: only the days that are asked for are looked at row by row.
    near = grown.select("*", day).join(asked_days, keys, "left_semi").groupBy(*keys, "time").agg(*[F.sum(c).alias(c) for c in counters])
    both = near.select("*", F.col("time").alias("latest"), F.lit(0).alias("side")).unionByName(
        asked.select("*", *zero, none, F.lit(1 if inclusive else -1).alias("side"))
    )
    upto = Window.partitionBy(*keys).orderBy("time", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.select(
        *keys, "time", "side", *[F.sum(c).over(upto).alias(f"i_{c}") for c in counters], F.max("latest").over(upto).alias("i_latest")
    ).filter("side <> 0")
    known = inside.join(carry, keys).select(
        "subject_id", F.col("time").alias("prediction_time"), *[(F.col(f"b_{c}") + F.col(f"i_{c}")).alias(c) for c in counters],
        F.greatest("b_latest", "i_latest").alias("original_latest_time"),
    )
    return labels.select(*EPISODE_KEY).join(known, ["subject_id", "prediction_time"], "left").select(
        *EPISODE_KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in counters], "original_latest_time"
    )


def _cutoffs_in_one_place(labels: DataFrame, ranked: DataFrame, points: DataFrame | None, inclusive: bool, counters: list[str]) -> DataFrame:
    """:func:`episode_cutoffs` by running values along each subject's events, points and episodes."""
    asked = labels.select(
        *EPISODE_KEY, F.col("prediction_time").alias("__time"), F.lit(1 if inclusive else -1).cast("byte").alias("__side"),
    )
    at = [F.col("time").alias("__time"), F.lit(0).cast("byte").alias("__side")]
    # Ranks count the events already.
    rows = asked.unionByName(ranked.select(
        "subject_id", *at, F.col("event_rank").cast("long").alias("n_events"), F.col("plain_rank").cast("long").alias("n_plain"),
    ), allowMissingColumns=True)
    if points is not None:
        first = F.col("place") == 1
        steps = {"n_points": F.lit(1), "n_eras": first, "n_compressed": F.col("place") == 2, "n_codes": first & (F.col("era") == 0)}
        rows = rows.unionByName(points.select("subject_id", *at, *[c.cast("byte").alias(n) for n, c in steps.items()]), allowMissingColumns=True)
    upto = Window.partitionBy("subject_id").orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = {n: F.max(n) if n in ("n_events", "n_plain") else F.sum(n) for n in counters if n in rows.columns}
    return rows.repartition("subject_id").select(
        *EPISODE_KEY, "__side", *[(F.coalesce(known[n].over(upto), F.lit(0)) if n in known else F.lit(0)).cast("long").alias(n) for n in counters],
        F.max(F.when(F.col("__side") == 0, F.col("__time"))).over(upto).alias("original_latest_time"),
    ).filter("__side <> 0").drop("__side")


def window_bounds(cutoffs: DataFrame, ranked: DataFrame, context: int) -> DataFrame:
    """Add the first event of each raw window and the earliest useful rank.

    ``floor_rank`` is the rank of the ``context``-th last plain event: whatever
    lies before it cannot be among the last ``context`` tokens.
    """
    low = F.greatest(F.col("n_events") - context, F.lit(0)).alias("window_low")
    edge = ranked.select(
        "subject_id", F.col("event_rank").alias("__edge"),
        F.col("time").alias("raw_window_boundary_time"),
        F.col("source_event_id").alias("raw_window_boundary_source_event_id"),
        (F.col("event_rank") - 1 - F.col("plain_rank") + (~F.col("is_compressible")).cast("int")).alias("__listed_before"),
    )
    plain = ranked.filter(~F.col("is_compressible")).select(
        "subject_id", F.col("plain_rank").alias("__plain"), F.col("event_rank").alias("floor_rank")
    )
    out = cutoffs.select("*", low).withColumn("__edge", F.col("window_low") + 1).withColumn(
        "__plain", F.col("n_plain") - context + 1
    )
    out = out.join(edge, ["subject_id", "__edge"], "left").join(plain, ["subject_id", "__plain"], "left")
    return out.select(
        *cutoffs.columns, "window_low", "raw_window_boundary_time", "raw_window_boundary_source_event_id",
        (F.col("n_events") - F.col("n_plain") - F.coalesce("__listed_before", F.lit(0))).alias("n_listed_in_window"),
        F.coalesce("floor_rank", F.lit(1)).alias("floor_rank"),
    )


def window_codes(cutoffs: DataFrame, ranked: DataFrame, context: int, carried: Sequence[str] = ()) -> DataFrame:
    """Per episode: distinct listed codes among its last ``context`` events, and the time of its first event.

    ``carried`` columns of ``cutoffs`` come along.

    A mention at rank r whose code came last at rank p is the first of its code
    in the windows that end from max(r, p + context) to r + context - 1. So the
    number of distinct codes is a running sum over the ranks at which windows
    end, read off at the episode's last event; no window is looked at.
    """
    keys = ["subject_id", "code"]
    listed = ranked.filter("is_compressible").select(*keys, "event_rank", calendar_day("time").alias("day"))
    days = listed.groupBy(*keys, "day").agg(F.max("event_rank").alias("__last"))
    days = days.select(*keys, "day", F.lag("__last").over(Window.partitionBy(*keys).orderBy("day")).alias("__before"))
    in_day = Window.partitionBy(*keys, "day").orderBy("event_rank")
    previous = F.coalesce(F.lag("event_rank").over(in_day), F.col("__before"))
    spans = listed.join(days, [*keys, "day"]).select(
        "subject_id", F.col("event_rank").alias("r"), F.coalesce(F.greatest(F.col("event_rank"), previous + context), F.col("event_rank")).alias("since")
    ).filter(F.col("since") < F.col("r") + context)
    ends = F.explode(F.array(
        F.struct(F.col("since").alias("rank"), F.lit(1).alias("step")), F.struct((F.col("r") + context).alias("rank"), F.lit(-1).alias("step")),
    ))
    steps = spans.select("subject_id", ends.alias("e")).groupBy("subject_id", "e.rank").agg(F.sum("e.step").alias("step"))
    asked = cutoffs.select("subject_id", F.col("n_events").alias("rank")).distinct()
    both = steps.select("subject_id", "rank", "step", F.lit(0).alias("side")).unionByName(
        asked.select("subject_id", "rank", F.lit(0).cast("long").alias("step"), F.lit(1).alias("side"))
    ).withColumn("__seg", F.floor(F.col("rank") / F.lit(4096)))
    known = running(both, ["subject_id"], ["rank", "side"], "__seg", ["step"]).filter("side = 1").select(
        "subject_id", F.col("rank").alias("n_events"), F.col("cum_step").alias("n_codes_in_window")
    )
    start = ranked.groupBy("subject_id").agg(F.min("time").alias("__start"))
    out = cutoffs.select(*dict.fromkeys([*EPISODE_KEY, "n_events", *carried])).join(known, ["subject_id", "n_events"], "left").join(start, "subject_id", "left")
    return out.select(
        *dict.fromkeys(["row_id", "task", *carried]), F.coalesce("n_codes_in_window", F.lit(0)).alias("n_codes_in_window"),
        F.when(F.col("n_events") > 0, F.col("__start")).alias("original_earliest_time"),
    )


def transformed_length() -> Column:
    return F.col("n_plain") + F.col("n_eras") + 2 * F.col("n_compressed")


# Days of the validity index: about 90 years before and after 1970; times beyond lie on its ends.
DAY_LEVELS = 16


def day_number(t: Column) -> Column:
    """Calendar day as a number from 0 on."""
    day = F.unix_date(F.to_date(t)) + (1 << DAY_LEVELS - 1)
    return F.greatest(F.lit(0), F.least(day, F.lit((1 << DAY_LEVELS) - 1)))


def day_nodes(first: Column, last: Column) -> Column:
    """The day range as blocks of 1, 2, 4, ... aligned days, at most two of each size; as numbers."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.ceil(first / size), F.floor((last + 1) / size)
        key = lambda node: level.cast("long") * (1 << DAY_LEVELS + 2) + node
        left = F.when((low < high) & (low % 2 == 1), key(low))
        right = F.when((low < high) & (high % 2 == 1), key(high - 1))
        return F.array(left, right)

    each = F.transform(F.sequence(F.lit(0), F.lit(DAY_LEVELS)), at)
    return F.filter(F.flatten(each), lambda x: x.isNotNull())


def nodes_of_day(day: Column) -> Column:
    """The aligned blocks that hold a day."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(DAY_LEVELS)),
        lambda level: level.cast("long") * (1 << DAY_LEVELS + 2) + F.call_function("shiftright", day.cast("long"), level),
    )


def held_tokens(bounds: DataFrame, tokens: DataFrame, context: int, inclusive: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Tokens that can be among the last ``context`` ones that hold at each prediction time; ``extra`` columns of ``bounds`` come along.

    Tokens of listed codes hold for a while. Each one's days are cut into
    aligned blocks, and an episode looks up the blocks that hold its day, so it
    meets the tokens that hold then, not the many that later mentions have
    replaced. Plain tokens hold forever; an episode meets its last ``context``
    of them, which lie in at most two blocks of plain ranks.
    """
    kept = F.least(transformed_length(), F.lit(context)).alias("__kept")
    episodes = bounds.filter("n_events > 0").select(*EPISODE_KEY, *extra, "floor_rank", "n_plain", kept)
    last_plain = episodes.filter("n_plain > 0").withColumn("__low", F.greatest(F.col("n_plain") - context, F.lit(0)))
    last_plain = last_plain.withColumn("__block", F.explode(blocks(F.col("__low"), F.col("n_plain"), context)))
    plain = tokens.filter(F.col("plain_rank").isNotNull()).withColumn("__block", F.floor((F.col("plain_rank") - 1) / F.lit(context)))
    columns = [*EPISODE_KEY, *extra, "__kept", *[c for c in TOKEN if c != "days_before_prediction"], "base_code"]
    always = last_plain.join(plain, ["subject_id", "__block"]).filter(
        (F.col("plain_rank") > F.col("__low")) & (F.col("plain_rank") <= F.col("n_plain"))
    ).select(*columns)

    asked = episodes.withColumn("__node", F.explode(nodes_of_day(day_number(F.col("prediction_time")))))
    until = F.when(F.col("valid_to").isNull(), F.lit((1 << DAY_LEVELS) - 1)).otherwise(day_number(F.col("valid_to")))
    listed = tokens.filter(F.col("plain_rank").isNull() & F.col("valid_from").isNotNull())
    listed = listed.withColumn("__node", F.explode(day_nodes(day_number(F.col("valid_from")), until)))
    cut = F.col("prediction_time")
    reached = (lambda c: c <= cut) if inclusive else (lambda c: c < cut)
    for_now = asked.join(listed, ["subject_id", "__node"]).filter(
        reached(F.col("valid_from")) & (F.col("valid_to").isNull() | ~reached(F.col("valid_to"))) & (F.col("event_rank") >= F.col("floor_rank"))
    ).select(*columns)
    return always.unionByName(for_now).withColumn("days_before_prediction", whole_days("time", "prediction_time").cast("float"))


# One place of an episode's packed tokens, in token order.
ITEM = ["time", "order_anchor_id", "role_order", "code", "numeric_value", "text_value", "is_compression_token"]
# Listed tokens of one chunk that are gathered in one array; a chunk with more of them is looked up by day blocks.
CROWDED = 4096


def packed_backfill(bounds: DataFrame, tokens: DataFrame, context: int, inclusive: bool = True, carried: Sequence[str] = ()) -> DataFrame:
    """Last ``context`` tokens that hold at each prediction time, as one array per episode; ``carried`` columns of ``bounds`` come along.

    A token can matter only while fewer than ``context`` plain events follow
    it, so it lies in at most two chunks of plain events, and an episode in
    one. The tokens of a chunk meet its episodes as one sorted array;
    what travels is tokens and episodes, never their pairs.
    """
    size = CHUNK * context
    episodes = bounds.withColumn("__chunk", chunk_of(F.col("n_plain"), size))
    last = F.col("plain_at") + context - 1
    placed = tokens.filter(F.col("valid_from").isNotNull()).withColumn(
        "__chunk", chunks_of(F.col("plain_from"), F.least(F.coalesce("plain_to", last), last), size)
    )
    place = ["subject_id", "__chunk"]
    crowded = placed.filter(F.col("plain_rank").isNull()).groupBy(*place).count().filter(F.col("count") > CROWDED).select(*place)
    many = not crowded.isEmpty()
    if many:
        crowded = broadcast_checked(crowded)
        looked_up = episodes.join(crowded, place, "left_semi").drop("__chunk")
        by_day = pack(backfill_tokens(looked_up, tokens, context, inclusive)).select("row_id", "task", "s")
        by_day = looked_up.select(*EPISODE_KEY, *carried).join(by_day, ["row_id", "task"], "left").select(
            *EPISODE_KEY, *carried, F.coalesce("s", F.array()).alias("s")
        )
        episodes, placed = episodes.join(crowded, place, "left_anti"), placed.join(crowded, place, "left_anti")
    chunks = chunk_arrays(placed, [*ITEM, "valid_from", "valid_to", "event_rank"])
    cut = F.col("prediction_time")
    reached = (lambda c: c <= cut) if inclusive else (lambda c: c < cut)
    met = episodes.join(chunks, place, "left").withColumn("s", F.filter(
        "s", lambda x: reached(x["valid_from"]) & (x["valid_to"].isNull() | ~reached(x["valid_to"])) & (x["event_rank"] >= F.col("floor_rank"))
    ))
    kept = F.transform(last_items("s", context), lambda x: F.struct(*[x[c].alias(c) for c in ITEM]))
    out = met.select(*EPISODE_KEY, *carried, F.coalesce(kept, F.array()).alias("s"))
    return out.unionByName(by_day) if many else out


def item(time: Column, code: Column, number: Column, text: Column, state: bool, anchor: Column, role: int) -> Column:
    """One place of packed tokens."""
    fields = [time, anchor.cast("long"), F.lit(role), code, number.cast("float"), text.cast("string"), F.lit(state)]
    return F.struct(*[c.alias(n) for n, c in zip(ITEM, fields)])


def plain_item(x: Column) -> Column:
    return item(x["time"], x["code"], x["numeric_value"], x["text_value"], False, x["source_event_id"], 0)


def packed_raw(bounds: DataFrame, ranked: DataFrame, context: int, carried: Sequence[str] = ()) -> DataFrame:
    """The last ``context`` events of each episode as one array of plain tokens; ``carried`` columns of ``bounds`` come along."""
    w = window_arrays(bounds, ranked, context, carried)
    return w.select(*EPISODE_KEY, *carried, F.transform("w", plain_item).alias("s"))


def _runs(array: str, new: Callable[[Column, Column], Column]) -> Column:
    """Places (from 0) at which a run begins: where ``new`` says so of the element before and the element."""
    at = F.transform(array, lambda x, i: F.when((i == 0) | new(F.get(F.col(array), i - 1), x), i))
    return F.filter(at, lambda i: i.isNotNull())


def _run_ends(starts: str, array: str, k: Column) -> Column:
    return F.coalesce(F.get(F.col(starts), k + 1), F.size(array))


def packed_no_backfill(bounds: DataFrame, ranked: DataFrame, gap_days: int, context: int, carried: Sequence[str] = ()) -> DataFrame:
    """Last ``context`` tokens after the eras inside each raw window, as one array per episode; ``carried`` columns of ``bounds`` come along.

    Points and eras are runs of the sorted window, so each episode is worked
    out in its own row: the same tokens as :func:`condition_era` on the window.
    ``in_window`` has the counts of the window that the transform audit reads.
    """
    own = [*EPISODE_KEY, *carried]
    mention = ["code", "compression_bucket", "time", "source_event_id", "numeric_value", "text_value"]
    rows = window_arrays(bounds, ranked, context, carried).select(*own, "w", F.sort_array(F.transform(
        F.filter("w", lambda x: x["is_compressible"]), lambda x: F.struct(*[x[c].alias(c) for c in mention])
    )).alias("listed"))
    other = lambda a, b: (a["code"] != b["code"]) | (a["compression_bucket"] != b["compression_bucket"])
    rows = rows.select(*own, "w", "listed", _runs("listed", other).alias("__at"))

    def point(at: Column) -> Column:
        x = F.get(F.col("listed"), at)
        return F.struct(*[x[c].alias(c) for c in mention if c != "compression_bucket"])

    rows = rows.select(*own, "w", "listed", F.sort_array(F.transform("__at", point)).alias("points"))
    apart = lambda a, b: (a["code"] != b["code"]) | (whole_days(a["time"], b["time"]) > gap_days)
    rows = rows.select(*own, "w", "listed", "points", _runs("points", apart).alias("__at"))

    def era(at: Column, k: Column) -> Column:
        end, get = _run_ends("__at", "points", k), lambda i: F.get(F.col("points"), i)
        return F.struct(get(at).alias("first"), get(end - 1).alias("last"), (end - at).alias("n_points"))

    rows = rows.select(*own, "w", "listed", "points", F.transform("__at", era).alias("eras"))

    def tokens(e: Column) -> Column:
        first, last, code, n, none = e["first"], e["last"], e["first"]["code"], e["n_points"], F.lit(None)
        start = item(first["time"], state_code(gap_days, "START", code), F.lit(0.0), none, True, first["source_event_id"], 10)
        end = item(last["time"], state_code(gap_days, "END", code), whole_days(first["time"], last["time"]), none, True, last["source_event_id"], 20)
        count = item(last["time"], state_code(gap_days, "COUNT_BIN", code, n), n, none, True, last["source_event_id"], 30)
        return F.when(n == 1, F.array(plain_item(first))).otherwise(F.array(start, end, count))

    plain = F.transform(F.filter("w", lambda x: ~x["is_compressible"]), plain_item)
    size = lambda c: F.size(c).cast("long")
    counts = {
        "n_events": size("w"), "n_plain": size("w") - size("listed"), "n_points": size("points"), "n_eras": size("eras"),
        "n_compressed": size(F.filter("eras", lambda e: e["n_points"] > 1)),
    }
    rows = rows.select(
        *own, F.struct(*[c.alias(n) for n, c in counts.items()]).alias("in_window"),
        F.sort_array(F.concat(plain, F.flatten(F.transform("eras", tokens)))).alias("s"),
    )
    return rows.select(*own, "in_window", last_items("s", context).alias("s"))


def last_items(array: str, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def pack(long: DataFrame) -> DataFrame:
    """One row per episode with its tokens in position order."""
    item = F.struct("event_position", *ITEM)
    s = long.groupBy(*EPISODE_KEY).agg(F.sort_array(F.collect_list(item)).alias("s"))
    return s.select(*EPISODE_KEY, F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in ITEM])).alias("s"))


def unpack(packed: DataFrame) -> DataFrame:
    """The long rows of packed episodes.

    The outer form, without its rows of empty episodes, keeps Spark from asking
    for the array's size below the steps that make it: that test would hold
    all of them anew, each as often as the one after it reads it.
    """
    rows = packed.select(*EPISODE_KEY, F.posexplode_outer("s").alias("__place", "t")).filter("__place is not null").select(
        *EPISODE_KEY, "t.*", (F.col("__place") + 1).cast("int").alias("event_position")
    )
    return rows.withColumn("days_before_prediction", whole_days("time", "prediction_time").cast("float")).select(*LONG)


def backfill_tokens(bounds: DataFrame, tokens: DataFrame, context: int, inclusive: bool = True) -> DataFrame:
    """Last ``context`` tokens that hold at each prediction time, with positions."""
    held = held_tokens(bounds, tokens, context, inclusive)
    back = Window.partitionBy("row_id", "task").orderBy(
        F.col("time").desc(), F.col("order_anchor_id").desc(), F.col("role_order").desc(), F.col("code").desc()
    )
    return (
        held.withColumn("__back", F.row_number().over(back)).filter(F.col("__back") <= context)
        .select(*EPISODE_KEY, *TOKEN, (F.col("__kept") - F.col("__back") + 1).cast("int").alias("event_position"))
    )


def structure_null(long: DataFrame, gap_days: int) -> DataFrame:
    """Control without state features: base codes, no values, same positions."""
    state = F.col("code").rlike(structural_pattern(gap_days))
    changed = {
        "numeric_value": F.when(~state, F.col("numeric_value")),
        "text_value": F.when(~state, F.col("text_value")),
        "is_compression_token": F.lit(False),
        "code": strip_structure("code", gap_days),
    }
    return long.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in long.columns])


def packed_structure_null(packed: DataFrame, gap_days: int) -> DataFrame:
    """:func:`structure_null` on packed tokens."""
    pattern = structural_pattern(gap_days)

    def bare(x: Column) -> Column:
        state = x["code"].rlike(pattern)
        return item(
            x["time"], strip_structure(x["code"], gap_days), F.when(~state, x["numeric_value"]), F.when(~state, x["text_value"]),
            False, x["order_anchor_id"], 0,
        ).withField("role_order", x["role_order"])

    return packed.withColumn("s", F.transform("s", bare))
