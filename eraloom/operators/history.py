"""Point-in-time histories: visit anchors, buckets, legal events, raw windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from eraloom.functions.ordered import asof_backward, calendar_day, running
from eraloom.functions.scalar import event_day, whole_days, whole_hours
from eraloom.schemas import EPISODE_KEY, EVENT_REQUIRED, require_columns
from eraloom.session import broadcast_checked, materialize

HISTORY = EPISODE_KEY + [
    "time", "code", "numeric_value", "text_value", "days_before_prediction", "compression_bucket",
    "source_event_id",
]
# One place of an episode's window, in raw order.
WINDOW_ITEM = ["event_rank", "time", "code", "numeric_value", "text_value", "compression_bucket", "source_event_id", "is_compressible"]


def canonical_events(events: DataFrame) -> DataFrame:
    """Typed event columns; optional ones become NULL, rows without a key go."""
    require_columns(events, [*EVENT_REQUIRED, "source_event_id"], "events")

    def optional(name: str, kind: str) -> Column:
        source = F.col(name) if name in events.columns else F.lit(None)
        return source.cast(kind).alias(name)

    return events.select(
        F.col("subject_id").cast("long").alias("subject_id"), "time",
        F.col("code").cast("string").alias("code"), "omop_table",
        optional("numeric_value", "float"), optional("text_value", "string"),
        F.col("source_event_id").cast("long").alias("source_event_id"),
    ).dropna(subset=["subject_id", "time", "code"])


def visit_anchors(events: DataFrame) -> DataFrame:
    """Distinct visit times with a zero-based index per subject."""
    visits = (
        events.filter(F.col("code").startswith("Visit/") & (F.col("omop_table") == "visit_occurrence"))
        .select("subject_id", F.col("time").alias("visit_time")).distinct()
        .withColumn("one", F.lit(1)).withColumn("__day", calendar_day("visit_time"))
    )
    return running(visits, ["subject_id"], ["visit_time"], "__day", ["one"]).select(
        "subject_id", "visit_time", (F.col("cum_one") - 1).cast("int").alias("visit_index")
    )


def bucket_events(events: DataFrame, anchors: DataFrame, max_days: int = 1) -> DataFrame:
    """Put each event into its visit, or into its day when no visit is near.

    A visit covers an event when the whole hours since the visit, as days, stay
    within ``max_days``.
    """
    matched = asof_backward(events, anchors, "subject_id", "time", "visit_time", ["visit_index"])
    near = (whole_hours("visit_time", "time") / F.lit(24.0)) <= F.lit(float(max_days))
    bucket = F.when(
        near, F.concat(F.lit("reconstructed_visit="), F.col("visit_index").cast("string"))
    ).otherwise(F.concat(F.lit("day="), event_day("time")))
    return matched.select(
        "subject_id", "time", "code", "numeric_value", "text_value",
        bucket.alias("compression_bucket"), "source_event_id",
    )


def legal(time: str, inclusive: bool) -> Column:
    return F.col(time) <= F.col("prediction_time") if inclusive else F.col(time) < F.col("prediction_time")


def episode_history(labels: DataFrame, base: DataFrame, inclusive: bool = True) -> DataFrame:
    """Every legal event of every episode, in full.

    Subject is an equi-key, so a hot subject is split by the skew join. Plans
    with a context length use :func:`raw_window` or the validity tokens, which
    never build this table.
    """
    return (
        labels.select(*EPISODE_KEY).join(base, "subject_id").filter(legal("time", inclusive))
        .withColumn("days_before_prediction", whole_days("time", "prediction_time").cast("float"))
        .select(*HISTORY)
    )


# Episodes of one subject that meet its events in one place.
TOGETHER = 2048
SPREAD_KEY = [*EPISODE_KEY, "part"]


def spread_history(labels: DataFrame, base: DataFrame, inclusive: bool = True, together: int = TOGETHER) -> DataFrame:
    """:func:`episode_history` with a column ``part`` and ``is_compressible`` of ``base``, for steps that go on by episode.

    Events and episodes meet by subject and part, so grouping by
    ``SPREAD_KEY`` leaves the pairs where the join makes them; a broadcast of
    few episodes would have all pairs move afterwards. A subject with
    more than ``together`` episodes has them dealt over several parts, each
    with its events.
    """
    parts = F.ceil(F.count("*") / F.lit(together)).cast("int").alias("__parts")
    busy = labels.groupBy("subject_id").agg(parts).filter("__parts > 1")
    first = F.lit(0).alias("part")
    if busy.isEmpty():
        episodes, events = labels.select(*EPISODE_KEY, first), base.select("*", first)
    else:
        busy, n = broadcast_checked(materialize(busy)), F.coalesce("__parts", F.lit(1))
        own = F.pmod(F.xxhash64("row_id", "task"), n).cast("int").alias("part")
        episodes = labels.join(busy, "subject_id", "left").select(*EPISODE_KEY, own)
        events = base.join(busy, "subject_id", "left").select(*base.columns, F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return (
        episodes.hint("merge").join(events, ["subject_id", "part"]).filter(legal("time", inclusive))
        .withColumn("days_before_prediction", whole_days("time", "prediction_time").cast("float"))
        .select(*HISTORY, "part", "is_compressible")
    )


def mark_codes(df: DataFrame, codes: DataFrame, out: str = "is_compressible") -> DataFrame:
    """Flag rows whose code is listed.

    A list of checked size is broadcast, so a code that holds a large share of
    the rows does not gather them in one task; a longer list joins by size.
    """
    listed = broadcast_checked(codes.select("code").distinct().withColumn(out, F.lit(True)))
    return df.join(listed, "code", "left").select(
        *df.columns, F.coalesce(out, F.lit(False)).alias(out)
    )


def ranked_events(base: DataFrame, codes: DataFrame) -> DataFrame:
    """Place of each event in its subject's timeline, in raw order.

    ``event_rank`` counts all events, ``plain_rank`` the events outside the code
    list up to and including this one.
    """
    marked = mark_codes(base, codes).select(
        "*", F.lit(1).alias("one"), (~F.col("is_compressible")).cast("int").alias("plain"),
        calendar_day("time").alias("__day"),
    )
    out = running(marked, ["subject_id"], ["time", "source_event_id", "code"], "__day", ["one", "plain"])
    return out.select(
        *base.columns, "is_compressible",
        F.col("cum_one").alias("event_rank"), F.col("cum_plain").alias("plain_rank"),
    )


# Events of one subject that are put in order in one place; those of a busier subject are ordered day by day.
ALONE = 65_536


def timeline_events(events: DataFrame, codes: DataFrame, max_days: int = 1, alone: int = ALONE) -> DataFrame:
    """Bucketed and ranked events; the events themselves move once.

    Visit index, latest visit and ranks are running values along a subject's
    events, which lie in one place. A subject with more than ``alone`` events
    is cut into its days, and one row per day carries in what went before. So
    one table serves :func:`visit_anchors`, :func:`bucket_events` and
    :func:`ranked_events` together.
    """
    is_visit = F.col("code").startswith("Visit/") & (F.col("omop_table") == "visit_occurrence")
    own = ["subject_id", "time", "code", "numeric_value", "text_value", "source_event_id"]
    rows = events.select(*own, is_visit.alias("__visits"))
    busy = events.groupBy("subject_id").agg(F.count("*").alias("n")).filter(F.col("n") > alone)
    busy = materialize(busy.select("subject_id", F.lit(True).alias("__busy")))
    group, carried = ["subject_id"], {c: F.lit(0) for c in ("n", "n_plain", "n_visits")}
    latest: list = []
    if not busy.isEmpty():
        group = ["subject_id", "__day"]
        rows = rows.join(broadcast_checked(busy), "subject_id", "left").select(*own, "__visits", F.when(F.col("__busy"), calendar_day("time")).alias("__day"))
        carry = _carried_in(mark_codes(rows.filter("__day is not null"), codes))
        rows = rows.join(broadcast_checked(carry), group, "left")
        carried, latest = {c: F.coalesce(f"__b_{c}", zero) for c, zero in carried.items()}, [F.col("__b_latest")]
    # Marked and numbered where they lie, so that only what was read travels.
    marked = mark_codes(rows.repartition(*group), codes).withColumn("__visit", F.when(F.col("__visits"), F.col("time")))
    in_order = Window.partitionBy(*group).orderBy("time", "source_event_id", "code")
    ordered = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy(*group).orderBy("time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Several visits at one time are one.
    same_time = Window.partitionBy(*group, "time").orderBy(F.col("__visit").isNull(), "source_event_id", "code")
    first = (F.col("__visit").isNotNull() & (F.row_number().over(same_time) == 1)).cast("int")
    now = F.max("__visit").over(upto)
    placed = marked.withColumn("__first", first).select(
        "*", (carried["n"] + F.row_number().over(in_order)).cast("long").alias("event_rank"),
        (carried["n_plain"] + F.sum((~F.col("is_compressible")).cast("int")).over(ordered)).alias("plain_rank"),
        (F.greatest(*latest, now) if latest else now).alias("visit_time"),
        (carried["n_visits"] + F.sum("__first").over(upto) - 1).alias("visit_index"),
    )
    near = (whole_hours("visit_time", "time") / F.lit(24.0)) <= F.lit(float(max_days))
    bucket = F.when(
        near, F.concat(F.lit("reconstructed_visit="), F.col("visit_index").cast("string"))
    ).otherwise(F.concat(F.lit("day="), event_day("time")))
    return placed.select(
        "subject_id", "time", "code", "numeric_value", "text_value", bucket.alias("compression_bucket"), "source_event_id",
        "is_compressible", "event_rank", "plain_rank",
    )


def _carried_in(marked: DataFrame) -> DataFrame:
    """Per subject and day: events, plain events, visits and the latest visit of the days before."""
    day = ["subject_id", "__day"]
    visit = F.when(F.col("__visits"), F.col("time"))
    plain = (~F.col("is_compressible")).cast("int")
    times = marked.groupBy(*day, "time").agg(F.count("*").alias("n"), F.sum(plain).alias("n_plain"), F.max(visit).alias("latest"))
    days = times.groupBy(*day).agg(
        F.sum("n").alias("n"), F.sum("n_plain").alias("n_plain"), F.count("latest").alias("n_visits"), F.max("latest").alias("latest")
    )
    before = Window.partitionBy("subject_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(
        *day, *[F.sum(c).over(before).alias(f"__b_{c}") for c in ("n", "n_plain", "n_visits")], F.max("latest").over(before).alias("__b_latest"),
    )


def blocks(low: Column, high: Column, size: int) -> Column:
    """Numbers of the ``size``-wide blocks that the ranks (low, high] touch."""
    return F.sequence(F.floor(low / F.lit(size)), F.floor((high - 1) / F.lit(size)))


# Contexts that a chunk of ranks spans; few rows then lie in two chunks.
CHUNK = 4


def chunk_of(rank: Column, size: int) -> Column:
    return F.floor(rank / F.lit(size))


def chunks_of(first: Column, last: Column, size: int) -> Column:
    """The chunks that the ranks ``first`` to ``last`` touch, one row each; none if there are no such ranks."""
    low, high = chunk_of(first, size), chunk_of(last, size)
    return F.explode(F.when(first <= last, F.sequence(low, high)))


def chunk_arrays(placed: DataFrame, items: list[str]) -> DataFrame:
    """One sorted array of ``items`` per subject and chunk."""
    return placed.groupBy("subject_id", "__chunk").agg(F.sort_array(F.collect_list(F.struct(*items))).alias("s"))


def window_arrays(cutoffs: DataFrame, ranked: DataFrame, context: int, carried: Sequence[str] = ()) -> DataFrame:
    """Last ``context`` legal events of each episode as one array ``w`` in raw order, with ``carried`` columns of ``cutoffs``.

    An event is among the last ``context`` ones while ranks r to r + context - 1
    end the history, so it lies in at most two chunks of ranks and an episode
    in one. The events of a chunk meet its episodes as one array; what
    travels is events and episodes, never their pairs.
    """
    episodes = cutoffs.withColumn("__chunk", chunk_of(F.col("n_events"), CHUNK * context)).withColumn(
        "__low", F.greatest(F.col("n_events") - context, F.lit(0))
    )
    rank = F.col("event_rank")
    events = ranked.select("subject_id", *WINDOW_ITEM, chunks_of(rank, rank + context - 1, CHUNK * context).alias("__chunk"))
    met = episodes.select(*dict.fromkeys([*EPISODE_KEY, "__chunk", "__low", "n_events", *carried])).join(
        chunk_arrays(events, WINDOW_ITEM), ["subject_id", "__chunk"], "left"
    )
    own = F.filter("s", lambda x: (x["event_rank"] > F.col("__low")) & (x["event_rank"] <= F.col("n_events")))
    return met.select(*EPISODE_KEY, *carried, "__low", F.coalesce(own, F.array()).alias("w"))


def raw_window(cutoffs: DataFrame, ranked: DataFrame, context: int) -> DataFrame:
    """Last ``context`` legal events of each episode, as history rows."""
    return (
        window_arrays(cutoffs.filter("n_events > 0"), ranked, context)
        .select(*EPISODE_KEY, "__low", F.explode("w").alias("e")).select(*EPISODE_KEY, "__low", "e.*")
        .withColumn("days_before_prediction", whole_days("time", "prediction_time").cast("float"))
        .select(*HISTORY, (F.col("event_rank") - F.col("__low")).cast("int").alias("event_position"))
    )


def last_n(history: DataFrame, n: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Last ``n`` rows per episode; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*(keys or ["row_id", "task"])).orderBy(*[F.col(c).desc() for c in order])
    return history.withColumn("__back", F.row_number().over(w)).filter(F.col("__back") <= n).drop("__back")


RAW_ORDER = ["time", "source_event_id", "code"]
TOKEN_ORDER = ["time", "order_anchor_id", "role_order", "code"]


def assign_position(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Dense 1..n position inside an episode that is already capped."""
    w = Window.partitionBy(*(keys or ["row_id", "task"])).orderBy(*TOKEN_ORDER)
    return tokens.withColumn("event_position", F.row_number().over(w))


def cap_and_place(tokens: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Last ``n`` tokens per episode with their position.

    The rank alone decides what stays, so every task cuts its own rows down to
    ``n`` per episode before the shuffle; the kept rows are counted after it.
    """
    group = Window.partitionBy(*(keys or ["row_id", "task"]))
    back = F.row_number().over(group.orderBy(*[F.col(c).desc() for c in TOKEN_ORDER]))
    kept = tokens.withColumn("__back", back).filter(F.col("__back") <= n)
    position = F.count("*").over(group) - F.col("__back") + 1
    return kept.withColumn("event_position", position.cast("int")).drop("__back")
