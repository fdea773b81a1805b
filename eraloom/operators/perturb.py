"""Copy-forward perturbation: copy one diagnosis into later visits and rebuild."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, functions as F

from eraloom.functions.ordered import calendar_day, exact_percentiles, keep_by_order, running
from eraloom.functions.scalar import ceil_fraction, copy_order_hash, fractional_days, safe_ratio
from eraloom.operators import eras, history, sequences
from eraloom.operators.history import HISTORY, legal
from eraloom.operators.metrics import risk_metrics, spearman
from eraloom.operators.predictions import with_baseline
from eraloom.schemas import EPISODE_KEY, join_null_safe, require_none
from eraloom.session import materialize

if TYPE_CHECKING:
    from eraloom.plans.dataset import Timeline

# Fixed values of the protocol: fractions, minimum visits, seed and the id range of copied rows.
FRACTIONS = (0.0, 0.25, 0.5, 1.0)
MIN_VISITS = 2
SELECTION_SEED = 20260722
COPY_ID_BASE = 7_000_000_000_000_000
COPY_ID_STEP = 100_000


def visit_events(timeline: Timeline) -> DataFrame:
    """Events that lie in a reconstructed visit."""
    return timeline.ranked.filter(F.col("compression_bucket").startswith("reconstructed_visit="))


def subject_visits(timeline: Timeline) -> DataFrame:
    """Visits of each subject with the time of their first event."""
    return visit_events(timeline).groupBy("subject_id", "compression_bucket").agg(F.min("time").alias("visit_time"))


def code_visits(timeline: Timeline) -> DataFrame:
    """Listed codes of each subject by visit: the first mention, and the code's first mention in any visit."""
    first = visit_events(timeline).filter("is_compressible").groupBy("subject_id", "code", "compression_bucket").agg(F.min("time").alias("first_time"))
    start = first.groupBy("subject_id", "code").agg(F.min("first_time").alias("first_diagnosis_time"))
    return first.join(start, ["subject_id", "code"])


def as_of(steps: DataFrame, asks: DataFrame, keys: list[str], counts: list[str], inclusive: bool = True) -> DataFrame:
    """``counts`` of ``steps`` up to the time of each distinct row (keys, time) of ``asks``."""
    asked = asks.select(*keys, "time", *[F.lit(0).alias(c) for c in counts], F.lit(1 if inclusive else -1).alias("side")).distinct()
    both = steps.select(*keys, "time", *counts, F.lit(0).alias("side")).unionByName(asked).withColumn("__day", calendar_day("time"))
    return running(both, keys, ["time", "side"], "__day", counts).filter("side <> 0").select(*keys, "time", *[f"cum_{c}" for c in counts])


def candidate_stats(timeline: Timeline, held: DataFrame, min_visits: int = MIN_VISITS, split: str = "held_out") -> DataFrame:
    """Listed codes seen in enough visits before the prediction, for the episodes of a split.

    ``held`` comes from :func:`code_visits`. Every number is a running count
    over a subject's mentions of a code, read off at the prediction time, so
    episodes meet the codes of their subject and never its events.
    ``n_later_held`` counts the code's visits that begin after its first mention.
    """
    keys = ["subject_id", "code"]
    visits = held.join(subject_visits(timeline), ["subject_id", "compression_bucket"])
    later = (F.col("visit_time") > F.col("first_diagnosis_time")).cast("int")
    zero = F.lit(0)
    mentions = visit_events(timeline).filter("is_compressible").select(*keys, "time", F.lit(1).alias("m"), zero.alias("v"), zero.alias("l"))
    steps = mentions.unionByName(visits.select(*keys, F.col("first_time").alias("time"), zero.alias("m"), F.lit(1).alias("v"), later.alias("l")))
    asks = timeline.labels.filter(F.col("split") == split).select(*EPISODE_KEY).join(
        held.select(*keys, "first_diagnosis_time").distinct(), "subject_id"
    ).filter(legal("first_diagnosis_time", timeline.inclusive))
    known = as_of(steps, asks.withColumnRenamed("prediction_time", "time"), keys, ["m", "v", "l"], timeline.inclusive)
    return asks.join(known.withColumnRenamed("time", "prediction_time"), [*keys, "prediction_time"]).select(
        *EPISODE_KEY, "code", F.col("cum_v").alias("n_existing_visits"), F.col("cum_m").alias("n_existing_mentions"), "first_diagnosis_time",
        F.col("cum_l").alias("n_later_held"),
    ).filter(F.col("n_existing_visits") >= min_visits)


def count_eligible(timeline: Timeline, stats: DataFrame) -> DataFrame:
    """Later visits without the code, counted without listing them.

    All visits before the prediction, less those up to the code's first
    mention, less the later ones that hold the code.
    """
    steps = subject_visits(timeline).select("subject_id", F.col("visit_time").alias("time"), F.lit(1).alias("one"))
    upto = as_of(steps, stats.select("subject_id", F.col("first_diagnosis_time").alias("time")), ["subject_id"], ["one"])
    upto = upto.select("subject_id", F.col("time").alias("first_diagnosis_time"), F.col("cum_one").alias("__upto"))
    seen = as_of(steps, stats.select("subject_id", F.col("prediction_time").alias("time")), ["subject_id"], ["one"], timeline.inclusive)
    seen = seen.select("subject_id", F.col("time").alias("prediction_time"), F.col("cum_one").alias("__seen"))
    out = stats.join(upto, ["subject_id", "first_diagnosis_time"]).join(seen, ["subject_id", "prediction_time"])
    n = F.col("__seen") - F.col("__upto") - F.col("n_later_held")
    return out.select(*[c for c in stats.columns if c != "n_later_held"], n.alias("n_eligible_visits")).filter("n_eligible_visits > 0")


def pick_candidate(counted: DataFrame) -> DataFrame:
    """One code per episode: most visits, mentions, eligible visits, then earliest, then by name."""
    order = [
        F.desc("n_existing_visits"), F.desc("n_existing_mentions"), F.desc("n_eligible_visits"),
        F.asc("first_diagnosis_time"), F.asc("code"),
    ]
    return keep_by_order(counted, ["row_id", "task"], order).withColumnRenamed("code", "candidate_code")


def candidate_plan(timeline: Timeline, min_visits: int = MIN_VISITS, seed: int = SELECTION_SEED) -> tuple[DataFrame, DataFrame]:
    """(episode plan, eligible visits with their copy rank)."""
    held = materialize(code_visits(timeline))  # read by several branches below
    counted = count_eligible(timeline, materialize(candidate_stats(timeline, held, min_visits)))
    episodes = materialize(pick_candidate(counted))
    return episodes, rank_eligible(eligible_visits(timeline, episodes, held), seed)


def eligible_visits(timeline: Timeline, episodes: DataFrame, held: DataFrame) -> DataFrame:
    """Later visits of each episode in which its chosen code is absent so far."""
    wanted = episodes.select(*EPISODE_KEY, "candidate_code", "n_eligible_visits", "first_diagnosis_time")
    later = wanted.join(subject_visits(timeline), "subject_id").filter(
        (F.col("visit_time") > F.col("first_diagnosis_time")) & legal("visit_time", timeline.inclusive)
    )
    known = held.select("subject_id", F.col("code").alias("candidate_code"), "compression_bucket", "first_time")
    same = [later[c] == known[c] for c in ("subject_id", "candidate_code", "compression_bucket")]
    cut = known["first_time"] <= later["prediction_time"] if timeline.inclusive else known["first_time"] < later["prediction_time"]
    return later.join(known, [*same, cut], "left_anti")


def rank_eligible(visits: DataFrame, seed: int = SELECTION_SEED) -> DataFrame:
    """Zero-based copy rank by a stable hash; hash prefixes are even segments."""
    hashed = visits.withColumn(
        "selection_score", copy_order_hash(seed, "task", "row_id", "candidate_code", "compression_bucket")
    ).withColumn("__seg", F.substring("selection_score", 1, 2)).withColumn("one", F.lit(1))
    out = running(hashed, ["row_id", "task"], ["selection_score", "visit_time", "compression_bucket"], "__seg", ["one"])
    return out.select(*visits.columns, "selection_score", (F.col("cum_one") - 1).alias("eligible_rank"))


def select_fraction(plan: DataFrame, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """First ``ceil(fraction * n)`` visits per episode and fraction; subsets are nested."""
    each = plan.withColumn("requested_copy_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions if f > 0])))
    return each.filter(F.col("eligible_rank") < ceil_fraction("n_eligible_visits", "requested_copy_fraction"))


def copied_rows(selected: DataFrame) -> DataFrame:
    """History rows of the copies, with ids from a reserved range and fractional day gaps."""
    require_none(selected, F.col("eligible_rank") >= COPY_ID_STEP, "an episode has more copies than reserved ids")
    made = {
        "time": F.col("visit_time"), "code": F.col("candidate_code"), "numeric_value": F.lit(None).cast("float"),
        "text_value": F.lit(None).cast("string"),
        "days_before_prediction": fractional_days("visit_time", "prediction_time").cast("float"),
        "source_event_id": F.lit(COPY_ID_BASE) + F.col("row_id") * COPY_ID_STEP + F.col("eligible_rank"),
    }
    return selected.select(*[made[c].alias(c) if c in made else F.col(c) for c in [*HISTORY, "requested_copy_fraction"]])


def inject(hist: DataFrame, episodes: DataFrame, selected: DataFrame, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Planned histories, once per fraction, with the copies added."""
    planned = hist.select(*HISTORY).join(episodes.select("task", "row_id"), ["row_id", "task"], "left_semi")
    return inject_planned(planned, selected, fractions)


def inject_planned(planned: DataFrame, selected: DataFrame, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """The same, from the histories of the planned episodes only, which then need not move to meet the plan."""
    return per_fraction(planned.select(*HISTORY), fractions).unionByName(copied_rows(selected))


CAP_KEY = ["row_id", "task", "requested_copy_fraction"]
# The other episode columns follow from the plan at the end and need not move with every token.
PERTURBED_KEY = [*CAP_KEY, "prediction_time"]


def per_fraction(df: DataFrame, fractions: Sequence[float]) -> DataFrame:
    return df.withColumn("requested_copy_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))


def perturbed_long(
    timeline: Timeline, episodes: DataFrame, selected: DataFrame, context: int, gap_days: int | None, fractions: Sequence[float] = FRACTIONS,
) -> DataFrame:
    """Final long rows for all fractions in one job; ``gap_days`` None is raw.

    Copies touch one code per episode. The tokens of all other codes that hold
    at the prediction time are taken from the shared timeline, at most
    ``context`` of them, once for all fractions. Only the eras of the one code
    are found anew, from its first mentions by visit and the copies.
    """
    key = episodes.select("row_id", "task", "candidate_code")
    if gap_days is None:
        reach = timeline.reach().join(key, ["row_id", "task"], "left_semi")
        window = history.raw_window(reach, timeline.ranked, context).select(*HISTORY)
        injected = per_fraction(window, fractions).unionByName(copied_rows(selected))
        tokens = eras.raw_tokens(history.last_n(injected, context, history.RAW_ORDER, CAP_KEY), PERTURBED_KEY)
        return history.cap_and_place(tokens, context, CAP_KEY)
    points = timeline.points(gap_days)
    bounds = timeline.bounds(gap_days, context).join(key, ["row_id", "task"])
    held = eras.held_tokens(bounds, eras.validity_tokens(timeline.ranked, points, gap_days), context, timeline.inclusive, ("candidate_code",))
    rest = history.last_n(held.filter("base_code <> candidate_code"), context, history.TOKEN_ORDER)
    rest = rest.select("row_id", "task", "prediction_time", *eras.TOKEN)
    point = ["code", "compression_bucket", "time", "source_event_id", "numeric_value", "text_value"]
    mine = points.withColumn("compression_bucket", F.lit(None).cast("string")).select("subject_id", *point)
    wanted = episodes.select("row_id", "task", "subject_id", "prediction_time", F.col("candidate_code").alias("code"))
    own = wanted.join(mine, ["subject_id", "code"]).filter(legal("time", timeline.inclusive))
    both = per_fraction(own.select("row_id", "task", "prediction_time", *point), fractions).unionByName(
        copied_rows(selected).select(*PERTURBED_KEY, *point)
    )
    changed = eras.compress_eras(eras.era_days(both.withColumn("n_mentions", F.lit(1)), PERTURBED_KEY, gap_days), PERTURBED_KEY, gap_days)
    tokens = per_fraction(rest, fractions).unionByName(changed.select(*PERTURBED_KEY, *eras.TOKEN))
    return history.cap_and_place(tokens, context, CAP_KEY)


def perturbed_sequences(
    timeline: Timeline, episodes: DataFrame, selected: DataFrame, vocab: DataFrame, context: int, gap_days: int | None,
    fractions: Sequence[float] = FRACTIONS,
) -> DataFrame:
    """Encoded sequences per episode and fraction under a frozen vocabulary."""
    long = perturbed_long(timeline, episodes, selected, context, gap_days, fractions)
    seqs = sequences.collect_sequences(sequences.encode_tokens(long, vocab), PERTURBED_KEY).drop("__times", "__anchors")
    copied = selected.groupBy(*CAP_KEY).agg(F.count("*").alias("n_copied_visits"))
    plan = episodes.select(
        "row_id", "task", "subject_id", "label", "split", "candidate_code", "n_existing_visits", "n_existing_mentions", "n_eligible_visits"
    )
    out = seqs.join(plan, ["row_id", "task"]).join(copied, CAP_KEY, "left").fillna(0, ["n_copied_visits"])
    return out.withColumn("realized_copy_fraction", safe_ratio("n_copied_visits", "n_eligible_visits"))


def plan_summary(episodes: DataFrame) -> DataFrame:
    base = episodes.groupBy("task").agg(
        F.count("*").alias("n_episodes"), F.countDistinct("subject_id").alias("n_patients"), F.sum("label").alias("n_positive"),
        F.avg("n_existing_visits").alias("mean_existing_visits"), F.avg("n_eligible_visits").alias("mean_eligible_visits"),
    )
    return join_null_safe(base, exact_percentiles(episodes, ["task"], "n_eligible_visits", {"median_eligible_visits": 0.5}), ["task"])


def injection_summary(episodes: DataFrame, selected: DataFrame, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """Copies per fraction over all planned episodes; episodes without copies count as zero."""
    each = per_fraction(episodes.select("task", "row_id", "n_eligible_visits"), fractions)
    copied = selected.groupBy(*CAP_KEY).agg(F.count("*").alias("n"))
    rows = each.join(copied, CAP_KEY, "left").fillna(0, ["n"])
    return rows.groupBy("task", "requested_copy_fraction").agg(
        F.count("*").alias("n_eligible_episodes"), F.sum("n").alias("n_copied_visits_total"),
        F.count_if(F.col("n") > 0).alias("n_episodes_with_at_least_one_copy"), F.avg("n").alias("mean_copied_visits_per_episode"),
        F.avg(F.col("n") / F.col("n_eligible_visits")).alias("mean_realized_fraction"),
    )


def delta_vs_zero(pred: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Change of each score against the unperturbed row."""
    out = with_baseline(pred, keys, columns)
    for c in columns:
        out = out.withColumn(f"delta_{c}_vs_0", F.col(c) - F.col(f"{c}_at_0"))
    return out


def baseline_agreement(rebuilt: DataFrame, saved: DataFrame, by: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Largest differences between rebuilt zero-fraction scores and saved scores."""
    keys = [*by, "row_id", "subject_id", "y_true"]
    both = rebuilt.select(*keys, "logit", "risk_calibrated").join(
        saved.select(*keys, F.col("logit").alias("__l"), F.col("risk_calibrated").alias("__r")), keys
    )
    out = both.groupBy(*by).agg(
        F.count("*").alias("n_compared"), F.max(F.abs(F.col("logit") - F.col("__l"))).alias("max_abs_logit_difference"),
        F.max(F.abs(F.col("risk_calibrated") - F.col("__r"))).alias("max_abs_calibrated_risk_difference"),
    )
    return out.withColumn("within_tolerance", F.col("max_abs_logit_difference") <= tolerance)


def perturbation_metrics(pred: DataFrame, by: Sequence[str], score: str = "risk_calibrated") -> DataFrame:
    """Metric bundle per group with statistics of the change against zero."""
    d, zero = f"delta_{score}_vs_0", f"{score}_at_0"
    rows = pred.withColumn("__abs", F.abs(d))
    shift = rows.groupBy(*by).agg(F.avg(d).alias("mean_delta_risk_vs_0"), F.avg("__abs").alias("mean_abs_delta_risk_vs_0"))
    marks = exact_percentiles(rows, by, "__abs", {"median_abs_delta_risk_vs_0": 0.5, "p95_abs_delta_risk_vs_0": 0.95})
    order = spearman(rows, score, zero, by).withColumnRenamed("spearman", "spearman_risk_vs_0")
    out = risk_metrics(pred, by, score=score)
    for part in (shift, marks, order):
        out = join_null_safe(out, part, list(by))
    return out
