"""Build every representation of a task from one shared subject timeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from eraloom.operators import audit, eras, history, sequences
from eraloom.schemas import EPISODE_KEY
from eraloom.session import materialize


@dataclass(frozen=True)
class Representation:
    """What to build: ``kind`` raw or condition_era, and how history is windowed."""

    name: str
    kind: str = "raw"
    window_mode: str = "raw"  # raw, backfill, no_backfill, structure_null
    context_length: int = 4096
    gap_days: int | None = None
    source_representation: str | None = None


@dataclass
class Timeline:
    """Shared tables of one event source and one set of labels."""

    labels: DataFrame
    ranked: DataFrame
    inclusive: bool = True
    codes: DataFrame | None = None
    _points: dict[int, DataFrame] = field(default_factory=dict)
    _cutoffs: dict[int | None, DataFrame] = field(default_factory=dict)
    _bounds: dict[tuple, DataFrame] = field(default_factory=dict)
    _reach: DataFrame | None = None

    def points(self, gap_days: int) -> DataFrame:
        if gap_days not in self._points:
            self._points[gap_days] = materialize(eras.subject_points(self.ranked, gap_days))
        return self._points[gap_days]

    def cutoffs(self, gap_days: int | None) -> DataFrame:
        """As-of counters; without a gap the era counters use one day-wide rule."""
        if gap_days not in self._cutoffs:
            points = self.points(gap_days if gap_days is not None else 0)
            self._cutoffs[gap_days] = materialize(
                eras.episode_cutoffs(self.labels, self.ranked, points, self.inclusive)
            )
        return self._cutoffs[gap_days]

    def reach(self) -> DataFrame:
        """Event counts only, which is all that raw windows need."""
        if self._cutoffs:
            return next(iter(self._cutoffs.values()))
        if self._reach is None:
            self._reach = materialize(eras.episode_cutoffs(self.labels, self.ranked, None, self.inclusive))
        return self._reach

    def bounds(self, gap_days: int | None, context: int) -> DataFrame:
        key = (gap_days, context)
        if key not in self._bounds:
            self._bounds[key] = materialize(eras.window_bounds(self.cutoffs(gap_days), self.ranked, context))
        return self._bounds[key]

    def known(self, gap_days: int | None, context: int) -> DataFrame:
        """All that audits read of the timeline, per episode."""
        bounds = self.bounds(gap_days, context)
        return eras.window_codes(bounds, self.ranked, context, bounds.columns)


def prepare(
    events: DataFrame, labels: DataFrame, codes: DataFrame, max_days: int = 1, inclusive: bool = True,
) -> Timeline:
    """As-of bucketing and ranking, done once for all representations."""
    ranked = history.timeline_events(history.canonical_events(events), codes, max_days)
    return Timeline(labels, materialize(ranked), inclusive, codes)


def represent(timeline: Timeline, spec: Representation) -> DataFrame:
    """Final long table of one representation: at most ``context_length`` rows per episode."""
    return eras.unpack(represent_packed(timeline, spec))


def represent_packed(timeline: Timeline, spec: Representation, known: DataFrame | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """The same, as one array per episode: of those with history, or of all in ``known`` with its ``carried`` columns."""
    n, gap = spec.context_length, spec.gap_days
    if spec.window_mode == "structure_null":
        source = Representation(spec.name, "condition_era", "backfill", n, gap)
        return eras.packed_structure_null(represent_packed(timeline, source, known, carried), gap)
    if spec.window_mode == "backfill":
        known = timeline.bounds(gap, n).filter("n_events > 0") if known is None else known
        tokens = eras.validity_tokens(timeline.ranked, timeline.points(gap), gap)
        return eras.packed_backfill(known, tokens, n, timeline.inclusive, carried)
    known = timeline.reach().filter("n_events > 0") if known is None else known
    if spec.kind == "raw":
        return eras.packed_raw(known, timeline.ranked, n, carried)
    return eras.packed_no_backfill(known, timeline.ranked, gap, n, carried)


def represent_audited(timeline: Timeline, spec: Representation) -> DataFrame:
    """Packed tokens of all episodes with what their audits read, so that neither moves again to meet the other."""
    known = timeline.known(spec.gap_days, spec.context_length)
    return represent_packed(timeline, spec, known, [c for c in known.columns if c not in EPISODE_KEY])


def build_examples(
    timeline: Timeline, spec: Representation, min_count: int = 1, max_vocab: int | None = None,
    packed: DataFrame | None = None, vocab: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examples, vocabulary, long table); episodes without history are kept, empty.

    ``packed`` comes from :func:`represent_audited`. Only it is written; the
    examples are worked out from it row by row by each reader, as far as it
    reads them.
    """
    packed = materialize(represent_audited(timeline, spec)) if packed is None else packed
    long = eras.unpack(packed)
    vocab = materialize(sequences.build_vocab(long, min_count, max_vocab)) if vocab is None else vocab
    seqs = sequences.encode_packed(packed, vocab, [c for c in packed.columns if c not in [*EPISODE_KEY, "s"]])
    arrays = {
        "token_ids": "array<int>", "codes": "array<string>", "days_before_prediction": "array<float>",
        "delta_days": "array<float>", "numeric_values": "array<float>",
    }
    counts = ["seq_len", "n_unique_tokens", "n_compression_events"]
    own = [*arrays, *counts]
    checked = audit.final_audit(seqs, spec.kind == "raw", spec.context_length, spec.window_mode, carried=own)
    extra = [c for c in checked.columns if c not in [*EPISODE_KEY, *own]]
    raw_len = F.least(F.col("original_history_len"), F.lit(spec.context_length))
    out = (
        checked.select(
            *EPISODE_KEY, F.lit(spec.name).alias("version"),
            *[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in arrays.items()],
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *extra,
        )
        .withColumn("raw_seq_len", raw_len)
        .withColumn("n_events_removed_vs_raw", F.lit(0) if spec.kind == "raw" else raw_len - F.col("seq_len"))
        .withColumn("n_compressible_chronic_events_raw", F.col("n_persistent_events_raw_window"))
        .withColumn("n_synthetic_events", F.col("n_compression_events"))
    )
    return out, vocab, long
