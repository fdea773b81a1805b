"""Metrics of bootstrap replicates from ranking states that merge.

Rows are sorted once, by score, into segments of bounded size. A segment keeps
its rows with a vector of multiplicities, one number per replicate, and its
ranking state: weight and positive weight as arrays over the replicates. States
add up from the highest segment down, which tells every segment what lies above
it. With that, a segment adds its own part of every metric for all replicates
at once: pairs won and half-ties, precision at its positives, losses, and what
it holds of the top fraction. Rows move once; later steps pass states only.

A score that very many rows share gets segments of its own, split by row id;
their states are added up first, since ties count as one level.

The multiplicities come from hashes of (seed, replicate, place), drawn once for
all groups with equally many subjects. Column 0 of each vector is 1: its
metrics are the observed ones.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eraloom.functions.ordered import add_segment, global_row_number, segment_count
from eraloom.operators.metrics import PREDICTIVE_METRICS
from eraloom.schemas import join_null_safe
from eraloom.session import materialize

# Rows times replicates of a segment, and replicates whose states are added up together.
SEGMENT_CELLS = 8_000_000
STATE_BLOCK = 128
# Replicates that a task scores at a time.
SCORED = 64
TOP = 0.10
# Draws of a task, and most tasks of a step.
TASK_DRAWS = 250_000
MOST_TASKS = 20_000

STATE = "block int, w binary, p binary"
CARRY = "block int, above_w binary, above_p binary, level_w binary, level_p binary, prior_w binary, all_w binary, all_p binary"
SUMS = ("auc", "ap", "brier", "loss", "top")


# --- multiplicities ----------------------------------------------------------


def cluster_indexes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, subject_id, cluster_index, n_clusters): the subjects of each group, numbered from 0 in id order."""
    keys = list(keys)
    placed = materialize(
        global_row_number(df.select(*keys, "subject_id").distinct(), [*[F.col(k) for k in keys], F.col("subject_id")])
    )
    spans = placed.groupBy(*keys).agg(F.min("row_number").alias("first"), F.count("*").alias("n_clusters"))
    return materialize(join_null_safe(placed, spans, keys, "inner").select(
        *keys, "subject_id", (F.col("row_number") - F.col("first")).alias("cluster_index"), "n_clusters"
    ))


def _drawn(seed: int, rep: int, place: int, n: int) -> int:
    """The cluster that a place of a replicate draws."""
    return int.from_bytes(hashlib.sha256(b"%d|%d|%d" % (seed, rep, place)).digest()[:4], "big") % n


def draw_vectors(index: DataFrame, n_rep: int, seed: int) -> DataFrame:
    """(n_clusters, cluster_index, draws): how often each replicate draws the cluster, one or more bytes for each replicate.

    ``index`` has n_clusters and cluster_index. Groups with the same number of
    clusters share their draws.
    """
    chunk = max(1, min(2**16, SEGMENT_CELLS // (2 * n_rep)))  # clusters whose vectors one task builds

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, 1_000_000 // n_rep)):
                part = batch.slice(at, max(1, 1_000_000 // n_rep))
                sizes, places = part.column(0).to_numpy(), part.column(1).to_numpy()
                hit = np.array([_drawn(seed, r, p, n) for n, p in zip(sizes.tolist(), places.tolist()) for r in range(n_rep)], dtype=np.int64)
                rep, n = np.tile(np.arange(n_rep), len(places)), np.repeat(sizes, n_rep)
                order = np.lexsort((hit, n))
                hit, rep, n = hit[order], rep[order], n[order]
                cuts = np.flatnonzero(np.r_[True, (np.diff(n) != 0) | (np.diff(hit // chunk) != 0)])
                ends = [*cuts[1:].tolist(), len(hit)]
                spans = list(zip(cuts.tolist(), ends))
                yield pa.RecordBatch.from_arrays([
                    pa.array(n[cuts]), pa.array(hit[cuts] // chunk),
                    pa.array([(hit[a:b] % chunk).astype(np.uint16).tobytes() for a, b in spans], pa.binary()),
                    pa.array([rep[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
                ], ["n_clusters", "chunk", "hits", "reps"])

    def build(table: pa.Table) -> pa.Table:
        n, c = table.column("n_clusters")[0].as_py(), table.column("chunk")[0].as_py()
        width = min(chunk, n - c * chunk)
        joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
        cell = joined("hits", np.uint16).astype(np.int64) * n_rep + joined("reps", np.uint32)
        found = np.bincount(cell, minlength=width * n_rep).reshape(width, n_rep)
        found = found.astype(np.uint8 if found.max(initial=0) < 256 else np.uint32)
        return pa.table([
            pa.array([n] * width, pa.int64()), pa.array(c * chunk + np.arange(width), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()),
        ], names=["n_clusters", "cluster_index", "draws"])

    # The work is in the draws, not in the bytes of their places, so adaptive plans must not gather it in few tasks.
    tasks = max(1, min(MOST_TASKS, index.count() * n_rep // TASK_DRAWS))
    places = index.select("n_clusters", "cluster_index").distinct().repartition(tasks, "n_clusters", "cluster_index")
    hits = places.mapInArrow(draw, "n_clusters long, chunk long, hits binary, reps binary")
    return hits.groupBy("n_clusters", "chunk").applyInArrow(build, "n_clusters long, cluster_index long, draws binary")


# --- segments ----------------------------------------------------------------


def _cuts(rows: DataFrame, n_rep: int) -> tuple[list[float], list[float], list[float]]:
    """Cut points of the score, those among them that are a level of their own, and cut points of the row id."""
    n = max(1, math.ceil(rows.count() * n_rep / SEGMENT_CELLS))
    if n == 1:
        return [], [], []
    probs = [i / n for i in range(1, n)]
    scores, ids = rows.select("score", F.col("row_id").cast("double").alias("id")).approxQuantile(["score", "id"], probs, 1 / (4 * n))
    heavy = {s for s, k in Counter(scores).items() if k > 1}
    return sorted(set(scores) | {math.nextafter(s, math.inf) for s in heavy}), sorted(heavy), sorted(set(ids))


def _blocks(*arrays: np.ndarray) -> list[dict]:
    names = [x.strip().split(" ")[0] for x in (STATE if len(arrays) == 2 else CARRY).split(",")][1:]
    return [
        {"block": b, **{n: x[at : at + STATE_BLOCK].tobytes() for n, x in zip(names, arrays)}}
        for b, at in enumerate(range(0, len(arrays[0]), STATE_BLOCK))
    ]


def _sort_segments(rows: DataFrame, keys: list[str], n_rep: int, n_segments: int) -> DataFrame:
    """One row per segment: its rows by falling score and rising id, their multiplicities and the ranking state."""
    kinds = dict(rows.dtypes)
    own = [*keys, "side"]

    def sort(table: pa.Table) -> pa.Table:
        score, ident = table.column("score").to_numpy(), table.column("row_id").to_numpy()
        order = np.lexsort((ident, -score))
        score, y, w = score[order], table.column("y").to_numpy()[order], table.column("w").to_numpy()[order]
        vectors = [np.frombuffer(x, dtype=np.uint8 if len(x) == n_rep else np.uint32) for x in table.column("draws").to_pylist()]
        mult = np.ones((len(order), n_rep + 1), dtype=np.result_type(*vectors))
        mult[:, 1:] = np.stack(vectors)[order]
        weight = np.concatenate([w @ mult[:, a : a + SCORED] for a in range(0, n_rep + 1, SCORED)])
        positive = np.concatenate([(w * y) @ mult[:, a : a + SCORED] for a in range(0, n_rep + 1, SCORED)])
        first = table.slice(0, 1).select([*own, "seg", "sub", "level"])
        rest = {
            "score": pa.array([score.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary()),
            "mult": pa.array([mult.tobytes()], pa.binary()),
            "state": pa.array([_blocks(weight, positive)], pa.list_(pa.struct([("block", pa.int32()), ("w", pa.binary()), ("p", pa.binary())]))),
        }
        for name, column in rest.items():
            first = first.append_column(name, column)
        return first

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in own]) + f", seg int, sub int, level boolean, score binary, y binary, w binary, mult binary, state array<struct<{STATE.replace(' ', ': ').replace(',:', ',')}>>"
    tasks = max(segment_count(rows), min(MOST_TASKS, n_segments))
    return rows.repartition(tasks, *own, "seg", "sub").groupBy(*own, "seg", "sub").applyInArrow(sort, schema)


def _carries(segments: DataFrame, own: list[str]) -> DataFrame:
    """For each segment and block of replicates, what lies above it and the totals."""
    kinds = dict(segments.dtypes)
    states = segments.select(*own, "seg", "sub", "level", F.explode("state").alias("s")).select(*own, "seg", "sub", "level", "s.*")

    def add_up(table: pa.Table) -> pa.Table:
        seg, sub = table.column("seg").to_numpy(), table.column("sub").to_numpy()
        order = np.lexsort((sub, -seg))
        table = table.take(pa.array(order))
        seg, level = seg[order], table.column("level").to_numpy()
        w, p = (np.stack([np.frombuffer(x, dtype=np.float64) for x in table.column(c).to_pylist()]) for c in "wp")
        heads = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        of = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(seg)]))
        seg_w, seg_p = np.add.reduceat(w, heads), np.add.reduceat(p, heads)
        before = lambda x: (np.cumsum(x, axis=0) - x)
        above_w, above_p = before(seg_w)[of], before(seg_p)[of]
        prior_w = before(w) - above_w
        made = {
            "above_w": above_w, "above_p": above_p, "level_w": np.where(level[:, None], seg_w[of], 0), "level_p": np.where(level[:, None], seg_p[of], 0),
            "prior_w": prior_w, "all_w": np.broadcast_to(w.sum(axis=0), w.shape), "all_p": np.broadcast_to(p.sum(axis=0), w.shape),
        }
        out = table.select([*own, "seg", "sub", "block"])
        for name, x in made.items():
            out = out.append_column(name, pa.array([np.ascontiguousarray(r).tobytes() for r in x], pa.binary()))
        return out

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in own]) + ", seg int, sub int, " + CARRY
    made = states.groupBy(*own, "block").applyInArrow(add_up, schema)
    parts = [c.strip().split(" ")[0] for c in CARRY.split(",")]
    return made.groupBy(*own, "seg", "sub").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("carry"))


# --- metrics -----------------------------------------------------------------


def segment_sums(score, y, w, level, carry, weighted_top: bool) -> dict[str, np.ndarray]:
    """A segment's part of each metric's sum, for each column of the weights ``w``; rows are in order."""
    y1 = y[:, None]
    taken, hits = np.cumsum(w, axis=0), np.cumsum(w * y1, axis=0)
    above_neg = carry["above_w"] - carry["above_p"]
    all_neg = carry["all_w"] - carry["all_p"]
    if level:  # part of one level: its ties are all rows of the level
        pos, level_neg = hits[-1], carry["level_w"] - carry["level_p"]
        auc = pos * (all_neg - above_neg - 0.5 * level_neg)
        reached = carry["above_w"] + carry["level_w"]
        ap = np.divide(pos * (carry["above_p"] + carry["level_p"]), reached, out=np.zeros_like(pos), where=reached > 0)
    else:
        ends = np.flatnonzero(np.append(score[1:] != score[:-1], True))  # last row of each distinct score
        t, h = taken[ends], hits[ends]
        pos, neg = np.diff(h, axis=0, prepend=0.0), np.diff(t - h, axis=0, prepend=0.0)
        auc = (pos * (all_neg - above_neg - (t - h) + 0.5 * neg)).sum(axis=0)
        reached = carry["above_w"] + t
        ap = np.divide(pos * (carry["above_p"] + h), reached, out=np.zeros_like(t), where=reached > 0).sum(axis=0)
    q = np.clip(score, 1e-6, 1 - 1e-6)
    k = target(carry["all_w"], weighted_top)
    part = np.clip(k - (carry["above_w"] + carry["prior_w"] + taken - w), 0.0, w)
    return {"auc": auc, "ap": ap, "brier": ((y - q) ** 2) @ w, "loss": -np.where(y == 1, np.log(q), np.log(1 - q)) @ w, "top": y @ part}


def target(total: np.ndarray, weighted_top: bool) -> np.ndarray:
    """Weight of the top fraction."""
    return TOP * total if weighted_top else np.maximum(1.0, np.ceil(TOP * total))


def _scored(segments: DataFrame, carries: DataFrame, own: list[str], n_rep: int, weighted_top: bool) -> DataFrame:
    """Metrics per group, side and replicate from all segments' sums."""
    kinds = dict(segments.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in own])
    payload = segments.select(*own, "seg", "sub", "level", "score", "y", "w", "mult")
    joined = join_null_safe(payload, carries, [*own, "seg", "sub"], "inner")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("level", "score", "y", "w", "mult", "carry")}
                score, y, w = (np.frombuffer(row[c], dtype=np.float64) for c in ("score", "y", "w"))
                size = len(row["mult"]) // (len(score) * (n_rep + 1))
                mult = np.frombuffer(row["mult"], dtype=f"u{size}").reshape(len(score), n_rep + 1)
                out: list[list] = []
                for c in row["carry"]:
                    arrays = {k: np.frombuffer(v, dtype=np.float64) for k, v in c.items() if k != "block"}
                    first, last = c["block"] * STATE_BLOCK, min((c["block"] + 1) * STATE_BLOCK, n_rep + 1)
                    parts = []
                    for a in range(first, last, SCORED):
                        b = min(a + SCORED, last)
                        there = {k: v[a - first : b - first] for k, v in arrays.items()}
                        parts.append(segment_sums(score, y, mult[:, a:b] * w[:, None], row["level"], there, weighted_top))
                    out.append([c["block"], *(np.concatenate([p[s] for p in parts]).tobytes() for s in SUMS), c["all_w"], c["all_p"]])
                keys = [pa.array([batch.column(k)[i].as_py()] * len(out), batch.schema.field(k).type) for k in own]
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], [*own, "block", *SUMS, "all_w", "all_p"]
                )

    def finish(table: pa.Table) -> pa.Table:
        x = {s: sum(np.frombuffer(v, dtype=np.float64) for v in table.column(s).to_pylist()) for s in SUMS}
        total, pos = (np.frombuffer(table.column(c)[0].as_py(), dtype=np.float64) for c in ("all_w", "all_p"))
        neg = total - pos
        both = (pos > 0) & (neg > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            values = [
                np.where(both, x["auc"] / (pos * neg), np.nan), np.where(both, x["ap"] / pos, np.nan), x["brier"] / total, x["loss"] / total,
                x["top"] / target(total, weighted_top),
            ]
        first = table.column("block")[0].as_py() * STATE_BLOCK - 1
        n = len(total)
        out = pa.table({k: pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in own})
        out = out.append_column("rep", pa.array(first + np.arange(n), pa.int64()))
        for m, v in zip(PREDICTIVE_METRICS, values):
            out = out.append_column(m, pa.array(v, mask=~np.isfinite(v)))
        return out

    parts = joined.select(*own, "level", "score", "y", "w", "mult", "carry").mapInArrow(
        sums, schema + ", block int, " + ", ".join(f"{s} binary" for s in (*SUMS, "all_w", "all_p"))
    )
    return parts.groupBy(*own, "block").applyInArrow(finish, schema + ", rep long, " + ", ".join(f"{m} double" for m in PREDICTIVE_METRICS))


def replicate_metrics(
    rows: DataFrame, keys: Sequence[str], n_rep: int, seed: int = 42, weight: str | None = None, weighted_top: bool = False,
    rank_clip: float | None = None,
) -> DataFrame:
    """Predictive metrics per key, side and replicate ``rep``; -1 stands for the observed values.

    ``rows`` holds keys, side, row_id, subject_id, y_true and score. Each
    group draws its own subjects; all sides of a group share the draws. A
    metric that a replicate does not have (one class only) is null.
    """
    keys = list(keys)
    own = [*keys, "side"]
    p = F.col("score").cast("double")
    if rank_clip:
        p = F.least(F.greatest(p, F.lit(rank_clip)), F.lit(1 - rank_clip))
    base = rows.select(
        *own, "row_id", "subject_id", F.col("y_true").cast("double").alias("y"), p.alias("score"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
    )
    index = cluster_indexes(rows, keys)
    base = materialize(join_null_safe(base, index, [*keys, "subject_id"], "inner").drop("subject_id"))
    scores, heavy, ids = _cuts(base, n_rep)
    base = add_segment(base, "score", scores, "seg")
    level = F.col("score").isin(heavy) if heavy else F.lit(False)
    base = add_segment(base.withColumn("level", level), "row_id", ids, "sub").withColumn("sub", F.when(F.col("level"), F.col("sub")).otherwise(0))
    segments = materialize(_sort_segments(base.join(draw_vectors(index, n_rep, seed), ["n_clusters", "cluster_index"]), keys, n_rep, len(scores) + len(ids) + 1))
    return _scored(segments, materialize(_carries(segments, own)), own, n_rep, weighted_top)
