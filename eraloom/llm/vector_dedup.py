"""Near-duplicate vectors by spherical-cap filters with random product codes.

A filter is a direction; a vector belongs to it when their cosine is at least
a bound. The directions are all combinations of a few random codewords, one
for each block of coordinates, so the filters of a vector are listed by
combining the blocks' scores and dropping combinations that cannot reach the
bound any more. Several such codes over randomly turned coordinates make up for
vectors that lie badly to one code. Vectors that share a filter are compared
exactly.

Equal vectors are one class with a size. A filter's members are dealt into
blocks of bounded size and each pair of blocks is one task's work, so a filter
that holds a large share of all vectors is spread. A pair counts in its first
common filter only, and tasks hand on sums and the local component of each
vector, never the pairs.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eraloom.llm.graph import components
from eraloom.llm.vectors import fingerprint, matrix, usable
from eraloom.session import materialize

LEAST_COSINE = 0.9
CODES = 3  # blocks of coordinates
TURNS = 6  # codes over turned coordinates
# Filters of each code that a vector is in, on average, and members that a filter should have.
LISTED, MEMBERS = 8, 400
BLOCK = 1024
SEED = 3


@lru_cache(maxsize=64)
def codewords(dim: int, words: int, turn: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """A random turn of the coordinates, and random unit codewords of each block, scaled so that each direction has length 1."""
    rng = np.random.default_rng([SEED, dim, words, turn])
    turned = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cuts = np.linspace(0, dim, min(CODES, dim) + 1).astype(int)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        w = rng.standard_normal((words, b - a))
        out.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(len(cuts) - 1))
    return turned, tuple(out)


def caps(x: np.ndarray, words: int, listed: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for all filters of all codes that the unit rows of ``x`` belong to."""
    found = [_caps(x, words, listed, turn) for turn in range(TURNS)]
    return np.concatenate([r for r, _ in found]), np.concatenate([f * TURNS + turn for turn, (_, f) in enumerate(found)])


def _caps(x: np.ndarray, words: int, listed: float, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for one code. The bound lets a random vector into ``listed`` filters on average. Rows
    that reach no filter go to their best one.
    """
    dim = x.shape[1]
    turned, code = codewords(dim, words, turn)
    x = x @ turned
    cuts = np.cumsum([0, *(w.shape[1] for w in code)])
    scores = [x[:, a:b] @ w.T for a, b, w in zip(cuts, cuts[1:], code)]
    filters = words ** len(code)
    bound = NormalDist().inv_cdf(1 - min(0.5, listed / filters)) / np.sqrt(dim)
    rest = np.array([s.max(axis=1) for s in scores])
    row, prefix, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for k, s in enumerate(scores):
        grown = total[:, None] + s[row]
        hope = grown + rest[k + 1 :].sum(axis=0)[row][:, None]
        i, w = np.nonzero(hope >= bound)
        row, prefix, total = row[i], prefix[i] * words + w, grown[i, w]
    missed = np.setdiff1d(np.arange(len(x)), row)
    best = np.zeros(len(missed), dtype=np.int64)
    for s in scores:
        best = best * words + s[missed].argmax(axis=1)
    return np.concatenate([row, missed]), np.concatenate([prefix, best])


def _local(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` members reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(words: int, listed: float, least: float):
    def compare(key: tuple, t: pa.Table) -> pa.Table:
        """Links of one pair of blocks: for each member with one, the size of what it links with, and its local component."""
        dim, cap, i, j = (k.as_py() for k in key)
        t = t.sort_by("rep")
        rep, size, block = (t[c].to_numpy() for c in ("rep", "size", "own"))
        x = matrix(t["v"])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = x[one] @ x[two].T >= least
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        a, b = one[a], two[b]
        if len(a):
            # The pair counts here only if this is its first common filter.
            used = np.unique(np.concatenate([a, b]))
            row, found = caps(x[used], words, listed)
            lists: dict[int, set[int]] = {int(u): set() for u in used}
            for r, f in zip(used[row].tolist(), found.tolist()):
                if f < cap:
                    lists[r].add(f)
            first = np.array([not (lists[p] & lists[q]) if lists[p] and lists[q] else True for p, q in zip(a.tolist(), b.tolist())])
            a, b = a[first], b[first]
        links = np.bincount(a, size[b], len(rep)) + np.bincount(b, size[a], len(rep))
        label = _local(len(rep), a, b)
        keep = np.unique(np.concatenate([a, b])).astype(int)
        return pa.table({"rep": pa.array(rep[keep], pa.int64()), "links": pa.array(links[keep].astype(np.int64)), "label": pa.array(rep[label[keep]], pa.int64())})

    return compare


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Per row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of one length are linked when their cosine in double precision is
    at least ``least``. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do rows with a null id, whose
    ``component_id`` is null and which are kept. Rows that repeat an id count
    as vectors of their own in ``n_links``. Other columns are ignored.
    """
    v = F.when(F.col("vec_id").isNotNull() & usable("embedding"), F.col("embedding"))
    rows = vectors.select("vec_id", v.alias("v"))
    rows = rows.select("vec_id", "v", fingerprint("v").alias("fp"))
    classes = materialize(
        rows.where("fp is not null").groupBy("fp").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v")).withColumn("dim", F.size("v"))
    )
    n = classes.count()
    words = max(4, round((n * LISTED / MEMBERS) ** (1 / CODES)))

    def list_caps(batches):
        for batch in batches:
            for dim in set(batch["dim"].to_pylist()):
                part = pa.Table.from_batches([batch]).filter(pa.compute.equal(batch["dim"], dim))
                x = matrix(part["v"])
                row, cap = caps(x / np.linalg.norm(x, axis=1, keepdims=True), words, LISTED)
                reps = part["rep"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(reps[row], pa.int64()), pa.array(cap, pa.int64()), pa.array([dim] * len(row), pa.int32())], ["rep", "cap", "dim"])

    listed = materialize(classes.select("rep", "v", "dim").mapInArrow(list_caps, "rep long, cap long, dim int"))
    blocks = listed.groupBy("dim", "cap").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = listed.join(blocks, ["dim", "cap"]).withColumn("own", F.pmod(F.xxhash64(F.lit("own"), "rep"), F.col("blocks")).cast("int"))
    dealt = (
        placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .join(classes.select("rep", "size", "v"), "rep")
        .select("dim", "cap", "i", "j", "own", "rep", "size", "v")
    )
    sums = dealt.groupBy("dim", "cap", "i", "j").applyInArrow(_compare(words, LISTED, least), "rep long, links long, label long")
    sums = materialize(sums)
    found = components(sums.select("rep", "label")).withColumnRenamed("id", "rep")
    totals = sums.groupBy("rep").agg(F.sum("links").alias("links"))
    done = classes.select("fp", "rep", "size").join(totals, "rep", "left").join(found, "rep", "left").select(
        "fp", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    return (
        rows.select("vec_id", "fp").join(done, "fp", "left")
        .withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")))
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
