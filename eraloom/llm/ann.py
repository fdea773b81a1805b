"""Nearest neighbours with a permutation index.

A vector is represented by its pivots in order of distance. Each pivot has an
inverted file that posts, for every vector, the place of the pivot in that
order. A query reads the pivots' files; the sum over pivots of the differences
between its own and the posted places is the footrule distance, which ranks
the vectors. The best of that rank are compared exactly.

The index is cut by the hash of the id into parts, and queries into blocks. A
part answers a block of queries on its own, with the pivots as one more row;
the answers are merged by rank, so no task holds more than a part and a block. Equal vectors are indexed once,
with the smallest of their ids: no more than k + 1 of them can be among the
k nearest, since ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from eraloom.llm.vectors import fingerprint, matrix, usable
from eraloom.session import materialize

PIVOTS = 128
# Share of a part, and least number of its vectors, that are compared exactly.
SHARE, LEAST = 0.1, 512
PART_VECTORS, BLOCK_QUERIES = 4096, 8192
NEIGHBOURS = 10


def places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each row of ``x``, the place of each pivot in the order of distance; ties go to the pivot listed first."""
    d = (pivots**2).sum(axis=1) - 2 * x @ pivots.T
    order = np.argsort(d, axis=1, kind="stable")
    out = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(len(pivots), dtype=np.int16), order.shape), axis=1)
    return out


class Index:
    """Inverted files of the pivots over the rows of ``x``."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray):
        self.files = np.ascontiguousarray(places(x, pivots).T)

    def footrule(self, place: np.ndarray) -> np.ndarray:
        """Footrule distance of all rows to a query's places."""
        return np.abs(self.files - place[:, None]).sum(axis=0, dtype=np.int32)


def _answer(key: tuple, part: pa.Table, asked: pa.Table) -> pa.Table:
    """The nearest vectors of one part for one block of queries: up to k + 1 classes for each query."""
    kind = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    if not len(part) or not len(asked):
        return kind.empty_table()
    k = NEIGHBOURS
    known = asked.filter(pc.is_valid(asked["pivots"]))
    asked = asked.filter(pc.is_null(asked["pivots"]))
    if not len(asked):
        return kind.empty_table()
    part, asked = part.sort_by("rep"), asked.sort_by("query_id")
    x, q = matrix(part["v"]), matrix(asked["v"])
    pivots = np.array(known["pivots"][0].as_py())
    index = Index(x, pivots)
    ids, queries = part["ids"].to_pylist(), asked["query_id"].to_pylist()
    take = min(len(x), max(LEAST, k + 1, int(np.ceil(SHARE * len(x)))))
    rows: list[tuple] = []
    for i, place in enumerate(places(q, pivots)):
        rank = index.footrule(place)
        chosen = np.argpartition(rank, take - 1)[:take] if take < len(x) else np.arange(len(x))
        d = np.sqrt(((x[chosen] - q[i]) ** 2).sum(axis=1))
        first = np.array([ids[c][0] for c in chosen])
        for j in np.lexsort((first, d))[: k + 1]:
            rows.append((queries[i], ids[chosen[j]], float(d[j])))
    return pa.Table.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(kind)], schema=kind)


def search(vectors: DataFrame, every: int = 100, k: int = NEIGHBOURS) -> DataFrame:
    """For each vector whose id is divisible by ``every``, its ``k`` nearest others found: ``query_id``, ``rank``, ``vec_id``, ``score``.

    The score is the Euclidean distance of the vectors as they are, in double
    precision; ties go to the smaller id. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do rows with a null
    id. Only vectors of the query's length are its candidates. Rows that
    repeat an id are candidates each, but never of a query with that id. With
    fewer candidates, all are returned; other columns are ignored.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", "v", F.size("v").alias("dim"), fingerprint("v").alias("fp"))
    # Of equal vectors the k + 1 smallest ids are enough; each task keeps no more before the shuffle.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int"))
    smallest = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    part = salted.groupBy("fp", "dim", "salt").agg(smallest(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    classes = part.groupBy("fp", "dim").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"), F.first("v").alias("v"))
    classes = materialize(classes.select("dim", "ids", "v", F.col("ids")[0].alias("rep")))
    # Pivots: for each length, the distinct vectors of the smallest hashes.
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    bound = F.coalesce(*[F.when(F.col("dim") == d, F.lit(min(1.0, 8 * PIVOTS / n))) for d, n in sizes.items()], F.lit(1.0)) if sizes else F.lit(1.0)
    few = classes.where(F.pmod(F.xxhash64(F.lit("pivot"), "rep"), F.lit(2**30)) < bound * 2**30)  # about 8 times as many as needed
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy(F.pmod(F.xxhash64(F.lit("pivot"), "rep"), F.lit(2**30)), "rep"))).where(F.col("place") <= PIVOTS)
    pivots = few.groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("pivots"))

    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "dim")
    n_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    parts = max([1, *(-(-n // PART_VECTORS) for n in sizes.values())])
    each_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "query_id"), F.lit(n_blocks)).cast("int")).select("*", F.lit(None).cast("array<array<double>>").alias("pivots"), each_part)
    # The pivots go to each part and block once, not along with each query.
    each_block = pivots.select("dim", "pivots", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    asked = asked.unionByName(each_block.select("*", each_part), allowMissingColumns=True)
    held = (
        classes.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "rep"), F.lit(parts)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    )
    keys = ("dim", "part", "block")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_answer, "query_id long, ids array<long>, score double")
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
