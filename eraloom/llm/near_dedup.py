"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Two fixed permutations make the whole signature: the first one scatters the
shingles, the second one is shifted by one place for each further coordinate.
Bands of coordinates are bucket keys.

Documents with equal shingle sets form a class, and only one document of each
class is banded. Bands are taken in rounds: in every bucket that still holds
several components each member outside the component of the smallest one is
checked against it, then components are joined before the next round, so a
copy costs about one check and not one for each band.

What is left are buckets whose members are alike without being linked to the
smallest one. Their documents are compared by an exact prefix join on the full
sets: shingles are ordered from rare to frequent, and two documents at the
threshold must share one so early in both that what follows can still make up
the overlap. Members of a family differ in shingles of their own, which come
first, so such a pair meets only if it may be linked, whatever the bucket's
size.

In the rounds a pair is dropped before the full check only when set sizes rule
it out, or when the last four bits of its coordinates, which travel with the
bucket rows, differ so often that a pair at the threshold would show it less
than once in ten million times (``MOST_DIFFERENT``); the prefix join does not
depend on it. Sharing no band at all at the threshold, five times in a million,
is the likelier loss.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from eraloom.llm.common import arrow_rows, collector_off
from eraloom.llm.graph import components
from eraloom.session import broadcast_checked, materialize

WORDS = 5
PERCENT = 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
# Coordinates whose last four bits differ: at similarity 0.75 the mean is 30 of 128 and the standard deviation 4.8.
MOST_DIFFERENT = 57
# Bands of each round.
ROUNDS = ((0, 4), (4, BANDS))
# Checks against one document are dealt over as many keys.
SALTS = 1024
BLOCK_CHARS = 800_000
MEMO_WORDS = 150_000
# Documents that a Python worker gets at a time.
BATCH_DOCS = 500


# --- shingle sets and signatures ---------------------------------------------


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of the distinct word shingles of texts."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        # On bytes, lower() changes A-Z only and split() cuts at space and 0x09-0x0D only.
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        for w in set(ws).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, ws), dtype=np.uint64, count=len(ws))

    def of(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        n = min(len(w), WORDS)
        if n == 0:
            return w
        count = len(w) - n + 1
        h = np.full(count, n, dtype=np.uint64)
        for j in range(n):
            h = _mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + count])
        return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Circulant MinHash signatures (rows of COORDINATES 32-bit numbers) of non-empty sets.

    The universe is the 32-bit numbers. Coordinate k is the least value of the
    second permutation, shifted by k places, over the elements that the first
    permutation gives.
    """
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = (flat >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)  # first permutation
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    y, t = np.empty_like(x), np.empty_like(x)
    for k in range(COORDINATES):
        np.add(x, np.uint32(k), out=y)  # wraps round: a circular shift
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):  # second permutation
            np.right_shift(y, np.uint32(shift), out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(factor), out=y)
        np.right_shift(y, np.uint32(16), out=t)
        np.bitwise_xor(y, t, out=y)
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def _blocks(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


# Columns with the last four bits of sixteen coordinates each.
LAST = [f"last{i}" for i in range(COORDINATES // 16)]


@F.pandas_udf(T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("fingerprint", T.BinaryType()), T.StructField("signature", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in LAST]]))
def sketch(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Set size, 128-bit fingerprint of the set, signature, and the last four bits of its coordinates; null but the size for empty sets."""
    with collector_off():  # many small objects and no cycles
        shingler = Shingler()
        for s in series:
            rows: list[tuple] = []
            for block in _blocks(s):
                sets = [shingler.of(t) for t in block]
                full = [x for x in sets if len(x)]
                made = signatures(full) if full else np.zeros((0, COORDINATES), dtype=np.uint32)
                four = (made & np.uint32(15)).astype(np.uint8)
                last = np.ascontiguousarray(four[:, ::2] | four[:, 1::2] << np.uint8(4)).view(np.int64).tolist()
                found = iter(zip(made, last))
                for x in sets:
                    if len(x):
                        own, bits = next(found)
                        rows.append((len(x), xxhash.xxh3_128_digest(x.tobytes()), own.tobytes(), *bits))
                    else:
                        rows.append((0, None, None, *[None] * len(LAST)))
            out = pd.DataFrame(rows, columns=["n_shingles", "fingerprint", "signature", *LAST])
            yield out.astype({c: "Int64" for c in LAST})
            gc.collect(0)


@F.pandas_udf(T.ArrayType(T.LongType()))
def full_set(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The set of a text, null unless it has the wanted fingerprint."""
    shingler = Shingler()
    for texts, wanted in series:
        sets = [shingler.of(t) for t in texts]
        yield pd.Series([x.view(np.int64) if xxhash.xxh3_128_digest(x.tobytes()) == w else None for x, w in zip(sets, wanted)], dtype=object)


# --- candidates, checks, components ------------------------------------------


OWN = ("rep", "n", *LAST)


def _alike(a: str, b: str) -> Column:
    """Set sizes and last bits allow the threshold; ``a`` and ``b`` are prefixes of the columns."""
    n, m = f"{a}n", f"{b}n"
    different = F.lit(0)
    for c in LAST:
        d = F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))
        d = d.bitwiseOR(F.shiftright(d, 1))
        d = d.bitwiseOR(F.shiftright(d, 2))
        different = different + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT) & (different <= MOST_DIFFERENT)


def _sets(reps: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, shingles) of the classes in ``reps``; only their documents' texts are read again."""
    needed = materialize(reps.select("rep").distinct().join(classes.select("rep", F.col("fingerprint").alias("wanted")), "rep"))
    # The set is made after the join, since it needs what the join brings.
    sets = (
        docs.select("doc_id", "text").join(broadcast_checked(needed.withColumnRenamed("rep", "doc_id")), "doc_id")
        .select(F.col("doc_id").alias("rep"), full_set("text", "wanted").alias("shingles"))
        .where("shingles is not null")
    )
    with arrow_rows(docs.sparkSession, BATCH_DOCS):
        return materialize(sets)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among candidate pairs (a, b), by full sets."""
    close = materialize(pairs.distinct().withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))))
    # A document that very many are checked against sends its set once for each salt.
    hubs = close.select("a", "salt").distinct().join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    both = F.size(F.array_intersect("x", "y"))
    return (
        close.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
        .join(hubs, ["a", "salt"])
        .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
        .where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * PERCENT)
        .select("a", "b")
        .distinct()
    )


def _check(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among candidate pairs (a, b), whose sets are made here."""
    pairs = materialize(pairs.distinct())
    return _linked(pairs, _sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), classes, docs))


def _open(rows: DataFrame) -> DataFrame:
    """Buckets with more than one component: their smallest member."""
    return (
        rows.groupBy("key")
        .agg(F.min("rep").alias("first"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high").select("key", "first")
    )


def _prefix_pairs(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from (rep, component, shingles).

    Shingles are ordered by the number of documents that hold them. If the
    first common one stands at places i and j of sets of sizes n and m, at most
    min(n - i, m - j) are common. Shingles that one document holds come first
    and are only counted.
    """
    rows = docs.select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = (
        rows.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("holders > 1").select("shingle", "holders", (F.col("low") != F.col("high")).alias("across"))
    )
    ordered = (
        rows.join(shared, "shingle")
        .groupBy("rep").agg(F.max("component").alias("component"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("holders", "shingle", "across"))).alias("s"))
        .select("rep", "component", "n", (F.col("n") - F.size("s")).alias("own"), F.posexplode("s").alias("at", "s"))
        .select("rep", "component", "n", (F.col("own") + F.col("at")).alias("at"), "s.shingle", "s.across")
    )
    prefix = materialize(ordered.where(F.col("across") & ((F.col("n") - F.col("at")) * 100 >= F.col("n") * PERCENT)).drop("across"))
    n, m = F.col("x.n"), F.col("y.n")
    common = F.least(n - F.col("x.at"), m - F.col("y.at"))
    may = (common * (100 + PERCENT) >= (n + m) * PERCENT) & (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT)
    return (
        prefix.alias("x").join(prefix.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & F.expr("x.rep < y.rep and x.component != y.component") & may)
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    )


def links_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Enough links (a, b) between class representatives to connect all that are linked."""
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(signature, i * {4 * ROWS} + 1, {4 * ROWS})))")
    members = classes.select(*OWN, keys.alias("keys"))
    owned, links = members.withColumn("component", F.col("rep")), None
    for start, stop in ROUNDS:
        rows = owned.select(*OWN, "component", F.explode(F.slice("keys", start + 1, stop - start)).alias("key"))
        hubs = materialize(_open(rows)).withColumnRenamed("first", "rep").join(owned.drop("keys"), "rep")
        hubs = hubs.select("key", *[F.col(c).alias(f"first_{c}") for c in (*OWN, "component")])
        stars = rows.join(hubs, "key").where(F.col("component") != F.col("first_component")).where(_alike("", "first_"))
        found = materialize(_check(stars.select(F.col("first_rep").alias("a"), F.col("rep").alias("b")), classes, docs))
        links = found if links is None else links.union(found)
        owned = members.join(components(links).withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    # Documents of buckets in which more than one component is left.
    rows = owned.select("rep", "component", F.explode("keys").alias("key"))
    left = materialize(rows.join(_open(rows).select("key"), "key").select("rep", "component").distinct())
    sets = _sets(left, classes, docs)
    pairs = _prefix_pairs(sets.join(left, "rep"))
    return links.union(materialize(_linked(pairs, sets)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when the Jaccard similarity of their sets of distinct
    five-word shingles is at least 0.75; documents with fewer words have the
    whole sequence as their only shingle; those without words (or null) have
    an empty set, link with nothing and stay. ``component_id`` is the smallest
    id reachable. Rows that share a ``doc_id`` are one document with all their
    links. A row with a null ``doc_id`` links with nothing: its
    ``component_id`` is null and it is kept. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    with arrow_rows(docs.sparkSession, BATCH_DOCS):
        sketches = materialize(docs.select("doc_id", sketch("text").alias("s")).select("doc_id", "s.*"))
    classes = materialize(
        sketches.where("fingerprint is not null and doc_id is not null")
        .groupBy("fingerprint")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("signature").alias("signature"), *[F.max(c).alias(c) for c in LAST])
    )
    member = sketches.select("doc_id", "fingerprint").join(classes.select("fingerprint", "rep"), "fingerprint")
    # Rows of one id with different texts tie their classes together.
    tied = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", "b")
    found = components(links_of(classes, docs).union(tied))
    groups = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return (
        sketches.select("doc_id", "n_shingles", "fingerprint").join(groups, "fingerprint", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
