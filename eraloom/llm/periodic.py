"""Periodic runs of words, found as maximal pairs of a text's repeats.

A run is a stretch of words that repeats with a smallest period and that no
neighbouring word extends. Two places of one text are a maximal pair when the
words from both agree for a length, differ after it, and differ before it.
A stretch with period q and length L is the maximal pair (s, s + q) that
agrees for L - q words, so maximal pairs whose distance is at most a third of
that length are the runs with at least four periods; nothing has to be
extended.

Pairs come from the LCP-interval tree of a text's suffixes, built bottom-up.
An interval keeps the places below it, and the same places by the word on
their left. When two children meet, each place of the smaller one asks the
larger one for places near it with another word on the left. Of the places
that near, all but the first have the same word on their left (each lies
inside the first one's repeat), so at most two class lists are read.

Only suffixes whose first five words recur in the same text can be in such a
pair; the others are left out before anything is sorted.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

# A run has at least so many words and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
# Words that both places of such a pair share at least.
SHARED = LEAST_WORDS - 1
# Characters of text whose suffixes are sorted together.
BLOCK_CHARS = 1_000_000

Run = tuple[int, int, int]  # start, length, period


# --- suffixes ----------------------------------------------------------------


def _repeating(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of the texts in which some five words occur twice, or seem to by their hash."""
    n = len(ids) - SHARED + 1
    if n < 2:
        return doc[:0]
    h = doc[:n].astype(np.uint64)
    for j in range(SHARED):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ ids[j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    return np.unique(doc[:n][np.isin(h, twice)]) if len(twice) else doc[:0]


def sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and LCP array of the suffixes that share four words or more with a neighbour.

    ``ids`` are the words of one or more texts, each text's different from the
    others' and ended by a number of its own. The LCP value stands between an
    entry and the one before it and is 0 where a group begins. Ranks of
    prefixes double in length; only suffixes that still tie are sorted again.
    """
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels = [(1, rank.astype(np.int32))]
    h, ties = 1, np.arange(n)
    order = np.zeros(0, dtype=np.int64)
    while len(ties):
        following = np.zeros(len(ties), dtype=np.int64)
        inside = ties + h < n
        following[inside] = rank[ties[inside] + h] + 1
        key = rank[ties] * (n + 1) + following
        at = np.argsort(key, kind="stable")
        ties, key = ties[at], key[at]
        new = np.r_[True, key[1:] != key[:-1]]
        # A group keeps the rank of its first suffix, so ranks of other groups stay right.
        base = rank[ties]
        outer = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
        place = np.arange(len(ties)) - np.repeat(outer, np.diff(np.r_[outer, len(ties)]))
        heads = np.flatnonzero(new)
        if h == 1:
            # Dense ranks of single words leave no room; start from places in the whole order.
            fresh = np.repeat(heads, np.diff(np.r_[heads, len(ties)]))
        else:
            fresh = base + np.repeat(place[heads], np.diff(np.r_[heads, len(ties)]))
        rank = rank.copy()
        rank[ties] = fresh
        h *= 2
        levels.append((h, rank.astype(np.int32)))
        tied = ~(new & np.r_[new[1:], True])
        ties = ties[tied]
        if h == 4:
            order = ties.copy()
    if not len(order):
        return order, order
    order = order[np.argsort(rank[order], kind="stable")]
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), dtype=np.int64)
    for h, level in reversed(levels):
        x, y = a + shared, b + shared
        ok = (x < n) & (y < n)
        same = np.zeros(len(a), dtype=bool)
        same[ok] = level[x[ok]] == level[y[ok]]
        shared[same] += h
    return order, np.r_[0, shared]


# --- maximal pairs -----------------------------------------------------------


class _Interval:
    """Words that an LCP interval's suffixes share; the places read so far, and the same by the word on their left, each in order."""

    __slots__ = ("shared", "places", "classes")

    def __init__(self, place: int, left: int):
        self.shared, self.places, self.classes = 0, [place], {left: [place]}


def maximal_pairs(order: list[int], shared: list[int], left: list[int]) -> Iterator[Run]:
    """(first place, agreeing words, distance) of the maximal pairs with a distance of at most a third of the agreeing words.

    ``left`` gives the word before each place, as a number.
    """
    found: list[Run] = []

    def join(a: _Interval, b: _Interval, length: int) -> _Interval:
        small, large = (a, b) if len(a.places) <= len(b.places) else (b, a)
        reach = length // (LEAST_PERIODS - 1)
        near, classes = large.places, large.classes
        for p in small.places:
            lo = bisect_left(near, p - reach)
            if lo < len(near) and near[lo] <= p + reach:
                own = left[p]
                # The words on the left of all places that near: that of the first, and that of all others.
                others = {left[q] for q in near[lo : lo + 2] if q <= p + reach}
                for word in others:
                    if word != own:
                        members = classes[word]
                        for q in members[bisect_left(members, p - reach) : bisect_right(members, p + reach)]:
                            found.append((min(p, q), length, abs(p - q)))
        for p in small.places:
            insort(near, p)
        for word, members in small.classes.items():
            mine = classes.setdefault(word, [])
            for p in members:
                insort(mine, p)
        large.shared = length
        return large

    stack: list[_Interval] = []
    last = None
    for place, length in zip(order, shared):
        if last:
            while stack and stack[-1].shared > length:
                top = stack.pop()
                last = join(top, last, top.shared)
            if length < SHARED:
                stack.clear()  # what is left shares too little
            elif stack and stack[-1].shared == length:
                stack[-1] = join(stack[-1], last, length)
            else:
                last.shared = length
                stack.append(last)
            yield from found
            found.clear()
        last = _Interval(place, left[place])
    while stack:
        top = stack.pop()
        last = join(top, last, top.shared)
    yield from found


def runs_of_block(texts: list[list[int]]) -> list[list[Run]]:
    """The runs of each text, given as word numbers, by start and then period."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1  # each text is followed by a number of its own
    ids = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    inner = np.ones(len(ids), dtype=bool)
    inner[ends] = False
    ids[inner] = np.fromiter(chain.from_iterable(texts), dtype=np.int64, count=int(sizes.sum()))
    top = int(ids.max(initial=0)) + 1
    ids[ends] = top + np.arange(len(texts))
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    out: list[list[Run]] = [[] for _ in texts]
    wanted = _repeating(ids, doc)
    if not len(wanted):
        return out
    kept = np.isin(doc, wanted)
    ids, doc = ids[kept], doc[kept]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    order, shared = sorted_suffixes(doc * (top + len(texts)) + ids)
    left = np.r_[-1, ids[:-1]]
    left[first] = -1
    start_of = np.zeros(len(texts), dtype=np.int64)
    start_of[doc[first]] = first
    periods: dict[tuple[int, int], int] = {}
    for place, length, distance in maximal_pairs(order.tolist(), shared.tolist(), left.tolist()):
        # The same stretch also pairs with multiples of its period; the smallest distance is the period.
        key = (place, length + distance)
        periods[key] = min(distance, periods.get(key, distance))
    for (place, length), period in periods.items():
        d = int(doc[place])
        out[d].append((place - int(start_of[d]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


# --- documents ---------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (0x20 and 0x09 to 0x0D); none for null."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def with_tail(words: list, doc_id) -> list:
    """For one document in ten, by its id, the words with a tail that repeats; the others as they are."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist()) if not d]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods; the first, then the one with the smaller period among equals."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += len(row[0] or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _texts(rows: Iterable[tuple], tails: bool) -> Iterator[tuple[list[bytes], list[Run]]]:
    """Words and runs of each (text, id)."""
    for block in _blocks(rows):
        number: dict[bytes, int] = {}
        texts = [with_tail(words_of(t), i) if tails else words_of(t) for t, i in block]
        found = runs_of_block([[number.setdefault(w, len(number)) for w in ws] for ws in texts])
        yield from zip(texts, found)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])))
def runs_of(texts: pd.Series) -> pd.Series:
    """The runs of each text by start and period; an empty list for null and for texts without any."""
    return pd.Series([found for _, found in _texts(((t, None) for t in texts), False)], dtype=object)


@F.pandas_udf(T.StringType())
def collapse(texts: pd.Series) -> pd.Series:
    """Each text's words joined by one space, with one period left of each run; null stays null."""
    made = [b" ".join(collapsed(ws, found)).decode("utf-8", "surrogatepass") for ws, found in _texts(((t, None) for t in texts), False)]
    return pd.Series([None if t is None else m for t, m in zip(texts, made)], dtype=object)


DIGEST = T.StructType([
    T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType()),
    T.StructField("exponent_milli", T.LongType()), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
])


def _digests(tails: bool):
    @F.pandas_udf(DIGEST)
    def digests(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        gc.disable()  # many small objects and no cycles
        for texts, ids in series:
            rows = []
            for words, found in _texts(zip(texts, ids), tails):
                best = strongest(found)
                rows.append((
                    len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest(),
                    hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest(),
                ))
            out = pd.DataFrame(rows, columns=DIGEST.names)
            yield out.astype({c: "Int64" for c in DIGEST.names[:5]})
            gc.collect(0)

    return digests


def find(docs: DataFrame, tails: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_runs``, its strongest run, and digests of its runs and of its collapsed words.

    ``tails`` makes the tail of one document in ten repeat first
    (``with_tail``). Every row is kept: repeated rows repeat, a null ``doc_id``
    stays null and gets no tail; null and empty texts have no words, no run and
    the digests of empty strings. Columns other than ``doc_id`` and ``text``
    are ignored; an empty table gives an empty result.
    """
    as_text = F.col("doc_id").cast("string")
    return docs.select("doc_id", _digests(tails)("text", as_text).alias("d")).select("doc_id", *[f"d.{c}" for c in DIGEST.names])


def find_rows(docs: DataFrame) -> DataFrame:
    """One row per run: ``doc_id``, ``start``, ``length``, ``period``, in words from 0."""
    return docs.select("doc_id", F.explode(runs_of("text")).alias("r")).select("doc_id", "r.*")
