"""Collocations: frequent phrases and how far their words stick together.

Every word of a piece of text points at a suffix: the words from there to the
end of the piece, of which the first ``LONGEST`` matter. Suffixes are routed to
buckets by language and leading word, in all of the corpus, and sorted there by
multikey three-way quicksort: each step splits a range of suffixes at a pivot
word into smaller, equal and larger ones. The equal range goes on with the next
word, and its size is the number of occurrences of the words so far. A range
that is smaller than the least count is abandoned, since nothing in it can
reach that count.

A leading word that holds more than a ``HOT``-th of all words is routed
together with its second word, and if that is as common, with its third, so no
bucket depends on how common a word is. Tasks merge equal suffixes before they
hand them on.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from eraloom.llm.common import arrow_rows
from eraloom.session import materialize

LONGEST = 3
LEAST_COUNT = 10
# A phrase goes when a longer one that holds it has at least this share of its occurrences, in percent.
SHARE = 50
TOP = 2000
UNKNOWN = "und"
# A word is hot with more than one in so many of all words, so there are fewer hot words than that.
HOT = 1000
# Words that a task sorts together before it hands them on, and words for each bucket.
CHUNK_WORDS = 1_000_000
BUCKET_WORDS = 1_500_000
# Documents that Python gets at a time.
BATCH_DOCS = 500

# Bytes after which a piece ends become line ends, tabs become spaces, capitals small letters.
_plain = bytes.maketrans(b".,;:!?\x0b\x0c\r\t" + bytes(range(65, 91)), b"\n" * 9 + b" " + bytes(range(97, 123)))


# --- words and suffixes of a chunk of texts ----------------------------------


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


GAP, END = 0, 1  # numbers of the empty string and of a piece's end


class Chunk:
    """Words of some texts as numbers, with a mark after each piece."""

    def __init__(self):
        self.number = _Numbers({b"": GAP, b"\n": END})
        self.langs = _Numbers()
        self.parts: list[np.ndarray] = []
        self.lang_of: list[int] = []
        self.size = 0

    def add(self, lang: str | None, text: str | None) -> None:
        data = (text or "").encode("utf-8", "surrogatepass").translate(_plain).replace(b"\n", b" \n ")
        ids = np.array(list(map(self.number.__getitem__, data.split(b" "))), dtype=np.int64)
        ids = ids[ids != GAP]
        self.parts += [ids, np.array([END])]
        self.lang_of += [self.langs[UNKNOWN if lang is None else lang]] * 2
        self.size += len(ids)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts one after the other, and the language number of each."""
        return np.concatenate(self.parts), np.repeat(self.lang_of, list(map(len, self.parts)))

    def counts(self) -> pa.RecordBatch:
        """(lang, word, n) of the chunk."""
        ids, lang = self.words()
        keep = ids > END
        key, n = np.unique(lang[keep] * len(self.number) + ids[keep], return_counts=True)
        return pa.RecordBatch.from_arrays(
            [_pick(list(self.langs), key // len(self.number)), _pick(list(self.number), key % len(self.number)), pa.array(n)], ["lang", "word", "n"]
        )

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, first, second and third word (or END) and number of the distinct suffixes of two words or more."""
        ids, lang = self.words()
        ids = np.r_[ids, END, END]
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        keep = (a > END) & (b > END)
        a, b, c, lang = a[keep], b[keep], c[keep], lang[keep]
        bits = len(self.number).bit_length()
        if len(self.langs).bit_length() + 3 * bits <= 63:
            key, n = np.unique(((lang << bits | a) << bits | b) << bits | c, return_counts=True)
            mask = (1 << bits) - 1
            return key >> 3 * bits, key >> 2 * bits & mask, key >> bits & mask, key & mask, n
        order = np.lexsort((c, b, a, lang))
        a, b, c, lang = a[order], b[order], c[order], lang[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1]) & (lang[1:] == lang[:-1])
        heads = np.flatnonzero(np.r_[True, ~same][: len(a)])
        return lang[heads], a[heads], b[heads], c[heads], np.diff(np.r_[heads, len(a)])


def _pick(names: list, at: np.ndarray) -> pa.Array:
    """The names at some places, as text."""
    text = pa.array([x if isinstance(x, str) else x.decode("utf-8", "surrogatepass") for x in names], pa.string())
    return text.take(pa.array(at))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    gc.disable()  # many small objects and no cycles
    chunk = Chunk()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang, text in zip(langs, batch.column(1)):
            chunk.add(lang, text.as_py())
            if chunk.size >= CHUNK_WORDS:
                yield chunk
                chunk = Chunk()
    if chunk.parts:
        yield chunk


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all whole texts."""

    def count(batches):
        for chunk in _chunks(batches):
            yield chunk.counts()

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


# --- routing -----------------------------------------------------------------


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def route(docs: DataFrame, hot: list[tuple[str, str]], buckets: int) -> DataFrame:
    """Suffixes of all texts by bucket: ``words`` (first words as language, tab, word) and the suffixes as places in it, with their numbers.

    A pair of two hot words is spread over buckets by its third word. Its own
    number then comes as a suffix without a third word.
    """
    common = frozenset(hot)

    def deal(batches):
        for chunk in _chunks(batches):
            lang, a, b, c, n = chunk.suffixes()
            if not len(a):
                continue
            words, langs = list(chunk.number), list(chunk.langs)
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
            is_hot = np.zeros((len(langs), len(words)), dtype=bool)
            for i, name in enumerate(langs):
                for other, word in common:
                    if other == name and (at := chunk.number.get(word.encode("utf-8", "surrogatepass"))) is not None:
                        is_hot[i, at] = True
            first, second = is_hot[lang, a], is_hot[lang, b]
            both = first & second
            if both.any():
                # Whole pairs, and apart from them their suffixes with a third word.
                pair, at = np.unique(np.stack([lang[both], a[both], b[both]]), axis=1, return_inverse=True)
                total = np.bincount(at.ravel(), weights=n[both]).astype(np.int64)
                keep = ~both | (c > END)
                extra = [pair[0], pair[1], pair[2], np.full(len(total), END), total, np.ones(len(total), bool), np.ones(len(total), bool)]
                lang, a, b, c, n, first, second = (np.r_[x[keep], y] for x, y in zip((lang, a, b, c, n, first, second), extra))
            lh = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], dtype=np.uint64)[lang]
            zero = np.uint64(0)
            to = (_mix(lh, h[a], np.where(first, h[b], zero), np.where(first & second, h[c], zero)) % np.uint64(buckets)).astype(np.int64)
            lead = len(words) + lang * len(words) + a
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0])
            out: list[list] = [[] for _ in range(6)]
            for rows in np.split(order, cuts[1:]):
                used, at = np.unique(np.concatenate([lead[rows], b[rows], c[rows]]), return_inverse=True)
                at = at.astype(np.uint32).reshape(3, -1)
                names = [
                    (words[u] if u < len(words) else f"{langs[u // len(words) - 1]}\t".encode("utf-8", "surrogatepass") + words[u % len(words)]).decode("utf-8", "surrogatepass")
                    for u in used.tolist()
                ]
                for x, y in zip(out, (int(to[rows[0]]), names, *(x.tobytes() for x in at), n[rows].astype(np.uint32).tobytes())):
                    x.append(y)
                if len(out[0]) == 64:
                    yield _dealt(out)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield _dealt(out)

    return docs.select("lang", "text").mapInArrow(deal, "bucket int, words array<string>, a binary, b binary, c binary, n binary")


def _dealt(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["bucket", "words", "a", "b", "c", "n"])


# --- quicksort ---------------------------------------------------------------


def frequent(keys: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ranges of equal words found by three-way quicksort: (words, one suffix of each range, the range as (suffixes, ends)).

    ``keys`` has a row for each word of the suffixes. All ranges are split in
    one step at a time. Ranges whose weights add up to less than ``least`` are
    abandoned.
    """
    depth_all = len(keys)
    # Routing: suffixes with the same leading word make the first ranges.
    order = np.argsort(keys[0], kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(keys[0][order]) != 0]) if len(order) else order
    depth = np.ones(len(starts), dtype=np.int64)
    equal = np.ones(len(starts), dtype=bool)
    while len(order):
        sizes = np.diff(np.r_[starts, len(order)])
        total = np.add.reduceat(weights[order], starts)
        enough = total >= least
        done = enough & equal
        for d in range(1, depth_all + 1):
            these = np.flatnonzero(done & (depth == d))
            if len(these):
                yield d, order[starts[these]], _members(order, starts[these], sizes[these])
        go_on = enough & (depth < depth_all)
        order = order[np.repeat(go_on, sizes)]
        sizes, depth = sizes[go_on], depth[go_on]
        if not len(order):
            break
        starts = np.cumsum(sizes) - sizes
        # Split each range at the word in its middle.
        key = keys[np.repeat(depth, sizes), order]
        pivot = np.repeat(key[starts + sizes // 2], sizes)
        side = (key > pivot).astype(np.int64) - (key < pivot) + 1
        part = np.repeat(np.arange(len(sizes)) * 3, sizes) + side
        if 3 * len(sizes) < 2**16:
            part = part.astype(np.uint16)
        at = np.argsort(part, kind="stable")
        order, part = order[at], part[at]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        head = part[starts].astype(np.int64)
        equal = head % 3 == 1
        depth = depth[head // 3] + equal


def _members(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of some ranges, and where each range begins among them."""
    first = np.cumsum(sizes) - sizes
    at = np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))
    return order[at], first


def phrases(routed: DataFrame, hot: list[tuple[str, str]], least: int = LEAST_COUNT) -> DataFrame:
    """(lang, w1, w2, w3, n) of the phrases of two and three words with at least ``least`` occurrences; ``w3`` is null for two."""
    def sort(table: pa.Table) -> pa.Table:
        words = table.column("words").combine_chunks()
        sizes = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary
        offset = np.cumsum(sizes) - sizes
        keys, n = [], []
        for c in "abc":
            blobs = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table.column(c)]
            keys.append(code[np.concatenate([b + o for b, o in zip(blobs, offset)])])
        keys = np.stack(keys)
        weights = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in table.column("n")]).astype(np.int64)
        text = names.to_pylist()
        place = {t: i for i, t in enumerate(text)}
        end = place.get("\n", -1)
        # Pairs of two hot words are counted by their suffixes without a third word only.
        of_pair = weights.copy()
        mates: dict[str, list[int]] = {}
        for lang, word in hot:
            mates.setdefault(lang, []).append(place.get(word, -1))
        for lang, word in hot:
            lead = place.get(f"{lang}\t{word}")
            if lead is not None:
                mine = np.flatnonzero(keys[0] == lead)
                of_pair[mine[np.isin(keys[1][mine], mates[lang]) & (keys[2][mine] != end)]] = 0
        rows: list[tuple] = []
        for depth, heads, (members, first) in frequent(keys, weights, least):
            if depth == 1:
                continue
            count = np.add.reduceat((of_pair if depth == 2 else weights)[members], first)
            for i, f in zip(heads.tolist(), count.tolist()):
                third = keys[2, i]
                if f >= least and (depth == 2 or third != end):
                    lang, w1 = text[keys[0, i]].rsplit("\t", 1)
                    rows.append((lang, w1, text[keys[1, i]], text[third] if depth == 3 else None, f))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, (*[pa.string()] * 4, pa.int64()))], names=["lang", "w1", "w2", "w3", "n"])

    return routed.groupBy("bucket").applyInArrow(sort, "lang string, w1 string, w2 string, w3 string, n long")


# --- scores ------------------------------------------------------------------


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1,000,000 a^2 / (l r)), exactly: the products have at most 37 digits for counts below 10^15."""
    return F.expr(f"cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0)))")


def mine(docs: DataFrame, least: int = LEAST_COUNT, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Phrases have two or three words of one piece; pieces end at ``.,;:!?`` and
    line ends, words at spaces and tabs, A-Z count as a-z. ``a`` is the number
    of a phrase's occurrences. Of its cuts into two the one with the lowest
    score floor(1,000,000 a^2 / (l r)) counts, the earliest among equals, where
    ``l`` and ``r`` are the occurrences of the two sides. A phrase is left out
    when a longer one that holds it has at least ``share`` percent of its
    occurrences. ``n`` is the number of words of the language. Ranks go by
    score, then ``a`` (both falling), then the phrase in byte order.

    A null ``lang`` is ``und``; null and empty texts have no words; repeated
    rows count again. Other columns are ignored; an empty table gives an empty
    result.
    """
    if least < 1:
        raise ValueError("the least count is at least 1")
    docs = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    with arrow_rows(docs.sparkSession, BATCH_DOCS):
        words = materialize(count_words(docs))
        total = words.agg(F.sum("n")).first()[0] or 0
        hot = [(r["lang"], r["word"]) for r in words.where(F.col("n") * HOT > total).collect()]  # fewer than HOT
        routed = route(docs, hot, max(1, math.ceil(total / BUCKET_WORDS)))
        found = materialize(phrases(routed, hot, least))
    one = words.where(F.col("n") >= least)
    two = found.where("w3 is null").select("lang", "w1", "w2", F.col("n").alias("a"))
    three = found.where("w3 is not null").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))

    def word(column: str, out: str) -> DataFrame:
        return one.select("lang", F.col("word").alias(column), F.col("n").alias(out))

    def pair(first: str, second: str, out: str) -> DataFrame:
        return two.select("lang", F.col("w1").alias(first), F.col("w2").alias(second), F.col("a").alias(out))

    held = (
        three.select("lang", "w1", "w2", "a").union(three.select("lang", "w2", "w3", "a"))
        .groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    )
    short = (
        two.join(held, ["lang", "w1", "w2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
        .join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    )
    cuts = (
        three.join(word("w1", "l1"), ["lang", "w1"]).join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
        .join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(word("w3", "r2"), ["lang", "w3"])
        .withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    )
    early = F.col("s1") <= F.col("s2")
    long_ = cuts.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = short.union(long_).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
