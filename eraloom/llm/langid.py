"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound by
multiplying its letters' vectors, each rotated by its place. A text is the
bundle (sum) of its trigrams, a language the bundle of its training texts. A
text gets the language whose bundle has the greatest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from eraloom.functions.ordered import exact_percentiles
from eraloom.llm.common import fold, forget
from eraloom.session import materialize

DIMENSION = 1024
SEED = 7
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
# Lengths of the labelled documents' beginnings from which the least cosine of text of a learned language comes, and how many there must be.
LENGTHS, LEAST_DOCS = tuple(2**k for k in range(1, 14)), 20
# A bound lies at this quantile of texts with shuffled letters, but no higher than this part of a low quantile of labelled text.
JUNK_QUANTILE, CLEAN_QUANTILE, CLEAN_PART = 0.95, 0.05, 0.8
BLOCK_DOCS, BLOCK_CHARS = 256, 500_000
# Trigrams that are bound at a time, for memory.
BLOCK_TRIGRAMS = 4_096


@dataclass(frozen=True)
class Profiles:
    letters: str  # all letters of the training texts; others are in no profile and share one vector
    languages: tuple[str, ...]  # in order
    bundles: bytes  # float32, one row of DIMENSION for each language, of unit length

    def matrix(self) -> np.ndarray:
        return np.frombuffer(self.bundles, dtype=np.float32).reshape(-1, DIMENSION)


@lru_cache(maxsize=4)
def _codes(letters: str) -> np.ndarray:
    """Code of each code point: 0 between words, from 1 the letters, then one for all others."""
    out = np.zeros(0x110000, dtype=np.int32)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = len(letters) + 1
    out[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
    return out


@lru_cache(maxsize=4)
def _vectors(letters: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of all codes, rotated for the first, second and last place of a trigram."""
    base = np.stack([np.random.default_rng([SEED, x]).choice(np.array([-1, 1], dtype=np.int8), DIMENSION) for x in (0, *map(ord, letters), 1)])
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigrams(text: str | None, letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's trigrams and their counts; words stand apart by one gap. Empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _codes(letters)[points]
    if not c.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.int64)
    n = len(letters) + 2
    code = (c[:-2] * n + c[1:-1]) * n + c[2:]
    if n <= 128 and len(code) > n**3 // 8:
        counts = np.bincount(code, minlength=1)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(code, return_counts=True)


def bind(codes: np.ndarray, letters: str) -> np.ndarray:
    """Vectors of trigrams, one row each."""
    n = len(letters) + 2
    first, second, last = _vectors(letters)
    out = first[codes // (n * n)]
    out *= second[codes // n % n]
    out *= last[codes % n]
    return out


def bundles(texts: Iterable[str | None], letters: str) -> np.ndarray:
    """Bundle of each text; zero without a letter."""
    found = [trigrams(t, letters) for t in texts]
    used = np.unique(np.concatenate([c for c, _ in found])) if found else np.zeros(0, dtype=np.int64)
    out = np.zeros((len(found), DIMENSION), dtype=np.float32)
    for at in range(0, len(used), BLOCK_TRIGRAMS):
        part = used[at : at + BLOCK_TRIGRAMS]
        counts = np.zeros((len(found), len(part)), dtype=np.float32)
        for i, (c, n) in enumerate(found):
            a, b = np.searchsorted(c, part[0]), np.searchsorted(c, part[-1], side="right")
            counts[i, np.searchsorted(part, c[a:b])] = n[a:b]
        out += counts @ bind(part, letters).astype(np.float32)
    return out


def _blocks(texts: Iterable[str | None], docs: int = BLOCK_DOCS) -> Iterator[list[str | None]]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text or "")
        if len(block) >= docs or size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _by_language(train: DataFrame, train_docs: int) -> DataFrame:
    """About ``train_docs`` rows by the hash of their id, as many of each language as far as it has them.

    The driver gets the number of documents of each language.
    """
    sizes = train.groupBy("lang").agg(F.count("*").alias("_n"))
    counts = sorted(r["_n"] for r in sizes.select("_n").collect())
    left = train_docs
    for i, n in enumerate(counts):
        most = max(left // (len(counts) - i), 1)
        if n > most:
            break
        left -= n
    else:
        return train
    share = sizes.select("lang", (F.least(F.lit(1.0), F.lit(float(most)) / F.col("_n")) * 2**30).cast("long").alias("_share"))
    return train.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(2**30)) < F.col("_share"))


def fit(docs: DataFrame, train_docs: int | None = None) -> Profiles:
    """Learn profiles from all documents with a language whose fold is not held out.

    With ``train_docs``, about that many of them are taken, by the hash of
    their id, so that rare languages are there too. The driver gets the letters
    and one vector for each language.
    """
    part = fold("doc_id", FOLDS)
    train = docs.select("doc_id", "text", "lang").where((part >= 0) & (part != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    train = (train if train_docs is None else _by_language(train, train_docs)).select("text", "lang")

    def count(batches):
        forget()
        for pdf in batches:
            points = np.frombuffer("".join(pdf["text"]).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            yield pd.DataFrame({"letter": [x for x in np.unique(points).tolist() if chr(x).isalpha()]}, dtype="int64")

    found = train.select("text").mapInPandas(count, "letter long").distinct().collect()
    letters = "".join(sorted(chr(r["letter"]) for r in found))

    def bundle(batches):
        forget()
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                for block in _blocks(group["text"]):
                    total[lang] = total.get(lang, 0) + bundles(block, letters).astype(np.float64).sum(axis=0)
        for lang, v in total.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(DIMENSION), "value": v})

    # Sums of whole numbers: the order of adding does not matter.
    summed = train.mapInPandas(bundle, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("v")).orderBy("lang").collect()
    kept = [(r["lang"], np.array(r["v"])) for r in rows if any(r["v"])]
    return Profiles(letters, tuple(x for x, _ in kept), b"".join((v / np.linalg.norm(v)).astype(np.float32).tobytes() for _, v in kept))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> tuple:
    """Column of (lang_pred, score): the language of greatest cosine and that cosine, at least 0.

    ``und`` with score 0 for null, empty and letterless texts, and when no
    language was learned. Among equals the first language in order wins.
    """

    @F.pandas_udf("lang_pred string, score double")
    def best(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        known = profiles.matrix()
        for s in series:
            rows = []
            for block in _blocks(s):
                v = bundles(block, profiles.letters)
                size = np.linalg.norm(v, axis=1)
                cosine = (v @ known.T) / np.where(size, size, 1)[:, None] if len(known) else np.zeros((len(v), 1))
                at = cosine.argmax(axis=1)
                for i, n in enumerate(size):
                    ok = n and len(known)
                    rows.append((profiles.languages[at[i]] if ok else UNKNOWN, float(min(max(cosine[i, at[i]], 0.0), 1.0)) if ok else 0.0))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return best(text)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def shuffled(text: str) -> str:
    """``text`` with its letters in another order, the same one each time."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    at = np.flatnonzero(_is_letter()[points])
    points[at] = points[at][np.random.default_rng([SEED, len(points), len(at)]).permutation(len(at))]
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def bounds(docs: DataFrame, profiles: Profiles) -> list[tuple[int, float]]:
    """(length, least cosine) by length: short texts of a language score low, long junk scores high.

    Learned from beginnings of all labelled documents and the same with
    shuffled letters. The driver gets one row for each length.
    """
    part = fold("doc_id", FOLDS)
    known = docs.where((part >= 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    beginnings = known.select(F.substring("text", 1, LENGTHS[-1]).alias("text"))

    def score(batches):
        forget()
        for pdf in batches:
            pairs = [(n, x[:n]) for x in pdf["text"] for n in LENGTHS if len(x) >= n and any(c.isalpha() for c in x[:n])]
            out = {"length": [n for n, _ in pairs]}
            for name, texts in (("clean", [x for _, x in pairs]), ("junk", [shuffled(x.lower()) for _, x in pairs])):
                found = [np.zeros(0)]
                # Beginnings of one text have most trigrams in common, so a few texts fill a block.
                for block in _blocks(texts, 8 * len(LENGTHS) if name == "clean" else BLOCK_DOCS):
                    v = bundles(block, profiles.letters)
                    size = np.linalg.norm(v, axis=1)
                    found.append(((v @ profiles.matrix().T) / np.where(size, size, 1)[:, None]).max(axis=1))
                out[name] = np.concatenate(found).astype(float)
            yield pd.DataFrame(out)

    if not profiles.languages:
        return []
    # Cosines lie in 32 bits, so that is all that is kept of them.
    rows = materialize(beginnings.mapInPandas(score, "length int, clean double, junk double").select("length", F.col("clean").cast("float").alias("clean"), F.col("junk").cast("float").alias("junk")))
    rows = rows.select("length", F.col("clean").cast("double").alias("clean"), F.col("junk").cast("double").alias("junk"))
    if rows.isEmpty():
        return []
    marks = exact_percentiles(rows, ["length"], "clean", {"clean": CLEAN_QUANTILE}).join(exact_percentiles(rows, ["length"], "junk", {"junk": JUNK_QUANTILE}), "length")
    rows = rows.groupBy("length").agg(F.count("*").alias("n")).join(marks, "length")
    return sorted((r["length"], max(0.0, min(r["junk"], CLEAN_PART * r["clean"]))) for r in rows.collect() if r["n"] >= LEAST_DOCS)


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Every row is kept, repeated ones too; a null ``doc_id`` is not held out and
    is not learned from. Columns other than ``doc_id``, ``text`` and ``lang``
    are ignored, ``lang`` is only a label to learn.
    """
    profiles = fit(docs)
    return docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), predict(docs, profiles).alias("p")).select("doc_id", "held_out", "p.*")
