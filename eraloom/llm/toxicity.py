"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

The features are lexicon densities, nearness of lexicon words to the second
person, capitals, punctuation and obfuscation. The lexicon is learned too:
words and word beginnings that labelled toxic documents have far more often
than others. Lexicon, trees and calibration each learn from their own part of
the labelled documents, so none is fooled by what another has memorised.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from eraloom.llm.common import collector_off, fold, forget
from eraloom.session import broadcast_checked, materialize

FOLDS, HELD_OUT = 5, 0
# Percentages of the labelled documents for lexicon, trees and calibration.
PARTS = (60, 25, 15)
# Documents that a task grows the trees on, and terms that a task counts before it hands them on.
TRAIN_ROWS, COUNTED_TERMS = 100_000, 200_000
# A term needs this many toxic documents and this likelihood ratio (twice the gain in log likelihood).
LEAST_DOCS, LEAST_RATIO = 3, 18.0
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)
FEATURES = (
    "strongest", "hits", "hit_share", "weight_share", "distinct_hits", "near_you", "you_share", "hidden_hits",
    "capital_share", "shouted_share", "bang_share", "punctuation_share", "obfuscated_share", "stretched_share", "log_words",
)
MEMO_WORDS = 100_000
THRESHOLD = 0.5

# Second-person forms of the languages at hand.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre tú ti usted vos su".split())
# Signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "|": "i"})

_word = re.compile(r"[^\W\d_]+")
_mixed = re.compile(r"\S*[^\W\d_][0-9@$*!|]+[^\W\d_]\S*")
_shout = re.compile(r"\b[A-Z]{3,}\b")
_capitals = bytes(range(65, 91))
_points = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) >= k)]


class Lexicon:
    """Weights of words: that of their strongest term."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: set[str] = set()
        self.found: dict[str, float] = {}

    def hits(self, words: set[str]) -> set[str]:
        """Those of ``words`` that have a weight."""
        if len(self.known) > MEMO_WORDS:
            self.known, self.found = set(), {}
        new = words - self.known
        get = self.weights.get
        for w in new:
            best = max(get(t, 0.0) for t in terms_of(w))
            if best:
                self.found[w] = best
        self.known |= new
        return words & self.found.keys()


def features(text: str | None, lexicon: Lexicon) -> tuple[float, ...]:
    """The values of FEATURES for a whole text; all 0 for null and empty texts."""
    if not text:
        return (0.0,) * len(FEATURES)
    words = _word.findall(text.lower())
    n = max(len(words), 1)
    distinct = set(words)
    bad = lexicon.hits(distinct)
    strongest = hits = weight = near = 0.0
    if bad:
        at = [i for i, w in enumerate(words) if w in bad]
        strongest, hits, weight = max(lexicon.found[w] for w in bad), float(len(at)), sum(lexicon.found[words[i]] for i in at)
        you = np.array([i for i, w in enumerate(words) if w in YOU])
        if len(you):
            near = float((1 / np.array([np.abs(you - i).min() for i in at])).sum()) if not any(words[i] in YOU for i in at) else 1.0
    mixed = _mixed.findall(text)
    hidden = 0
    if mixed:
        cleared = {w for m in mixed for w in _word.findall(m.lower().translate(SIGNS))}
        hidden = len(lexicon.hits(cleared))
    data = text.encode("utf-8", "surrogatepass")
    size = len(data)
    b = np.frombuffer(data, dtype=np.uint8)
    letters = (b[2:] > 64) & (b[2:] < 128)
    return (
        strongest, math.log1p(hits), hits / n, weight / n, float(len(bad)), near, sum(map(words.count, distinct & YOU)) / n, float(hidden),
        (size - len(data.translate(None, _capitals))) / size, len(_shout.findall(text)) / n, (data.count(b"!") + data.count(b"?")) / size,
        (size - len(data.translate(None, _points))) / size, len(mixed) / n,
        float(((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & letters).sum()) / n, math.log1p(len(words)),
    )


def feature_column(weights: dict[str, float], text: str = "text") -> Column:
    @F.pandas_udf("array<double>")
    def of(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        with collector_off():  # many small objects and no cycles
            lexicon = Lexicon(weights)
            for s in series:
                yield pd.Series([features(t, lexicon) for t in s], dtype=object)
                gc.collect()

    return of(text)


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Log odds of the terms that tell toxic documents (``label`` 1) from others, from ``text`` and ``label``.

    A term counts once for each document. Terms of too few toxic documents
    cannot pass, so the others are counted first, and of the clean documents
    only these terms travel. The driver gets the terms that pass.
    """
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}

    def count(batches):
        forget()
        seen: Counter = Counter()
        full = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update({t for w in set(_word.findall((text or "").lower())) for t in terms_of(w)})
                if len(seen) >= COUNTED_TERMS:
                    yield full()
                    seen.clear()
        yield full()

    def counts(label: int) -> DataFrame:
        return train.where(F.col("label") == label).select("text").mapInArrow(count, "term string, n long")

    often = materialize(counts(1).groupBy("term").agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST_DOCS))
    others = counts(0).join(broadcast_checked(often.select("term")), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("b"))
    counted = often.join(others, "term", "left").select("term", "a", F.coalesce("b", F.lit(0)).alias("b"))
    x = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    a, b, all_ = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    gain = (
        x(a, F.lit(toxic)) + x(toxic - a, F.lit(toxic)) + x(b, F.lit(clean)) + x(clean - b, F.lit(clean))
        - x(all_, F.lit(toxic + clean)) - x(toxic + clean - all_, F.lit(toxic + clean))
    )
    weight = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    passed = counted.where(a / toxic > b / clean).withColumn("ratio", 2 * gain).where(F.col("ratio") >= LEAST_RATIO)
    return {r["term"]: r["w"] for r in passed.select("term", weight.alias("w")).where("w >= 2").collect()}


class Model:
    """Lexicon, trees and calibration; without both labels to learn from, the share of toxic labels."""

    def __init__(self, weights: dict[str, float], trees: GBTClassificationModel | None, scale: IsotonicRegressionModel | None, share: float):
        self.weights, self.trees, self.scale, self.share = weights, trees, scale, share

    def score(self, df: DataFrame, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
        """Columns ``keep`` of ``df`` and the score as ``out``."""
        if self.trees is None:
            return df.select(*keep, F.lit(self.share).alias(out))
        own = [f"_tox_{i}" for i in range(len(keep))]  # names of the model's columns never clash with the caller's
        rows = df.select(*[F.col(c).alias(o) for c, o in zip(keep, own)], array_to_vector(feature_column(self.weights, text)).alias("features"))
        rows = self.trees.transform(rows).withColumn("margin", vector_to_array("probability")[1])
        if self.scale is not None:
            rows = self.scale.transform(rows)
        result = F.col("calibrated" if self.scale is not None else "margin")
        return rows.select(*[F.col(o).alias(c) for c, o in zip(keep, own)], F.least(F.greatest(result, F.lit(0.0)), F.lit(1.0)).alias(out))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled documents that are not held out.

    A document that is labelled more than once counts as toxic if any label
    says so. Null labels and ids are left out.
    """
    part = fold("doc_id", FOLDS)
    known = labels.where((part >= 0) & (part != HELD_OUT) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    # Read by both branches below.
    known = materialize(known.withColumn("slot", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(100)).cast("int")))
    first, second = PARTS[0], PARTS[0] + PARTS[1]

    def train(slots: Column) -> DataFrame:
        # Few labels go to the documents; with many, the texts that are read here move once.
        return docs.select("doc_id", "text").join(broadcast_checked(known.where(slots)), "doc_id").select("text", "label", "slot")

    weights = learn_lexicon(train(F.col("slot") < first))
    rest = materialize(train(F.col("slot") >= first).select("label", "slot", feature_column(weights).alias("values"))).select("label", "slot", array_to_vector("values").alias("features"))
    sizes = {(r["p"], r["label"]): r["n"] for r in rest.groupBy((F.col("slot") < second).alias("p"), "label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sum(n for (_, label), n in sizes.items() if label == 1) / total if total else 0.0
    if not (sizes.get((True, 1)) and sizes.get((True, 0))):
        return Model(weights, None, None, share)
    grown = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, subsamplingRate=1.0, seed=5)
    parts = -(-(sizes[True, 1] + sizes[True, 0]) // TRAIN_ROWS)
    trees = grown.fit(rest.where(F.col("slot") < second).coalesce(parts))
    scale = None
    if sizes.get((False, 1)) and sizes.get((False, 0)):
        held = trees.transform(rest.where(F.col("slot") >= second)).select("label", vector_to_array("probability")[1].alias("margin"))
        # Margins are sums of a few leaves, so many documents share one.
        held = held.groupBy("label", "margin").agg(F.count("*").cast("double").alias("weight"))
        scale = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(held)
    return Model(weights, trees, scale, share)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Every row is kept, repeated ones too; null and empty texts are scored by
    their features, all 0. A null ``doc_id`` is not held out and not learned
    from. Other columns are ignored.
    """
    scored = fit(docs, labels).score(docs, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
