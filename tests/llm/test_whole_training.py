"""Models learn from all labelled documents, however many there are, and pivots travel once for each part."""

import numpy as np
from pyspark.sql import functions as F

from eraloom.llm import ann, langid, pii, toxicity

N = 21_000


def test_personal_data_is_learned_from_all_documents(spark, monkeypatch):
    docs = spark.range(N).select(F.col("id").alias("doc_id"), F.concat(F.lit("host 10.0.0."), F.col("id") % 400, F.lit(" or 555 123-4567")).alias("text"))
    written = []
    monkeypatch.setattr(pii, "materialize", lambda df: written.append(df) or df)
    assert pii.fit(docs) is not None
    assert written[0].count() == N
    kinds = {r["kind"]: r["n"] for r in written[1].groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    assert kinds[1] == N and kinds[3] == N and written[1].count() < 100


def test_toxicity_is_learned_from_all_labels(spark, monkeypatch):
    docs = spark.range(N * 2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "you grolken fool").otherwise("you green river").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    seen = []
    learn = toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda train: seen.append(train.count()) or learn(train))
    model = toxicity.fit(docs, labels)
    part = toxicity.fold("doc_id", toxicity.FOLDS)
    known = docs.where(part != toxicity.HELD_OUT).count()
    assert known > 30_000 and abs(seen[0] - 0.6 * known) < 0.02 * known
    got = {r["text"]: r["s"] for r in model.score(docs.limit(8), ["text"]).groupBy("text").agg(F.max("score").alias("s")).collect()}
    assert got["you grolken fool"] > 0.9 and got["you green river"] < 0.1


def test_terms_are_counted_alike_in_small_portions(spark, monkeypatch):
    rows = [(f"word{'abcdefg'[i % 7]} some{'abcdefghijk'[i % 11]}", int(i % 7 < 2)) for i in range(400)]
    train = spark.createDataFrame(rows, "text string, label int").repartition(3)
    want = toxicity.learn_lexicon(train)
    monkeypatch.setattr(toxicity, "COUNTED_TERMS", 5)
    got = toxicity.learn_lexicon(train)
    assert want and got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-12 for t in want)


def test_languages_are_learned_from_all_documents(spark, monkeypatch):
    docs = spark.range(N * 2).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "abab").otherwise("cdcd").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("lang"))
    # One letter that only one document has.
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 40_001, "cdcdz").otherwise(F.col("text")))
    fold = docs.where("doc_id = 40001").select(langid.fold("doc_id", langid.FOLDS)).first()[0]
    assert fold != langid.HELD_OUT
    profiles = langid.fit(docs)
    assert profiles.letters == "abcdz" and profiles.languages == ("x", "y")
    seen = []
    percentiles = langid.exact_percentiles
    monkeypatch.setattr(langid, "exact_percentiles", lambda df, *a: seen.append(df.where("length = 4").count()) or percentiles(df, *a))
    bounds = dict(langid.bounds(docs, profiles))
    assert seen == [2 * N, 2 * N] and set(bounds) == {2, 4}


def test_pivots_do_not_travel_with_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 + i % 2).tolist()) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann.search(vectors, every=5).collect()))
    monkeypatch.setattr(ann, "PART_VECTORS", 30)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    found = ann.search(vectors, every=5)
    assert sorted(map(tuple, found.collect())) == whole
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
