"""The pipeline's stages on small documents, each against what it must keep."""

import random

import pytest

import corpus_pipeline as pipeline
from eraloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(500):
        ws = [rng.choice(["stone", "river", "light", "green", "water"]) + rng.choice("abcdefgh") for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            ws[rng.randrange(40)], ws[rng.randrange(40)] = "grolken", "snarfy"
        rows.append((i, " ".join(ws), "en", "s", 1, 0.1, True))
        labels.append((i, 1, int(bad)))
    copy = next(r for r in rows if r[0] % 5)
    rows += [(600, copy[1], "en", "s", 1, 0.1, True), (601, "12 34", "en", "s", 1, 0.1, True), (602, None, None, "s", 1, 0.1, True), (603, "", "en", "s", 1, 0.1, True)]
    rows += [(604, "write to someone@mail.example.com about the green river and the stone", "en", "s", 1, 0.1, True)] * 2
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows


def test_stages_and_run(spark, made):
    where, rows = made
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language", "near-dedup", "pii", "packing"]
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, where)
        if name != "packing":
            assert out.columns == docs.columns, name
        docs = pipeline.materialize(out)
        seen[name] = docs.collect()
    ids = lambda name: [r["doc_id"] for r in seen[name]]
    clean = {i for i in range(500) if i % 5}
    assert clean | {600, 601, 602, 603, 604} <= set(ids("toxicity")) and len(set(ids("toxicity")) - clean - {600, 601, 602, 603, 604}) <= 3
    assert not {601, 602, 603} & set(ids("language")) and clean <= set(ids("language"))
    assert 600 not in ids("near-dedup") and ids("near-dedup").count(604) == 1 and clean <= set(ids("near-dedup"))
    text = {r["doc_id"]: r["text"] for r in seen["pii"]}
    assert text[604] == "write to <EMAIL> about the green river and the stone" and sorted(text) == sorted(ids("near-dedup"))
    assert sorted(set(ids("packing"))) == sorted(text)
    assert sorted(r["doc_id"] for r in pipeline.run(spark, where).collect()) == sorted(ids("packing"))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())


def test_text_of_no_learned_language_goes(spark):
    rng, rows = random.Random(5), []
    words = {g: ["".join(rng.choice(x) + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(60)] for g, x in (("aa", "bdfgklm"), ("bb", "nprstvw"))}
    for i in range(600):
        g = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choice(words[g]) for _ in range(rng.randrange(10, 80))), g))
    short = [(1000 + i, " ".join(rng.choice(words["aa"]) for _ in range(4)), None) for i in range(20)]
    junk = [(2000 + i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40)), None) for i in range(40) for letters in ["bcdfghjklmnpqrstvwxyzaeiou" if i % 2 else "абвгдежзиклмнопрст"]]
    docs = spark.createDataFrame([(i, x, g, "s", len(x), 0.5, True) for i, x, g in rows + short + junk], DOCS)
    kept = {r["doc_id"] for r in pipeline.keep_languages(spark, docs, "").collect()}
    assert {i for i, _, _ in rows + short} <= kept and not kept & {i for i, _, _ in junk}
