import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from eraloom.llm import bpe, packing
from eraloom.llm.common import tokenizer_path


def test_remembered_pieces_are_byte_strings_and_shared():
    """A worker remembers several hundred thousand pieces and words at once."""
    path = tokenizer_path()
    enc = packing._encoder.__wrapped__(path)
    pieces = ["Hello", "world,", "naïve", "x" * 40, "don't", "hello", "😀a", "<|endoftext|>"]
    enc.learn(set(pieces))
    assert [enc.memo[p] for p in pieces] == [np.array(ids, dtype="<u4").tobytes() for ids in bpe.piece_ids(path)(pieces)]
    merged = next(c.cell_contents for c in enc.ids_of.__closure__ if isinstance(c.cell_contents, dict))
    assert all(isinstance(v, bytes) for v in merged.values())
    assert enc.memo["hello"] is merged["hello"]


def test_packing_hands_python_few_documents_at_a_time(spark, monkeypatch):
    """Also where a caller writes the stage's result without setting anything."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).coalesce(1)

    def pieces(docs, path, capacity):
        def sizes(batches):
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array([1] * n, pa.int64()), pa.array([n] * n, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return docs.select("doc_id").mapInArrow(sizes, "doc_id long, piece int, start long, length long, ids_crc32 long")

    monkeypatch.setattr(packing, "token_pieces", pieces)
    out = packing.pack_documents(docs, "")
    assert out.count() == 3000 and out.agg(F.max("ids_crc32")).first()[0] <= packing.BATCH_DOCS


def test_stages_with_python_hand_it_few_documents_at_a_time(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from eraloom.llm import toxicity

    spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    class Sizes:
        def score(self, df: DataFrame, keep, out):
            def sizes(batches):
                for batch in batches:
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([n] * n, pa.int64()), batch.column(1), pa.array([0.0] * n)], [*keep, out])

            return df.mapInArrow(sizes, f"doc_id long, text string, {out} double")

    monkeypatch.setattr(toxicity, "fit", lambda *a: Sizes())
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.count() == 3000 and out.agg(F.max("doc_id")).first()[0] <= corpus_pipeline.BATCH_DOCS
