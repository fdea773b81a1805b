import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F


def test_stages_hand_python_few_documents_at_a_time(spark, tmp_path, monkeypatch):
    spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def stage(spark, docs, sf_dir):
        def sizes(batches):
            for batch in batches:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n] * n, pa.int64())], ["doc_id", "text", "rows"])

        return docs.mapInArrow(sizes, "doc_id long, text string, rows long")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", stage)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() == 3000 and rows.agg(F.max("rows")).first()[0] <= corpus_pipeline.BATCH_DOCS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_scoring_leaves_the_collector_of_a_reused_worker_on(spark):
    from eraloom.llm import toxicity

    def on(batches):
        import gc

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()] * batch.num_rows)], ["on"])

    docs = spark.range(8).select(F.lit("some text").alias("text")).repartition(8)
    docs.select(toxicity.feature_column({"text": 3.0})).collect()
    assert all(r["on"] for r in docs.mapInArrow(on, "on boolean").collect())
