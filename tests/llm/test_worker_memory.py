import pytest
from pyspark.sql import functions as F

from eraloom.llm import langid, packing, toxicity
from eraloom.llm.common import tokenizer_path


@pytest.mark.parametrize("stage", ["toxicity", "language"])
def test_later_stages_give_back_what_packing_keeps_in_a_worker(spark, monkeypatch, stage):
    """Spark hands Python workers from stage to stage."""
    made = []

    def plain(kind):
        def keep(function):
            made.append(function)
            return lambda *columns: F.lit(None)

        return keep

    docs = spark.createDataFrame([(1, "some words of a text", "en")], "doc_id long, text string, lang string")
    profiles = langid.fit(docs)
    monkeypatch.setattr(F, "pandas_udf", plain)
    toxicity.feature_column({}) if stage == "toxicity" else langid.predict(docs, profiles)
    packing._encoder(tokenizer_path())
    assert packing._encoder.cache_info().currsize == 1
    import pandas as pd

    list(made[0](iter([pd.Series(["some words"])])))
    assert packing._encoder.cache_info().currsize == 0
