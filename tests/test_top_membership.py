"""Top groups before and after: pairs are not sent through the driver again and again."""

from pyspark.sql import functions as F

from eraloom.operators import robustness


def test_pairs_are_made_once_and_not_broadcast(spark, monkeypatch):
    risk = lambda f: (F.pmod(F.xxhash64("id", f), F.lit(1000)) / 1000.0)
    pred = spark.range(400).select(F.col("id").alias("row_id"), F.explode(F.array(F.lit(0.0), F.lit(0.5))).alias("f"), "id").select(
        F.lit("t").alias("task"), F.lit("v").alias("compression_version"), F.col("f").alias("requested_copy_fraction"), "row_id",
        F.col("row_id").alias("subject_id"), F.lit(1).alias("y_true"), risk("f").alias("risk_calibrated"),
    )
    made = []
    paired = robustness.paired_with_zero
    monkeypatch.setattr(robustness, "paired_with_zero", lambda p: made.append(paired(p)) or made[-1])
    out = robustness.top_membership(pred)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert "requested_copy_fraction = 0" not in out._jdf.queryExecution().optimizedPlan().toString()
    n = {r["top10_status"]: r["count"] for r in out.filter("requested_copy_fraction = 0.5").groupBy("top10_status").count().collect()}
    assert n.get("retained", 0) + n["exited"] == 40 == n.get("retained", 0) + n["entered"] and sum(n.values()) == 400
    assert out.filter("requested_copy_fraction = 0 and top10_status in ('entered', 'exited')").isEmpty()
