"""Present the benchmark tables in the shapes the operators take.

Orders become visits, line items become diagnoses and measurements, every order
becomes a prediction episode, and scores are a fixed function of order, seed,
version and copy fraction. Everything is derived row by row: no window, no
generated table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eraloom.functions.scalar import sigmoid

# Fixed values of the score adapter.
VERSIONS = [("raw_64", 0), ("condition_era_90_backfill_64", 1)]
SEEDS = [42, 43, 44, 45, 46]
FRACTIONS = [0.0, 0.25, 0.5, 1.0]
TASK = "order_f"
CODE_LIST = ["DX/ECONOMY", "DX/PROMO", "DX/STANDARD"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subject_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("subject_id"), split_of(k).alias("split")
    )


def split_of(key: Column) -> Column:
    return F.when(key % 10 < 7, "train").when(key % 10 == 7, "tuning").otherwise("held_out")


def event_id(*parts: Column) -> Column:
    """A 52-bit id from the source row, below the range kept for copied rows."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def clinical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, parts = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    o, null = F.col, F.lit(None)

    def shaped(time: Column, code: Column, number: Column, text: Column, kind: str, ident: Column) -> list[Column]:
        return [
            time.alias("time"), code.alias("code"), F.lit(kind).alias("omop_table"),
            number.cast("float").alias("numeric_value"), text.cast("string").alias("text_value"), ident.alias("source_event_id"),
        ]

    sold = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    cents = F.round(o("l_extendedprice") * 100).cast("long")
    line = [o("l_partkey"), o("l_suppkey"), cents]
    subject = o("o_custkey").alias("subject_id")
    visits = shaped(o("o_orderdate"), F.concat(F.lit("Visit/"), o("o_orderpriority")), null, null,
                    "visit_occurrence", event_id(o("o_orderkey"), F.lit("v")))
    later = F.expr("timestampadd(MINUTE, 299 * l_linenumber, o_orderdate)")
    diagnosis = shaped(later, F.concat(F.lit("DX/"), o("p_type")), null, o("l_returnflag"),
                       "condition_occurrence", event_id(o("l_orderkey"), F.lit("d"), o("l_linenumber"), *line))
    lab = shaped(o("l_shipdate"), F.concat(F.lit("LAB/"), o("p_brand")), o("l_quantity"), o("l_linestatus"),
                 "measurement", event_id(o("l_orderkey"), F.lit("m"), o("l_linenumber"), *line))
    # A line is joined once and gives both of its events.
    both = sold.select(subject, F.explode(F.array(F.struct(*diagnosis), F.struct(*lab))).alias("e")).select("subject_id", "e.*")
    return orders.select(subject, *visits).unionByName(both)


def episode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.lit(TASK).alias("task"), F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("prediction_time"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        split_of(F.col("o_custkey")).alias("split"),
    )


def code_list(spark: SparkSession, codes: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(c,) for c in codes or CODE_LIST], "code string")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-day event table, read as a batch; ``view`` plays the visit."""
    kind = F.col("event_type")
    visit = kind == "view"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"), F.col("ts").alias("time"),
        F.when(visit, F.concat(F.lit("Visit/"), kind)).otherwise(kind).alias("code"),
        F.when(visit, "visit_occurrence").otherwise("condition_occurrence").alias("omop_table"),
        F.col("value").cast("float").alias("numeric_value"), F.col("props").alias("text_value"),
        F.col("event_id").alias("source_event_id"),
    )


def scores(spark: SparkSession, sf_dir: str, fractions: list[float] | None = None) -> DataFrame:
    """Wide predictions per version, seed and copy fraction (40 rows per order)."""
    grid = F.array(*[
        F.struct(F.lit(v).alias("version"), F.lit(i).alias("vid"), F.lit(s).alias("seed"), F.lit(f).alias("fraction"))
        for v, i in VERSIONS for s in SEEDS for f in (fractions or FRACTIONS)
    ])
    key, y = F.col("row_id"), F.col("y_true")
    base = episode_labels(spark, sf_dir).withColumnRenamed("label", "y_true").select("*", F.explode(grid).alias("g"))
    vid = F.col("g.vid")
    mixed = (key * 7919 + F.col("g.seed") * 104729 + vid * 1299709) % 1000
    logit = (
        F.lit(-0.7) + F.lit(0.6) * y + (mixed.cast("double") / F.lit(500.0) - F.lit(1.0))
        + F.col("g.fraction") * F.lit(0.05) * (vid + 1).cast("double") * ((key % 7) - 3).cast("double")
    )
    return base.select(
        "task", F.lit("sequence").alias("representation"), F.col("g.version").alias("compression_version"),
        F.lit(64).alias("max_len"), F.when(vid == 1, 90).alias("era_gap"), F.lit("scorer").alias("model"),
        F.lit("numeric_sequence").alias("model_family"), F.lit(True).alias("numeric_on"),
        F.col("g.seed").alias("seed"), F.col("g.fraction").alias("requested_copy_fraction"), "split", "row_id",
        "subject_id", "prediction_time", "y_true", F.round(logit, 6).alias("logit"),
    ).withColumn("risk_raw", sigmoid("logit")).withColumn(
        "risk_calibrated", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(0.9) * F.col("logit") - F.lit(0.1))))
    )


def audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label reference plus five copies, each with one planted fault."""
    labels = episode_labels(spark, sf_dir)
    row, split, subject = F.col("row_id"), F.col("split"), F.col("subject_id")

    def source(kind: str, name: str, rows: DataFrame, split=split, subject=subject, time: bool = True) -> DataFrame:
        stamp = F.date_format("prediction_time", "yyyy-MM-dd HH:mm:ss") if time else F.lit(None)
        return rows.select(
            F.lit(kind).alias("source_type"), F.lit(name).alias("source_name"), "task", F.lit("v1").alias("version"),
            F.lit("event_time <= prediction_time").alias("time_rule"), "row_id", subject.alias("subject_id"),
            stamp.cast("string").alias("prediction_time"), "label", split.alias("split"), F.lit(f"/{name}").alias("path"),
        )

    copies = [
        source("label_reference", "labels", labels),
        source("sequence", "moved", labels, split=F.when((subject % 100 == 3) & (row % 2 == 0), "held_out").otherwise(split)),
        source("sequence", "repeated", labels).unionByName(source("sequence", "repeated", labels.filter(row % 200 == 7))),
        source("sequence", "missing", labels.filter(row % 100 != 5), time=False),
        source("tabular", "odd_split", labels, split=F.when(row % 500 == 9, "valid").otherwise(split)),
        source("tabular", "no_subject", labels, subject=F.when(row % 400 != 11, subject)),
    ]
    out = copies[0]
    for c in copies[1:]:
        out = out.unionByName(c)
    return out
