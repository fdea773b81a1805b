"""Readers of the file layouts users already have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from eraloom.functions.scalar import normalize_label
from eraloom.operators.splits import core_rows
from eraloom.schemas import (
    EPISODE_KEY, EVENT_REQUIRED, LABEL_CANDIDATES, PERTURBED_REQUIRED, DataContractError, require_columns, require_none, require_unique,
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), EVENT_REQUIRED, "events")


def split_column(df: DataFrame) -> str:
    if "split" in df.columns:
        return "split"
    found = [c for c in df.columns if "split" in c.lower()]
    if len(found) != 1:
        raise DataContractError(f"no single split column in {df.columns}")
    return found[0]


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    rows = df.select(F.col("subject_id").cast("long").alias("subject_id"), F.col(split_column(df)).cast("string").alias("split"))
    return require_unique(rows, ["subject_id"], "subject splits")


def label_column(df: DataFrame) -> str:
    """First candidate column that holds a value, found in one aggregation."""
    have = [c for c in LABEL_CANDIDATES if c in df.columns]
    if not have:
        raise DataContractError(f"no label column in {df.columns}")
    counts = df.agg(*[F.count(c).alias(c) for c in have]).first()
    filled = [c for c in have if counts[c]]
    if not filled:
        raise DataContractError("every label column is empty")
    return filled[0]


def attach(df: DataFrame, dim: DataFrame, key: str, column: str, check: bool = True) -> DataFrame:
    """Left join of a dimension column that must match every row."""
    out = df.join(dim.select(key, column), key, "left")
    return require_none(out, F.col(column).isNull(), f"rows without {column}") if check else out


def read_labels(spark: SparkSession, path: str, splits: DataFrame, task: str, row_id: str = "row_id") -> DataFrame:
    """Episodes of a task with 0/1 labels and splits.

    Files have no stable row order in a cluster, so the table brings its own
    unique ``row_id`` column.
    """
    df = require_columns(spark.read.parquet(path), [row_id, "subject_id", "prediction_time"], "labels")
    rows = df.select(
        F.lit(task).alias("task"), F.col(row_id).cast("long").alias("row_id"), F.col("subject_id").cast("long").alias("subject_id"),
        "prediction_time", normalize_label(label_column(df)).alias("label"),
    )
    return attach(rows, splits, "subject_id", "split").select(*EPISODE_KEY)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), ["code"], "codes").dropDuplicates(["code"])


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct codes of a CSV list, as text; an empty list is an error."""
    codes = spark.read.option("header", True).csv(path).select(F.col("code").cast("string")).dropna().distinct()
    if not codes.limit(1).count():
        raise DataContractError("the code list is empty")
    return codes


def read_prediction_runs(spark: SparkSession, root: str, run_tags: Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV runs below ``root`` with the run tag and the file they came from."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    out = None
    for tag in run_tags:
        run = reader.csv(f"{root.rstrip('/')}/{tag}").select("*", F.lit(tag).alias("source_run_tag"), F.col("_metadata.file_path").alias("source_file"))
        out = run if out is None else out.unionByName(run, allowMissingColumns=True)
    return out


def read_perturbed_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = require_columns(reader.format(fmt).load(path), PERTURBED_REQUIRED, "perturbed predictions")
    kinds = {"requested_copy_fraction": "double", "row_id": "long", "subject_id": "long", "y_true": "int", "risk_calibrated": "double"}
    df = df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])
    return require_unique(df, ["task", "compression_version", "requested_copy_fraction", "row_id"], "perturbed predictions")


# Names used by older example files.
OLD_EXAMPLE_NAMES = {"example_id": "row_id", "y_true": "label", "compression_version": "version"}


def read_examples(spark: SparkSession, root: str, task: str, version: str) -> DataFrame:
    """Examples of one task and version; the partition filter prunes folders."""
    df = spark.read.parquet(root).filter((F.col("task") == task) & (F.col("version") == version))
    renames = {old: new for old, new in OLD_EXAMPLE_NAMES.items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(renames)


def read_tabular_sources(spark: SparkSession, folder: str, tasks: Sequence[str]) -> DataFrame:
    """Audit rows of cached feature tables; task and cutoff rule come from the file name."""
    df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(folder)
    files = df.withColumn("__parts", F.split(F.col("_metadata.file_path"), "/"))
    # A table may be one file or a folder of part files.
    named = F.filter("__parts", lambda p: p.endswith(".parquet") & ~p.startswith("part-"))
    rows = files.withColumn("__file", F.element_at(named, -1))
    task = F.coalesce(*[F.when(F.col("__file").startswith(f"{t}_"), t) for t in sorted(tasks, key=len, reverse=True)])
    strict = F.col("__file").contains("_lt_prediction_time_")
    version = F.when(strict, "tabular_lt_prediction_time").otherwise("tabular_leq_prediction_time")
    rule = F.when(strict, "event_time < prediction_time").otherwise("event_time <= prediction_time")
    rows = rows.withColumn("__task", task).filter("__task is not null")
    return core_rows(
        rows, "tabular", F.concat_ws("__", F.lit("tabular"), F.col("__task"), version), F.col("__task"), version, rule, F.col("__file")
    )


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary as a (code, token_id) table or as one JSON object per line."""
    if path.endswith(".json"):
        text = spark.read.option("wholetext", True).text(path)
        pairs = F.explode(F.from_json("value", "map<string,int>")).alias("code", "token_id")
        return text.select(pairs)
    return require_columns(spark.read.parquet(path), ["code", "token_id"], "vocabulary")
