"""Writers of tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, codec: str = "zstd", partition_by: Sequence[str] = ()) -> None:
    """Parquet table; ``lz4`` suits intermediates and ``zstd`` final outputs."""
    writer = df.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_examples(df: DataFrame, root: str) -> None:
    """Examples in task and version folders that readers can prune."""
    write_table(df, root, "zstd", ["task", "version"])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV report; Spark keeps it in as many files as the data needs."""
    df.write.mode("overwrite").option("header", True).csv(path)
