"""Evidence table sinks: raw tables are appended to, derived ones replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_raw(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("project_id").parquet(path)


def replace_derived(df: DataFrame, path: str) -> None:
    """Replace only the projects present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch; a replayed batch replaces its own files."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
