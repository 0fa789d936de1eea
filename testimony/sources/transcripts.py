"""Readers for transcript lines, in batch and as a stream of finished turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from testimony.functions.text import digest

TRANSCRIPT = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


def _shaped(raw: DataFrame, project_id: str | None) -> DataFrame:
    """Project and session come from the path ``.../<project>/<session>.jsonl``."""
    path = F.col("_metadata.file_path")
    parts = F.split(path, "/")
    session = F.regexp_replace(F.element_at(parts, -1), "[.][^.]*$", "")
    project = F.lit(project_id) if project_id else F.element_at(parts, -2)
    return raw.select(
        project.alias("project_id"),
        session.alias("session_id"),
        F.to_timestamp("timestamp").alias("ts"),
        "role",
        "name",
        "content",
        F.col("_corrupt_record").alias("corrupt_record"),
    )


def _schema() -> T.StructType:
    return T.StructType([*TRANSCRIPT.fields, T.StructField("_corrupt_record", T.StringType())])


def read_transcripts(spark: SparkSession, paths: str | Sequence[str], project_id: str | None = None) -> DataFrame:
    """Transcript lines from explicit paths; unreadable lines keep their text."""
    return _shaped(spark.read.schema(_schema()).option("mode", "PERMISSIVE").json(paths), project_id)


def read_transcript_stream(spark: SparkSession, path: str, project_id: str | None = None, max_files: int = 1000) -> DataFrame:
    stream = spark.readStream.schema(_schema()).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", max_files).json(path)
    return _shaped(stream, project_id)


def backfill(spark: SparkSession, paths: Sequence[str], project_id: str | None = None) -> DataFrame:
    """Old transcripts named one by one by the caller; never a directory search."""
    if isinstance(paths, str) or not paths:
        raise ValueError("backfill takes an explicit list of transcript files")
    return read_transcripts(spark, list(paths), project_id)


def with_record_ids(lines: DataFrame) -> DataFrame:
    """Content-derived record ids, so that reading a line twice gives one record."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("project_id", "session_id", "role", "name", "content")]
    return lines.withColumn("record_id", digest(*parts, F.coalesce(stamp, F.lit(""))))
