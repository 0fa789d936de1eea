"""Micro-batch ingest of finished turns and once-only delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from testimony.operators.normalize import dedup_records
from testimony.sources.sinks import write_batch
from testimony.sources.transcripts import with_record_ids

RECORDS = "project_id string, session_id string, ts timestamp, role string, name string, content string, corrupt_record string, record_id string, batch_id bigint"


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """All ingested records; an empty store is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], RECORDS)
    return spark.read.schema(RECORDS).parquet(path)


def ingest_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """New records of one micro-batch.

    A replay of the same batch compares with earlier batches only and then
    replaces its own files, so it changes nothing.
    """
    spark = batch.sparkSession
    earlier = stored_records(spark, path).where(F.col("batch_id") < batch_id)
    fresh = dedup_records(with_record_ids(batch), earlier)
    write_batch(fresh, path, batch_id)


def ingest_stream(lines: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Ingests a stream of transcript lines; ``then`` sees each stored batch, e.g. to govern its projects."""

    def step(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, path)
        if then is not None:
            then(stored_records(batch.sparkSession, path).where(F.col("batch_id") == batch_id), batch_id)

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inject_once_stream(requests: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First request per (session, project) within the watermark, so that state expires."""
    return requests.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id", "project_id"])


def tools_of(records: DataFrame) -> DataFrame:
    """Tool records as calls for ``classify_tools``."""
    return records.where(F.col("role") == "tool").select(
        "project_id",
        F.concat(F.lit("tev_"), F.substring("record_id", 1, 24)).alias("source_id"),
        "session_id",
        F.lit("").alias("user_id"),
        "ts",
        "name",
        "content",
    )


def utterances_of(records: DataFrame) -> DataFrame:
    """User records as evidence rows. Assistant records never become any."""
    return records.where(F.col("role") == "user").select(
        "project_id",
        F.concat(F.lit("utt_"), F.substring("record_id", 1, 24)).alias("source_id"),
        "session_id",
        F.lit("").alias("user_id"),
        F.lit("user_utterance").alias("source_type"),
        "ts",
        F.col("content").alias("text"),
    )
