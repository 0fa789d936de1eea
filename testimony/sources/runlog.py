"""Run events: nested JSON logs projected to a fixed set of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The metrics kept of a run event. Members and fingerprints are
# absent from the schema, so parsing drops them.
RUN_SCHEMA = (
    "hook string, timestamp string, session_id string, ingested boolean, local_only boolean, step_count bigint, step_scripts array<string>,"
    " world_state struct<included_count:bigint,structured_count:bigint,compact_structured_count:bigint,characters:bigint,compact_characters:bigint>,"
    " state_upgrade struct<needs_upgrade:boolean,from_version:string,to_version:string,repair:boolean,local_only:boolean,llm_used:boolean>,"
    " user_profile struct<changed:boolean,generated_candidates:bigint,min_confidence:bigint>,"
    " conflicts struct<new_conflicts:bigint,total_conflicts:bigint>,"
    " conflict_clusters struct<total_conflicts:bigint,cluster_count:bigint>,"
    " evidence_index struct<segment_count:bigint,source_types:map<string,bigint>,source_file_count:bigint,skipped:boolean,skip_reason:string,local_only:boolean>,"
    " drift struct<ok:boolean,compact_characters:bigint,max_compact_chars:bigint,unresolved_high_severity_conflicts:bigint,max_high_severity_conflicts:bigint,"
    "conflict_cluster_count:bigint,dangling_reference_errors:bigint,stale_revived_items:bigint,assistant_only_core_items:bigint,candidate_core_items:bigint,"
    "evidence_mix:map<string,bigint>,warnings:array<string>,hard_failures:array<string>>"
)


def summarize_runs(runs: DataFrame, raw: str = "raw", tail_chars: int = 1000) -> DataFrame:
    """Adds ``summary``, ``raw_stdout_chars`` and, for output that is no JSON object, ``stdout_tail`` or ``stdout_type``."""
    body = F.trim(F.col(raw))
    kind = F.when(body == "", "empty").when(F.try_parse_json(body).isNull(), "text")
    kind = kind.when(body.startswith("{"), "object").when(body.startswith("["), "list").otherwise("scalar")
    out = runs.withColumn("kind", kind)
    size = F.length(raw)
    tail = F.when(size > tail_chars, F.substring(F.col(raw), size - tail_chars + 1, F.lit(tail_chars))).otherwise(F.col(raw))
    return (
        out.withColumn("raw_stdout_chars", F.when(F.col("kind") != "empty", size.cast("long")))
        .withColumn("stdout_tail", F.when(F.col("kind") == "text", tail))
        .withColumn("stdout_type", F.when(F.col("kind").isin("list", "scalar"), F.col("kind")))
        .withColumn("summary", F.when(F.col("kind") == "object", F.from_json(body, RUN_SCHEMA)))
    )
