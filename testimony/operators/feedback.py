"""Feedback events: validation, reports, trends and drift attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import as_of_last
from testimony.functions.text import digest
from testimony.rules import FEEDBACK_FAMILIES

OUTCOMES = ("positive", "negative", "neutral")


def record_feedback(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted events with ids, refused events with a reason)."""
    reason = (
        F.when(~F.coalesce(F.col("event_family").isin(*FEEDBACK_FAMILIES), F.lit(False)), "unknown_family")
        .when(F.coalesce(F.trim("event_name"), F.lit("")) == "", "missing_name")
        .when(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), "unknown_outcome")
        .when(~F.coalesce(F.col("severity").between(0, 100), F.lit(False)), "severity_out_of_range")
    )
    checked = events.withColumn("refused", reason)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    key = digest("session_id", stamp, "event_family", "event_name", "target_type", "target_id", "outcome")
    good = checked.where(F.col("refused").isNull()).drop("refused").withColumn("feedback_id", F.concat(F.lit("fb_"), F.substring(key, 1, 24)))
    return good, checked.where(F.col("refused").isNotNull())


def report(events: DataFrame, high: int = 80) -> DataFrame:
    """All headline counts in one pass."""
    negative = F.col("outcome") == "negative"
    return events.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(negative).alias("negative"),
        F.count_if(negative & (F.col("severity") >= high)).alias("high_severity_negative"),
        F.count_if((F.col("event_family") == "correction") & (F.col("event_name") == "user_correction")).alias("user_corrections"),
        F.count_if((F.col("event_family") == "test") & (F.col("source_type") == "tool_evidence")).alias("deterministic_tool"),
        F.count_if(F.col("event_family") == "drift").alias("drift"),
        F.count_if(F.col("event_name") == "gate_false_accept").alias("gate_false_accept"),
        F.count_if(F.col("event_name") == "gate_false_reject").alias("gate_false_reject"),
    )


def cube(events: DataFrame) -> DataFrame:
    """Counts by family, by outcome, by both, and in total."""
    return events.cube("event_family", "outcome").agg(F.count(F.lit(1)).alias("events"), F.max("severity").alias("max_severity"))


def daily(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Events per day and family; the same code serves a stream with a watermark."""
    src = events.withWatermark("ts", watermark) if watermark else events
    out = src.groupBy(F.window("ts", "1 day").alias("w"), "event_family").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("outcome") == "negative").alias("negative"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_family", "events", "negative")


def attribute_drift(drift: DataFrame, manifests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Why a drifting claim did not hold: from the last manifest before the event.

    ``drift`` has event_id, session_id, item_id, ts; ``manifests`` session_id,
    ts, manifest_id; ``outcomes`` manifest_id, item_id, outcome.
    """
    placed = as_of_last(drift, manifests, ["session_id"], "ts", ["manifest_id"], "event_id")
    out = placed.join(outcomes, ["manifest_id", "item_id"], "left")
    cause = (
        F.when(F.col("manifest_id").isNull(), "no_context_delivered")
        .when(F.col("outcome").isNull(), "not_admitted")
        .when(F.col("outcome") == "included", "selected_but_ignored")
        .when(F.col("outcome") == "over_budget", "over_budget")
        .when(F.col("outcome") == "conditional_conflict_block", "blocked_by_conditional_conflict")
        .otherwise("not_selected")
    )
    return out.withColumn("cause", cause)
