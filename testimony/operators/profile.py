"""User profile across projects: candidates, rejections, diff and explicit apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.functions.scale import apart, crowd
from testimony.rules import OPPOSITION

# Predicates about how the work is done, not about what the user wants.
IMPLEMENTATION = ("test_passed", "score_evidence", "render", "call_llm", "infers", "observed")
GROUP = ("user_id", "scope", "subject", "predicate", "object_key", "modality")
SAYING = ("item_id", "user_id")


def sayings(bridge: DataFrame) -> DataFrame:
    """Sessions and records per (user, claim), folded by session first. What one record alone says is not shuffled."""
    user = bridge.where(F.col("source_type") == "user_utterance")
    several, single = apart(user, crowd(user, ["item_id"]))
    per_session = several.groupBy(*SAYING, "session_id").agg(F.count(F.lit(1)).alias("n"))
    many = per_session.groupBy(*SAYING).agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("records"))
    once = F.lit(1).cast("long")
    return many.unionByName(single.select(*SAYING, once.alias("sessions"), once.alias("records")))


def profile_candidates(items: DataFrame, bridge: DataFrame, blocked: DataFrame, minimum: int = 90, min_sessions: int = 2) -> DataFrame:
    """What each user says across projects, with the first reason that speaks against it.

    Claims come in folded per user and project, so a phrase that a third of
    all records repeat adds one row per project.
    """
    side = blocked.select("item_id").distinct().withColumn("__conflicted", F.lit(True))
    live = items.where(F.col("source_type") == "user_utterance").join(side, "item_id", "left")
    facts = live.select("item_id", "project_id", *GROUP[1:], "claim", "confidence", "status", F.coalesce("__conflicted", F.lit(False)).alias("conflicted"))
    # Moved once, for the groups and for the slots that they are held against.
    rows = sayings(bridge).join(facts, "item_id").repartition(*GROUP[:-1])
    out = rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("projects"),
        F.sum("sessions").cast("long").alias("sessions"),
        F.sum("records").cast("long").alias("records"),
        F.max("confidence").alias("confidence"),
        F.max("conflicted").alias("conflicted"),
        F.min(F.col("status").isin("rejected", "superseded")).alias("all_stale"),
        F.min("claim").alias("claim"),
    )
    # One user's wishes about one thing speak against each other across projects too; a slot has a few rows.
    slot = Window.partitionBy(*GROUP[:-1])
    live = ~F.col("all_stale")
    against = F.lit(False)
    for negative, positives in OPPOSITION:
        sides = [F.max(F.col("modality").isin(*m) & live).over(slot) for m in ([negative], positives)]
        against = against | (F.col("modality").isin(negative, *positives) & sides[0] & sides[1])
    reason = (
        F.when(F.col("scope") != "user_global", "project_only")
        .when(F.col("all_stale"), "rejected_or_superseded")
        .when(F.col("conflicted") | against, "conflicted")
        .when(F.col("confidence") < minimum, "low_confidence")
        .when(F.col("sessions") < min_sessions, "single_weak_expression")
        .when(F.col("predicate").isin(*IMPLEMENTATION), "implementation_detail")
        .otherwise("")
    )
    return out.withColumn("rejected_reason", reason)


def profile_summary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("user_id", "rejected_reason").agg(F.count(F.lit(1)).alias("candidates"))


def entries(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("rejected_reason") == "").select(*GROUP, "claim", "confidence")


def profile_diff(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """would_change rows: added, removed or changed profile entries."""
    old = current.select(*GROUP, F.col("confidence").alias("old_confidence"), F.lit(True).alias("__old"))
    new = wanted.select(*GROUP, F.col("confidence").alias("new_confidence"), F.lit(True).alias("__new"))
    both = old.join(new, list(GROUP), "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("old_confidence") != F.col("new_confidence"), "changed")
    return both.withColumn("change", change).where(F.col("change").isNotNull()).drop("__old", "__new")


def apply_profile(current: DataFrame, wanted: DataFrame, apply: bool = False) -> DataFrame:
    """The profile to store: unchanged unless apply is asked for."""
    return wanted if apply else current
