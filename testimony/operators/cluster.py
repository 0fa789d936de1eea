"""Denoising: claims that say the same thing on the same slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import attach_group, crowded
from testimony.functions.text import digest
from testimony.operators.conflicts import ACTIVE, SLOT_KEYS, authority

CLUSTER_KEYS = (*SLOT_KEYS, "modality")


def _best():
    """Sorts the representative first as a minimum: authority, accepted, confidence, evidence, id."""
    return F.struct(
        (-authority("source_type")).alias("a"),
        F.when(F.col("status") == "accepted", 0).otherwise(1).alias("s"),
        (-F.col("confidence")).alias("c"),
        (-F.col("evidence_count")).alias("e"),
        F.col("item_id").alias("id"),
        F.col("source_type").alias("src"),
    )


def members(items: DataFrame) -> DataFrame:
    """Every member of a cluster of two or more, with its representative.

    Minimum and count combine before the shuffle; the join back is one that AQE
    can split where a cluster is large.
    """
    live = items.where(F.col("status").isin(*ACTIVE))
    # Members meet under a digest of their keys, so that these need not be shuffled.
    key = F.unhex(F.sha2(F.to_json(F.struct(*CLUSTER_KEYS)), 256))
    rows = crowded(live, CLUSTER_KEYS).select(*CLUSTER_KEYS, "item_id", "source_type", "status", "confidence", "evidence_count", key.alias("__cluster"))
    best = F.struct(*[F.col("__best")[f].alias(f) for f in ("a", "s", "c", "e", "id")])
    top = [F.min(best).alias("__top"), F.count(F.lit(1)).alias("member_count"), F.count_if(F.col("source_type") == "user_utterance").alias("user_members")]
    out = attach_group(rows.withColumn("__best", _best()), ["__cluster"], top).where(F.col("member_count") > 1)
    weaker = F.col("member_count") > F.col("user_members")
    action = F.when((F.col("user_members") > 0) & weaker, "prefer_user_anchor_block_weaker_duplicates").otherwise("keep_representative_block_duplicates")
    return out.select(
        *CLUSTER_KEYS,
        digest(F.lit("candidate_cluster"), *CLUSTER_KEYS).alias("cluster_id"),
        "item_id",
        "source_type",
        F.col("__top.id").alias("representative_id"),
        (F.col("__top.id") != F.col("item_id")).alias("is_duplicate"),
        "member_count",
        action.alias("governance_action"),
    )


def clusters(items: DataFrame) -> DataFrame:
    """One row per cluster of two or more active claims."""
    live = items.where(F.col("status").isin(*ACTIVE))
    rows = crowded(live.select(*CLUSTER_KEYS, "item_id", "source_type", "status", "confidence", "evidence_count"), CLUSTER_KEYS).withColumn("__best", _best())
    out = rows.groupBy(*CLUSTER_KEYS).agg(
        F.count(F.lit(1)).alias("member_count"), F.min("__best").alias("__top"), F.count_if(F.col("source_type") == "user_utterance").alias("user_members")
    )
    out = out.where(F.col("member_count") > 1)
    action = F.when((F.col("user_members") > 0) & (F.col("member_count") > F.col("user_members")), "prefer_user_anchor_block_weaker_duplicates")
    return out.select(
        *CLUSTER_KEYS,
        digest(F.lit("candidate_cluster"), *CLUSTER_KEYS).alias("cluster_id"),
        "member_count",
        F.col("__top.id").alias("representative_id"),
        F.col("__top.src").alias("representative_source"),
        F.lit("none_no_state_mutation").alias("merge_mode"),
        F.lit(False).alias("updates_world_state"),
        action.otherwise("keep_representative_block_duplicates").alias("governance_action"),
    )


def duplicates(items: DataFrame) -> DataFrame:
    return members(items).where(F.col("is_duplicate"))


def duplicate_ratio(items: DataFrame) -> DataFrame:
    """Cluster and duplicate counts per project, relative to its active claims."""
    live = items.where(F.col("status").isin(*ACTIVE))
    slots = live.groupBy("project_id", F.unhex(digest(*CLUSTER_KEYS)).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    out = slots.groupBy("project_id").agg(
        F.sum("n").cast("long").alias("active_items"),
        F.count_if(F.col("n") > 1).alias("candidate_cluster_count"),
        F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).cast("long").alias("duplicate_candidates"),
    )
    return out.withColumn("duplicate_candidate_ratio", F.round(F.col("duplicate_candidates") / F.col("active_items"), 6))
