"""Update proposals and their review in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def propose(items: DataFrame) -> DataFrame:
    """A pending proposal for every candidate claim of a user."""
    fit = items.where((F.col("status") == "candidate") & (F.col("source_type") == "user_utterance"))
    return fit.withColumn("proposal_id", F.concat(F.lit("prop_"), "item_id")).withColumn("proposal_status", F.lit("pending"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Last review per proposal; ``reviews`` has proposal_id, seq, action. Folded before the shuffle."""
    return reviews.groupBy("proposal_id").agg(F.max(F.struct("seq", "action")).alias("r"), F.count(F.lit(1)).alias("reviews")).select("proposal_id", F.col("r.action").alias("action"), F.col("r.seq").alias("review_seq"), "reviews")


def review_updates(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    out = proposals.join(latest_reviews(reviews), "proposal_id", "left")
    status = F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").otherwise("pending")
    return out.withColumn("proposal_status", status)


def accepted_items(reviewed: DataFrame) -> DataFrame:
    """Accepted proposals as claims of their own, with a source that outranks the rest."""
    won = reviewed.where(F.col("proposal_status") == "accepted")
    out = won.withColumn("item_id", F.sha2(F.concat_ws("|", F.lit("accepted"), "item_id"), 256))
    return out.withColumn("source_type", F.lit("proposed_update")).withColumn("status", F.lit("accepted"))


def after_review(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """All claims after the review of their proposals, in one pass: rejected ones are marked, accepted ones stand
    beside a claim of their own, with a source that outranks the rest."""
    named = latest_reviews(reviews).where(F.col("proposal_id").startswith("prop_"))
    out = items.join(named.select(F.expr("substring(proposal_id, 6)").alias("item_id"), F.col("action").alias("__action")), "item_id", "left")
    proposed = (F.col("status") == "candidate") & (F.col("source_type") == "user_utterance")
    both = F.when(proposed & (F.col("__action") == "accept"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    out = out.withColumn("status", F.when(proposed & (F.col("__action") == "reject"), "rejected").otherwise(F.col("status"))).withColumn("__own", F.explode(both))
    return out.withColumns(
        {
            "item_id": F.when(F.col("__own"), F.sha2(F.concat_ws("|", F.lit("accepted"), "item_id"), 256)).otherwise(F.col("item_id")),
            "source_type": F.when(F.col("__own"), "proposed_update").otherwise(F.col("source_type")),
            "status": F.when(F.col("__own"), "accepted").otherwise(F.col("status")),
        }
    ).drop("__own", "__action")


def review_feedback(reviewed: DataFrame) -> DataFrame:
    """Scoring feedback of every reviewed proposal, with the signals it was scored by."""
    done = reviewed.where(F.col("proposal_status").isin("accepted", "rejected"))
    return done.select(
        "project_id",
        F.concat(F.lit("feedback_"), "proposal_id").alias("feedback_id"),
        "proposal_id",
        F.when(F.col("proposal_status") == "accepted", "accept").otherwise("reject").alias("action"),
        F.col("confidence").alias("proposal_confidence"),
        "category",
        (F.col("proposal_status") == "accepted").alias("should_update_world_state"),
        F.col("score_signals").alias("signals"),
        F.lit(False).alias("applied_to_weights"),
    )


def review_backlog(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("proposals"),
        F.count_if(F.col("proposal_status") == "pending").alias("pending"),
        F.count_if(F.col("proposal_status") == "accepted").alias("accepted"),
        F.count_if(F.col("proposal_status") == "rejected").alias("rejected"),
    )
