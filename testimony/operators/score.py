"""Evidence-weighted confidence, inclusion flags and weight learning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.text import quoted
from testimony.rules import MIN_INCLUDE_CONFIDENCE, SIGNAL_WEIGHTS, WEIGHT_BOUNDS, Scoring


def _lookup(key: str, values: Mapping[str, int], default: int) -> Column:
    whens = " ".join(f"WHEN {quoted(name)} THEN {value}" for name, value in values.items())
    return F.expr(f"CASE {key} {whens} ELSE {default} END")


def score_signals() -> Column:
    """The signals that apply to a claim, sorted."""
    user = F.col("source_type").isin("user_utterance", "proposed_update", "manual_initialization")
    tool = F.col("source_type") == "tool_evidence"

    def when(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    return F.array_sort(
        F.array_compact(
            F.array(
                when(user & F.col("explicit_preference"), "user_explicit_preference"),
                when(user & F.col("explicit_rejection"), "user_explicit_rejection"),
                when(user & F.col("strong_emphasis"), "user_strong_emphasis"),
                when(user & F.col("long_form"), "user_long_form"),
                when(user & F.col("repeated"), "user_repeated"),
                when(tool, "tool_evidence"),
                when(tool & F.col("deterministic"), "tool_deterministic"),
                when(F.col("source_type") == "agent_interpretation", "agent_interpretation"),
            )
        )
    )


def weight_map(weights: Mapping[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])


def weight_map_of(weights: DataFrame, column: str = "weight") -> Column:
    """The weight table as one map value; it has one row per signal name of the rules."""
    known = weights.where(F.col("signal").isin(*SIGNAL_WEIGHTS))
    pairs = known.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("signal", F.col(column).cast("int").alias("w"))))).alias("m"))
    return pairs.scalar()


def score(items: DataFrame, scoring: Scoring = Scoring(), weights: Column | None = None) -> DataFrame:
    """Base by source plus the weights of the signals, up to the source's ceiling.

    ``weights`` may be a map column, so that a proposed weight table can be
    tried without changing the rules.
    """
    table = weight_map(scoring.weights) if weights is None else weights
    out = items.withColumn("score_signals", score_signals()).withColumn("__w", table)
    gained = F.aggregate("score_signals", F.lit(0), lambda acc, s: acc + F.coalesce(F.element_at(F.col("__w"), s), F.lit(0)))
    base = _lookup("source_type", scoring.base, 50)
    ceiling = _lookup("source_type", scoring.ceiling, 100)
    out = out.withColumn("confidence", F.least(ceiling, base + gained).cast("int")).drop("__w")
    return out.withColumn("evidence_types", F.array("source_type"))


def tool_only(items: DataFrame) -> DataFrame:
    flag = F.array_distinct("evidence_types") == F.array(F.lit("tool_evidence"))
    return items.withColumn("requires_governance_gate_for_world_state", flag)


def inclusion(items: DataFrame, blocked: DataFrame | None = None, minimum: int = MIN_INCLUDE_CONFIDENCE) -> DataFrame:
    """Only accepted, confident claims that no conflict holds back are included.

    ``blocked`` has the ids of deferred, unresolved or conditionally blocked
    sides. A candidate is never included here: admission is the gate's.
    """
    flag = (F.col("status") == "accepted") & (F.col("confidence") >= minimum)
    if "utterance_intent" in items.columns:
        flag = flag & F.coalesce(F.col("utterance_intent") == "direct_user_intent", F.lit(True))
    if blocked is None:
        return items.withColumn("include_in_world_state", flag)
    side = blocked.select("item_id").distinct().withColumn("__blocked", F.lit(True))
    return items.join(side, "item_id", "left").withColumn("include_in_world_state", flag & F.col("__blocked").isNull()).drop("__blocked")


def confidence_rollup(items: DataFrame) -> DataFrame:
    return items.rollup("source_type", "status").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if("include_in_world_state").alias("included"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.sum("confidence").cast("long").alias("sum_confidence"),
    )


def weight_shadow(feedback: DataFrame, weights: DataFrame, delta: int = 1, bounds: tuple[int, int] = WEIGHT_BOUNDS) -> DataFrame:
    """What pending feedback would do to each signal weight; nothing is written.

    Signals without a weight are listed as ignored.
    """
    step = F.when(F.col("action") == "accept", delta).when(F.col("action") == "reject", -delta).otherwise(0)
    pending = feedback.where(~F.col("applied_to_weights")).select(F.explode("signals").alias("signal"), step.alias("step"))
    sums = pending.groupBy("signal").agg(
        F.sum("step").cast("long").alias("delta"), F.count(F.lit(1)).alias("feedback_rows"), F.count_if(F.col("step") == 0).alias("zero_delta_rows")
    )
    out = weights.join(sums, "signal", "full_outer")
    wanted = F.col("weight") + F.coalesce("delta", F.lit(0))
    bounded = F.when(wanted.isNotNull(), F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), wanted)))
    return out.select(
        "signal",
        F.col("weight").cast("long").alias("weight"),
        F.coalesce("delta", F.lit(0)).cast("long").alias("delta"),
        bounded.cast("long").alias("new_weight"),
        F.coalesce("feedback_rows", F.lit(0)).cast("long").alias("feedback_rows"),
        F.coalesce("zero_delta_rows", F.lit(0)).cast("long").alias("zero_delta_rows"),
        F.col("weight").isNull().alias("ignored"),
        F.coalesce(bounded != wanted, F.lit(False)).alias("bounds_hit"),
        F.coalesce(bounded != F.col("weight"), F.lit(False)).alias("changed"),
    )


def shadow_summary(feedback: DataFrame, shadow: DataFrame) -> DataFrame:
    pending = feedback.agg(
        F.count(F.lit(1)).alias("feedback_total"),
        F.count_if(~F.col("applied_to_weights")).alias("pending"),
        F.count_if(~F.col("applied_to_weights") & F.col("action").isin("accept", "reject")).alias("would_apply"),
    )
    changes = shadow.agg(
        F.count_if("changed").alias("changed_signal_count"), F.count_if("ignored").alias("ignored_signals"), F.count_if("bounds_hit").alias("bounds_hits")
    )
    totals = pending.select(F.struct(*pending.columns)).scalar()
    out = changes.withColumn("__t", totals).select(*[F.col(f"__t.{c}").alias(c) for c in pending.columns], *changes.columns)
    return out.withColumn("mode", F.lit("shadow")).withColumn("writes_weights", F.lit(False))


def apply_weights(feedback: DataFrame, weights: DataFrame, shadow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new weights, feedback marked as applied), for the caller to write."""
    fresh = shadow.where(~F.col("ignored")).select("signal", "new_weight")
    updated = weights.join(fresh, "signal", "left").select("signal", F.coalesce("new_weight", "weight").cast("long").alias("weight"))
    return updated, feedback.withColumn("applied_to_weights", F.lit(True))
