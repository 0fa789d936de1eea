"""Policy gate: reasons, constitutional blocks, budgets and metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testimony.functions.scale import crowded, cut, join_few, top_k, without_few
from testimony.functions.text import rank_of
from testimony.operators.conflicts import conditional_sides, held_sides
from testimony.rules import Policy

STALE = ("superseded", "rejected", "deferred", "expired")
# What an accepted claim from a stable source need not have.
WAIVED = ("missing_evidence", "blocked_as_duplicate_candidate")
BUDGETS = (
    ("max_per_slot", ("project_id", "slot_id")),
    ("max_per_predicate", ("project_id", "predicate")),
    ("max_per_category", ("project_id", "category")),
    ("max_allowed", ("project_id",)),
)


def _flags(items: DataFrame, ids: dict[str, DataFrame | None]) -> DataFrame:
    """Marks the items of each set of ids. The sets are written as one small table."""
    marked = [side.select("item_id", *[F.lit(n == name).alias(n) for n in ids]) for name, side in ids.items() if side is not None]
    if not marked:
        return items.withColumns({name: F.lit(False) for name in ids})
    few = reduce(DataFrame.unionByName, marked).groupBy("item_id").agg(*[F.max(n).alias(n) for n in ids])
    return join_few(items, cut(few, "flags"), "item_id").withColumns({name: F.coalesce(name, F.lit(False)) for name in ids})


def threshold(policy: Policy) -> Column:
    source = F.col("source_type")
    return F.when(source == "user_utterance", policy.min_confidence_user).when(source == "tool_evidence", policy.min_confidence_tool).otherwise(policy.min_confidence)


def decide(items: DataFrame, policy: Policy = Policy(), conflicts: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """Every rule an item fails, before budgets.

    Conflicts and duplicates come in as id sets joined on the unique item id,
    so no key of these joins is hot.
    """
    held = None if conflicts is None else held_sides(conflicts, items, policy.min_conflict_severity)
    has_conditional = conflicts is not None and "blocks_world_state" in conflicts.columns
    out = _flags(items, {"__open": held, "__conditional": conditional_sides(conflicts) if has_conditional else None, "__duplicate": duplicates})
    if "conditional_conflict_block" in items.columns:
        out = out.withColumn("__conditional", F.col("__conditional") | F.coalesce(F.col("conditional_conflict_block.blocks_world_state"), F.lit(False)))
    source = F.col("source_type")
    stable = (F.col("status") == "accepted") & source.isin(*policy.allowed_accepted_sources)
    intent = F.col("utterance_intent") if "utterance_intent" in items.columns else F.lit(None).cast("string")
    deterministic = F.coalesce(F.col("deterministic"), F.lit(False)) if "deterministic" in items.columns else F.lit(False)
    minimum = threshold(policy)
    checks = [
        (F.col("status").isin(*STALE), "stale_or_rejected"),
        (F.col("__open"), "unresolved_high_severity_conflict"),
        (F.col("__conditional"), "conditional_conflict_block"),
        (intent != "direct_user_intent", "quoted_or_external_material"),
        (source == "assistant_output", "assistant_output_claim"),
        ((source == "agent_interpretation") | (F.col("evidence_types") == F.array(F.lit("agent_interpretation"))), "agent_only_evidence"),
        (F.col("__duplicate"), "blocked_as_duplicate_candidate"),
        (F.col("evidence_count") == 0, "missing_evidence"),
        ((source == "tool_evidence") & ~deterministic, "tool_evidence_not_deterministic"),
    ]
    named = [F.when(cond, F.lit(name)) for cond, name in checks]
    named.append(F.when(F.col("confidence") < minimum, F.concat(F.lit("confidence_below_"), minimum.cast("string"))))
    reasons = F.array_compact(F.array(*named))
    out = out.withColumn("__all", reasons)
    constitutional = F.arrays_overlap("__all", F.array(*[F.lit(b) for b in policy.constitutional_blocks])) if policy.constitutional_blocks else F.lit(False)
    out = out.withColumn("constitutional_block", constitutional)
    # constitutional blocks come first: they cannot be waived by acceptance
    waived = stable & ~F.col("constitutional_block")
    kept = F.array_except("__all", F.array(*[F.lit(w) for w in WAIVED]))
    out = out.withColumn("reasons", F.when(waived, kept).otherwise(F.col("__all")))
    return out.drop("__all", "__open", "__conditional", "__duplicate")


def priority(policy: Policy) -> list[Column]:
    return [
        rank_of("source_type", policy.source_priority),
        rank_of("predicate", policy.predicate_priority),
        rank_of("modality", policy.modality_priority),
        F.desc("confidence"),
        F.asc("item_id"),
    ]


def budget(decided: DataFrame, policy: Policy = Policy(), materialize: bool = True) -> DataFrame:
    """Admission budgets in stages: slot, predicate, category, total.

    Each stage ranks only what the previous one kept and each ranks at most
    ``cap`` rows per group and task, whatever the size of the group. Of slots
    only those with more claims than their cap are ranked. How far an item came
    is joined back on its unique id, for those few that came further or less
    far than most.
    """
    active = [(name, keys, getattr(policy, name)) for name, keys in BUDGETS if getattr(policy, name) > 0]
    survivors = decided.where(F.size("reasons") == 0)
    order = priority(policy)
    if not active:
        return decided.withColumn("allowed", F.size("reasons") == 0)
    keep = cut if materialize else lambda df, _: df
    kept = survivors.select("item_id", "project_id", "slot_id", "predicate", "category", "source_type", "modality", "confidence")
    kept, reached, usual = keep(kept, "survivors"), [], 0
    for stage, (name, keys, cap) in enumerate(active, 1):
        if name == "max_per_slot":
            ranked = crowded(kept, keys, cap + 1).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            over = keep(ranked.where(F.col("rank") > cap).select("item_id"), "over-slot")
            kept, usual = without_few(kept, over, "item_id"), stage
            reached.append(over.withColumn("stage", F.lit(stage - 1)))
        else:
            kept = keep(top_k(kept, keys, order, cap).drop("rank"), name)
            reached.append(kept.select("item_id", F.lit(stage).alias("stage")))
    far = reduce(DataFrame.unionByName, reached).groupBy("item_id").agg(F.max("stage").alias("__stage"))
    out = join_few(decided, keep(far, "stages"), "item_id").withColumn("__stage", F.coalesce("__stage", F.lit(usual)))
    stopped = None
    for stage, (name, _, _) in enumerate(active):
        reason = F.lit(f"blocked_by_gate_budget_{name}")
        stopped = F.when(F.col("__stage") == stage, reason) if stopped is None else stopped.when(F.col("__stage") == stage, reason)
    passing = F.size("reasons") == 0
    out = out.withColumn("allowed", passing & (F.col("__stage") == len(active)))
    return out.withColumn("reasons", F.when(passing & ~F.col("allowed"), F.array(stopped)).otherwise(F.col("reasons"))).drop("__stage")


def gate(
    items: DataFrame,
    policy: Policy = Policy(),
    conflicts: DataFrame | None = None,
    duplicates: DataFrame | None = None,
    materialize: bool = True,
) -> DataFrame:
    """Decision per item, traceable to the policy that made it.

    Of the decisions before budgets, what the budget stages rank by is written
    once; ``materialize=False`` leaves them lazy.
    """
    out = budget(decide(items, policy, conflicts, duplicates), policy, materialize)
    return (
        out.withColumn("policy_version", F.lit(policy.version))
        .withColumn("policy_hash", F.lit(policy.hash))
        .withColumn("policy_path", F.lit(policy.path))
    )


def gate_by_policy(items: DataFrame, policies: Sequence[Policy], conflicts: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """Decisions of several policies side by side. Policies are a short list of rule files."""
    return reduce(DataFrame.unionByName, [gate(items, p, conflicts, duplicates) for p in policies])


def gate_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("policy_version", "policy_hash", "project_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if("allowed").alias("allowed_count"),
        F.count_if(~F.col("allowed")).alias("blocked_count"),
        F.count_if(F.exists("reasons", lambda r: r.startswith("blocked_by_gate_budget"))).alias("budget_blocked_count"),
    )


def reason_counts(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("allowed")).select("project_id", F.explode("reasons").alias("reason")).groupBy("project_id", "reason").agg(F.count(F.lit(1)).alias("items"))


def policy_violations(policies: DataFrame) -> DataFrame:
    """One row per broken rule of each policy; an empty result means valid.

    ``policies`` has policy_id and the numeric fields of a policy.
    """
    percent = ("min_confidence", "min_confidence_user", "min_confidence_tool", "min_conflict_severity")
    caps = ("max_allowed", "max_per_category", "max_per_predicate", "max_per_slot")
    checks = [(F.col(c).isNull(), f"{c}_missing") for c in (*percent, *caps)]
    checks += [(~F.col(c).between(0, 100), f"{c}_out_of_range") for c in percent]
    checks += [(F.col(c) < 0, f"{c}_negative") for c in caps]
    checks.append((F.col("min_confidence_tool") > F.lit(89), "min_confidence_tool_unreachable"))
    bound = (F.col("max_allowed") > 0) & (F.col("max_per_slot") > F.col("max_allowed"))
    checks.append((bound, "max_per_slot_above_max_allowed"))
    rules = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))
    return policies.select("policy_id", F.explode(rules).alias("rule"))
