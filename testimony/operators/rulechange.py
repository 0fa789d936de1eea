"""Rule changes: propose, simulate, check and apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut, join_few
from testimony.functions.text import digest
from testimony.operators import cluster, gate, integrity, score, state
from testimony.operators.conflicts import open_sides
from testimony.rules import Policy

# Transitions that block a rule change.
FORBIDDEN = (
    "assistant_or_agent_only_entered_core",
    "quoted_or_external_user_material_entered_core",
    "stale_item_entered_core",
    "unresolved_conflict_side_entered_world_state",
    "compact_characters_exceeded",
    "validation_errors_increased",
    "drift_report_hard_failures_present",
)

# Columns of claims that no decision needs.
TEXTS = ("claim", "object", "object_key", "confidence_reason")


def propose(shadow: DataFrame, feedback_ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """A pending proposal per changed signal, with the share of its evidence that exists.

    ``evidence`` has signal, feedback_id: the feedback rows a change rests on.
    """
    known = feedback_ids.select("feedback_id").distinct().withColumn("__known", F.lit(True))
    refs = evidence.distinct().join(known, "feedback_id", "left").groupBy("signal").agg(F.count(F.lit(1)).alias("evidence_refs"), F.count_if(F.col("__known").isNull()).alias("missing_refs"))
    changed = shadow.where(F.col("changed")).join(refs, "signal", "left")
    return changed.select(
        F.concat(F.lit("rule_prop_"), F.substring(digest(F.lit("scoring_weight_update"), "signal", F.col("new_weight").cast("string")), 1, 16)).alias("proposal_id"),
        F.lit("scoring_weight_update").alias("kind"),
        "signal",
        "weight",
        "new_weight",
        F.coalesce("evidence_refs", F.lit(0)).alias("evidence_refs"),
        F.coalesce("missing_refs", F.lit(0)).alias("missing_refs"),
        F.lit("pending").alias("status"),
        F.lit(True).alias("requires_explicit_apply"),
    )


@dataclass(frozen=True)
class Simulation:
    """Claims, conflicts and decisions under the present rules (scenario '') and under each proposal.

    Ids of projects, items, slots and conflicts begin with their scenario and a bar, so that every operator keeps
    scenarios apart as it keeps projects apart; base_project and base_item are the plain ones.
    """

    items: DataFrame
    conflicts: DataFrame
    decisions: DataFrame
    policy: Policy


def simulate(claims: DataFrame, conflicts: DataFrame, proposals: DataFrame, weights: DataFrame, policy: Policy = Policy()) -> Simulation:
    """What the claims would be scored and decided like under each proposal, all proposals in one plan.

    ``proposals`` has proposal_id, signal, new_weight: at most one for each signal that has a weight. Weights touch no
    contradiction, so ``conflicts`` are those of the claims, found once. Nothing of the present state is written.
    """
    present = score.weight_map_of(weights)
    others = F.map_filter("present", lambda k, v: k != F.col("signal"))
    tried = proposals.withColumn("present", present).select(F.col("proposal_id").alias("scenario"), F.map_concat(others, F.create_map("signal", F.col("new_weight").cast("int"))).alias("w"))
    packed = tried.union(claims.sparkSession.range(1).select(F.lit(""), present)).groupBy().agg(F.collect_list(F.struct("scenario", "w")).alias("s")).scalar()

    def branched(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        out = df.withColumn("__all", packed).withColumn("__s", F.explode("__all")).drop("__all").withColumn("scenario", F.col("__s.scenario"))
        return out.withColumns({c: F.concat_ws("|", "scenario", c) for c in columns})

    every = branched(claims.withColumns({"base_project": F.col("project_id"), "base_item": F.col("item_id")}), ("project_id", "item_id", "slot_id"))
    scored = score.score(every, weights=F.col("__s.w")).drop("__s")
    found = cut(branched(conflicts, ("project_id", "conflict_id", "item_a", "item_b")).drop("__s"), "sim-conflicts")
    # Of every scenario only what is decided is written; the claims with their texts are read from ``claims`` again.
    held = cut(open_sides(found).withColumn("__held", F.lit(True)), "sim-held")
    flagged = score.inclusion(join_few(scored, held, "item_id"))
    items = flagged.withColumn("include_in_world_state", F.col("include_in_world_state") & F.col("__held").isNull()).drop("__held")
    decided = gate.gate(items, policy, found, cluster.duplicates(items)).drop(*TEXTS)
    return Simulation(items, found, cut(decided, "sim-decisions"), policy)


def simulate_diff(sim: Simulation) -> DataFrame:
    """(scenario, project_id, item_id, old_*, new_*) of the items whose score, inclusion or decision a proposal changes."""
    cols = ("confidence", "include_in_world_state", "allowed", "reasons")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.col("base_project").alias("project_id"), F.col("base_item").alias("item_id"), "scenario", *[F.col(c).alias(f"{tag}_{c}") for c in cols])

    old = side(sim.decisions.where("scenario = ''"), "old").drop("scenario")
    both = side(sim.decisions.where("scenario <> ''"), "new").join(old, ["project_id", "item_id"])
    same = reduce(lambda x, y: x & y, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in cols])
    return both.where(~same)


def diff_summary(diff: DataFrame) -> DataFrame:
    """What each proposal changes in each project, with the ids that it lets in or out of the state."""
    old, new = F.coalesce("old_allowed", F.lit(False)), F.coalesce("new_allowed", F.lit(False))
    enters, leaves = ~old & new, old & ~new
    return diff.groupBy("scenario", "project_id").agg(
        F.count_if(~F.col("old_confidence").eqNullSafe(F.col("new_confidence"))).alias("score_changes"),
        F.count_if(~F.col("old_include_in_world_state").eqNullSafe(F.col("new_include_in_world_state"))).alias("inclusion_changes"),
        F.count_if(enters).alias("newly_allowed"),
        F.count_if(leaves).alias("newly_blocked"),
        F.count_if(~F.col("old_reasons").eqNullSafe(F.col("new_reasons"))).alias("reason_changes"),
        # A project's admission is bounded by its budget, and so are these.
        F.array_sort(F.collect_list(F.when(enters, F.col("item_id")))).alias("entering_ids"),
        F.array_sort(F.collect_list(F.when(leaves, F.col("item_id")))).alias("leaving_ids"),
    )


def state_delta(sim: Simulation) -> DataFrame:
    """(scenario, project_id, old_chars, new_chars, compact_delta): sizes of the compact states, and which state items a
    proposal adds and takes away is in diff_summary."""
    sizes = state.build_state(sim.items, sim.decisions, sim.policy).select(F.col("project_id").alias("key"), "compact_characters")
    named = sim.items.select(F.col("project_id").alias("key"), "scenario", F.col("base_project").alias("project_id")).distinct().join(sizes, "key")
    old = named.where("scenario = ''").select("project_id", F.col("compact_characters").alias("old_chars"))
    new = named.where("scenario <> ''").select("scenario", "project_id", F.col("compact_characters").alias("new_chars"))
    return new.join(old, "project_id").withColumn("compact_delta", F.col("new_chars") - F.col("old_chars"))


def transitions(sim: Simulation, max_compact_chars: int = 1600) -> DataFrame:
    """(scenario, project_id, rule, subject, entered) of everything forbidden that the state of a scenario would hold.

    ``entered``: it is not so under the present rules. Scores outside 0 to 100 count as validation errors, included claims
    that drift reports as failing as drift.
    """
    # The written decisions have all of an item but its texts; only the objects of admitted ones are looked up, by the plain claim.
    core = sim.decisions.where("allowed")
    named = cut(sim.decisions.groupBy("project_id", "scenario", "base_project").agg(F.count_if(~F.col("confidence").between(0, 100)).alias("errors")), "sim-projects")
    old = named.where("scenario = ''").select("base_project", F.col("errors").alias("old_errors"))
    errors = named.join(old, "base_project").select("project_id", "old_errors", F.col("errors").alias("new_errors"))
    said = sim.items.where("scenario = ''").select("base_item", "object")
    shown = core.select("project_id", "item_id", "source_type", "scope", "predicate", "modality", "confidence", "base_item").join(said, "base_item").drop("base_item")
    sizes = cut(state.build_state(named, None, sim.policy, admitted=cut(shown, "sim-shown")).select("project_id", "compact_characters"), "sim-sizes")
    drift = integrity.hard_failures(sim.decisions).groupBy("project_id").agg(F.count(F.lit(1)).alias("hard_failures"))
    hits = forbidden_transitions(core, sim.conflicts, sizes, errors, drift, max_compact_chars)
    plain = F.expr("substring(subject, length(scenario) + 2)")
    hits = cut(hits.join(named.select("project_id", "scenario", "base_project"), "project_id").select("scenario", F.col("base_project").alias("project_id"), "rule", plain.alias("subject")), "sim-hits")
    known = hits.where("scenario = ''").select("project_id", "rule", "subject", F.lit(True).alias("known")).distinct()
    return hits.where("scenario <> ''").join(known, ["project_id", "rule", "subject"], "left").select("scenario", "project_id", "rule", "subject", F.col("known").isNull().alias("entered"))


def simulations(proposals: DataFrame, found: DataFrame) -> DataFrame:
    """(proposal_id, hard_failures) of simulated proposals: how many forbidden things each would let in."""
    failing = found.where("entered").groupBy(F.col("scenario").alias("proposal_id")).agg(F.count(F.lit(1)).alias("hard_failures"))
    return proposals.select("proposal_id").join(failing, "proposal_id", "left").select("proposal_id", F.coalesce("hard_failures", F.lit(0)).alias("hard_failures"))


def forbidden_transitions(
    core: DataFrame,
    conflicts: DataFrame,
    state: DataFrame | None = None,
    errors: DataFrame | None = None,
    drift: DataFrame | None = None,
    max_compact_chars: int = 1600,
    min_severity: int = 80,
) -> DataFrame:
    """(project_id, rule, subject) of everything a rule change must not cause.

    ``core`` are the items that would be in the state, ``state`` has
    compact_characters per project, ``errors`` old_errors and new_errors,
    ``drift`` hard_failures.
    """
    intent = F.col("utterance_intent") if "utterance_intent" in core.columns else F.lit(None).cast("string")
    rules = [
        F.when(F.col("source_type").isin("agent_interpretation", "assistant_output"), F.lit(FORBIDDEN[0])),
        F.when(intent != "direct_user_intent", F.lit(FORBIDDEN[1])),
        F.when(F.col("status").isin("superseded", "rejected", "deferred"), F.lit(FORBIDDEN[2])),
    ]
    hits = core.select("project_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"), F.col("item_id").alias("subject"))
    side = core.join(open_sides(conflicts, min_severity), "item_id", "left_semi")
    hits = hits.unionByName(side.select("project_id", F.lit(FORBIDDEN[3]).alias("rule"), F.col("item_id").alias("subject")))

    def project_rule(df: DataFrame | None, cond, rule: str) -> DataFrame | None:
        return None if df is None else df.where(cond).select("project_id", F.lit(rule).alias("rule"), F.col("project_id").alias("subject"))

    for part in (
        project_rule(state, F.col("compact_characters") > max_compact_chars, FORBIDDEN[4]),
        project_rule(errors, F.col("new_errors") > F.col("old_errors"), FORBIDDEN[5]),
        project_rule(drift, F.col("hard_failures") > 0, FORBIDDEN[6]),
    ):
        if part is not None:
            hits = hits.unionByName(part)
    return hits


def apply_rules(proposals: DataFrame, simulations: DataFrame, weights: DataFrame, applied_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals with their new status, log rows, new weights).

    ``simulations`` has proposal_id and hard_failures. A proposal without a
    simulation, or with a hard failure, is refused and changes nothing.
    """
    out = proposals.join(simulations.select("proposal_id", "hard_failures"), "proposal_id", "left")
    refusal = F.when(F.col("hard_failures").isNull(), "not_simulated").when(F.col("hard_failures") > 0, "hard_failures").when(F.col("missing_refs") > 0, "missing_evidence")
    out = out.withColumn("refused", F.coalesce(refusal, F.lit("")))
    ok = F.col("refused") == ""
    out = out.withColumn("status", F.when(ok, "applied").otherwise(F.col("status"))).withColumn("applied_at", F.when(ok, applied_at))
    log = out.where(ok).select(
        F.concat(F.lit("rule_log_"), F.substring(digest("proposal_id", F.lit(applied_at)), 1, 16)).alias("log_id"), "proposal_id", "signal", "weight", "new_weight", "applied_at"
    )
    fresh = out.where(ok).select("signal", F.col("new_weight").alias("__new"))
    updated = weights.join(fresh, "signal", "left").select("signal", F.coalesce("__new", "weight").cast("long").alias("weight"))
    return out, log, updated

