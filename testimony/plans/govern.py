"""The pipeline from evidence to governed tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import apart, cut, key_filter
from testimony.operators import cluster, conflicts, extract, gate, normalize, score, state
from testimony.rules import DEFAULT_RULES, Policy, Rules, Scoring

EVIDENCE = ("project_id", "source_id", "session_id", "user_id", "source_type", "ts", "text")


@dataclass
class Governed:
    """Tables of one run; each is a DataFrame over the written claims."""

    bridge: DataFrame
    items: DataFrame
    conflicts: DataFrame
    duplicates: DataFrame
    decisions: DataFrame
    policy: Policy

    @property
    def admitted(self) -> DataFrame:
        return state.state_items(self.items, self.decisions)

    def state(self, budget: int = state.BUDGET) -> DataFrame:
        return state.build_state(self.items, self.decisions, self.policy, budget)


def evidence_bridge(
    utterances: DataFrame,
    rules: Rules,
    tools: DataFrame | None = None,
    interpretations: DataFrame | None = None,
    passages: DataFrame | None = None,
) -> DataFrame:
    """Claim-to-evidence rows of all sources. Only direct user text is extracted from.

    Inputs have the EVIDENCE columns; ``tools`` is classified tool evidence. Utterances that hold sentences of
    ``passages`` (text), foreign material that users paste, are quotes and say nothing.
    """
    if passages is not None:
        utterances = utterances.join(normalize.external_overlap(utterances, passages), ["project_id", "source_id"], "left_anti")
    utterances = utterances.select(*EVIDENCE)
    flagged = normalize.direct_with_signals(utterances, rules)
    if interpretations is not None:
        flagged = flagged.unionByName(normalize.with_cue_signals(interpretations.select(*EVIDENCE), rules))
    # Records move once, before they are split: their clauses then meet where they are, and meet their repeats there.
    repeats = normalize.repeated_sources(utterances)

    def told(structured: DataFrame) -> DataFrame:
        return extract.with_repeats(extract.mentions(structured), repeats)

    said = told(extract.structure(extract.clauses(flagged.repartition("project_id", "source_id"), rules), rules))
    return said if tools is None else said.unionByName(told(extract.tool_claims(tools).repartition("project_id", "source_id")))


def scored_claims(bridge: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    return score.tool_only(score.score(extract.claims(bridge), scoring))


def settled(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """Written claims after the review of their conflicts. Claims in no conflict are not shuffled; those that may be in one are
    written, as all that follows reads them many times."""
    sides = key_filter(resolved.select(F.explode(F.array("item_a", "item_b")).alias("item_id")), "item_id")
    touched, others = apart(items, (sides, F.col("item_id")))
    some = conflicts.apply_supersession(touched, resolved)
    held = conflicts.held_sides(resolved, some).unionByName(conflicts.conditional_sides(resolved).select("item_id"))
    others = others.withColumn("superseded_by", F.lit(None).cast("string")).withColumn("supersedes", F.array().cast("array<string>"))
    return cut(score.inclusion(some, held), "settled").unionByName(score.inclusion(others))


def govern_items(items: DataFrame, bridge: DataFrame, policy: Policy = Policy(), resolved: DataFrame | None = None) -> Governed:
    """Conflicts, duplicates and decisions over given claims."""
    found = conflicts.detect_conflicts(items) if resolved is None else resolved
    held = conflicts.held_sides(found, items)
    if "blocks_world_state" in found.columns:
        held = held.unionByName(conflicts.conditional_sides(found).select("item_id"))
    items = score.inclusion(items, held)
    dups = cluster.duplicates(items)
    return Governed(bridge, items, found, dups, gate.gate(items, policy, found, dups), policy)


def govern(
    utterances: DataFrame,
    tools: DataFrame | None = None,
    interpretations: DataFrame | None = None,
    rules: Rules = DEFAULT_RULES,
    policy: Policy = Policy(),
    scoring: Scoring = Scoring(),
    accepted: DataFrame | None = None,
    passages: DataFrame | None = None,
) -> Governed:
    """Evidence of many projects at once to bridge, claims, conflicts and decisions.

    The bridge and the claims are written once, as everything after reads
    them several times.
    """
    bridge = cut(evidence_bridge(utterances, rules, tools, interpretations, passages), "bridge")
    items = scored_claims(bridge, scoring)
    if accepted is not None:
        items = items.unionByName(accepted, allowMissingColumns=True)
    return govern_items(cut(items, "items"), bridge, policy)


def admission_report(decisions: DataFrame) -> DataFrame:
    """Which claims each project admits, and why the others were blocked."""
    return decisions.select(
        "project_id",
        "item_id",
        "source_type",
        "status",
        "scope",
        "subject",
        "predicate",
        "object_key",
        "modality",
        "confidence",
        "evidence_count",
        "allowed",
        F.array_join("reasons", ",").alias("reasons"),
    )
