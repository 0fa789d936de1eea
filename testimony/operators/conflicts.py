"""Contradictions between claims, and what is done about them.

Claims are unique per (slot, modality, source kind), so a slot has at most
modalities x sources of them and its pairs are bounded by a constant; how
often records repeat a claim does not add pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import apart, key_filter
from testimony.functions.text import digest, quoted
from testimony.rules import AUTHORITY, OPPOSITION

ACTIVE = ("candidate", "accepted")
SLOT_KEYS = ("project_id", "scope", "subject", "predicate", "object_key")


def authority(source: str) -> Column:
    whens = " ".join(f"WHEN {quoted(name)} THEN {level}" for name, level in AUTHORITY.items())
    return F.expr(f"CASE {source} {whens} ELSE 0 END")


def negative_of(modality: Column) -> Column:
    """The negative modalities a positive one contradicts."""
    opposed: dict[str, list[str]] = {}
    for negative, positives in OPPOSITION:
        for positive in positives:
            opposed.setdefault(positive, []).append(negative)
    chain = None
    for positive, negatives in opposed.items():
        value = F.array(*[F.lit(n) for n in negatives])
        chain = F.when(modality == positive, value) if chain is None else chain.when(modality == positive, value)
    return chain


def _party(source: str) -> Column:
    names = {"user_utterance": "user", "tool_evidence": "tool", "agent_interpretation": "agent", "proposed_update": "accepted", "manual_initialization": "accepted"}
    whens = " ".join(f"WHEN {quoted(name)} THEN {quoted(label)}" for name, label in names.items())
    return F.expr(f"CASE {source} {whens} ELSE 'other' END")


def detect_conflicts(items: DataFrame, temporal: bool = False) -> DataFrame:
    """Opposing claims on one slot, with type, severity and suggested side.

    Negative claims meet positive ones by an equi-join on slot and opposed
    modality. With ``temporal``, their validity must overlap. Slots are first told by a hash: claims of those with
    one side only are not shuffled.
    """
    live = items.where(F.col("status").isin(*ACTIVE))
    sides = {"n": [n for n, _ in OPPOSITION], "p": [p for _, ps in OPPOSITION for p in ps]}
    told = live.groupBy(F.xxhash64(*SLOT_KEYS).alias("__slot")).agg(*[F.max(F.col("modality").isin(*m)).alias(side) for side, m in sides.items()])
    live, _ = apart(live, (key_filter(told.where("n and p"), "__slot"), F.xxhash64(*SLOT_KEYS)))
    if temporal:
        cols = ["item_id", "source_type", "status", "modality", "valid_from", "valid_until"]
    else:
        cols = ["item_id", "source_type", "status", "modality"]
    neg = live.where(F.col("modality").isin(*[n for n, _ in OPPOSITION]))
    neg = neg.select(*SLOT_KEYS, *[F.col(c).alias(f"n_{c}") for c in cols], F.col("modality").alias("opposed"))
    pos = live.where(F.col("modality").isin(*[p for _, ps in OPPOSITION for p in ps]))
    pos = pos.select(*SLOT_KEYS, *[F.col(c).alias(f"p_{c}") for c in cols], F.explode(negative_of(F.col("modality"))).alias("opposed"))
    pairs = neg.join(pos, [*SLOT_KEYS, "opposed"])
    if temporal:
        never = F.lit("9999-12-31").cast("timestamp")
        pairs = pairs.where((F.col("n_valid_from") < F.coalesce("p_valid_until", never)) & (F.col("p_valid_from") < F.coalesce("n_valid_until", never)))
    n_auth, p_auth = authority("n_source_type"), authority("p_source_type")
    n_party, p_party = _party("n_source_type"), _party("p_source_type")
    kind = (
        F.when((F.col("n_status") == "accepted") & (F.col("p_status") == "candidate") | (F.col("n_status") == "candidate") & (F.col("p_status") == "accepted"), "old_vs_new")
        .when(n_auth >= p_auth, F.concat_ws("_vs_", n_party, p_party))
        .otherwise(F.concat_ws("_vs_", p_party, n_party))
    )
    base = F.when(F.col("p_modality") == "must", 90).when(F.col("p_modality") == "is", 85).otherwise(80)
    a, b = F.least("n_item_id", "p_item_id"), F.greatest("n_item_id", "p_item_id")
    return pairs.select(
        "project_id",
        digest(F.lit("conflict"), a, b).alias("conflict_id"),
        *SLOT_KEYS[1:],
        a.alias("item_a"),
        b.alias("item_b"),
        kind.alias("type"),
        F.least(F.lit(100), base + F.abs(n_auth - p_auth)).cast("int").alias("severity"),
        F.lit("unresolved").alias("resolution"),
        F.when(n_auth > p_auth, F.col("n_item_id")).when(p_auth > n_auth, F.col("p_item_id")).otherwise("").alias("chosen_side"),
        F.concat_ws(" ", F.col("n_modality"), F.lit("against"), F.col("p_modality"), F.lit("on"), F.col("object_key")).alias("description"),
    )


def new_conflicts(found: DataFrame, stored: DataFrame) -> DataFrame:
    return found.join(stored.select("conflict_id"), "conflict_id", "left_anti")


def incremental_conflicts(new_items: DataFrame, stored_items: DataFrame) -> DataFrame:
    """Conflicts that involve a new claim; only the slots of new claims are read."""
    slots = new_items.select(*SLOT_KEYS).distinct()
    affected = stored_items.join(slots, list(SLOT_KEYS), "left_semi").join(new_items.select("item_id"), "item_id", "left_anti")
    both = new_items.unionByName(affected, allowMissingColumns=True)
    found = detect_conflicts(both)
    fresh = new_items.select(F.col("item_id").alias("side"))
    touched = found.select("conflict_id", F.explode(F.array("item_a", "item_b")).alias("side")).join(fresh, "side", "left_semi").select("conflict_id").distinct()
    return found.join(touched, "conflict_id", "left_semi")


def backlog(conflicts: DataFrame) -> DataFrame:
    band = F.when(F.col("severity") >= 90, "critical").when(F.col("severity") >= 80, "high").otherwise("low")
    return conflicts.where(F.col("resolution") == "unresolved").groupBy("project_id", "type", band.alias("band")).agg(F.count(F.lit(1)).alias("conflicts"))


def open_sides(conflicts: DataFrame, min_severity: int = 0) -> DataFrame:
    """Ids that unresolved or deferred conflicts hold back."""
    held = conflicts.where(((F.col("resolution") == "unresolved") & (F.col("severity") >= min_severity)) | (F.col("resolution") == "deferred"))
    return held.select(F.explode(F.array("item_a", "item_b")).alias("item_id")).distinct()


def unsettled_sides(conflicts: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of both sides of conflicts that were marked as resolved without a choice, while both claims are active: until one
    of them goes, neither may enter the state."""
    marked = conflicts.where(F.col("resolution_type") == "mark_resolved").select("conflict_id", F.explode(F.array("item_a", "item_b")).alias("item_id"))
    active = apart(items.where(F.col("status").isin(*ACTIVE)).select("item_id"), (key_filter(marked, "item_id"), F.col("item_id")))[0]
    live = marked.join(active, "item_id", "left_semi")
    both = live.groupBy("conflict_id").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a <> b")
    return both.select(F.explode(F.array("a", "b")).alias("item_id")).distinct()


def held_sides(conflicts: DataFrame, items: DataFrame, min_severity: int = 0) -> DataFrame:
    """Ids that open conflicts hold back, and ones that were closed without a choice."""
    held = open_sides(conflicts, min_severity)
    return held.unionByName(unsettled_sides(conflicts, items)).distinct() if "resolution_type" in conflicts.columns else held


def conditional_sides(conflicts: DataFrame) -> DataFrame:
    held = conflicts.where(F.col("blocks_world_state"))
    sides = held.select(F.explode(F.array("item_a", "item_b")).alias("item_id"), "conflict_id", "condition")
    return sides.groupBy("item_id").agg(F.min(F.struct("conflict_id", "condition")).alias("m")).select("item_id", "m.conflict_id", "m.condition")


def resolve(conflicts: DataFrame, actions: DataFrame) -> DataFrame:
    """Conflicts after the last action on each; untouched ones stay as they are.

    ``actions`` has conflict_id, action, condition, reason, seq.
    """
    last = actions.groupBy("conflict_id").agg(F.max(F.struct("seq", "action", "condition", "reason")).alias("act")).select("conflict_id", "act")
    out = conflicts.join(last, "conflict_id", "left")
    act = F.col("act.action")
    picked = act.isin("choose-a", "choose-b")
    chosen = F.when(act == "choose-a", F.col("item_a")).when(act == "choose-b", F.col("item_b"))
    chosen = chosen.when(act.isin("coexist-by-condition", "defer", "mark-resolved"), "").otherwise(F.col("chosen_side"))
    return (
        out.withColumn("resolution", F.when(act == "defer", "deferred").when(act.isNotNull(), "resolved").otherwise(F.col("resolution")))
        .withColumn("resolution_type", F.when(act.isNull(), "").otherwise(F.regexp_replace(act, "-", "_")))
        .withColumn("chosen_side", chosen)
        .withColumn("loser", F.when(act == "choose-a", F.col("item_b")).when(act == "choose-b", F.col("item_a")).otherwise(""))
        .withColumn("superseding", F.coalesce(picked, F.lit(False)))
        .withColumn("condition", F.when(act == "coexist-by-condition", F.coalesce("act.condition", F.lit(""))).otherwise(""))
        .withColumn("blocks_world_state", F.coalesce(act == "coexist-by-condition", F.lit(False)))
        .withColumn("reason", F.coalesce("act.reason", F.lit("")))
        .drop("act")
    )


def supersessions(resolved: DataFrame) -> DataFrame:
    """(winner, loser) of every conflict settled by choosing a side."""
    return resolved.where(F.col("superseding")).select("project_id", F.col("chosen_side").alias("winner"), "loser").distinct()


def apply_supersession(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """Losers become superseded and are never included; winners list their losers."""
    pairs = supersessions(resolved)
    lost = pairs.groupBy(F.col("loser").alias("item_id")).agg(F.min("winner").alias("superseded_by"))
    won = pairs.groupBy(F.col("winner").alias("item_id")).agg(F.array_sort(F.collect_set("loser")).alias("__won"))
    out = items.join(lost, "item_id", "left").join(won, "item_id", "left")
    old = F.col("supersedes") if "supersedes" in items.columns else F.array().cast("array<string>")
    out = out.withColumn("supersedes", F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce("__won", F.array().cast("array<string>")))))
    out = out.withColumn("status", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")))
    if "include_in_world_state" in items.columns:
        out = out.withColumn("include_in_world_state", F.col("include_in_world_state") & (F.col("status") != "superseded"))
    return out.drop("__won")


def mutual_supersessions(pairs: DataFrame) -> DataFrame:
    """Two claims that supersede each other: actions to be looked at."""
    back = pairs.select(F.col("winner").alias("loser"), F.col("loser").alias("winner"))
    return pairs.join(back, ["winner", "loser"], "left_semi").where(F.col("winner") < F.col("loser"))


def with_conditional_block(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """Marks both sides of a conditional coexistence; neither loses its status."""
    sides = conditional_sides(resolved).select("item_id", F.struct("conflict_id", "condition", F.lit(True).alias("blocks_world_state")).alias("conditional_conflict_block"))
    return items.drop("conditional_conflict_block").join(sides, "item_id", "left")


def with_audit(resolved: DataFrame) -> DataFrame:
    """Audit summary of each settled conflict."""
    both = resolved.withColumn("__super", F.when(F.col("superseding"), F.array("loser")).otherwise(F.array().cast("array<string>")))
    held = F.col("blocks_world_state") | (F.col("resolution") == "deferred")
    status = F.map_from_entries(
        F.array(
            F.struct(F.col("item_a").alias("k"), (held | (F.col("item_a") == F.col("loser"))).alias("v")),
            F.struct(F.col("item_b").alias("k"), (held | (F.col("item_b") == F.col("loser"))).alias("v")),
        )
    )
    summary = F.struct(
        F.col("resolution_type").alias("action"),
        F.col("chosen_side").alias("chosen"),
        F.col("loser"),
        F.col("condition"),
        F.col("__super").alias("supersedes"),
        status.alias("blocked_status"),
    )
    return both.withColumn("audit_summary", F.when(F.col("resolution_type") != "", summary)).drop("__super")


def cluster_conflicts(conflicts: DataFrame) -> DataFrame:
    """One cluster per contested slot. A slot's claims are few, so its id list is short."""
    grouped = conflicts.groupBy(*SLOT_KEYS).agg(
        F.count(F.lit(1)).alias("member_count"),
        F.count_if((F.col("chosen_side") != "") & (F.col("resolution") == "unresolved")).alias("suggested_count"),
        F.max("severity").alias("max_severity"),
        F.collect_set("item_a").alias("__a"),
        F.collect_set("item_b").alias("__b"),
    )
    out = grouped.withColumn("cluster_id", digest(F.lit("conflict_cluster"), *SLOT_KEYS))
    return out.withColumn("cognition_ids", F.array_sort(F.array_union("__a", "__b"))).drop("__a", "__b")


def review_actions(conflicts: DataFrame, cluster_actions: DataFrame) -> DataFrame:
    """Cluster-level decisions turned into one action per unresolved conflict.

    ``cluster_actions`` has cluster_id, action (apply-suggested or defer),
    reason, seq. A conflict without a suggestion is skipped by apply-suggested.
    """
    keyed = conflicts.where(F.col("resolution") == "unresolved").withColumn("cluster_id", digest(F.lit("conflict_cluster"), *SLOT_KEYS))
    out = keyed.join(cluster_actions, "cluster_id")
    suggested = F.col("action") == "apply-suggested"
    act = (
        F.when(F.col("action") == "defer", "defer")
        .when(suggested & (F.col("chosen_side") == F.col("item_a")), "choose-a")
        .when(suggested & (F.col("chosen_side") == F.col("item_b")), "choose-b")
    )
    return out.select("project_id", "cluster_id", "conflict_id", F.col("action").alias("cluster_action"), act.alias("action"), F.lit("").alias("condition"), "reason", "seq")


def review_counts(per_conflict: DataFrame) -> DataFrame:
    return per_conflict.groupBy("project_id", "cluster_id", "cluster_action").agg(
        F.count_if(F.col("action").isNotNull()).alias("reviewed_count"), F.count_if(F.col("action").isNull()).alias("skipped_count")
    )


def conflict_volume(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Contradicting pairs per slot, counted without building any pair."""
    n = F.lit(1) if weight is None else weight
    used = sorted({m for neg, ps in OPPOSITION for m in (neg, *ps)})
    counts = rows.groupBy(*SLOT_KEYS).agg(*[F.sum(F.when(F.col("modality") == m, n).otherwise(0)).cast("long").alias(f"n_{m}") for m in used])
    pairs = None
    for negative, positives in OPPOSITION:
        for positive in positives:
            term = F.col(f"n_{negative}") * F.col(f"n_{positive}")
            pairs = term if pairs is None else pairs + term
    return counts.withColumn("pairs", pairs).where(F.col("pairs") > 0)


def valid_as_of(items: DataFrame, moment: Column) -> DataFrame:
    return items.where((F.col("valid_from") <= moment) & (F.col("valid_until").isNull() | (F.col("valid_until") > moment)))
