"""Integrity of the governed tables: references, drift, orphans, upgrades, checksums, schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut, join_few
from testimony.functions.text import any_term, drop_forms, forms_of, with_forms
from testimony.operators.cluster import duplicate_ratio
from testimony.operators.normalize import utterance_intent
from testimony.rules import READ_CUES, Rules

# Drift failures that stop a run.
HARD_FAILURES = ("stale_rule_revived", "assistant_only_entered_core", "ungoverned_candidate_entered_core")


def references(df: DataFrame, table: str, row_id: str, field: str, target: str) -> DataFrame:
    """(project_id, table, row_id, field, target, ref) rows of one reference column, scalar or array."""
    is_array = df.schema[field].dataType.typeName() == "array"
    ref = F.explode(F.col(field).cast("array<string>")) if is_array else F.col(field).cast("string")
    project = F.col("project_id") if "project_id" in df.columns else F.lit("")
    names = [F.lit(table).alias("table"), F.col(row_id).cast("string").alias("row_id"), F.lit(field).alias("field"), F.lit(target).alias("target")]
    return df.select(project.alias("project_id"), *names, ref.alias("ref")).where(F.col("ref").isNotNull() & (F.col("ref") != ""))


def dangling_refs(refs: Sequence[DataFrame], ids: Mapping[str, DataFrame]) -> DataFrame:
    """References to ids that do not exist, over all tables: (project_id, table, row_id, field, missing_id).

    References are written once. One aggregate marks every id that is referred to, that exists, or both: an id that
    very many rows mention is one row of it, and only missing ones go back to their rows.
    """
    every = cut(reduce(DataFrame.unionByName, refs), "references")
    known = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("target"), F.col(df.columns[0]).cast("string").alias("ref"), F.lit(True).alias("exists")) for name, df in ids.items()])
    marks = every.select("target", "ref", F.lit(False).alias("exists")).unionByName(known).groupBy("target", "ref").agg(F.max("exists").alias("exists"))
    missing = cut(marks.where(~F.col("exists")).select("target", "ref"), "missing-ids")
    return every.join(missing, ["target", "ref"]).select("project_id", "table", "row_id", "field", F.col("ref").alias("missing_id"))


def hard_failures(items: DataFrame) -> DataFrame:
    """(project_id, item_id, failure) of included claims that must never be."""
    inside = items.where(F.col("include_in_world_state"))
    checks = (
        F.when(F.col("status").isin("superseded", "rejected"), F.lit(HARD_FAILURES[0])),
        F.when(F.col("source_type").isin("agent_interpretation", "assistant_output"), F.lit(HARD_FAILURES[1])),
        F.when((F.col("status") == "candidate") & (F.col("source_type") != "agent_interpretation"), F.lit(HARD_FAILURES[2])),
    )
    return inside.select("project_id", "item_id", F.explode(F.array_compact(F.array(*checks))).alias("failure"))


def metric_rows(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Wide per-project columns as (project_id, metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(col).cast("long").alias("value")) for name, col in values.items()])
    return df.select("project_id", F.explode(pairs).alias("m")).select("project_id", "m.metric", "m.value")


def drift_report(items: DataFrame, conflicts: DataFrame, decisions: DataFrame, clusters: DataFrame, state: DataFrame, dangling: DataFrame | None = None, high: int = 90) -> DataFrame:
    """Long-form drift metrics of every project. A run is ok without hard failures.

    Each kind of metric, a few rows a project, is written as it is made: one plan over all of them would hold the items' many times.
    """
    flags = [F.sum(F.when(F.col("failure") == f, 1).otherwise(0)).cast("long").alias(f) for f in HARD_FAILURES]
    per = items.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("source_type") == "user_utterance").alias("evidence_user"),
        F.count_if(F.col("source_type") == "tool_evidence").alias("evidence_tool"),
        F.count_if(F.col("source_type") == "agent_interpretation").alias("evidence_agent"),
    )
    gate = decisions.groupBy("project_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"))
    blocked = decisions.where(~F.col("allowed")).select("project_id", F.explode("reasons").alias("reason")).groupBy("project_id", "reason").agg(F.count(F.lit(1)).alias("value"))
    repeated = duplicate_ratio(items).withColumn("permille", F.floor(1000 * F.col("duplicate_candidates") / F.col("active_items")))
    out = metric_rows(per, {"items": "items", "evidence_mix_user": "evidence_user", "evidence_mix_tool": "evidence_tool", "evidence_mix_agent": "evidence_agent"})
    parts = [
        metric_rows(hard_failures(items).groupBy("project_id").agg(*flags), {f: f for f in HARD_FAILURES}),
        metric_rows(gate, {"governance_allowed_count": "allowed", "governance_blocked_count": "blocked"}),
        metric_rows(clusters.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")), {"candidate_cluster_count": "n"}),
        metric_rows(
            conflicts.groupBy("project_id").agg(F.count_if((F.col("resolution") == "unresolved") & (F.col("severity") >= high)).alias("n")),
            {"unresolved_high_severity_conflicts": "n"},
        ),
        metric_rows(state, {"compact_characters": "compact_characters"}),
        metric_rows(repeated, {"duplicate_candidate_ratio_permille": "permille"}),
        blocked.select("project_id", F.concat(F.lit("governance_blocked_reason_counts."), "reason").alias("metric"), "value"),
    ]
    if dangling is not None:
        parts.append(metric_rows(dangling.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")), {"dangling_reference_errors": "n"}))
    return reduce(DataFrame.unionByName, [cut(part, "drift") for part in (out, *parts)])


def drift_ok(report: DataFrame) -> DataFrame:
    bad = F.col("metric").isin(*HARD_FAILURES) & (F.col("value") > 0)
    return report.groupBy("project_id").agg((F.count_if(bad) == 0).alias("ok"))


def split_orphans(items: DataFrame, bridge: DataFrame, evidence_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): a claim that had evidence and lost all of it moves aside."""
    live = bridge.select("item_id", "source_id").join(evidence_ids.select("source_id"), "source_id", "left_semi").select("item_id").distinct()
    had = bridge.select("item_id").distinct()
    orphans = had.join(live, "item_id", "left_anti")
    return items.join(orphans, "item_id", "left_anti"), items.join(orphans, "item_id", "left_semi")


def upgrade_utterances(utterances: DataFrame, rules: Rules) -> DataFrame:
    """Backfills the intent where it is missing."""
    out, forms = with_forms(utterances, "text")
    filled = F.coalesce(F.col("utterance_intent"), utterance_intent(F.col("text"), forms, rules))
    return drop_forms(out.withColumn("intent_backfilled", F.col("utterance_intent").isNull()).withColumn("utterance_intent", filled))


def upgrade_items(items: DataFrame, non_direct: DataFrame, version: str, cues: Sequence[str] = READ_CUES) -> DataFrame:
    """Legacy predicate fixed, non-direct claims taken out of the core, version stamped.

    ``non_direct`` has the ids of claims resting on quoted or foreign text.
    """
    legacy = (F.col("predicate") == "render") & any_term(forms_of("concat_ws(' ', claim, object)"), cues)
    # Read twice, so written; the texts are looked at before anything moves.
    side = cut(non_direct.select("item_id").distinct().withColumn("__foreign", F.lit(True)), "foreign")
    out = join_few(items.withColumn("predicate_fixed", legacy), side, "item_id")
    out = out.withColumn("core_cleared", F.coalesce(F.col("__foreign"), F.lit(False)) & F.col("include_in_world_state"))
    return (
        out.withColumn("predicate", F.when(F.col("predicate_fixed"), "read_source").otherwise(F.col("predicate")))
        .withColumn("include_in_world_state", F.col("include_in_world_state") & F.col("__foreign").isNull())
        .withColumn("state_schema_version", F.lit(version))
        .drop("__foreign")
    )


def upgrade_report(utterances: DataFrame, items: DataFrame) -> DataFrame:
    """Pending changes per project, from the flags of the two upgrades."""
    a = utterances.groupBy("project_id").agg(F.count_if("intent_backfilled").alias("user_utterance_intents_backfilled"))
    b = items.groupBy("project_id").agg(F.count_if("predicate_fixed").alias("predicates_fixed"), F.count_if("core_cleared").alias("core_flags_cleared"))
    out = a.join(b, "project_id", "full_outer").na.fill(0)
    total = F.col("user_utterance_intents_backfilled") + F.col("predicates_fixed") + F.col("core_flags_cleared")
    return out.withColumn("needs_upgrade", total > 0)


def checksum(df: DataFrame, table: str, cols: Sequence[str]) -> DataFrame:
    """Row count and order-free content sum per project of one table."""
    parts = [F.coalesce(F.array_join(c, ",") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string"), F.lit("")) for c in cols]
    value = F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    out = df.groupBy("project_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(value).cast("decimal(38,0)").alias("content_sum"))
    return out.select(F.lit(table).alias("table"), "project_id", "rows", "content_sum")


def changed_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables and projects whose content differs between two snapshots."""
    old = before.select("table", "project_id", F.col("rows").alias("old_rows"), F.col("content_sum").alias("old_sum"))
    new = after.select("table", "project_id", F.col("rows").alias("new_rows"), F.col("content_sum").alias("new_sum"))
    both = old.join(new, ["table", "project_id"], "full_outer")
    return both.where(~(F.col("old_rows").eqNullSafe(F.col("new_rows")) & F.col("old_sum").eqNullSafe(F.col("new_sum"))))


def schema_violations(df: DataFrame, table: str, row_id: Column, required: Sequence[str] = (), enums: Mapping[str, Sequence[str]] | None = None, ranges: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """(table, row_id, rule) for missing, unknown or out-of-range values. A null is not one of an enum's values; where the
    column is required as well, it is only missing."""
    checks = [(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"{c}_missing") for c in required]
    checks += [(F.coalesce(~F.col(c).isin(*values), F.lit(c not in required)), f"{c}_not_in_enum") for c, values in (enums or {}).items()]
    checks += [(~F.col(c).between(lo, hi), f"{c}_out_of_range") for c, (lo, hi) in (ranges or {}).items()]
    rules = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in checks]))
    return df.select(F.lit(table).alias("table"), row_id.cast("string").alias("row_id"), F.explode(rules).alias("rule"))
