"""One query per operator, over the driver's whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import sentences
from contract.lift import OPEN, PROSE_RULES, STRICT, Lift
from testimony.functions.scale import among, checkpoint_root, cut
from testimony.functions.text import digest
from testimony.operators import (
    cluster,
    conflicts,
    context,
    extract,
    feedback,
    gate,
    index_store,
    integrity,
    lookup,
    normalize,
    profile,
    review,
    rulechange,
    score,
    state,
)
from testimony.rules import DEFAULT_RULES, Policy
from testimony.sources import runlog

Query = Callable[[SparkSession, str], DataFrame]
OVER_LIFT: dict[str, Callable[[Lift], DataFrame]] = {}
REGISTRY: dict[str, Query] = {}
R = PROSE_RULES
RULESET_HASH = "prose-rules-1"


def query(fn: Callable[[Lift], DataFrame]) -> Callable[[Lift], DataFrame]:
    OVER_LIFT[fn.__name__] = fn
    REGISTRY[fn.__name__] = lambda spark, sf_dir: fn(Lift(spark, sf_dir))
    return fn


def joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


def long(col: Column, name: str) -> Column:
    return col.cast("long").alias(name)


# ---------------------------------------------------------------- sources


@query
def transcript_scan(L: Lift) -> DataFrame:
    c = L.conversations
    return c.select("project_id", "session_id", "turn", "role", long(F.length("content"), "content_chars"), F.sha2("content", 256).alias("content_sha"))


@query
def route_user(L: Lift) -> DataFrame:
    return normalize.route_by_role(L.conversations)["user"].select("project_id", "session_id", "turn", F.col("content").alias("text"))


@query
def route_assistant_log(L: Lift) -> DataFrame:
    log = normalize.route_by_role(L.conversations)["assistant_log"]
    return log.groupBy("project_id", "session_id").agg(F.count(F.lit(1)).alias("logged_turns"), F.sum(F.length("content")).alias("logged_chars"))


@query
def ingest_counts(L: Lift) -> DataFrame:
    return normalize.ingest_counts(L.lines)


@query
def ingest_dedup(L: Lift) -> DataFrame:
    """First copy of every text of a project, not counting texts already told in a conversation."""
    docs = L.documents.withColumn("record_id", digest("project_id", normalize.text_key(F.col("text"))))
    kept = normalize.dedup_records(docs.select("record_id", "project_id", "source_id", "doc_id"), order="doc_id")
    return kept.select("project_id", "source_id", "record_id")


def _raw_lines(L: Lift) -> DataFrame:
    """Conversation lines as an agent host would log them: with injected blocks around some turns."""
    c, turn = L.conversations, F.col("turn")
    head = F.concat(F.lit("[PROJECT_STATE]\nrules of "), "project_id", F.lit("\n</PROJECT_STATE>\n"), "content")
    tail = F.concat("content", F.lit("\n<!-- HOST_USER_PROFILE_BEGIN -->\nlikes "), "role", F.lit("\n<!-- HOST_USER_PROFILE_END -->\n"))
    content = F.when(turn % 3 == 0, head).when(turn % 3 == 1, tail).otherwise(F.col("content"))
    return c.select("project_id", F.concat(F.lit("conv #"), F.col("conv_id").cast("string")).alias("session_id"), "turn", "role", content.alias("content"))


@query
def clean_evidence(L: Lift) -> DataFrame:
    out = normalize.clean_evidence(_raw_lines(L), field_limit=400)
    return out.select("project_id", F.col("clean_session_id").alias("session_id"), "turn", "turn_id", "clean_content", "log_content", "injected_removed", "field_capped", "session_rewritten")


@query
def clean_report(L: Lift) -> DataFrame:
    return normalize.clean_report(normalize.clean_evidence(_raw_lines(L), field_limit=400))


@query
def run_summary(L: Lift) -> DataFrame:
    s = runlog.summarize_runs(L.run_logs, tail_chars=40)
    return s.select(
        "run_id",
        "kind",
        F.col("summary.hook").alias("hook"),
        F.col("summary.session_id").alias("session_id"),
        F.col("summary.step_count").alias("step_count"),
        F.col("summary.conflict_clusters.total_conflicts").alias("total_conflicts"),
        F.col("summary.conflict_clusters.cluster_count").alias("cluster_count"),
        F.col("summary.evidence_index.segment_count").alias("segment_count"),
        F.col("summary.evidence_index.skipped").alias("skipped"),
        F.col("summary.drift.ok").alias("drift_ok"),
        "raw_stdout_chars",
        "stdout_tail",
        "stdout_type",
    )


@query
def backfill_ingest(L: Lift) -> DataFrame:
    """Old transcripts added to what the first turns already brought in; repeats are not added again."""
    lines = L.conversations.withColumn("record_id", digest("project_id", "session_id", "role", F.sha2("content", 256)))
    stored = lines.where(F.col("turn") == 0).select("record_id").distinct()
    fresh = normalize.dedup_records(lines.select("record_id", "project_id", "session_id", "turn", "role"), stored, order="turn")
    return fresh.groupBy("project_id", "role").agg(F.count(F.lit(1)).alias("records_added"), F.countDistinct("session_id").alias("sessions"))


# ---------------------------------------------------------- normalisation


@query
def tool_evidence_kind(L: Lift) -> DataFrame:
    return L.tool_evidence.select("project_id", "source_id", "source_log_id", "evidence_kind", "deterministic", "outcome", "content_summary")


def _about_suppliers(L: Lift, templates: tuple[tuple[str | None, ...], ...]) -> DataFrame:
    """(s_suppkey, number, text, more) for each template and supplier."""
    rows = [F.struct(F.lit(i).alias("number"), F.lit(t).alias("template")) for i, t in enumerate(templates)]
    out = L.table("supplier").select("s_suppkey", "s_name", F.explode(F.array(*rows)).alias("r"))
    return out.select("s_suppkey", "r.number", F.replace(F.col("r.template"), F.lit("{}"), F.col("s_name")).alias("text"))


@query
def default_labels(L: Lift) -> DataFrame:
    """The default rules on clauses of which the labels are known."""
    said = _about_suppliers(L, tuple(c[0] for c in sentences.CLAUSES)).withColumn("source_type", F.lit("user_utterance"))
    found = extract.structure(extract.clauses(said, DEFAULT_RULES), DEFAULT_RULES)
    known = F.when(F.col("object_key").isin(*{c[3] for c in sentences.CLAUSES if c[3]}), F.col("object_key"))
    return found.select("s_suppkey", "number", "pos", "predicate", "modality", known.alias("object_key"))


@query
def default_intents(L: Lift) -> DataFrame:
    said = _about_suppliers(L, tuple(c[0] for c in sentences.UTTERANCES))
    return normalize.with_intent(said, DEFAULT_RULES).select("s_suppkey", "number", "utterance_intent")


@query
def default_outcomes(L: Lift) -> DataFrame:
    said = _about_suppliers(L, tuple(c[1] for c in sentences.OUTPUTS))
    tool = F.element_at(F.array(*[F.lit(c[0]) for c in sentences.OUTPUTS]), F.col("number") + 1)
    found = normalize.classify_tools(said.select("s_suppkey", "number", tool.alias("name"), F.col("text").alias("content")))
    return found.select("s_suppkey", "number", "evidence_kind", "outcome")


@query
def utterance_intent(L: Lift) -> DataFrame:
    return normalize.with_intent(L.utterances, R).select("project_id", "source_id", "utterance_intent")


@query
def utterance_signals(L: Lift) -> DataFrame:
    return normalize.with_signals(L.utterances, R).select("project_id", "source_id", *normalize.SIGNALS, "importance_score")


@query
def topic_links(L: Lift) -> DataFrame:
    return normalize.with_topics(L.utterances, R).select("project_id", "source_id", joined("linked_topics"))


@query
def intent_filter_counts(L: Lift) -> DataFrame:
    """Utterances and extracted clauses per intent: only direct ones yield any."""
    u = normalize.with_intent(L.utterances, R)
    seen = u.groupBy("utterance_intent").agg(F.count(F.lit(1)).alias("utterances"))
    said = extract.clauses(normalize.direct_only(u), R).groupBy("utterance_intent").agg(F.count(F.lit(1)).alias("clauses"))
    return seen.join(said, "utterance_intent", "left").select("utterance_intent", "utterances", F.coalesce("clauses", F.lit(0)).alias("clauses"))


@query
def agent_only_blocked(L: Lift) -> DataFrame:
    d = L.decisions.where(F.col("source_type") == "agent_interpretation")
    return d.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("agent_items"),
        F.count_if("allowed").alias("allowed"),
        F.count_if(F.array_contains("reasons", "agent_only_evidence")).alias("agent_only"),
        F.max("confidence").alias("max_confidence"),
    )


@query
def external_overlap(L: Lift) -> DataFrame:
    return normalize.external_overlap(L.utterances, L.table("benchmark"))


# ------------------------------------------------------------- extraction


@query
def clause_split(L: Lift) -> DataFrame:
    return extract.clauses(L.utterances.select("source_id", "text"), R)


def _structured(L: Lift) -> DataFrame:
    return extract.structure(extract.clauses(L.utterances.select("project_id", "source_id", "source_type", "text"), R), R)


@query
def predicate_label(L: Lift) -> DataFrame:
    return _structured(L).select("source_id", "pos", "predicate")


@query
def object_key(L: Lift) -> DataFrame:
    return _structured(L).select("source_id", "pos", "object", "object_key")


@query
def modality_counts(L: Lift) -> DataFrame:
    s = _structured(L).withColumn("category", extract.category())
    return s.groupBy("project_id", "scope", "subject", "category", "modality").agg(F.count(F.lit(1)).alias("clauses"))


@query
def structured_claims(L: Lift) -> DataFrame:
    c = extract.claims(L.bridge)
    return c.select(
        *("project_id", "item_id", "slot_id", "scope", "subject", "predicate", "object", "object_key", "modality", "category", "claim", "source_type", "status"),
        "evidence_count",
        "mention_count",
        long(F.unix_timestamp("valid_from"), "valid_from"),
        long(F.unix_timestamp("last_verified"), "last_verified"),
        "confidence_reason",
    )


@query
def claim_evidence(L: Lift) -> DataFrame:
    """The evidence bridge: which record supports which claim."""
    return L.bridge.select("item_id", "source_id", "session_id", "mention_count", "repeated")


@query
def candidate_upsert(L: Lift) -> DataFrame:
    """Mentions found against claims added, where reviewed claims are stored already."""
    stored = L.reviews.select(F.substring("proposal_id", 6, 64).alias("item_id")).distinct()
    claims = extract.claims(L.bridge).select("project_id", "item_id", "mention_count")
    added = extract.new_claims(claims, stored).groupBy("project_id").agg(F.count(F.lit(1)).alias("candidates_added"))
    found = claims.groupBy("project_id").agg(F.sum("mention_count").cast("long").alias("candidate_count"), F.count(F.lit(1)).alias("claims"))
    return found.join(added, "project_id", "left").select("project_id", "candidate_count", "claims", F.coalesce("candidates_added", F.lit(0)).alias("candidates_added"))


@query
def tool_candidates(L: Lift) -> DataFrame:
    m = extract.with_repeats(extract.mentions(extract.tool_claims(L.tool_evidence)), L.tool_evidence.select("project_id", "source_id", F.lit(False).alias("repeated")))
    return extract.claims(m).select("project_id", "item_id", "scope", "subject", "predicate", "object_key", "modality", "evidence_count", "deterministic")


# ---------------------------------------------------------------- scoring


@query
def score_candidates(L: Lift) -> DataFrame:
    return L.candidates.select("project_id", "item_id", "source_type", "confidence", joined("score_signals"))


@query
def inclusion_flags(L: Lift) -> DataFrame:
    return L.superseded.select("project_id", "item_id", "status", "confidence", "include_in_world_state")


@query
def tool_only_gate(L: Lift) -> DataFrame:
    return L.items.groupBy("project_id", "source_type").agg(F.count(F.lit(1)).alias("items"), F.count_if("requires_governance_gate_for_world_state").alias("requires_gate"))


@query
def weight_shadow(L: Lift) -> DataFrame:
    return score.weight_shadow(L.scoring_feedback, L.weights)


@query
def weight_shadow_summary(L: Lift) -> DataFrame:
    return score.shadow_summary(L.scoring_feedback, score.weight_shadow(L.scoring_feedback, L.weights))


@query
def weight_apply(L: Lift) -> DataFrame:
    weights, marked = score.apply_weights(L.scoring_feedback, L.weights, score.weight_shadow(L.scoring_feedback, L.weights))
    applied = marked.agg(F.count_if("applied_to_weights").alias("feedback_applied")).scalar()
    return weights.select("signal", "weight", applied.alias("feedback_applied"))


@query
def confidence_rollup(L: Lift) -> DataFrame:
    return score.confidence_rollup(L.superseded)


# -------------------------------------------------------------- conflicts


@query
def detect_conflicts(L: Lift) -> DataFrame:
    return L.found


@query
def new_conflicts(L: Lift) -> DataFrame:
    """Conflicts that exist only since updates were accepted."""
    stored = conflicts.detect_conflicts(L.items.where(F.col("source_type") != "proposed_update"))
    new = conflicts.new_conflicts(L.found, stored)
    n = new.groupBy("project_id").agg(F.count(F.lit(1)).alias("new_conflicts"))
    total = L.found.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_conflicts"))
    return total.join(n, "project_id", "left").select("project_id", F.coalesce("new_conflicts", F.lit(0)).alias("new_conflicts"), "total_conflicts")


@query
def conflict_sides(L: Lift) -> DataFrame:
    return L.found.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("conflicts"), F.count_if(F.col("chosen_side") != "").alias("suggested"))


@query
def unresolved_conflicts(L: Lift) -> DataFrame:
    return conflicts.backlog(L.resolved)


@query
def resolve_conflicts(L: Lift) -> DataFrame:
    return L.resolved.select("project_id", "conflict_id", "resolution", "resolution_type", "chosen_side", "loser", "condition", "blocks_world_state", "reason")


@query
def apply_supersession(L: Lift) -> DataFrame:
    return conflicts.apply_supersession(L.items, L.resolved).select("project_id", "item_id", "status", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"), joined("supersedes"))


@query
def deferred_blocked(L: Lift) -> DataFrame:
    held = conflicts.open_sides(L.resolved.where(F.col("resolution") == "deferred"))
    items = L.superseded.join(held, "item_id", "left_semi")
    return items.select("project_id", "item_id", "status", "include_in_world_state")


@query
def conditional_coexist(L: Lift) -> DataFrame:
    out = conflicts.with_conditional_block(L.items, L.resolved).where(F.col("conditional_conflict_block").isNotNull())
    return out.select("project_id", "item_id", "status", "conditional_conflict_block.conflict_id", "conditional_conflict_block.condition", "conditional_conflict_block.blocks_world_state")


@query
def conflict_audit(L: Lift) -> DataFrame:
    a = conflicts.with_audit(L.resolved).where(F.col("audit_summary").isNotNull())
    return a.select(
        "conflict_id",
        "audit_summary.action",
        "audit_summary.chosen",
        "audit_summary.loser",
        "audit_summary.condition",
        F.array_join("audit_summary.supersedes", ",").alias("supersedes"),
        F.element_at("audit_summary.blocked_status", F.col("item_a")).alias("blocked_a"),
        F.element_at("audit_summary.blocked_status", F.col("item_b")).alias("blocked_b"),
    )


@query
def cluster_conflicts(L: Lift) -> DataFrame:
    return conflicts.cluster_conflicts(L.found).select("project_id", "cluster_id", "member_count", "suggested_count", "max_severity", joined("cognition_ids"))


def _cluster_actions(L: Lift) -> DataFrame:
    c = conflicts.cluster_conflicts(L.found).select("cluster_id")
    action = F.when(F.substring("cluster_id", 1, 1) < "8", "apply-suggested").otherwise("defer")
    return c.select("cluster_id", action.alias("action"), F.lit("cluster review").alias("reason"), F.lit(1).alias("seq"))


@query
def review_clusters(L: Lift) -> DataFrame:
    return conflicts.review_counts(conflicts.review_actions(L.found, _cluster_actions(L)))


@query
def cluster_review_result(L: Lift) -> DataFrame:
    acts = conflicts.review_actions(L.found, _cluster_actions(L)).where(F.col("action").isNotNull())
    done = conflicts.resolve(L.found, acts)
    return done.groupBy("project_id", "resolution", "resolution_type").agg(F.count(F.lit(1)).alias("conflicts"), F.count_if(F.col("loser") != "").alias("losers"))


@query
def conflict_volume(L: Lift) -> DataFrame:
    """Contradicting pairs of single mentions, counted per slot."""
    return conflicts.conflict_volume(L.bridge, F.col("mention_count"))


@query
def valid_as_of(L: Lift) -> DataFrame:
    """Conflicts between claims whose validity overlaps; unconfirmed claims lapse a day after their last record."""
    until = F.when(F.col("status") == "accepted", F.lit(None).cast("timestamp")).otherwise(F.col("last_verified") + F.expr("INTERVAL 1 DAY"))
    found = conflicts.detect_conflicts(L.items.withColumn("valid_until", until), temporal=True)
    return found.groupBy("project_id", "type").agg(F.count(F.lit(1)).alias("conflicts"))


# ------------------------------------------------------------- clustering


@query
def cluster_candidates(L: Lift) -> DataFrame:
    return cluster.clusters(L.items).select("project_id", "cluster_id", "member_count", "merge_mode", "updates_world_state", "governance_action")


@query
def cluster_representative(L: Lift) -> DataFrame:
    return cluster.clusters(L.items).select("project_id", "cluster_id", "representative_id", "representative_source")


@query
def cluster_duplicates(L: Lift) -> DataFrame:
    return cluster.duplicates(L.items).select("project_id", "cluster_id", "item_id", "representative_id", "member_count", "governance_action")


@query
def duplicate_ratio(L: Lift) -> DataFrame:
    return cluster.duplicate_ratio(L.items)


# ------------------------------------------------------------------- gate


@query
def gate_thresholds(L: Lift) -> DataFrame:
    p = Policy().overridden(min_confidence_user=96)
    t = gate.threshold(p)
    return L.items.groupBy("source_type", t.cast("int").alias("threshold")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("confidence") < t).alias("below"))


@query
def gate_decisions(L: Lift) -> DataFrame:
    return L.decided.select("project_id", "item_id", "constitutional_block", joined("reasons"))


@query
def gate_allowed(L: Lift) -> DataFrame:
    return L.decided.where(F.size("reasons") == 0).groupBy("project_id", "source_type", "status").agg(F.count(F.lit(1)).alias("allowed"))


@query
def gate_constitutional(L: Lift) -> DataFrame:
    """Accepted claims that a constitutional block keeps out all the same."""
    d = L.decided.where((F.col("status") == "accepted") & F.col("constitutional_block"))
    return d.select("project_id", "item_id", "confidence", joined("reasons"))


@query
def gate_budget(L: Lift) -> DataFrame:
    return L.decisions.select("project_id", "item_id", "allowed", joined("reasons"))


@query
def gate_by_policy(L: Lift) -> DataFrame:
    """The rows of each policy, a few a project, are written before the next is planned."""
    each = [gate.gate_summary(gate.gate_by_policy(L.governed, [p], L.resolved, L.duplicates)) for p in (Policy(), STRICT, OPEN)]
    return reduce(DataFrame.unionByName, [cut(d, "by-policy") for d in each])


def _project_policies(L: Lift) -> DataFrame:
    """A policy per project, with thresholds its own numbers of claims suggest; some are not valid."""
    per = L.documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    c = F.col("chars")
    return per.select(
        F.col("project_id").alias("policy_id"),
        (c % 120).cast("int").alias("min_confidence"),
        F.when(c % 5 == 0, F.lit(None).cast("int")).otherwise((c % 101).cast("int")).alias("min_confidence_user"),
        (c % 95).cast("int").alias("min_confidence_tool"),
        (c % 130 - 10).cast("int").alias("min_conflict_severity"),
        (c % 50 - 5).cast("int").alias("max_allowed"),
        (c % 20).cast("int").alias("max_per_category"),
        (c % 30 - 3).cast("int").alias("max_per_predicate"),
        (c % 40).cast("int").alias("max_per_slot"),
    )


@query
def policy_violations(L: Lift) -> DataFrame:
    return gate.policy_violations(_project_policies(L))


@query
def gate_reason_counts(L: Lift) -> DataFrame:
    return gate.reason_counts(L.decisions)


# ------------------------------------------------------------------ state


@query
def state_items(L: Lift) -> DataFrame:
    return state.state_items(L.governed, L.decisions).select("project_id", "item_id", "claim", "confidence")


@query
def state_fallback(L: Lift) -> DataFrame:
    """Without any gate output, accepted and included claims make the state."""
    return state.state_items(L.governed).groupBy("project_id").agg(F.count(F.lit(1)).alias("included"))


@query
def compact_items(L: Lift) -> DataFrame:
    return state.compact_items(L.admitted).select("project_id", "item_id", "rank", "confidence", "modality")


@query
def compact_lines(L: Lift) -> DataFrame:
    return state.fitted_lines(L.admitted, L.governed.select("project_id")).select("project_id", long(F.col("rank"), "rank"), "line", "running")


@query
def compact_state(L: Lift) -> DataFrame:
    return state.build_state(L.governed, L.admitted).select("project_id", "state", "structured_count", "characters", "compact_state", "compact_structured_count", "compact_characters", "included_count")


# ----------------------------------------------------------------- lookup


def _index(L: Lift) -> DataFrame:
    return lookup.evidence_index(L.records)


@query
def evidence_index(L: Lift) -> DataFrame:
    return _index(L).select("project_id", "source_id", "source_type", "preview", long(F.size("terms"), "terms"), "record_level", "chunked", "segment_index")


def _requested(L: Lift) -> DataFrame:
    """Ids that reviews ask for, whether or not they exist as records."""
    return L.table("labels").select(F.concat(F.lit("utt_"), F.col("doc_id").cast("string")).alias("source_id"))


@query
def lookup_by_id(L: Lift) -> DataFrame:
    return index_store.lookup_by_id(L.spark, L.index, _requested(L)).select("project_id", "source_id", "source_type", "preview")


def _queries(L: Lift) -> DataFrame:
    return L.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


@query
def lookup_terms(L: Lift) -> DataFrame:
    return index_store.lookup_terms(L.spark, L.index, _queries(L)).select("query_id", "source_id", "score", "shared_terms", long(F.col("rank"), "rank"))


@query
def ground_lookup(L: Lift) -> DataFrame:
    hits = index_store.lookup_terms(L.spark, L.index, _queries(L), k=1)
    out = lookup.ground(hits, index_store.stored(L.spark, L.index, "records"))
    return out.select("query_id", "source_id", "project_id", "source_type", long(F.length("text"), "full_chars"), F.sha2("text", 256).alias("text_sha"))


@query
def vector_index(L: Lift) -> DataFrame:
    v = lookup.vector_index(L.table("embeddings"))
    return v.select("vec_id", long(F.size("unit"), "dims"), F.round("norm", 6).alias("norm"), F.round(lookup.dot(F.col("unit"), F.col("unit")), 6).alias("unit_norm"), "record_level_no_split")


@query
def vector_topk(L: Lift) -> DataFrame:
    """The nearest records to the mean direction of every label."""
    e = L.table("embeddings")
    out = lookup.vector_topk(lookup.vector_index(e), lookup.centroids(e, "label"), k=10)
    return out.select(long(F.col("query_id"), "query_id"), "vec_id", "similarity", long(F.col("rank"), "rank"))


def _prints(L: Lift) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all records now, and of those the index was built from, which lacked one hour of events."""
    e = L.tool_evidence
    cols = ("source_id", "name", "content")
    late = (F.hour("ts") == 5) & (F.col("project_id") < "p5")
    return lookup.fingerprints(e, cols), lookup.fingerprints(e.where(~late), cols)


@query
def index_stale_projects(L: Lift) -> DataFrame:
    now, built = _prints(L)
    return lookup.stale_projects(now, built).select("project_id", "rows", F.col("content_sum").cast("string").alias("content_sum"))


@query
def index_refresh(L: Lift) -> DataFrame:
    """What a refresh does to an index of tool evidence that was built before some projects changed, came and went."""
    path = f"{checkpoint_root(L.spark)}/evidence-index-{uuid.uuid4().hex}"
    now = L.tool_evidence.select("project_id", "source_id", F.lit("tool_evidence").alias("source_type"), F.col("content").alias("text"), "ts")
    late = (F.hour("ts") == 5) & (F.col("project_id") < "p5")
    before = now.where(~late & (F.col("project_id") != "p9")).unionByName(now.where("project_id = 'p0'").withColumn("project_id", F.lit("gone")))
    index_store.refresh_index(before, path)
    report = index_store.refresh_index(now, path)
    held = index_store.stored(L.spark, path, "records").groupBy("project_id").agg(F.count(F.lit(1)).alias("records"), F.max("version").alias("version"))
    return report.join(held, "project_id", "left").select("project_id", "action", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("version", F.lit(0)).alias("version"))


@query
def index_projects(L: Lift) -> DataFrame:
    return index_store.index_report(L.spark, L.index)


@query
def index_stats(L: Lift) -> DataFrame:
    return lookup.index_stats(_index(L))


# ---------------------------------------------------------------- context


def _context(L: Lift) -> tuple[DataFrame, DataFrame, DataFrame]:
    relevant = cut(context.relevance(L.context_pool, L.tasks), "relevance")
    selected = cut(context.select_context(L.context_pool, L.tasks, max_chars=600), "selected")
    excluded = context.exclusions(L.governed, L.tasks, L.context_pool, relevant, selected)
    return relevant, selected, excluded


@query
def context_select(L: Lift) -> DataFrame:
    return context.relevance(L.context_pool, L.tasks).select("project_id", "session_id", "item_id", "overlap")


@query
def context_budget(L: Lift) -> DataFrame:
    return context.select_context(L.context_pool, L.tasks, max_chars=600).select("project_id", "session_id", "item_id", "overlap", long(F.col("rank"), "rank"), "cost")


@query
def context_exclusions(L: Lift) -> DataFrame:
    return _context(L)[2].select("project_id", "session_id", "included", "not_admitted", "conditional_conflict_block", "not_task_relevant", "over_budget")


@query
def context_manifest(L: Lift) -> DataFrame:
    _, selected, excluded = _context(L)
    prints = lookup.fingerprints(L.governed, ("item_id", "confidence", "status"))
    m = context.manifests(selected, excluded, RULESET_HASH, Policy().hash, prints, max_chars=600)
    return m.select(
        *("project_id", "session_id", "max_chars", "included", "not_admitted", "over_budget", "output_characters"),
        *("prompt_fingerprint", "selection_fingerprint", "ruleset_hash", "gate_policy_hash", "source_manifest", "mutates_state"),
        joined("included_cognition_ids"),
    )


@query
def inject_once(L: Lift) -> DataFrame:
    e = L.feedback.select("project_id", "session_id", "ts", F.col("event_id").alias("request_id"), "event_name")
    return context.inject_once(e).select("project_id", "session_id", "request_id", "event_name")


# --------------------------------------------------------------- feedback


@query
def feedback_valid(L: Lift) -> DataFrame:
    good, refused = feedback.record_feedback(L.feedback)
    a = good.select("event_id", "feedback_id", F.lit("").alias("refused"))
    return a.unionByName(refused.select("event_id", F.lit("").alias("feedback_id"), "refused"))


def _good(L: Lift) -> DataFrame:
    return feedback.record_feedback(L.feedback)[0]


@query
def feedback_report(L: Lift) -> DataFrame:
    return feedback.report(_good(L))


@query
def feedback_cube(L: Lift) -> DataFrame:
    return feedback.cube(_good(L))


@query
def feedback_daily(L: Lift) -> DataFrame:
    return feedback.daily(_good(L))


def _drift(L: Lift) -> DataFrame:
    d = L.feedback.where(F.col("event_family") == "drift").select("event_id", "session_id", F.col("target_id").alias("item_id"), "ts")
    return feedback.attribute_drift(d, L.manifests.select("session_id", "ts", "manifest_id"), L.manifest_outcomes)


@query
def drift_attribution(L: Lift) -> DataFrame:
    return _drift(L).select("event_id", "session_id", "item_id", F.coalesce("manifest_id", F.lit("")).alias("manifest_id"), "cause")


# ------------------------------------------------------------ rule change


@query
def rule_proposal(L: Lift) -> DataFrame:
    return L.proposals


@query
def simulate_diff(L: Lift) -> DataFrame:
    d = rulechange.simulate_diff(L.simulation)
    return d.select("scenario", "project_id", "item_id", "old_confidence", "new_confidence", "old_allowed", "new_allowed", joined("old_reasons"), joined("new_reasons"))


@query
def simulate_summary(L: Lift) -> DataFrame:
    out = rulechange.diff_summary(rulechange.simulate_diff(L.simulation))
    return out.withColumn("entering_ids", F.array_join("entering_ids", ",")).withColumn("leaving_ids", F.array_join("leaving_ids", ","))


@query
def forbidden_transitions(L: Lift) -> DataFrame:
    """What each proposal's state would hold that it must not, under a policy that waives its blocks for accepted claims."""
    hits = rulechange.transitions(L.lax_simulation)
    return hits.groupBy("scenario", "project_id", "rule").agg(F.count(F.lit(1)).alias("hits"), F.count_if("entered").alias("entered"), F.min("subject").alias("first_subject"))


@query
def rule_apply(L: Lift) -> DataFrame:
    """Proposals that lower a weight were not simulated; those that let forbidden things in are refused."""
    p = L.proposals
    sims = rulechange.simulations(p.where("new_weight > weight"), rulechange.transitions(L.lax_simulation))
    out, log, weights = rulechange.apply_rules(p, sims, L.weights, "2024-02-01T00:00:00Z")
    logged = log.select("proposal_id", "log_id")
    return weights.join(out.select("proposal_id", "signal", "status", "refused"), "signal", "left").join(logged, "proposal_id", "left").select(
        "signal", F.col("weight").alias("weight"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("proposal_id", "status", "refused", "log_id")]
    )


# -------------------------------------------------------------- integrity


def _first_copies(L: Lift) -> DataFrame:
    """Utterance ids that survive ingest deduplication by text."""
    keyed = L.utterances.select(digest("project_id", normalize.text_key(F.col("text"))).alias("record_id"), "source_id")
    return normalize.dedup_records(keyed, order="source_id").select("source_id")


def _dangling(L: Lift) -> DataFrame:
    """References of all kinds into tables that lost some rows."""
    item_ids = L.governed.where(F.col("status") != "rejected").select("item_id")
    logs = L.tool_calls.where(F.col("name") != "shell").select("source_log_id")
    read = L.documents.where(F.col("source_type") == "agent_interpretation").withColumn("based_on_utterance_ids", F.array(F.concat(F.lit("utt_"), (F.col("doc_id") - 20).cast("string"))))
    heard = L.feedback.withColumn("source_refs", F.array(F.concat(F.lit("tev_"), (F.col("event_id") + 1).cast("string"))))
    applied = L.proposals.withColumn("log_id", F.concat(F.lit("log_"), "signal"))
    refs = [
        integrity.references(L.bridge.where(F.col("source_type") == "user_utterance"), "item_evidence", "item_id", "source_id", "utterance"),
        integrity.references(L.tool_evidence, "tool_evidence", "source_id", "source_log_id", "tool_log"),
        integrity.references(L.resolved, "conflicts", "conflict_id", "item_a", "item"),
        integrity.references(L.resolved, "conflicts", "conflict_id", "item_b", "item"),
        integrity.references(L.governed, "items", "item_id", "supersedes", "item"),
        integrity.references(L.reviews.withColumn("item_ref", F.substring("proposal_id", 6, 64)), "reviews", "seq", "item_ref", "item"),
        integrity.references(read, "agent_interpretations", "source_id", "based_on_utterance_ids", "utterance"),
        integrity.references(heard, "feedback_events", "event_id", "source_refs", "tool_evidence"),
        integrity.references(applied, "rule_change_log", "log_id", "proposal_id", "rule_proposal"),
    ]
    ids = {"utterance": _first_copies(L), "tool_log": logs, "item": item_ids, "tool_evidence": L.tool_evidence.select("source_id"), "rule_proposal": L.proposals.where("new_weight < weight").select("proposal_id")}
    return integrity.dangling_refs(refs, ids)


@query
def dangling_refs(L: Lift) -> DataFrame:
    return _dangling(L).drop("project_id")


@query
def drift_report(L: Lift) -> DataFrame:
    risky = L.governed.withColumn("include_in_world_state", F.col("include_in_world_state") | (F.substring("item_id", 1, 2) == "00"))
    st = state.build_state(L.governed, L.admitted).select("project_id", "compact_characters")
    return integrity.drift_report(risky, L.resolved, L.decisions, cluster.clusters(L.governed), st, _dangling(L).where(F.col("project_id") != ""))


@query
def quarantine_orphans(L: Lift) -> DataFrame:
    kept, moved = integrity.split_orphans(L.items, L.bridge.where(F.col("source_type") == "user_utterance"), _first_copies(L))
    return moved.select("project_id", "item_id", F.lit("quarantined").alias("place")).unionByName(kept.select("project_id", "item_id", F.lit("kept").alias("place")))


def _upgrades(L: Lift) -> tuple[DataFrame, DataFrame]:
    """Part of the utterances has no intent yet, and claims of sessions with quoted text may sit in the core."""
    u = normalize.with_intent(L.utterances, R)
    legacy = u.withColumn("utterance_intent", F.when(F.length("session_id") % 2 == 0, F.col("utterance_intent")))
    utt = integrity.upgrade_utterances(legacy, R)
    quoted = utt.where(F.col("utterance_intent") != "direct_user_intent").select("project_id", "session_id").distinct()
    ids = L.bridge.where(among(quoted, "project_id", "session_id")).join(quoted, ["project_id", "session_id"], "left_semi").select("item_id").distinct()
    # an accepted update rests on the evidence of the claim it came from
    ids = ids.unionByName(ids.select(digest(F.lit("accepted"), "item_id").alias("item_id")))
    return utt, integrity.upgrade_items(L.superseded, ids, "2", cues=("read", "this", "un", "the"))


@query
def upgrade_report(L: Lift) -> DataFrame:
    return integrity.upgrade_report(*_upgrades(L))


@query
def upgrade_apply(L: Lift) -> DataFrame:
    return _upgrades(L)[1].select("project_id", "item_id", "predicate", "include_in_world_state", "state_schema_version", "predicate_fixed", "core_cleared")


ITEM_COLS = ("item_id", "status", "confidence", "modality", "supersedes")


@query
def state_checksum(L: Lift) -> DataFrame:
    items = integrity.checksum(L.governed, "items", ITEM_COLS)
    conf = integrity.checksum(L.resolved, "conflicts", ("conflict_id", "resolution", "chosen_side"))
    tools = integrity.checksum(L.tool_evidence, "tool_evidence", ("source_id", "evidence_kind", "outcome"))
    return items.unionByName(conf).unionByName(tools).select("table", "project_id", "rows", F.col("content_sum").cast("string").alias("content_sum"))


@query
def state_changes(L: Lift) -> DataFrame:
    """Which projects the resolution of conflicts changed."""
    cols = ("item_id", "status")
    diff = integrity.changed_tables(integrity.checksum(L.items, "items", cols), integrity.checksum(L.governed, "items", cols))
    return diff.select("table", "project_id", "old_rows", "new_rows", F.col("old_sum").cast("string").alias("old_sum"), F.col("new_sum").cast("string").alias("new_sum"))


@query
def schema_violations(L: Lift) -> DataFrame:
    c = L.conversations.withColumn("row_id", F.concat_ws("_", "session_id", F.col("turn").cast("string")))
    a = integrity.schema_violations(c, "transcript", F.col("row_id"), ("content",), {"role": ("user", "assistant", "tool")})
    b = integrity.schema_violations(L.feedback, "feedback", F.col("event_id"), ("event_name",), {"event_family": ("correction", "test", "drift", "retrieval", "gate")}, {"severity": (0, 100)})
    d = integrity.schema_violations(L.table("documents"), "utterance", F.col("doc_id"), ("text", "source"), {"lang": ("en", "de", "fr", "es")}, {"n_chars": (1, 100_000)})
    return a.unionByName(b).unionByName(d)


# ------------------------------------------------- profile, update review


def _profile(L: Lift) -> DataFrame:
    return profile.profile_candidates(L.superseded, L.bridge, conflicts.open_sides(L.resolved))


@query
def profile_candidates(L: Lift) -> DataFrame:
    return _profile(L)


@query
def profile_reasons(L: Lift) -> DataFrame:
    return profile.profile_summary(_profile(L))


@query
def profile_diff(L: Lift) -> DataFrame:
    """The wanted profile against one built before conflicts were reviewed, without must rules."""
    wanted = cut(_profile(L), "profile")
    before = profile.profile_candidates(L.items, L.bridge, L.items.select("item_id").where(F.lit(False)), minimum=85)
    current = profile.entries(before.where(F.col("modality") != "must"))
    return profile.profile_diff(current, profile.entries(wanted)).select(*profile.GROUP, "old_confidence", "new_confidence", "change")


@query
def review_updates(L: Lift) -> DataFrame:
    return L.reviewed.select("project_id", "proposal_id", "proposal_status", F.coalesce("reviews", F.lit(0)).alias("reviews"), "confidence")


@query
def review_backlog(L: Lift) -> DataFrame:
    return review.review_backlog(L.reviewed)


@query
def review_feedback(L: Lift) -> DataFrame:
    f = review.review_feedback(L.reviewed)
    return f.select("project_id", "feedback_id", "action", "proposal_confidence", "category", "should_update_world_state", joined("signals"))


@query
def admission(L: Lift) -> DataFrame:
    """Which claims every project admits, and why the others stay out."""
    return L.decisions.select("project_id", "item_id", "source_type", "status", "predicate", "modality", "object_key", "confidence", "allowed", joined("reasons"))


flagship = REGISTRY["admission"]
