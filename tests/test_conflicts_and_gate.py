from __future__ import annotations

from helpers import agent, by, item, items
from pyspark.sql import functions as F

from testimony.operators import cluster, conflicts, gate, integrity, rulechange, score, state
from testimony.rules import Policy

ACTIONS = "conflict_id string, seq int, action string, condition string, reason string"


def act(spark, found, action, condition=""):
    return found.select("conflict_id", F.lit(1).alias("seq"), F.lit(action).alias("action"), F.lit(condition).alias("condition"), F.lit("because").alias("reason"))


def test_user_outranks_agent(spark):
    rows = conflicts.detect_conflicts(items(spark, item("u"), agent("a"))).collect()
    assert [(r.chosen_side, r.resolution, r.type) for r in rows] == [("u", "unresolved", "user_vs_agent")]


def test_tool_outranks_agent_and_web_does_not_outrank_user(spark):
    slot = dict(scope="test", subject="test_result", predicate="test_passed", object_key="test_suite")
    tool = item("t", source_type="tool_evidence", modality="is_not", confidence=89, **slot)
    found = conflicts.detect_conflicts(items(spark, tool, agent("a", **{**slot, "modality": "is"})))
    assert [r.chosen_side for r in found.collect()] == ["t"]
    user = item("u", modality="must_not", confidence=95)
    web = item("w", source_type="tool_evidence", modality="may", confidence=89)
    assert [r.chosen_side for r in conflicts.detect_conflicts(items(spark, user, web)).collect()] == ["u"]


def test_other_scope_or_same_modality_is_no_conflict(spark):
    found = conflicts.detect_conflicts(items(spark, item("a"), item("b", modality="may", scope="user_global"), item("c")))
    assert found.count() == 0


def test_validity_must_overlap(spark):
    base = items(spark, item("old"), item("new", modality="may"))
    at = F.when(F.col("item_id") == "old", F.lit("2024-01-01")).otherwise(F.lit("2024-03-01")).cast("timestamp")
    until = F.when(F.col("item_id") == "old", F.lit("2024-02-01").cast("timestamp"))
    timed = base.withColumn("valid_from", at).withColumn("valid_until", until)
    assert conflicts.detect_conflicts(timed).count() == 1
    assert conflicts.detect_conflicts(timed, temporal=True).count() == 0
    assert {r.item_id for r in conflicts.valid_as_of(timed, F.lit("2024-01-15").cast("timestamp")).collect()} == {"old"}


def test_choose_side_supersedes_loser_and_audits(spark):
    base = items(spark, agent("old"), item("new", status="accepted"))
    found = conflicts.detect_conflicts(base)
    side = "choose-a" if found.first().item_a == "new" else "choose-b"
    done = conflicts.resolve(found, act(spark, found, side))
    rows = by(conflicts.apply_supersession(base, done))
    assert rows["old"].status == "superseded" and rows["new"].supersedes == ["old"] and rows["new"].status == "accepted"
    audit = conflicts.with_audit(done).first().audit_summary
    assert (audit.chosen, audit.loser, audit.supersedes) == ("new", "old", ["old"])
    assert audit.blocked_status == {"old": True, "new": False}
    assert conflicts.detect_conflicts(conflicts.apply_supersession(base, done)).count() == 0


def test_last_action_wins(spark):
    found = conflicts.detect_conflicts(items(spark, item("u"), agent("a")))
    cid = found.first().conflict_id
    actions = spark.createDataFrame([(cid, 1, "choose-a", "", ""), (cid, 2, "defer", "", "")], ACTIONS)
    assert conflicts.resolve(found, actions).first().resolution == "deferred"


def test_defer_blocks_both_sides(spark):
    base = items(spark, item("a", status="accepted"), item("b", status="accepted", modality="must"))
    found = conflicts.detect_conflicts(base)
    done = conflicts.resolve(found, act(spark, found, "defer"))
    rows = by(score.inclusion(base, conflicts.open_sides(done)))
    assert not rows["a"].include_in_world_state and not rows["b"].include_in_world_state
    assert by(score.inclusion(base))["a"].include_in_world_state


def test_conditional_coexistence(spark):
    base = items(spark, item("a", status="accepted"), item("b", status="accepted", modality="may"))
    found = conflicts.detect_conflicts(base)
    done = conflicts.resolve(found, act(spark, found, "coexist-by-condition", "only_when_asked"))
    row = done.first()
    assert (row.resolution, row.chosen_side, row.condition, row.blocks_world_state) == ("resolved", "", "only_when_asked", True)
    marked = by(conflicts.with_conditional_block(base, done))
    assert all(r.status == "accepted" and r.conditional_conflict_block.condition == "only_when_asked" for r in marked.values())
    decisions = by(gate.gate(base, Policy(), done))
    assert not any(d.allowed for d in decisions.values())
    assert all("conditional_conflict_block" in d.reasons and d.constitutional_block for d in decisions.values())
    assert conflicts.backlog(done).count() == 0


def four(spark):
    return items(spark, item("n1"), item("n2"), agent("p1"), agent("p2"))


def test_conflict_cluster(spark):
    found = conflicts.detect_conflicts(four(spark))
    rows = conflicts.cluster_conflicts(found).collect()
    assert len(rows) == 1 and rows[0].member_count == found.count() == 4
    assert rows[0].cognition_ids == ["n1", "n2", "p1", "p2"]
    assert conflicts.conflict_volume(four(spark)).first().pairs == 4


def test_cluster_review_applies_skips_and_defers(spark):
    def review(base, action):
        found = conflicts.detect_conflicts(base)
        todo = conflicts.cluster_conflicts(found).select("cluster_id", F.lit(action).alias("action"), F.lit("r").alias("reason"), F.lit(1).alias("seq"))
        per = conflicts.review_actions(found, todo)
        counts = conflicts.review_counts(per).first()
        return conflicts.resolve(found, per.where(F.col("action").isNotNull())), counts.reviewed_count, counts.skipped_count

    base = items(spark, item("u"), agent("a"))
    done, reviewed, skipped = review(base, "apply-suggested")
    assert (reviewed, skipped) == (1, 0)
    assert by(conflicts.apply_supersession(base, done))["a"].status == "superseded"
    equal = items(spark, item("a"), item("b", modality="must"))
    done, reviewed, skipped = review(equal, "apply-suggested")
    assert (reviewed, skipped) == (0, 1) and done.first().resolution == "unresolved"
    done, reviewed, skipped = review(equal, "defer")
    assert (reviewed, skipped) == (1, 0) and done.first().resolution == "deferred"


def test_incremental_conflicts_equal_full_detection(spark):
    old, new = items(spark, item("n1"), agent("p1")), items(spark, item("n2"), agent("p2"))
    everything = conflicts.detect_conflicts(old.unionByName(new))
    stored = conflicts.detect_conflicts(old)
    fresh = conflicts.incremental_conflicts(new, old)
    assert {r.conflict_id for r in fresh.collect()} == {r.conflict_id for r in conflicts.new_conflicts(everything, stored).collect()}


def test_candidate_cluster(spark):
    base = items(spark, item("anchor", confidence=99), item("reworded", confidence=96), agent("dup", modality="must_not"), item("global", scope="user_global"))
    rows = cluster.clusters(base).collect()
    assert len(rows) == 1
    c = rows[0]
    assert (c.member_count, c.representative_id, c.merge_mode, c.updates_world_state) == (3, "anchor", "none_no_state_mutation", False)
    assert c.governance_action == "prefer_user_anchor_block_weaker_duplicates"
    assert {r.item_id for r in cluster.duplicates(base).collect()} == {"reworded", "dup"}
    ratio = cluster.duplicate_ratio(base).first()
    assert (ratio.active_items, ratio.candidate_cluster_count, ratio.duplicate_candidates) == (4, 1, 2)


def test_group_aggregates_reach_every_row(spark):
    from testimony.functions.scale import attach_group

    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), F.col("id").alias("item_id"))
    got = attach_group(rows, ["k"], [F.count(F.lit(1)).alias("n")]).collect()
    assert len(got) == 2000
    assert {r.n for r in got if r.k == "hot"} == {667} and {r.n for r in got if r.k is None} == {666}
    assert {r.n for r in got if r.k not in ("hot", None)} == {1}


def test_gate(spark):
    rows = [
        item("anchor", confidence=99),
        item("dup"),
        agent("agent_dup", modality="must_not"),
        item("low", confidence=80, modality="must", subject="world_state", predicate="render", object_key="low"),
        item("ca", confidence=99, modality="must", predicate="update_world_state", object_key="world_state"),
        item("cb", confidence=99, modality="must_not", predicate="update_world_state", object_key="world_state"),
    ]
    base = items(spark, *rows)
    found = conflicts.detect_conflicts(base)
    before = integrity.checksum(base, "items", ("item_id", "status", "confidence"))
    decisions = gate.gate(base, Policy(), found, cluster.duplicates(base))
    d = by(decisions)
    assert [k for k, r in d.items() if r.allowed] == ["anchor"]
    assert "blocked_as_duplicate_candidate" in d["dup"].reasons
    assert "agent_only_evidence" in d["agent_dup"].reasons
    assert "confidence_below_90" in d["low"].reasons
    assert "unresolved_high_severity_conflict" in d["ca"].reasons
    assert integrity.changed_tables(before, integrity.checksum(base, "items", ("item_id", "status", "confidence"))).count() == 0
    assert [r.item_id for r in state.state_items(base, decisions).collect()] == ["anchor"]
    assert by(gate.reason_counts(decisions), "reason")["agent_only_evidence"]["items"] == 1


def test_tools_need_determinism_and_quotes_never_pass(spark):
    base = items(
        spark,
        item("sure", source_type="tool_evidence", confidence=89, deterministic=True, object_key="a"),
        item("unsure", source_type="tool_evidence", confidence=89, object_key="b"),
        item("quoted", utterance_intent="quoted_evaluation", status="accepted", object_key="c"),
        item("bare", evidence_count=0, object_key="d"),
        item("stable", evidence_count=0, status="accepted", source_type="manual_initialization", object_key="e"),
    )
    d = by(gate.gate(base))
    assert {k for k, r in d.items() if r.allowed} == {"sure", "stable"}
    assert d["quoted"].reasons == ["quoted_or_external_material"] and d["bare"].reasons == ["missing_evidence"]


def test_budget_and_overrides(spark):
    base = items(spark, item("high", confidence=99), item("mid", modality="must", object_key="x", confidence=98), item("low", modality="should", object_key="y", confidence=95))
    policy = Policy(max_allowed=2, max_per_category=0, max_per_predicate=0, max_per_slot=0)
    d = by(gate.gate(base, policy))
    assert {k for k, r in d.items() if r.allowed} == {"high", "mid"}
    assert d["low"].reasons == ["blocked_by_gate_budget_max_allowed"]
    one, two = policy.overridden(max_allowed=1), policy.overridden(max_allowed=0)
    assert len({policy.hash, one.hash, two.hash}) == 3 and policy.overridden(path="elsewhere").hash == policy.hash
    summary = by(gate.gate_summary(gate.gate_by_policy(base, [one, two])), "policy_hash")
    assert summary[one.hash].allowed_count == 1 and summary[two.hash].allowed_count == 3


def test_budget_is_exact_for_a_large_group(spark):
    """Brute force over one project with many claims in few slots."""
    n = 400
    base = spark.range(n).selectExpr("'p' AS project_id", "sha2(cast(id AS string), 256) AS item_id", "cast(id % 40 AS string) AS slot_id", "cast(90 + id % 7 AS int) AS confidence")
    base = base.selectExpr("*", "'user_utterance' AS source_type", "if(confidence % 2 = 0, 'create', 'render') AS predicate", "'must' AS modality", "'constraint' AS category", "array() AS reasons")
    base = base.withColumn("reasons", F.col("reasons").cast("array<string>"))
    policy = Policy(max_per_slot=3, max_per_predicate=25, max_per_category=0, max_allowed=40)
    got = {r.item_id for r in gate.budget(base, policy).where("allowed").collect()}
    rows = sorted(base.collect(), key=lambda r: (policy.predicate_priority.index(r.predicate), -r.confidence, r.item_id))
    for keys, cap in ((("slot_id",), 3), (("predicate",), 25), ((), 40)):
        seen, kept = {}, []
        for r in rows:
            k = tuple(r[x] for x in keys)
            seen[k] = seen.get(k, 0) + 1
            if seen[k] <= cap:
                kept.append(r)
        rows = kept
    assert got == {r.item_id for r in rows}


def test_policy_document_and_violations(spark):
    p = Policy.from_json('{"version": 7, "thresholds": {"min_confidence": 91}, "admission_budget": {"max_allowed": 3}, "priority": {"source": {"user_utterance": 1, "manual_initialization": 0}}}')
    assert (p.version, p.min_confidence, p.max_allowed, p.source_priority) == (7, 91, 3, ("manual_initialization", "user_utterance"))
    cols = "policy_id string, min_confidence int, min_confidence_user int, min_confidence_tool int, min_conflict_severity int, max_allowed int, max_per_category int, max_per_predicate int, max_per_slot int"
    rows = spark.createDataFrame([("ok", 90, 90, 88, 80, 10, 5, 5, 1), ("bad", 101, None, 88, 80, -1, 5, 5, 1)], cols)
    broken = {(r.policy_id, r.rule) for r in gate.policy_violations(rows).collect()}
    assert broken == {("bad", "min_confidence_out_of_range"), ("bad", "min_confidence_user_missing"), ("bad", "max_allowed_negative")}


def test_drift_hard_failures(spark):
    base = items(
        spark,
        item("stale", status="superseded", include_in_world_state=True),
        agent("agent", include_in_world_state=True),
        item("cand", include_in_world_state=True),
        item("fine", status="accepted", include_in_world_state=True),
    )
    found = {(r.item_id, r.failure) for r in integrity.hard_failures(base).collect()}
    assert found == {("stale", "stale_rule_revived"), ("agent", "assistant_only_entered_core"), ("cand", "ungoverned_candidate_entered_core")}
    report = integrity.metric_rows(integrity.hard_failures(base).groupBy("project_id").agg(F.count(F.lit(1)).alias("stale_rule_revived")), {"stale_rule_revived": "stale_rule_revived"})
    assert not integrity.drift_ok(report).first().ok


def test_all_forbidden_transitions(spark):
    base = items(
        spark,
        agent("agent"),
        item("quoted", utterance_intent="quoted_evaluation", object_key="q"),
        item("stale", status="superseded", object_key="s"),
        item("side", object_key="c"),
        item("other", object_key="c", modality="must"),
    )
    found = conflicts.detect_conflicts(base)
    one = spark.createDataFrame([("p", 1700, 0, 1, 2)], "project_id string, compact_characters int, old_errors int, new_errors int, hard_failures int")
    hits = rulechange.forbidden_transitions(base, found, one, one, one)
    assert {r.rule for r in hits.collect()} == set(rulechange.FORBIDDEN)
    clean = items(spark, item("fine"))
    zero = one.selectExpr("project_id", "0 AS compact_characters", "0 AS old_errors", "0 AS new_errors", "0 AS hard_failures")
    assert rulechange.forbidden_transitions(clean, conflicts.detect_conflicts(clean), zero, zero, zero).count() == 0


def test_a_conflict_closed_without_a_choice_admits_neither_side(spark):
    """Until one of the two claims is no longer active."""
    accepted = {"source_type": "proposed_update", "status": "accepted", "confidence": 98}
    rows = [item("a", modality="must_not", **accepted), item("b", modality="may", **accepted), item("c", modality="may", object_key="other", **accepted)]

    def allowed(rows):
        df = items(spark, *rows)
        found = conflicts.detect_conflicts(items(spark, *[{**r, "status": "accepted"} for r in rows]))
        actions = found.select("conflict_id", F.lit("mark-resolved").alias("action"), F.lit("").alias("condition"), F.lit("").alias("reason"), F.lit(1).alias("seq"))
        resolved = conflicts.resolve(found, actions)
        assert {r.resolution for r in resolved.collect()} == {"resolved"}
        return {r.item_id for r in gate.gate(score.inclusion(df, conflicts.held_sides(resolved, df)), Policy(), resolved).where("allowed").collect()}

    assert allowed(rows) == {"c"}
    assert allowed([rows[0], {**rows[1], "status": "rejected"}, rows[2]]) == {"a", "c"}
