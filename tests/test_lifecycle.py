from __future__ import annotations

from helpers import agent, by, item, items
from pyspark.sql import functions as F

from testimony.operators import conflicts, feedback, integrity, profile, review, rulechange, score
from testimony.rules import DEFAULT_RULES as R
from testimony.rules import SIGNAL_WEIGHTS, Policy

FEEDBACK = "feedback_id string, action string, signals array<string>, applied_to_weights boolean"


def weights(spark):
    return spark.createDataFrame(sorted(SIGNAL_WEIGHTS.items()), "signal string, weight int")


def rows(spark):
    return spark.createDataFrame(
        [("f1", "accept", ["user_explicit_preference", "user_strong_emphasis"], False), ("f2", "reject", ["agent_interpretation"], False), ("f3", "accept", ["unheard_of"], True)], FEEDBACK
    )


def test_shadow_and_apply(spark):
    fb, w = rows(spark), weights(spark)
    shadow = score.weight_shadow(fb, w)
    s = score.shadow_summary(fb, shadow).first()
    assert (s.mode, s.would_apply, s.changed_signal_count, s.writes_weights) == ("shadow", 2, 3, False)
    fresh, marked = score.apply_weights(fb, w, shadow)
    new = {r.signal: r.weight for r in fresh.collect()}
    assert new["user_explicit_preference"] == SIGNAL_WEIGHTS["user_explicit_preference"] + 1 and new["agent_interpretation"] == SIGNAL_WEIGHTS["agent_interpretation"] - 1
    assert all(r.applied_to_weights for r in marked.collect()) and {r.signal: r.weight for r in w.collect()} == SIGNAL_WEIGHTS


def test_shadow_bounds_and_ignored(spark):
    fb = spark.createDataFrame([(str(i), "accept", ["tool_evidence", "odd"], False) for i in range(30)], FEEDBACK)
    got = by(score.weight_shadow(fb, weights(spark)), "signal")
    assert got["tool_evidence"].new_weight == 20 and got["tool_evidence"].bounds_hit
    assert got["odd"].ignored and got["odd"].new_weight is None


def test_rule_change_lifecycle(spark):
    fb, w = rows(spark), weights(spark)
    evidence = fb.select(F.explode("signals").alias("signal"), "feedback_id")
    props = rulechange.propose(score.weight_shadow(fb, w), fb, evidence)
    assert all(p.status == "pending" and p.requires_explicit_apply and p.missing_refs == 0 for p in props.collect())
    none = spark.createDataFrame([], "proposal_id string, hard_failures int")
    out, log, same = rulechange.apply_rules(props, none, w, "now")
    assert {r.refused for r in out.collect()} == {"not_simulated"} and log.count() == 0
    assert {r.signal: r.weight for r in same.collect()} == SIGNAL_WEIGHTS
    bad = props.where(F.col("signal") == "agent_interpretation").select("proposal_id")
    sims = props.select("proposal_id", F.lit(0).alias("hard_failures")).join(bad, "proposal_id", "left_anti").unionByName(bad.withColumn("hard_failures", F.lit(2)))
    out, log, new = rulechange.apply_rules(props, sims, w, "now")
    assert log.count() == 2 and by(out, "signal")["agent_interpretation"].refused == "hard_failures"
    assert {r.signal: r.weight for r in new.collect()}["agent_interpretation"] == SIGNAL_WEIGHTS["agent_interpretation"]
    assert {r.status for r in out.where("refused = ''").collect()} == {"applied"}


def test_simulation_tries_every_proposal_against_the_present(spark):
    flags = ("explicit_preference", "explicit_rejection", "strong_emphasis", "long_form", "repeated")
    base = items(spark, item("a", modality="must"), agent("b", object_key="other"), item("c", modality="must_not", object_key="third"), agent("d", modality="may", object_key="third"))
    for f in flags:
        base = base.withColumn(f, F.lit(f == "explicit_rejection"))
    props = spark.createDataFrame([("r1", "user_explicit_rejection", 1), ("r2", "agent_interpretation", 5), ("r3", "user_explicit_rejection", 9)], "proposal_id string, signal string, new_weight long")
    found = conflicts.detect_conflicts(base)
    sim = rulechange.simulate(base, found, props, weights(spark))
    diff = rulechange.simulate_diff(sim).collect()
    got = {(x.scenario, x.item_id): (x.old_confidence, x.new_confidence, x.old_allowed, x.new_allowed) for x in diff}
    assert got == {
        ("r1", "a"): (90, 83, True, False),
        ("r1", "c"): (90, 83, False, False),
        ("r2", "b"): (64, 65, False, False),
        ("r2", "d"): (64, 65, False, False),
        ("r3", "a"): (90, 91, True, True),
        ("r3", "c"): (90, 91, False, False),
    }
    rows_ = by(rulechange.diff_summary(rulechange.simulate_diff(sim)), "scenario")
    assert (rows_["r1"].score_changes, rows_["r1"].newly_blocked, rows_["r1"].newly_allowed, rows_["r1"].leaving_ids) == (2, 1, 0, ["a"]) and rows_["r3"].entering_ids == []
    deltas = by(rulechange.state_delta(sim), "scenario")
    assert deltas["r1"].compact_delta <= 0 and deltas["r3"].compact_delta == 0
    assert rulechange.transitions(sim).count() == 0
    assert rulechange.simulate_diff(rulechange.simulate(base, found, props.limit(0), weights(spark))).count() == 0
    assert rulechange.simulate_diff(rulechange.simulate(base.limit(0), found.limit(0), props, weights(spark))).count() == 0


def test_a_proposal_that_lets_a_contested_claim_in_is_refused(spark):
    """Under a policy without conflict blocks, a higher weight lifts one side of an open conflict over the threshold."""
    flags = ("explicit_preference", "explicit_rejection", "strong_emphasis", "long_form", "repeated")
    base = items(spark, item("a", modality="must_not"), agent("b", modality="may"))
    for f in flags:
        base = base.withColumn(f, F.lit(f == "strong_emphasis"))
    signals = ["user_strong_emphasis", "user_long_form", "agent_interpretation"]
    props = spark.createDataFrame([(f"r{i}", x, 5, w, 0, "pending") for i, (x, w) in enumerate(zip(signals, (12, 9, -90), strict=True))], "proposal_id string, signal string, weight long, new_weight long, missing_refs long, status string")
    lax = Policy(min_conflict_severity=101, constitutional_blocks=())
    found = rulechange.transitions(rulechange.simulate(base, conflicts.detect_conflicts(base), props, weights(spark), lax))
    assert {(r.scenario, r.rule, r.subject, r.entered) for r in found.collect()} == {
        ("r0", "unresolved_conflict_side_entered_world_state", "a", True),
        ("r2", "validation_errors_increased", "p", True),
    }
    out, log, _ = rulechange.apply_rules(props, rulechange.simulations(props, found), weights(spark), "now")
    assert {r.proposal_id: r.refused for r in out.collect()} == {"r0": "hard_failures", "r1": "", "r2": "hard_failures"}
    assert [r.proposal_id for r in log.collect()] == ["r1"]


def test_scoring_ceilings_and_inclusion(spark):
    base = items(spark, agent("a"), item("t", source_type="tool_evidence", deterministic=True), item("u"), item("acc", status="accepted", source_type="proposed_update"))
    for f in ("explicit_preference", "explicit_rejection", "strong_emphasis", "long_form", "repeated"):
        base = base.withColumn(f, F.lit(True))
    got = by(score.inclusion(score.tool_only(score.score(base))))
    assert got["a"].confidence <= 74 and got["t"].confidence == 89 and got["u"].confidence == 100
    assert "tool_evidence" in got["t"].score_signals and got["t"].requires_governance_gate_for_world_state
    assert {k for k, r in got.items() if r.include_in_world_state} == {"acc"}


def test_feedback_record_and_report(spark):
    cols = "project_id string, session_id string, ts timestamp, event_family string, event_name string, target_type string, target_id string, outcome string, severity int, source_type string"
    ev = spark.createDataFrame(
        [
            ("p", "s", None, "correction", "user_correction", "cognition", "c", "negative", 90, "user_utterance"),
            ("p", "s", None, "test", "suite", "cognition", "c", "negative", 40, "tool_evidence"),
            ("p", "s", None, "weather", "rain", "cognition", "c", "negative", 40, "tool_evidence"),
        ],
        cols,
    )
    good, refused = feedback.record_feedback(ev)
    assert [r.refused for r in refused.collect()] == ["unknown_family"] and all(r.feedback_id.startswith("fb_") for r in good.collect())
    r = feedback.report(good).first()
    assert (r.total, r.negative, r.high_severity_negative, r.user_corrections, r.deterministic_tool) == (2, 2, 1, 1, 1)
    assert feedback.cube(good).where("event_family IS NULL AND outcome IS NULL").first().events == 2


def test_drift_causes(spark):
    drift = spark.createDataFrame([(i, "s", f"i{i}", 100) for i in range(5)] + [(9, "lonely", "i0", 100)], "event_id int, session_id string, item_id string, t long")
    mani = spark.createDataFrame([("s", 50, "m"), ("s", 200, "later")], "session_id string, t long, manifest_id string")
    outc = spark.createDataFrame([("m", "i0", "included"), ("m", "i1", "over_budget"), ("m", "i2", "not_task_relevant"), ("m", "i3", "conditional_conflict_block"), ("later", "i4", "included")], "manifest_id string, item_id string, outcome string")
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    got = {r.event_id: r.cause for r in feedback.attribute_drift(at(drift), at(mani), outc).collect()}
    assert got == {0: "selected_but_ignored", 1: "over_budget", 2: "not_selected", 3: "blocked_by_conditional_conflict", 4: "not_admitted", 9: "no_context_delivered"}


def test_dangling_references_name_the_missing_id(spark):
    ids = {"utterance": spark.createDataFrame([("u1",)], "id string"), "item": spark.createDataFrame([("a",), ("b",)], "id string")}
    conf = spark.createDataFrame([("c1", "a", "gone")], "id string, item_a string, item_b string")
    ev = spark.createDataFrame([("a", ["u1", "u9"]), ("b", ["u1"])], "id string, evidence array<string>")
    refs = [integrity.references(conf, "conflicts", "id", "item_a", "item"), integrity.references(conf, "conflicts", "id", "item_b", "item"), integrity.references(ev, "items", "id", "evidence", "utterance")]
    got = {(r.table, r.row_id, r.field, r.missing_id) for r in integrity.dangling_refs(refs, ids).collect()}
    assert got == {("conflicts", "c1", "item_b", "gone"), ("items", "a", "evidence", "u9")}
    assert integrity.dangling_refs(refs[:1], ids).count() == 0


def test_orphans_move_aside(spark):
    base = items(spark, item("kept"), item("orphan"), item("unsourced"))
    bridge = spark.createDataFrame([("kept", "u1"), ("kept", "gone"), ("orphan", "gone")], "item_id string, source_id string")
    live = spark.createDataFrame([("u1",)], "source_id string")
    kept, moved = integrity.split_orphans(base, bridge, live)
    assert {r.item_id for r in kept.collect()} == {"kept", "unsourced"} and [r.item_id for r in moved.collect()] == ["orphan"]
    assert conflicts.detect_conflicts(kept).count() == 0


def test_upgrade(spark):
    utt = spark.createDataFrame([("p", "direct", "开航之前先读 WORLD_STATE.md。", None), ("p", "quoted", "Verdict: the pier is sound.", None)], "project_id string, source_id string, text string, utterance_intent string")
    up = integrity.upgrade_utterances(utt, R)
    assert {r.source_id: r.utterance_intent for r in up.collect()} == {"direct": "direct_user_intent", "quoted": "quoted_evaluation"}
    base = items(spark, item("read", predicate="render", claim="开航之前先读 WORLD_STATE.md", status="accepted", include_in_world_state=True), item("quoted", status="accepted", include_in_world_state=True))
    done = integrity.upgrade_items(base, base.where("item_id = 'quoted'").select("item_id"), "2")
    got = by(done)
    assert got["read"].predicate == "read_source" and got["read"].include_in_world_state and not got["quoted"].include_in_world_state
    r = integrity.upgrade_report(up, done).first()
    assert (r.user_utterance_intents_backfilled, r.predicates_fixed, r.core_flags_cleared, r.needs_upgrade) == (2, 1, 1, True)


def test_schema_violations(spark):
    df = spark.createDataFrame([("1", "user", 5), ("2", "robot", 500), ("3", None, 5)], "id string, role string, n int")
    got = {(r.row_id, r.rule) for r in integrity.schema_violations(df, "t", F.col("id"), ("role",), {"role": ("user",)}, {"n": (0, 100)}).collect()}
    assert got == {("2", "role_not_in_enum"), ("2", "n_out_of_range"), ("3", "role_missing")}
    assert {(r.row_id, r.rule) for r in integrity.schema_violations(df, "t", F.col("id"), (), {"role": ("user", "robot")}).collect()} == {("3", "role_not_in_enum")}


def test_reviews_make_items_and_feedback(spark):
    base = items(spark, item("yes"), item("no", object_key="n"), item("open", object_key="o"), agent("agent"))
    base = base.withColumn("score_signals", F.array(F.lit("user_explicit_preference")))
    reviews = spark.createDataFrame([("prop_yes", 1, "reject"), ("prop_yes", 2, "accept"), ("prop_no", 1, "reject")], "proposal_id string, seq int, action string")
    done = review.review_updates(review.propose(base), reviews)
    assert {r.item_id: r.proposal_status for r in done.collect()} == {"yes": "accepted", "no": "rejected", "open": "pending"}
    acc = review.accepted_items(done).collect()
    assert [(r.source_type, r.status) for r in acc] == [("proposed_update", "accepted")]
    fb = {r.proposal_id: (r.action, r.signals) for r in review.review_feedback(done).collect()}
    assert fb == {"prop_yes": ("accept", ["user_explicit_preference"]), "prop_no": ("reject", ["user_explicit_preference"])}
    b = review.review_backlog(done).first()
    assert (b.proposals, b.pending, b.accepted, b.rejected) == (3, 1, 1, 1)


def test_profile(spark):
    glob = dict(scope="user_global", predicate="requires")
    base = items(
        spark,
        item("good", object_key="good", **glob),
        item("project", object_key="project", predicate="requires"),
        item("weak", object_key="weak", **glob),
        item("low", object_key="low", confidence=70, **glob),
        item("fight", object_key="fight", **glob),
        item("old", object_key="old", status="rejected", **glob),
        item("detail", object_key="detail", scope="user_global", predicate="render"),
    )
    said = [(i, "me", f"s{n}", f"u{n}", "user_utterance") for i in ("good", "project", "low", "fight", "old", "detail") for n in (1, 2)] + [("weak", "me", "s1", "u1", "user_utterance")]
    bridge = spark.createDataFrame(said, "item_id string, user_id string, session_id string, source_id string, source_type string")
    cands = profile.profile_candidates(base, bridge, spark.createDataFrame([("fight",)], "item_id string"))
    assert {r.object_key: r.rejected_reason for r in cands.collect()} == {
        "good": "", "project": "project_only", "weak": "single_weak_expression", "low": "low_confidence", "fight": "conflicted", "old": "rejected_or_superseded", "detail": "implementation_detail",
    }
    wanted = profile.entries(cands)
    nothing = wanted.limit(0)
    assert [r.change for r in profile.profile_diff(nothing, wanted).collect()] == ["added"]
    assert profile.apply_profile(nothing, wanted).count() == 0 and profile.apply_profile(nothing, wanted, apply=True).count() == 1
    assert profile.profile_diff(wanted, wanted).count() == 0
