from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from testimony.functions.text import with_forms
from testimony.operators import extract, normalize
from testimony.plans import govern
from testimony.rules import DEFAULT_RULES as R
from testimony.rules import INTENTS, PREDICATES, Rules

EVIDENCE = "project_id string, source_id string, session_id string, user_id string, source_type string, ts timestamp, text string"


def utterances(spark, *texts, source="user_utterance"):
    rows = [("p", f"u{i}", "s", "me", source, None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EVIDENCE)


PREDICATE_CASES = [
    ("Tide tables belong in core memory once two stations agree.", "enter_core_memory"),
    ("潮位读数属于长期记忆。", "enter_core_memory"),
    ("Every harbour rule waits for a sign off.", "require_review"),
    ("航道变更要经过审批。", "require_review"),
    ("Nothing is to be preloaded; injection slows the pilot down.", "inject_context"),
    ("The night watch should not ask the model for a digest.", "call_llm"),
    ("The tide job may not call LLM at night.", "call_llm"),
    ("Before sailing, consult the original record.", "read_source"),
    ("出港之前查阅航海图。", "read_source"),
    ("Depths are displayed in fathoms.", "render"),
    ("Each buoy report carries an evidence weight.", "score_evidence"),
    ("The captain resolves what the two charts dispute.", "resolve_conflict"),
    ("Last night's test run went through.", "test_passed"),
    ("码头新建一份清单。", "create"),
    ("Foghorn times are only logged.", "store_log"),
    ("Pilot orders outrank the timetable.", "override"),
    ("A world state update follows every survey.", "update_world_state"),
    ("The crane must stand still.", "requires"),
    ("Gulls nest on the mole.", "states"),
]

OBJECT_CASES = [
    ("an assistant reply", "assistant_output"),
    ("your final answer", "assistant_output"),
    ("助手输出", "assistant_output"),
    ("what a core fact holds", "core_memory"),
    ("核心记忆", "core_memory"),
    ("the world state", "world_state"),
    ("世界观", "world_state"),
    ("their chat history", "history_context"),
    ("聊天历史", "history_context"),
    ("a raw log", "raw_logs"),
    ("agents.md", "agents_md"),
    ("用户档案", "user_profile"),
    ("a suite of tests", "test_suite"),
    ("Grey Seal", "grey_seal"),
    ("灰海豹", "灰海豹"),
]

STORY = [f"On day {i} the ferry could not dock and the crew must wait." for i in range(8)]
INTENT_CASES = [
    ("Could you repaint the harbour map?", "direct_user_intent"),
    ("帮我把浮标表排好。", "direct_user_intent"),
    ("Boats must not anchor in the channel.", "direct_user_intent"),
    ("Please answer this. The reviewer says: neat work, slow crane.", "mixed_request_with_quote"),
    ("Verdict: the pier is sound.", "quoted_evaluation"),
    ("\n".join(STORY), "external_commentary"),
    ("\n".join(["I want a poem in this tone.", *STORY]), "direct_user_intent"),
    ("Take a look at the pilot's evaluation:\nA sound pier. Progress: 70%.", "mixed_request_with_quote"),
    ("看一下船长的点评：\n码头很稳。", "mixed_request_with_quote"),
    ("The new crane is up. Progress judgement: 70%. Two bolts are loose.", "quoted_evaluation"),
    ("新吊机装好了。进度评估：七成。还缺两颗螺栓。", "quoted_evaluation"),
    ("\n".join(f"On day {i} they went to build, write and fix what the storm took, and to continue the mole." for i in range(7)), "external_commentary"),
    ("\n".join(f"第{i}天他们继续修防波堤，又申请了木料。" for i in range(7)), "external_commentary"),
    ("Build a shed by the mole.", "direct_user_intent"),
]

MODALITY_CASES = [
    ("You must not moor here", "must_not"),
    ("I can't let you moor here", "must_not"),
    ("Don't moor here", "must_not"),
    ("No barge may enter the lock", "must_not"),
    ("Nobody in the crew should open the valve", "must_not"),
    ("严禁停泊", "must_not"),
    ("You don't have to pay the toll", "may"),
    ("Nobody, by the way, asked: you may dock", "may"),
    ("无需缴费", "may"),
    ("You may moor here", "may"),
    ("The pilot has to sign", "must"),
    ("You ought to slow down", "should"),
    ("The light isn't green", "is_not"),
    ("The light is green", "is"),
    ("No, you must tie up here", "must"),
    ("No problem, you can tie up here", "may"),
    ("There is no doubt that pilots must call first", "must"),
    ("Never mind, you may paint the buoy", "may"),
    ("You do not need to log in at the lock", "may"),
    ("It is not forbidden to read the harbour log", "may"),
    ("It is not prohibited to moor", "may"),
    ("You must repeat failed soundings", "must"),
    ("The sounding failed", "is_not"),
    ("Pilots cannot moor here", "must_not"),
    ("The pilot must note what is not charted", "must"),
    ("Not only ferries may dock", "may"),
]


def structured(spark, *texts):
    rows = utterances(spark, *texts).withColumn("clause", F.col("text")).withColumn("pos", F.lit(0))
    return {r.clause: r for r in extract.structure(rows, R).collect()}


def test_predicate_labels(spark):
    got = structured(spark, *[t for t, _ in PREDICATE_CASES])
    assert {t: got[t].predicate for t, _ in PREDICATE_CASES} == dict(PREDICATE_CASES)
    assert {p for _, p in PREDICATE_CASES} <= set(PREDICATES)


def test_object_keys(spark):
    got = structured(spark, *[t for t, _ in OBJECT_CASES])
    assert {t: got[t].object_key for t, _ in OBJECT_CASES} == dict(OBJECT_CASES)


def test_intents(spark):
    got = {r.text: r.utterance_intent for r in normalize.with_intent(utterances(spark, *[t for t, _ in INTENT_CASES]), R).collect()}
    assert got == dict(INTENT_CASES)
    assert set(got.values()) == set(INTENTS)


def test_phrases_are_not_read_by_their_words(spark):
    assert structured(spark, "You do not need to log in at the lock")["You do not need to log in at the lock"].predicate != "store_log"


def test_modality(spark):
    got = structured(spark, *[t for t, _ in MODALITY_CASES])
    assert {t: got[t].modality for t, _ in MODALITY_CASES} == dict(MODALITY_CASES)


def test_compound_sentence(spark):
    text = "Crane readings are logged, but no reading may enter core memory; preload the full history never. Consult WORLD_STATE.md first"
    rows = extract.structure(extract.clauses(utterances(spark, text), R), R).orderBy("pos").collect()
    assert [(r.predicate, r.modality) for r in rows] == [("store_log", "is"), ("enter_core_memory", "must_not"), ("inject_context", "must_not"), ("read_source", "is")]
    assert [r.object_key for r in rows][1:] == ["core_memory", "history_context", "world_state"]


def test_short_clauses_are_kept(spark):
    rows = extract.clauses(utterances(spark, "A. 停! . \n ok"), R).orderBy("pos").collect()
    assert [r.clause for r in rows] == ["A", "停", "ok"]


def test_file_names_do_not_end_sentences(spark):
    rows = extract.clauses(utterances(spark, "Read WORLD_STATE.md first. Then stop."), R).orderBy("pos").collect()
    assert [r.clause for r in rows] == ["Read WORLD_STATE.md first", "Then stop"]


def test_forms_are_computed_once(spark):
    df, forms = with_forms(spark.createDataFrame([("Can't DOCK, isn't free.",)], "text string"), "text")
    row = df.first()
    assert (row["__low"], row["__words"].split()) == ("can't dock, isn't free.", ["can", "not", "dock", "is", "not", "free"])
    assert forms.words == "__words"


TOOL_CASES = [
    ("run_tests", "ran 4 cases, 4 passed", "test_result", "passed", True),
    ("bash", "9 failed, 1 passed", "test_result", "failed", True),
    ("shell", "test result: ok. 8 passed; 0 failed", "test_result", "passed", True),
    ("pytest", "7 passed, 0 errors", "test_result", "passed", True),
    ("shell", "no errors found, done", "command_output", "passed", False),
    ("make", "failures: 0, ok", "command_output", "passed", False),
    ("git-log", "commit 1f2e", "git_result", "unknown", True),
    ("read_file", "harbour.txt", "filesystem_result", "unknown", True),
    ("search_files", "harbour.txt", "filesystem_result", "unknown", True),
    ("github_search", "two hits", "web_result", "unknown", False),
    ("browser_read_page", "tides", "web_result", "unknown", False),
    ("http_write", "ok", "web_result", "passed", False),
    ("web_file_download", "done", "web_result", "passed", False),
    ("latest_news", "storm", "command_output", "unknown", False),
    ("contest_api", "list", "command_output", "unknown", False),
    ("linkedin_profile", "pilot", "command_output", "unknown", False),
    ("bash", "fatal: no such pier", "command_output", "failed", False),
    ("run_tests", "0 of 9 tests failed", "test_result", "passed", True),
    ("run_tests", "2 of 9 tests failed", "test_result", "failed", True),
    ("run_tests", "10 failed", "test_result", "failed", True),
    ("make", "fixed the failed weld, now green", "command_output", "passed", False),
    ("notes", "error handling described on page two", "command_output", "unknown", False),
    ("run_tests", "KeyError: 'tide'", "test_result", "failed", True),
]


def test_tool_classes(spark):
    df = spark.createDataFrame([(i, n, c) for i, (n, c, *_) in enumerate(TOOL_CASES)], "id int, name string, content string")
    got = [(r.evidence_kind, r.outcome, r.deterministic) for r in normalize.classify_tools(df).orderBy("id").collect()]
    assert got == [(k, o, d) for _, _, k, o, d in TOOL_CASES]


def test_cleaning(spark):
    text = "[PROJECT_STATE]\ntide: low\n</PROJECT_STATE>\nhello <!-- PORT_USER_PROFILE_BEGIN -->\npilot\n<!-- PORT_USER_PROFILE_END --> there\n<!-- A_WORLD_STATE_BEGIN -->kept<!-- B_WORLD_STATE_END -->"
    df = spark.createDataFrame([("p", "a/b c#", "user", text), ("p", "###", "user", "x" * 50)], "project_id string, session_id string, role string, content string")
    a, b = normalize.clean_evidence(df, field_limit=30).orderBy(F.desc("session_id")).collect()
    assert a.clean_content == "hello there\n<!-- A_WORLD_STATE_BEGIN -->kept<!-- B_WORLD_STATE_END -->" and a.clean_session_id == "a_b_c" and a.injected_removed
    assert b.clean_session_id == "default" and b.field_capped and len(b.log_content) == 30 and b.log_content.endswith("[truncated]")
    assert {(r.rule, r.rows_changed) for r in normalize.clean_report(normalize.clean_evidence(df, field_limit=30)).collect()} == {("injected_removed", 1), ("field_capped", 2), ("session_rewritten", 2)}


def test_routing_counts_and_dedup(spark):
    lines = spark.createDataFrame([("p", "s", "user", None, "hi"), ("p", "s", "user", None, "hi"), ("p", "s", "assistant", None, "yo"), ("p", "s", "tool", "ls", "a"), ("p", "s", "system", None, "x")], "project_id string, session_id string, role string, name string, content string")
    assert {k: v.count() for k, v in normalize.route_by_role(lines).items()} == {"user": 2, "assistant_log": 1, "tool": 1, "ignored": 1}
    r = normalize.ingest_counts(lines).first()
    assert (r.user, r.assistant, r.tool, r.tool_evidence, r.ignored, r.duplicates) == (1, 1, 1, 1, 1, 1)
    recs = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 1, "c"), ("z", 1, "d")], "record_id string, ts int, v string")
    kept = normalize.dedup_records(recs, spark.createDataFrame([("z",)], "record_id string"))
    assert {(r.record_id, r.v) for r in kept.collect()} == {("x", "a"), ("y", "c")}


def test_repeats_signals_and_topics(spark):
    u = utterances(spark, "Never  waive an approval", "never waive an APPROVAL", "I prefer tests")
    rows = {r.source_id: r for r in normalize.with_topics(normalize.with_signals(u, R), R).collect()}
    assert rows["u0"].repeated and rows["u1"].repeated and not rows["u2"].repeated
    assert rows["u0"].explicit_rejection and rows["u2"].explicit_preference and not rows["u2"].explicit_rejection
    assert rows["u0"].linked_topics == ["review_flow"] and rows["u2"].linked_topics == ["testing"]
    assert rows["u0"].importance_score > rows["u2"].importance_score


def test_external_material_is_not_extracted(spark):
    u = utterances(spark, "The lighthouse keeper counts nine ships. You must row.", "You must row to the far buoy before noon.")
    known = spark.createDataFrame([("Nine ships pass the lighthouse keeper",), (None,), ("",)], "text string")
    assert normalize.external_overlap(u, known).count() == 0
    known = spark.createDataFrame([("the lighthouse keeper counts nine ships!",)], "text string")
    marked = normalize.mark_external(normalize.with_intent(u, R), normalize.external_overlap(u, known))
    assert {r.source_id: r.utterance_intent for r in marked.collect()} == {"u0": "quoted_evaluation", "u1": "direct_user_intent"}


def test_foreign_sentences_are_found_inside_longer_ones(spark):
    held = ("Yesterday, so he said, the old pilot brought nine barges home and slept", "他说过港口的灯塔今晚不亮了呢", "Row on. Ahoy! Row", "nine barges home the old pilot brought", "x 港口的灯塔今晚不亮. nine", None)
    foreign = ["The old pilot brought nine barges home.", "港口的灯塔今晚不亮。Ahoy", "brought nine barges home and never", "nine barges"]
    known = spark.createDataFrame([(t,) for t in foreign], "text string")
    got = {r.source_id: r.shared_sentences for r in normalize.external_overlap(utterances(spark, *held), known).collect()}
    assert got == {"u0": 1, "u1": 1, "u2": 1, "u4": 1}
    assert normalize.external_overlap(utterances(spark, *held).limit(0), known).count() == 0


def test_pipeline_end_to_end(spark):
    users = utterances(spark, "An assistant reply must not enter core memory.", "Verdict: the mole holds. Core memory must grow.")
    agents = utterances(spark, "An assistant reply may enter core memory", source="agent_interpretation").withColumn("source_id", F.lit("i0"))
    tools = spark.createDataFrame([("p", "t0", "s", "me", None, "pytest", "3 passed", "pytest suite")], "project_id string, source_id string, session_id string, user_id string, ts timestamp, name string, content string, object string")
    run = govern.govern(users, normalize.classify_tools(tools), agents)
    rows = {(r.source_type, r.predicate): r for r in run.decisions.collect()}
    assert set(rows) == {("user_utterance", "enter_core_memory"), ("agent_interpretation", "enter_core_memory"), ("tool_evidence", "test_passed")}
    tool = rows[("tool_evidence", "test_passed")]
    assert "tool_evidence" in tool.score_signals and tool.requires_governance_gate_for_world_state and not tool.include_in_world_state and tool.allowed
    assert all(not r.include_in_world_state for r in rows.values() if r.status == "candidate")
    assert [r.type for r in run.conflicts.collect()] == ["user_vs_agent"]
    assert run.state().first().compact_characters <= 1600
    assert {r.item_id for r in run.admitted.collect()} == {r.item_id for r in rows.values() if r.allowed}


def test_same_result_under_repartition(spark):
    users = utterances(spark, *[f"Rule {i % 7}: you must not create AGENTS.md. You may create AGENTS.md." for i in range(30)])
    a = govern.scored_claims(govern.evidence_bridge(users, R)).orderBy("item_id").collect()
    b = govern.scored_claims(govern.evidence_bridge(users.repartition(5), R)).orderBy("item_id").collect()
    assert a == b and sum(r.mention_count for r in a) == 60 and max(r.evidence_count for r in a) == 30


def test_rules_from_a_lexicon_table(spark):
    rows = [("predicate", "deploy", "create", 2), ("predicate", "ship it", "create", 3), ("predicate", "deploy log", "store_log", 1), ("request_cues", "kindly", "", 1)]
    rules = Rules.from_rows(rows)
    assert rules.predicate == (("store_log", ("deploy log",)), ("create", ("deploy", "ship it"))) and rules.request_cues == ("kindly",)
    assert rules.modality == R.modality
    df = utterances(spark, "open the deploy log", "deploy now").withColumn("clause", F.col("text"))
    assert [r.predicate for r in extract.structure(df, rules).orderBy("source_id").collect()] == ["store_log", "create"]
    with pytest.raises(ValueError):
        Rules.from_rows([("nonsense", "x", "y", 1)])


def test_quotes_in_terms_are_safe(spark):
    rules = Rules.from_rows([("predicate", "l\u2019été d'août \\\\ '", "create", 1)])
    df = utterances(spark, "Dans l\u2019été d'août \\\\ ' ici").withColumn("clause", F.col("text"))
    assert extract.structure(df, rules).first().predicate == "create"
