from __future__ import annotations

import json

from pyspark.sql import functions as F

from testimony.operators import conflicts, gate
from testimony.plans import govern
from testimony.sources import tables
from testimony.sources.transcripts import read_transcript_stream
from testimony.streaming import ingest
from testimony.streaming.projects import govern_touched


def record(i, modality="must", **kw):
    s = dict(subject="world_state", predicate="render", object="x", object_key="x", scope="project", modality=modality, valid_from="2026-01-01T00:00:00Z", valid_until=None, source_refs=[], confidence_reason="", supersedes=[])
    s.update(kw.pop("structured", {}))
    base = dict(id=i, claim=f"claim {i}", category="constraint", confidence=98, evidence=["u1"], conflicts=[], stability="stable", include_in_world_state=True, source_type="manual_initialization", status="accepted", topics=[], structured=s)
    return {**base, **kw}


def put(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n", encoding="utf-8")
    return str(path)


def test_items_document_and_lines_give_the_same_claims(spark, tmp_path):
    rows = [record("a"), record("b", "must_not", utterance_intents=["direct_user_intent", "quoted_evaluation"]), record("c", conditional_conflict_block={"conflict_id": "k", "condition": "w", "blocks_world_state": True}, structured={"object_key": "y"})]
    doc = tmp_path / "table.json"
    doc.write_text(json.dumps({"items": rows}, indent=1), encoding="utf-8")
    a = tables.flat_items(tables.read_item_document(spark, str(doc), "p"))
    b = tables.flat_items(tables.read_table(spark, "items", put(tmp_path / "items.jsonl", rows), "p"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    found = conflicts.detect_conflicts(a)
    assert found.count() == 1
    d = {r.item_id: r.reasons for r in gate.gate(a, conflicts=found).collect()}
    assert "quoted_or_external_material" in d["b"] and "conditional_conflict_block" in d["c"] and d["a"] == ["unresolved_high_severity_conflict"]


def test_missing_file_is_an_empty_table(spark, tmp_path):
    assert tables.read_table(spark, "conflicts", str(tmp_path / "none.jsonl"), "p").count() == 0


def test_validation_names_missing_ids(spark, tmp_path):
    def load(name, rows):
        return tables.read_table(spark, name, put(tmp_path / f"{name}.jsonl", rows), "p")

    good = {
        "user_utterances": load("user_utterances", [{"id": "u1", "text": "hi"}]),
        "agent_interpretations": load("agent_interpretations", [{"id": "i1", "based_on_utterance_ids": ["u1"]}]),
        "tool_calls": load("tool_calls", [{"id": "l1"}]),
        "tool_evidence": load("tool_evidence", [{"id": "t1", "source_log_id": "l1"}]),
        "items": load("items", [record("a"), record("b", evidence=["t1", "i1"], structured={"supersedes": ["a"]})]),
        "conflicts": load("conflicts", [{"id": "c1", "item_a": "a", "item_b": "b"}]),
        "proposed_updates": load("proposed_updates", [{"id": "p1", "evidence": ["u1"], "conflicts": ["c1"]}]),
        "feedback_events": load("feedback_events", [{"id": "f1", "source_refs": ["u1"]}]),
        "rule_change_proposals": load("rule_change_proposals", [{"id": "r1", "evidence": ["f1"]}]),
        "rule_change_log": load("rule_change_log", [{"id": "g1", "proposal_id": "r1"}]),
    }
    assert tables.validate_tables(good).count() == 0
    bad = {
        **good,
        "conflicts": load("conflicts", [{"id": "c1", "item_a": "a", "item_b": "gone"}]),
        "items": load("items", [record("a", evidence=["u404"]), record("b", structured={"supersedes": ["a404"]})]),
        "rule_change_log": load("rule_change_log", [{"id": "g1", "proposal_id": "r404"}]),
        "feedback_events": load("feedback_events", [{"id": "f1", "source_refs": ["s404"]}]),
    }
    got = {(r.table, r.field, r.missing_id) for r in tables.validate_tables(bad).collect()}
    assert got == {("conflicts", "item_b", "gone"), ("items", "evidence", "u404"), ("items", "supersedes", "a404"), ("rule_change_log", "proposal_id", "r404"), ("feedback_events", "source_refs", "s404")}


def test_stream_governs_touched_projects_like_a_batch(spark, tmp_path):
    texts = {"p": ["You must not create AGENTS.md.", "You may create AGENTS.md."], "q": ["Never inject the full history."]}
    for project, said in texts.items():
        for i, text in enumerate(said):
            (tmp_path / "in" / project).mkdir(parents=True, exist_ok=True)
            put(tmp_path / "in" / project / f"s{i}.jsonl", [{"role": "user", "content": text, "timestamp": f"2026-01-01T00:0{i}:00Z"}, {"role": "assistant", "content": "You must create AGENTS.md."}])
    store, out = str(tmp_path / "store"), str(tmp_path / "decisions")
    lines = read_transcript_stream(spark, str(tmp_path / "in" / "*"), max_files=1)
    ingest.ingest_stream(lines, store, str(tmp_path / "ck"), then=govern_touched(store, out)).awaitTermination()
    cols = ["project_id", "item_id", "confidence", "allowed", "reasons"]
    streamed = spark.read.parquet(out).select(*cols).collect()
    whole = govern.govern(ingest.utterances_of(ingest.stored_records(spark, store))).decisions.select(*cols).collect()
    assert sorted(map(str, streamed)) == sorted(map(str, whole)) and len(whole) == 3
    assert spark.read.parquet(out).where(F.array_contains("reasons", "unresolved_high_severity_conflict")).count() == 2
