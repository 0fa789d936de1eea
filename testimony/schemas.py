"""Declared schemas of the evidence tables, as they come in and go out."""

from __future__ import annotations

STRUCTURED = (
    "struct<subject:string,predicate:string,object:string,object_key:string,scope:string,modality:string,valid_from:timestamp,valid_until:timestamp,"
    "source_refs:array<string>,confidence_reason:string,supersedes:array<string>>"
)
ITEM = (
    "id string, claim string, category string, confidence int, evidence array<string>, conflicts array<string>, last_verified timestamp, stability string,"
    " include_in_world_state boolean, source_type string, status string, topics array<string>, structured " + STRUCTURED + ","
    " evidence_types array<string>, score_signals array<string>, superseded_by string, utterance_intents array<string>,"
    " requires_governance_gate_for_world_state boolean, conditional_conflict_block struct<conflict_id:string,condition:string,blocks_world_state:boolean>"
)
TABLES = {
    "user_utterances": "id string, session_id string, timestamp timestamp, text string, source string, utterance_intent string, importance_score int,"
    " signals struct<long_form:boolean,repeated:boolean,explicit_preference:boolean,explicit_rejection:boolean,strong_emphasis:boolean>, linked_topics array<string>, notes string",
    "agent_interpretations": "id string, session_id string, timestamp timestamp, based_on_utterance_ids array<string>, agent_understanding string, inferred_goals array<string>,"
    " inferred_constraints array<string>, risks array<string>, confidence int, possible_misreadings array<string>, status string",
    "tool_calls": "id string, session_id string, timestamp timestamp, name string, content string",
    "tool_evidence": "id string, session_id string, timestamp timestamp, tool_name string, source_log_id string, source string, evidence_kind string, deterministic boolean,"
    " outcome string, content_summary string, linked_topics array<string>, notes string",
    "items": ITEM,
    "conflicts": "id string, timestamp timestamp, type string, item_a string, item_b string, description string, severity int, resolution string, chosen_side string, reason string,"
    " resolved_at timestamp, resolution_type string, condition string, blocks_world_state boolean",
    "proposed_updates": "id string, timestamp timestamp, claim string, category string, evidence array<string>, confidence int, reason string, conflicts array<string>,"
    " suggested_action string, should_update_world_state boolean, status string, structured " + STRUCTURED,
    "feedback_events": "id string, timestamp timestamp, session_id string, task_id string, event_family string, event_name string, target_type string, target_id string,"
    " outcome string, severity int, source_type string, source_refs array<string>, confidence int, notes string",
    "scoring_feedback": "id string, timestamp timestamp, proposal_id string, action string, proposal_confidence int, category string, should_update_world_state boolean,"
    " signals array<string>, note string, applied_to_weights boolean",
    "rule_change_proposals": "id string, timestamp timestamp, kind string, status string, requires_explicit_apply boolean, evidence array<string>, simulation_report_path string, applied_at timestamp",
    "rule_change_log": "id string, timestamp timestamp, proposal_id string, applied_at timestamp",
}

# (table, field, table the field refers to). An evidence id may name any raw record.
REFERENCES = (
    ("items", "evidence", "evidence"),
    ("items", "supersedes", "items"),
    ("conflicts", "item_a", "items"),
    ("conflicts", "item_b", "items"),
    ("proposed_updates", "evidence", "evidence"),
    ("proposed_updates", "conflicts", "conflicts"),
    ("proposed_updates", "supersedes", "items"),
    ("tool_evidence", "source_log_id", "tool_calls"),
    ("agent_interpretations", "based_on_utterance_ids", "user_utterances"),
    ("feedback_events", "source_refs", "evidence"),
    ("rule_change_proposals", "evidence", "feedback_events"),
    ("rule_change_log", "proposal_id", "rule_change_proposals"),
)
EVIDENCE_TABLES = ("user_utterances", "agent_interpretations", "tool_evidence")
