"""Sentences about the driver's suppliers, and the labels that the default rules must give them.

``{}`` stands for a supplier's name. What a sentence must be labelled is written beside it by hand: the SQL reads these
labels, never the rules.
"""

from __future__ import annotations

#: (sentence, predicate, modality, object key where it is one of the known ones)
CLAUSES = (
    ("The final answer of {} must never enter core memory", "enter_core_memory", "must_not", "assistant_output"),
    ("Claims of {} belong in long-term memory", "enter_core_memory", "is", None),
    ("Each change by {} waits for a sign off", "require_review", "is", None),
    ("{} 的改动必须经过审批", "require_review", "must", None),
    ("You do not need to preload the chat history of {}", "inject_context", "may", "history_context"),
    ("The nightly job of {} must not call LLM for a digest", "call_llm", "must_not", None),
    ("Before an order, {} should consult the original record", "read_source", "should", None),
    ("It is not forbidden to read the raw logs of {}", "read_source", "may", "raw_logs"),
    ("Prices of {} are displayed in euros", "render", "is", None),
    ("An offer of {} can carry an evidence weight", "score_evidence", "may", None),
    ("{} has to settle the conflict with the carrier", "resolve_conflict", "must", None),
    ("The test suite of {} failed", "test_passed", "is_not", "test_suite"),
    ("{} 不得新建清单", "create", "must_not", None),
    ("Deliveries by {} are only logged", "store_log", "is", None),
    ("Nobody at {} may override the user profile", "override", "must_not", "user_profile"),
    ("The world state update of {} is not done", "update_world_state", "is_not", "world_state"),
    ("No, you must keep the pallets of {}", "requires", "must", None),
    ("No problem, you can pick up the pallets of {}", "states", "may", None),
    ("There is no doubt that {} must ask first", "requires", "must", None),
    ("Never mind, {} may deliver on Monday", "states", "may", None),
    ("You do not need to log in at {}", "states", "may", None),
    ("{} must repeat failed deliveries", "requires", "must", None),
    ("{} cannot deliver on Sunday", "requires", "must_not", None),
    ("{} ships by rail", "states", "is", None),
)

#: (text, intent)
UTTERANCES = (
    ("Could you call {}?", "direct_user_intent"),
    ("Write to {} today.", "direct_user_intent"),
    ("帮我联系 {}。", "direct_user_intent"),
    ("{} must not deliver at night.", "direct_user_intent"),
    ("Take a look at the evaluation of {}:\nPunctual. Progress: 80%.", "mixed_request_with_quote"),
    ("看一下 {} 的评价：\n很准时。", "mixed_request_with_quote"),
    ("{} came twice. Progress judgement: 80%. One pallet is late.", "quoted_evaluation"),
    ("Verdict: {} is punctual.", "quoted_evaluation"),
    ("{} came at dawn.\nThe gate was shut.\nThey went to build a ramp.\nRain fell.\nNobody could write it down.\nThe clerk slept.\nAt noon it opened.", "external_commentary"),
)

#: (tool, output, kind, outcome)
OUTPUTS = (
    ("run_tests", "{}: 0 of 12 tests failed", "test_result", "passed"),
    ("run_tests", "{}: 3 of 12 tests failed", "test_result", "failed"),
    ("pytest", "{}: 7 passed, 0 errors", "test_result", "passed"),
    ("make", "{}: fixed the failed build, now green", "command_output", "passed"),
    ("read_file", "error handling of {} documented in file", "filesystem_result", "unknown"),
    ("shell", "KeyError: {}", "command_output", "failed"),
    ("git_status", "on branch {}", "git_result", "unknown"),
    ("web_search", "offers of {}", "web_result", "unknown"),
)
