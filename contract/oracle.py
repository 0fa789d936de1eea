"""Plain SQL for every query, built from the same rule data."""

from __future__ import annotations

import re

from contract import sentences
from contract.lift import LAX, OPEN, PROSE_RULES, SIM_POLICY, STRICT
from contract.queries import RULESET_HASH
from testimony.functions.text import term_key
from testimony.operators.gate import BUDGETS
from testimony.rules import (
    AUTHORITY,
    BASE_CONFIDENCE,
    CATEGORY_OF_MODALITY,
    CEILING,
    DOCTRINE,
    FAIL_COUNT,
    FAIL_WORD,
    MODALITY_WORDS,
    NAMED_FAILURE,
    NO_FAILURE,
    PASS_WORD,
    PREDICATE_WORDS,
    READ_CUES,
    SIGNAL_WEIGHTS,
    TOOL_OUTPUT,
    TOOL_SEGMENTS,
    Policy,
)

R = PROSE_RULES


def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(x: str) -> str:
    return f"' ' || regexp_replace(replace(regexp_replace(lower({x}), '(can|won)[’'']t', '\\1 not', 'g'), 'n''t', ' not'), '[^a-z0-9]+', ' ', 'g') || ' '"


def has(w: str, terms) -> str:
    return "(" + " OR ".join(f"contains(({w}), {s(term_key(t)[0])})" for t in terms) + ")"


def case(w: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(w, terms)} THEN {s(label)}" for label, terms in rules) + f" ELSE {default} END"


def pick(col: str, values: dict, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {s(k)} THEN {s(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {default} END"


def rank(col: str, order) -> str:
    return pick(col, {v: i for i, v in enumerate(order)}, str(len(order)))


def array(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def word_sequence(x: str) -> str:
    apart = f"regexp_replace(lower({x}), '(\\p{{Han}}|\\p{{Hiragana}}|\\p{{Katakana}})', ' \\1 ', 'g')"
    return f"list_filter(string_split_regex({apart}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def tokens(x: str) -> str:
    return f"list_distinct({word_sequence(x)})"


SPLIT = "[.;!?\\n。；！？]+"
ADVERSATIVE = "|".join(R.adversatives)
PROTECTED = f"regexp_replace(regexp_replace(text, '([A-Za-z0-9_])[.]([A-Za-z0-9])', '\\1' || chr(1) || '\\2', 'g'), '[,，][ ]*({ADVERSATIVE})', chr(10) || '\\1', 'g')"
ALIASES = sorted(((a, k) for k, names in R.objects for a in names), key=lambda x: (-len(x[0]), x[0]))
SLUG = "regexp_replace(regexp_replace(lower(object), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
SLOT = "project_id, scope, subject, predicate, object_key"
FLAG_NAMES = ("long_form", "explicit_preference", "explicit_rejection", "strong_emphasis")
FLAG_SQL = f"""length(text) >= {R.long_form_chars} AS long_form, {has('w', R.preference)} AS explicit_preference,
    {has('w', R.rejection)} AS explicit_rejection, {has('w', R.emphasis)} AS strong_emphasis"""
TEXT_KEY = "sha256(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')))"
USERISH = "source_type IN ('user_utterance', 'proposed_update', 'manual_initialization')"
SIGNALS = array(
    [
        "CASE WHEN source_type = 'agent_interpretation' THEN 'agent_interpretation' END",
        "CASE WHEN source_type = 'tool_evidence' AND deterministic THEN 'tool_deterministic' END",
        "CASE WHEN source_type = 'tool_evidence' THEN 'tool_evidence' END",
        f"CASE WHEN {USERISH} AND explicit_preference THEN 'user_explicit_preference' END",
        f"CASE WHEN {USERISH} AND explicit_rejection THEN 'user_explicit_rejection' END",
        f"CASE WHEN {USERISH} AND long_form THEN 'user_long_form' END",
        f"CASE WHEN {USERISH} AND repeated THEN 'user_repeated' END",
        f"CASE WHEN {USERISH} AND strong_emphasis THEN 'user_strong_emphasis' END",
    ]
)


def gained(weight: dict[str, str]) -> str:
    return f"""(CASE WHEN source_type = 'agent_interpretation' THEN {weight['agent_interpretation']} ELSE 0 END
    + CASE WHEN source_type = 'tool_evidence' THEN {weight['tool_evidence']} + CASE WHEN deterministic THEN {weight['tool_deterministic']} ELSE 0 END ELSE 0 END
    + CASE WHEN {USERISH} THEN CASE WHEN explicit_preference THEN {weight['user_explicit_preference']} ELSE 0 END
        + CASE WHEN explicit_rejection THEN {weight['user_explicit_rejection']} ELSE 0 END
        + CASE WHEN long_form THEN {weight['user_long_form']} ELSE 0 END
        + CASE WHEN repeated THEN {weight['user_repeated']} ELSE 0 END
        + CASE WHEN strong_emphasis THEN {weight['user_strong_emphasis']} ELSE 0 END ELSE 0 END)"""


def confidence(weight: dict[str, str]) -> str:
    return f"CAST(least({pick('source_type', CEILING, '100')}, {pick('source_type', BASE_CONFIDENCE, '50')} + {gained(weight)}) AS INTEGER)"


STATIC = {k: str(v) for k, v in SIGNAL_WEIGHTS.items()}
AUTH = lambda col: pick(col, AUTHORITY, "0")
PARTY = lambda col: pick(col, {"user_utterance": "user", "tool_evidence": "tool", "agent_interpretation": "agent", "proposed_update": "accepted", "manual_initialization": "accepted"}, "'other'")
ITEM_COLS = "project_id, item_id, slot_id, scope, subject, predicate, object, object_key, modality, category, claim, source_type, status, evidence_count, mention_count, valid_from, last_verified, confidence_reason, long_form, explicit_preference, explicit_rejection, strong_emphasis, repeated, deterministic"


def conflicts_of(items: str, extra: str = "") -> str:
    return f"""SELECT n.project_id, sha256('conflict|' || least(n.item_id, p.item_id) || '|' || greatest(n.item_id, p.item_id)) AS conflict_id,
    n.scope, n.subject, n.predicate, n.object_key, least(n.item_id, p.item_id) AS item_a, greatest(n.item_id, p.item_id) AS item_b,
    CASE WHEN (n.status = 'accepted' AND p.status = 'candidate') OR (n.status = 'candidate' AND p.status = 'accepted') THEN 'old_vs_new'
        WHEN {AUTH('n.source_type')} >= {AUTH('p.source_type')} THEN {PARTY('n.source_type')} || '_vs_' || {PARTY('p.source_type')}
        ELSE {PARTY('p.source_type')} || '_vs_' || {PARTY('n.source_type')} END AS type,
    CAST(least(100, CASE p.modality WHEN 'must' THEN 90 WHEN 'is' THEN 85 ELSE 80 END + abs({AUTH('n.source_type')} - {AUTH('p.source_type')})) AS INTEGER) AS severity,
    'unresolved' AS resolution,
    CASE WHEN {AUTH('n.source_type')} > {AUTH('p.source_type')} THEN n.item_id WHEN {AUTH('p.source_type')} > {AUTH('n.source_type')} THEN p.item_id ELSE '' END AS chosen_side,
    n.modality || ' against ' || p.modality || ' on ' || n.object_key AS description
    FROM {items} n JOIN {items} p ON n.project_id = p.project_id AND n.scope = p.scope AND n.subject = p.subject AND n.predicate = p.predicate AND n.object_key = p.object_key
    AND ((n.modality = 'must_not' AND p.modality IN ('may', 'must')) OR (n.modality = 'is_not' AND p.modality = 'is'))
    WHERE n.status IN ('candidate', 'accepted') AND p.status IN ('candidate', 'accepted') {extra}"""


def best(prefix: str = "") -> str:
    return f"{AUTH(prefix + 'source_type')} DESC, ({prefix}status = 'accepted') DESC, {prefix}confidence DESC, {prefix}evidence_count DESC, {prefix}item_id"


def members_of(items: str) -> str:
    keys = f"{SLOT}, modality"
    return f"""SELECT *, sha256('candidate_cluster|' || concat_ws('|', {keys})) AS cluster_id,
    first_value(item_id) OVER (PARTITION BY {keys} ORDER BY {best()}) AS representative_id,
    first_value(source_type) OVER (PARTITION BY {keys} ORDER BY {best()}) AS representative_source,
    count(*) OVER (PARTITION BY {keys}) AS member_count,
    count(*) FILTER (source_type = 'user_utterance') OVER (PARTITION BY {keys}) AS user_members
    FROM {items} WHERE status IN ('candidate', 'accepted')"""


ACTION = "CASE WHEN user_members > 0 AND member_count > user_members THEN 'prefer_user_anchor_block_weaker_duplicates' ELSE 'keep_representative_block_duplicates' END AS governance_action"


def decided_of(items: str, conflicts: str, dups: str, policy: Policy, conditional: bool) -> str:
    threshold = f"CASE source_type WHEN 'user_utterance' THEN {policy.min_confidence_user} WHEN 'tool_evidence' THEN {policy.min_confidence_tool} ELSE {policy.min_confidence} END"
    stable = f"(status = 'accepted' AND source_type IN ({', '.join(s(x) for x in policy.allowed_accepted_sources)}))"
    held = f"(resolution = 'unresolved' AND severity >= {policy.min_conflict_severity}) OR resolution = 'deferred'"
    unsettled = " UNION SELECT item_a FROM unsettled UNION SELECT item_b FROM unsettled" if conditional else ""
    cond = f"item_id IN (SELECT item_a FROM {conflicts} WHERE blocks_world_state UNION SELECT item_b FROM {conflicts} WHERE blocks_world_state)" if conditional else "false"
    checks = array(
        [
            "CASE WHEN status IN ('superseded', 'rejected', 'deferred', 'expired') THEN 'stale_or_rejected' END",
            f"CASE WHEN item_id IN (SELECT item_a FROM {conflicts} WHERE {held} UNION SELECT item_b FROM {conflicts} WHERE {held}{unsettled}) THEN 'unresolved_high_severity_conflict' END",
            f"CASE WHEN {cond} THEN 'conditional_conflict_block' END",
            "CASE WHEN source_type = 'agent_interpretation' THEN 'agent_only_evidence' END",
            f"CASE WHEN item_id IN (SELECT item_id FROM {dups} WHERE item_id <> representative_id) THEN 'blocked_as_duplicate_candidate' END",
            "CASE WHEN evidence_count = 0 THEN 'missing_evidence' END",
            "CASE WHEN source_type = 'tool_evidence' AND NOT deterministic THEN 'tool_evidence_not_deterministic' END",
            f"CASE WHEN confidence < {threshold} THEN 'confidence_below_' || {threshold} END",
        ]
    )
    blocks = ", ".join(s(b) for b in policy.constitutional_blocks)
    return f"""SELECT * EXCLUDE (failing), CASE WHEN {stable} AND NOT constitutional_block
        THEN list_filter(failing, lambda x: x NOT IN ('missing_evidence', 'blocked_as_duplicate_candidate')) ELSE failing END AS reasons
    FROM (SELECT *, len(list_intersect(failing, [{blocks}])) > 0 AS constitutional_block FROM (SELECT *, {checks} AS failing FROM {items}))"""


def order_of(policy: Policy) -> str:
    return f"{rank('source_type', policy.source_priority)}, {rank('predicate', policy.predicate_priority)}, {rank('modality', policy.modality_priority)}, confidence DESC, item_id"


def budget_ctes(tag: str, decided: str, policy: Policy) -> dict[str, tuple[str, ...]]:
    """The stages of the admission budget, each over what the one before kept."""
    out, prev, stages = {}, f"(SELECT * FROM {decided} WHERE len(reasons) = 0)", []
    for name, keys in BUDGETS:
        cap = getattr(policy, name)
        if cap > 0:
            cte = f"{tag}_{name}"
            out[cte] = f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order_of(policy)}) AS rn FROM {prev}) WHERE rn <= {cap}"
            stages.append((name, cte))
            prev = cte
    if stages:
        chain = " ".join(f"WHEN item_id NOT IN (SELECT item_id FROM {cte}) THEN ['blocked_by_gate_budget_{name}']" for name, cte in stages)
        out[tag] = f"SELECT * REPLACE (CASE WHEN len(reasons) > 0 THEN reasons {chain} ELSE reasons END AS reasons), len(reasons) = 0 AND item_id IN (SELECT item_id FROM {stages[-1][1]}) AS allowed FROM {decided}"
    else:
        out[tag] = f"SELECT *, len(reasons) = 0 AS allowed FROM {decided}"
    return out


READ = "(predicate = 'render' AND (" + has(words("object"), [t for t in READ_CUES if t.isascii()]) + "".join(f" OR contains(lower(object), {s(t)})" for t in READ_CUES if not t.isascii()) + "))"
LINE = f"'- ' || {pick('modality', MODALITY_WORDS, 'modality')} || {pick(f'(CASE WHEN {READ} THEN ' + s('read_source') + ' ELSE predicate END)', PREDICATE_WORDS, 'predicate')} || '：' || object"
LEVEL = f"{rank('source_type', Policy().source_priority)} * 1000000 + {rank('predicate', Policy().predicate_priority)} * 10000 + {rank('modality', Policy().modality_priority)} * 1000 + (100 - confidence)"


def filled(source: str, keys: str, order: str, budget: int) -> str:
    """Rows taken in order while they fit what is left; those that don't are passed over."""
    take = "x.cost <= a.left"
    return f"""SELECT * EXCLUDE (n, taken), row_number() OVER (PARTITION BY {keys} ORDER BY n) AS rank, sum(cost) OVER (PARTITION BY {keys} ORDER BY n ROWS UNBOUNDED PRECEDING) AS running
        FROM (SELECT *, length(line) + 1 AS cost, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM ({source}))
        JOIN (SELECT {keys}, list_reduce(list_prepend({{'n': 0::BIGINT, 'cost': 0::BIGINT, 'left': {budget}::BIGINT, 'taken': []::BIGINT[]}},
            list({{'n': n, 'cost': cost::BIGINT, 'left': 0::BIGINT, 'taken': []::BIGINT[]}} ORDER BY n)),
            lambda a, x: {{'n': x.n, 'cost': x.cost, 'left': CASE WHEN {take} THEN a.left - x.cost ELSE a.left END, 'taken': CASE WHEN {take} THEN list_append(a.taken, x.n) ELSE a.taken END}}).taken AS taken
            FROM (SELECT *, length(line) + 1 AS cost, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM ({source})) GROUP BY {keys}) USING ({keys})
        WHERE list_contains(taken, n)"""


def lines_of(claims: str) -> str:
    doctrine = ", ".join(f"({i - len(DOCTRINE)}, {s('- ' + d)})" for i, d in enumerate(DOCTRINE))
    lines = f"""SELECT project_id, {LEVEL} AS priority, item_id, {LINE} AS line FROM {claims}
        UNION ALL SELECT project_id, d.p, '', d.line FROM (SELECT DISTINCT project_id FROM governed), (VALUES {doctrine}) d(p, line)"""
    return filled(lines, "project_id", "priority, item_id", 1600)


def fingerprint(cols: str) -> str:
    return f"CAST(sum(CAST(('0x' || substring(sha256(concat_ws('|', {cols})), 1, 15)) AS UBIGINT)) AS VARCHAR)"


def run_ctes(tag: str, policy: Policy) -> dict[str, str]:
    """The claims under the present weights (scenario '') and under each proposal, ids prefixed with their scenario."""
    held = "resolution = 'unresolved' OR resolution = 'deferred'"
    weight = {k: f"CASE WHEN changed = {s(k)} THEN new_weight ELSE {v} END" for k, v in STATIC.items()}
    out = {
        f"{tag}_scored": f"""SELECT * REPLACE (scenario || '|' || project_id AS project_id, scenario || '|' || item_id AS item_id, scenario || '|' || slot_id AS slot_id), {confidence(weight)} AS confidence
            FROM (SELECT *, project_id AS base_project, item_id AS base_item FROM claims), (SELECT proposal_id AS scenario, signal AS changed, new_weight FROM proposals UNION ALL SELECT '', '', 0)""",
        f"{tag}_found": conflicts_of(f"{tag}_scored"),
        f"{tag}_items": f"SELECT *, (status = 'accepted' AND confidence >= 90 AND item_id NOT IN (SELECT item_a FROM {tag}_found WHERE {held} UNION SELECT item_b FROM {tag}_found WHERE {held})) AS include_in_world_state FROM {tag}_scored",
        f"{tag}_members": members_of(f"{tag}_items"),
        f"{tag}_decided": decided_of(f"{tag}_items", f"{tag}_found", f"{tag}_members", policy, conditional=False),
    }
    out.update(budget_ctes(tag, f"{tag}_decided", policy))
    return out


LAST_ACTION = """CASE WHEN substring(conflict_id, 1, 1) IN ('0', '1', '2', '3') THEN 'choose-a' WHEN substring(conflict_id, 1, 1) IN ('4', '5') THEN 'choose-b'
    WHEN substring(conflict_id, 1, 1) IN ('6', '7') THEN 'defer' WHEN substring(conflict_id, 1, 1) = '8' THEN 'mark-resolved'
    WHEN substring(conflict_id, 1, 1) IN ('9', 'a') THEN 'coexist-by-condition' WHEN substring(conflict_id, 2, 1) < '8' THEN 'defer' END"""


def resolve_of(found: str, action: str, condition: str, reason: str) -> str:
    return f"""SELECT * EXCLUDE (act) REPLACE (
        CASE WHEN act = 'defer' THEN 'deferred' WHEN act IS NOT NULL THEN 'resolved' ELSE resolution END AS resolution,
        CASE WHEN act = 'choose-a' THEN item_a WHEN act = 'choose-b' THEN item_b WHEN act IS NOT NULL THEN '' ELSE chosen_side END AS chosen_side),
    CASE WHEN act IS NULL THEN '' ELSE replace(act, '-', '_') END AS resolution_type,
    CASE WHEN act = 'choose-a' THEN item_b WHEN act = 'choose-b' THEN item_a ELSE '' END AS loser,
    coalesce(act IN ('choose-a', 'choose-b'), false) AS superseding,
    CASE WHEN act = 'coexist-by-condition' THEN {s(condition)} ELSE '' END AS condition,
    coalesce(act = 'coexist-by-condition', false) AS blocks_world_state,
    CASE WHEN act IS NULL THEN '' ELSE {s(reason)} END AS reason
    FROM (SELECT *, {action} AS act FROM {found})"""


def tool_kind() -> str:
    segments = "string_split_regex(lower(name), '[^a-z0-9]+')"
    named = {k: f"list_has_any({segments}, [{', '.join(map(s, terms))}])" for k, terms in TOOL_SEGMENTS}
    said = {k: f" OR regexp_matches(lower(content), '{p}')" for k, p in TOOL_OUTPUT}
    web = f"{named['web_result']} AND NOT (list_contains({segments}, 'search') AND {named['filesystem_result']})"
    rest = " ".join(f"WHEN {named[k]}{said.get(k, '')} THEN '{k}'" for k in ("test_result", "git_result", "filesystem_result"))
    return f"CASE WHEN {web} THEN 'web_result' {rest} ELSE 'command_output' END"


def outcome() -> str:
    told = f"regexp_replace(lower(content), '{NAMED_FAILURE}', ' ', 'g')"
    rest = f"regexp_replace({told}, '{NO_FAILURE}', ' ', 'g')"
    failed = f"regexp_matches({rest}, '{FAIL_COUNT}') OR regexp_matches({rest}, '{FAIL_WORD}')"
    return f"CASE WHEN {failed} THEN 'failed' WHEN regexp_matches({rest}, '{PASS_WORD}') OR regexp_matches({told}, '{NO_FAILURE}') THEN 'passed' ELSE 'unknown' END"


def maxes(names) -> str:
    return ", ".join(f"max({n}) AS {n}" for n in names)


MENTION_KEYS = f"item_id, slot_id, {SLOT}, modality, source_type, source_id, session_id, user_id, ts"
IDS = f"sha256(concat_ws('|', {SLOT})) AS slot_id, sha256(concat_ws('|', sha256(concat_ws('|', {SLOT})), modality, source_type)) AS item_id"
CATEGORY = pick("modality", CATEGORY_OF_MODALITY, "NULL")
HELD = "resolution = 'unresolved' OR resolution = 'deferred' OR blocks_world_state"

CTES: dict[str, str] = {
    "conv": "SELECT 'p' || (conv_id % 10) AS project_id, 'c' || conv_id AS session_id, turn, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 1000 + turn) AS ts, role, text AS content, conv_id FROM conversations",
    "docs": "SELECT source AS project_id, 'utt_' || doc_id AS source_id, 's' || (doc_id // 10) AS session_id, lang AS user_id, CASE WHEN (doc_id // 20) % 5 = 4 THEN 'agent_interpretation' ELSE 'user_utterance' END AS source_type, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts, text, doc_id FROM documents",
    "utt": """SELECT project_id, source_id, session_id, user_id, source_type, ts, text FROM docs WHERE source_type = 'user_utterance'
        UNION ALL SELECT project_id, 'utt_' || session_id || '_' || turn, session_id, 'u' || (conv_id % 7), 'user_utterance', ts, content FROM conv WHERE role = 'user'""",
    "utti": f"""SELECT *, CASE WHEN {has('w', R.quote_cues)} AND {has('w', R.request_cues)} THEN 'mixed_request_with_quote' WHEN {has('w', R.quote_cues)} THEN 'quoted_evaluation'
        WHEN {has('w', R.request_cues)} THEN 'direct_user_intent' WHEN length(text) - length(replace(text, chr(10), '')) + 1 >= {R.narrative_lines} THEN 'external_commentary' ELSE 'direct_user_intent' END AS utterance_intent,
        {FLAG_SQL} FROM (SELECT *, {words('text')} AS w FROM utt)""",
    "spoken": f"SELECT project_id, source_id, session_id, user_id, source_type, ts, text, {', '.join(FLAG_NAMES)} FROM utti WHERE utterance_intent = 'direct_user_intent' UNION ALL SELECT project_id, source_id, session_id, user_id, source_type, ts, text, {FLAG_SQL} FROM (SELECT *, {words('text')} AS w FROM docs WHERE source_type = 'agent_interpretation')",
    "tools": f"""SELECT *, evidence_kind IN ('test_result', 'git_result', 'filesystem_result') AS deterministic,
        {outcome()} AS outcome,
        substring(regexp_replace(content, '[ \\t\\r\\n]+', ' ', 'g'), 1, 200) AS content_summary
        FROM (SELECT *, {tool_kind()} AS evidence_kind FROM (SELECT 'p' || (user_id % 10) AS project_id, 'tev_' || event_id AS source_id, 'tlog_' || event_id AS source_log_id, 'u' || user_id AS session_id, 'u' || user_id AS user_id, ts,
            CASE event_type WHEN 'error' THEN 'pytest' WHEN 'purchase' THEN 'git_commit' WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'web_search' ELSE 'shell' END AS name,
            'suite ' || json_extract_string(props, '$.k') || ' ' || CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'passed' ELSE 'seen' END || '  after ' || event_type AS content,
            'suite ' || json_extract_string(props, '$.k') AS object FROM events))""",
}


def clause_cte(source: str, keep: str) -> str:
    return f"SELECT * REPLACE (trim(replace(clause, chr(1), '.')) AS clause) FROM (SELECT {keep}, unnest(string_split_regex({PROTECTED}, '{SPLIT}')) AS clause, generate_subscripts(string_split_regex({PROTECTED}, '{SPLIT}'), 1) - 1 AS pos FROM {source}) WHERE trim(replace(clause, chr(1), '.')) <> ''"


def structure_cte(source: str) -> str:
    alias = "CASE " + " ".join(f"WHEN contains(w, {s(' ' + a + ' ')}) THEN {s(k)}" for a, k in ALIASES) + " END"
    fallback = "CASE WHEN source_type = 'agent_interpretation' THEN 'infers' WHEN source_type = 'tool_evidence' THEN 'observed' WHEN modality IN ('must', 'must_not') THEN 'requires' ELSE 'states' END"
    return f"""SELECT *, {case('w', R.predicate, fallback)} AS predicate, coalesce(alias_key, CASE WHEN {SLUG} <> '' THEN {SLUG} ELSE lower(trim(object)) END) AS object_key FROM (
        SELECT *, {case('w', R.modality, s('is'))} AS modality, {case('w', R.scope, s('project'))} AS scope, {case('w', R.subject, s('project'))} AS subject,
        trim(regexp_extract(lower(clause), '{R.object_pattern}', 1)) AS object, {alias} AS alias_key FROM (SELECT *, {words('clause')} AS w FROM {source}))
        WHERE coalesce(alias_key, CASE WHEN {SLUG} <> '' THEN {SLUG} ELSE lower(trim(object)) END) <> ''"""


CTES.update(
    {
        "cl": clause_cte("spoken", f"project_id, source_id, session_id, user_id, source_type, ts, {', '.join(FLAG_NAMES)}"),
        "structured": structure_cte("cl"),
        "reps": f"SELECT project_id, source_id, count(*) OVER (PARTITION BY project_id, {TEXT_KEY}) > 1 AS repeated FROM utt",
        "toolclaims": """SELECT project_id, source_id, session_id, user_id, 'tool_evidence' AS source_type, ts, object || ' ' || outcome AS clause, CASE WHEN outcome = 'passed' THEN 'is' ELSE 'is_not' END AS modality,
            'test' AS scope, 'test_result' AS subject, object, 'test_passed' AS predicate, regexp_replace(lower(object), '[^a-z0-9]+', '_', 'g') AS object_key, deterministic FROM tools WHERE outcome IN ('passed', 'failed')""",
        "bridge": f"""SELECT m.*, coalesce(r.repeated, false) AS repeated FROM (
            SELECT {MENTION_KEYS}, min(clause) AS clause, min(object) AS object, count(*) AS mention_count, {maxes(FLAG_NAMES)}, false AS deterministic FROM (SELECT *, {IDS} FROM structured) GROUP BY {MENTION_KEYS}
            UNION ALL SELECT {MENTION_KEYS}, min(clause), min(object), count(*), false, false, false, false, max(deterministic) FROM (SELECT *, {IDS} FROM toolclaims) GROUP BY {MENTION_KEYS}) m
            LEFT JOIN reps r ON m.project_id = r.project_id AND m.source_id = r.source_id""",
        "claims0": f"""SELECT project_id, item_id, slot_id, scope, subject, predicate, min(object) AS object, object_key, modality, {CATEGORY} AS category, min(clause) AS claim, source_type, 'candidate' AS status,
            count(*) AS evidence_count, CAST(sum(mention_count) AS BIGINT) AS mention_count, min(ts) AS valid_from, max(ts) AS last_verified, 'Extracted by rule from ' || source_type AS confidence_reason, {maxes((*FLAG_NAMES, 'repeated', 'deterministic'))}
            FROM bridge GROUP BY item_id, slot_id, {SLOT}, modality, source_type""",
        "candidates": f"SELECT *, {confidence(STATIC)} AS confidence, {SIGNALS} AS score_signals FROM claims0",
        "reviews": "SELECT 'prop_' || item_id AS proposal_id, item_id, doc_id AS seq, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS action FROM bridge JOIN labels ON source_id = 'utt_' || doc_id WHERE source_type = 'user_utterance'",
        "latest": "SELECT proposal_id, arg_max(action, (seq, action)) AS action, count(*) AS reviews FROM reviews GROUP BY proposal_id",
        "reviewed": "SELECT c.*, 'prop_' || item_id AS proposal_id, l.reviews, CASE l.action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS proposal_status FROM candidates c LEFT JOIN latest l ON l.proposal_id = 'prop_' || c.item_id WHERE c.source_type = 'user_utterance'",
        "claims": f"""SELECT {ITEM_COLS} FROM candidates WHERE source_type <> 'user_utterance'
            UNION ALL SELECT {ITEM_COLS} FROM (SELECT * REPLACE (CASE WHEN proposal_status = 'rejected' THEN 'rejected' ELSE status END AS status) FROM reviewed)
            UNION ALL SELECT {ITEM_COLS} FROM (SELECT * REPLACE (sha256('accepted|' || item_id) AS item_id, 'proposed_update' AS source_type, 'accepted' AS status) FROM reviewed WHERE proposal_status = 'accepted')""",
        "items": f"SELECT *, {confidence(STATIC)} AS confidence, {SIGNALS} AS score_signals FROM claims",
        "found": conflicts_of("items"),
        "resolved": resolve_of("found", LAST_ACTION, "only_when_asked", "reviewed"),
        "pairs": "SELECT DISTINCT project_id, chosen_side AS winner, loser FROM resolved WHERE superseding",
        "alive": "SELECT item_id FROM items WHERE status IN ('candidate', 'accepted') AND item_id NOT IN (SELECT loser FROM pairs)",
        "unsettled": "SELECT item_a, item_b FROM resolved WHERE resolution_type = 'mark_resolved' AND item_a IN (SELECT item_id FROM alive) AND item_b IN (SELECT item_id FROM alive)",
        "superseded": f"""SELECT i.* REPLACE (CASE WHEN l.superseded_by IS NOT NULL THEN 'superseded' ELSE status END AS status), coalesce(l.superseded_by, '') AS superseded_by, coalesce(w.supersedes, []) AS supersedes,
            (status = 'accepted' AND l.superseded_by IS NULL AND confidence >= 90 AND i.item_id NOT IN (SELECT item_a FROM resolved WHERE {HELD} UNION SELECT item_b FROM resolved WHERE {HELD} UNION SELECT item_a FROM unsettled UNION SELECT item_b FROM unsettled)) AS include_in_world_state
            FROM items i LEFT JOIN (SELECT loser, min(winner) AS superseded_by FROM pairs GROUP BY loser) l ON l.loser = i.item_id
            LEFT JOIN (SELECT winner, list_sort(list(DISTINCT loser)) AS supersedes FROM pairs GROUP BY winner) w ON w.winner = i.item_id""",
        "governed": "SELECT * FROM superseded",
        "members": members_of("items"),
        "gmembers": members_of("governed"),
        "decided": decided_of("governed", "resolved", "gmembers", Policy(), conditional=True),
        **budget_ctes("decisions", "decided", Policy()),
        "admitted": "SELECT * FROM decisions WHERE allowed",
        "tasks": "SELECT 'src' || (conv_id % 20) AS project_id, session_id, arg_min(content, turn) AS task FROM conv WHERE role = 'user' GROUP BY conv_id, session_id",
        "pool": "SELECT *, substring(item_id, 1, 1) = '0' AS conditional_block FROM admitted",
        "relevance": f"""SELECT t.project_id, t.session_id, t.task, p.item_id, any_value(p.confidence) AS confidence, any_value(p.line) AS line, count(*) AS overlap
            FROM (SELECT *, unnest({tokens('task')}) AS term FROM tasks) t JOIN (SELECT project_id, item_id, confidence, {LINE} AS line, unnest({tokens("claim || ' ' || object_key")}) AS term FROM pool WHERE NOT conditional_block) p
            ON t.project_id = p.project_id AND t.term = p.term GROUP BY t.project_id, t.session_id, t.task, p.item_id""",
        "selected": filled("SELECT * FROM relevance", "project_id, session_id, task", "overlap DESC, confidence DESC, item_id", 600),
        "excluded": """SELECT t.project_id, t.session_id, t.task, coalesce(s.n, 0) AS included, coalesce(i.n, 0) - coalesce(a.n, 0) AS not_admitted, coalesce(a.b, 0) AS conditional_conflict_block,
            coalesce(a.n, 0) - coalesce(a.b, 0) - coalesce(r.n, 0) AS not_task_relevant, coalesce(r.n, 0) - coalesce(s.n, 0) AS over_budget FROM tasks t
            LEFT JOIN (SELECT project_id, count(*) AS n FROM governed GROUP BY 1) i ON i.project_id = t.project_id
            LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (conditional_block) AS b FROM pool GROUP BY 1) a ON a.project_id = t.project_id
            LEFT JOIN (SELECT session_id, count(*) AS n FROM relevance GROUP BY 1) r ON r.session_id = t.session_id
            LEFT JOIN (SELECT session_id, count(*) AS n FROM selected GROUP BY 1) s ON s.session_id = t.session_id""",
        "fb": """SELECT event_id, 'p' || (user_id % 10) AS project_id, 'u' || user_id AS session_id, ts,
            CASE event_type WHEN 'error' THEN 'drift' WHEN 'click' THEN 'correction' WHEN 'view' THEN 'retrieval' WHEN 'purchase' THEN 'test' ELSE 'gate' END AS event_family,
            CASE WHEN event_type = 'error' THEN 'drift_incident' WHEN event_type = 'click' THEN 'user_correction' WHEN event_type = 'view' THEN 'lookup_used' WHEN event_type = 'purchase' THEN 'suite_passed' WHEN value >= 10 THEN 'gate_false_accept' ELSE 'gate_false_reject' END AS event_name,
            'cognition' AS target_type, 'item_' || json_extract_string(props, '$.k') AS target_id,
            CASE WHEN event_type IN ('error', 'click', 'signup') THEN 'negative' WHEN event_type = 'purchase' THEN 'positive' ELSE 'neutral' END AS outcome, CAST(floor(value) AS INTEGER) AS severity,
            CASE WHEN event_type = 'click' THEN 'user_utterance' WHEN event_type IN ('error', 'purchase') THEN 'tool_evidence' ELSE 'manual_review' END AS source_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
        "fbgood": "SELECT * FROM fb WHERE severity BETWEEN 0 AND 100",
        "manifests": "SELECT 'm' || event_id AS manifest_id, session_id, ts, k FROM fb WHERE event_family = 'retrieval'",
        "weights": "SELECT * FROM (VALUES " + ", ".join(f"({s(k)}, {v})" for k, v in sorted(SIGNAL_WEIGHTS.items())) + ") w(signal, weight)",
        "sfb": f"""SELECT project_id, 'fb_' || doc_id AS feedback_id, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS action, doc_id % 11 = 0 AS applied_to_weights, {array([
            "CASE WHEN source_type = 'agent_interpretation' THEN 'agent_interpretation' END",
            "CASE WHEN source_type <> 'agent_interpretation' AND explicit_preference THEN 'user_explicit_preference' END",
            "CASE WHEN source_type <> 'agent_interpretation' AND explicit_rejection THEN 'user_explicit_rejection' END",
            "CASE WHEN source_type <> 'agent_interpretation' AND strong_emphasis THEN 'user_strong_emphasis' END",
            "CASE WHEN source_type <> 'agent_interpretation' AND long_form THEN 'user_long_form' END",
            "CASE WHEN toxic = 1 THEN 'hostile_tone' END"])} AS signals
            FROM (SELECT d.*, l.quality, l.toxic, {FLAG_SQL} FROM (SELECT *, {words('text')} AS w FROM docs) d JOIN labels l ON l.doc_id = d.doc_id)""",
        "shadow": """SELECT coalesce(w.signal, f.signal) AS signal, CAST(w.weight AS BIGINT) AS weight, CAST(coalesce(f.delta, 0) AS BIGINT) AS delta,
            CASE WHEN w.weight IS NULL THEN NULL ELSE CAST(greatest(0, least(20, w.weight + coalesce(f.delta, 0))) AS BIGINT) END AS new_weight,
            coalesce(f.n, 0) AS feedback_rows, CAST(0 AS BIGINT) AS zero_delta_rows, w.weight IS NULL AS ignored,
            coalesce(greatest(0, least(20, w.weight + coalesce(f.delta, 0))) <> w.weight + coalesce(f.delta, 0), false) AS bounds_hit,
            coalesce(greatest(0, least(20, w.weight + coalesce(f.delta, 0))) <> w.weight, false) AS changed
            FROM weights w FULL JOIN (SELECT signal, sum(CASE action WHEN 'accept' THEN 1 ELSE -1 END) AS delta, count(*) AS n FROM (SELECT action, unnest(signals) AS signal FROM sfb WHERE NOT applied_to_weights) GROUP BY 1) f ON w.signal = f.signal""",
        "proposals": f"""SELECT 'rule_prop_' || substring(sha256('scoring_weight_update|' || s.signal || '|' || new_weight), 1, 16) AS proposal_id, 'scoring_weight_update' AS kind, s.signal, weight, new_weight,
            coalesce(e.n, 0) AS evidence_refs, CAST(0 AS BIGINT) AS missing_refs, 'pending' AS status, true AS requires_explicit_apply FROM shadow s
            LEFT JOIN (SELECT signal, count(DISTINCT feedback_id) AS n FROM (SELECT feedback_id, unnest(signals) AS signal FROM sfb WHERE NOT applied_to_weights) GROUP BY 1) e ON e.signal = s.signal WHERE changed""",
        "recs": """SELECT project_id, source_id, source_type, text FROM utt UNION ALL SELECT project_id, source_id, 'tool_evidence', content FROM tools
            UNION ALL SELECT project_id, source_log_id, 'tool_call', content FROM tools""",
        "idx": f"SELECT *, {tokens('text')} AS terms, substring(text, 1, 80) AS preview FROM recs",
        "qterms": f"SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark",
        "hits": "SELECT source_id, term FROM (SELECT source_id, unnest(terms) AS term FROM idx) WHERE term IN (SELECT term FROM qterms)",
        "scored_hits": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM (SELECT query_id, source_id, CAST(sum(w) AS BIGINT) AS score, count(*) AS shared_terms
            FROM hits JOIN (SELECT query_id, q.term, CAST(floor(1000 * ln(1.0::DOUBLE + (SELECT count(*) FROM recs)::DOUBLE / n)) AS BIGINT) AS w FROM qterms q JOIN (SELECT term, count(*) AS n FROM hits GROUP BY 1) f ON f.term = q.term) t ON t.term = hits.term GROUP BY 1, 2)""",
        "units": "SELECT vec_id, label, sqrt(list_dot_product(e, e)) AS norm, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS unit FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)",
        "cents": """SELECT label AS query_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS unit FROM (SELECT label, list(s ORDER BY pos)::DOUBLE[] AS v FROM (
            SELECT label, pos, sum(CAST(round(x::DOUBLE * 1000000) AS BIGINT)) AS s FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)""",
        "lost": f"SELECT source_id FROM (SELECT source_id, row_number() OVER (PARTITION BY project_id, {TEXT_KEY} ORDER BY source_id) AS rn FROM utt) WHERE rn > 1",
        "liveids": "SELECT item_id FROM governed WHERE status <> 'rejected'",
        "dangling": """SELECT project_id, 'item_evidence' AS "table", item_id AS row_id, 'source_id' AS field, source_id AS missing_id FROM bridge WHERE source_type = 'user_utterance' AND source_id IN (SELECT source_id FROM lost)
            UNION ALL SELECT project_id, 'tool_evidence', source_id, 'source_log_id', source_log_id FROM tools WHERE name = 'shell'
            UNION ALL SELECT project_id, 'conflicts', conflict_id, 'item_a', item_a FROM resolved WHERE item_a NOT IN (SELECT item_id FROM liveids)
            UNION ALL SELECT project_id, 'conflicts', conflict_id, 'item_b', item_b FROM resolved WHERE item_b NOT IN (SELECT item_id FROM liveids)
            UNION ALL SELECT project_id, 'items', item_id, 'supersedes', ref FROM (SELECT project_id, item_id, unnest(supersedes) AS ref FROM governed) WHERE ref NOT IN (SELECT item_id FROM liveids)
            UNION ALL SELECT '', 'reviews', CAST(seq AS VARCHAR), 'item_ref', item_id FROM reviews WHERE item_id NOT IN (SELECT item_id FROM liveids)
            UNION ALL SELECT source, 'agent_interpretations', 'utt_' || doc_id, 'based_on_utterance_ids', 'utt_' || (doc_id - 20) FROM documents
                WHERE (doc_id // 20) % 5 = 4 AND 'utt_' || (doc_id - 20) NOT IN (SELECT source_id FROM utt WHERE source_id NOT IN (SELECT source_id FROM lost))
            UNION ALL SELECT project_id, 'feedback_events', CAST(event_id AS VARCHAR), 'source_refs', 'tev_' || (event_id + 1) FROM fb WHERE 'tev_' || (event_id + 1) NOT IN (SELECT source_id FROM tools)
            UNION ALL SELECT '', 'rule_change_log', 'log_' || signal, 'proposal_id', proposal_id FROM proposals WHERE new_weight >= weight""",
        "state_lines": lines_of("admitted"),
        "short_items": f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {order_of(Policy())}) AS rn FROM admitted WHERE scope = 'project' AND modality IN ('must', 'must_not') AND confidence >= 95) WHERE rn <= 5",
        "short_lines": lines_of("short_items"),
        "rendered": """SELECT f.project_id, f.state, f.structured_count, f.characters, c.state AS compact_state, c.structured_count AS compact_structured_count, c.characters AS compact_characters, coalesce(n.n, 0) AS included_count FROM
            (SELECT project_id, string_agg(line, chr(10) ORDER BY rank) AS state, count(*) FILTER (item_id <> '') AS structured_count, CAST(sum(cost) AS BIGINT) AS characters FROM state_lines GROUP BY 1) f
            JOIN (SELECT project_id, string_agg(line, chr(10) ORDER BY rank) AS state, count(*) FILTER (item_id <> '') AS structured_count, CAST(sum(cost) AS BIGINT) AS characters FROM short_lines GROUP BY 1) c ON c.project_id = f.project_id
            LEFT JOIN (SELECT project_id, count(*) AS n FROM admitted GROUP BY 1) n ON n.project_id = f.project_id""",
        **run_ctes("simrun", SIM_POLICY),
        **run_ctes("laxrun", LAX),
        "simdiff": """SELECT n.scenario, n.base_project AS project_id, n.base_item AS item_id, o.confidence AS old_confidence, n.confidence AS new_confidence, o.allowed AS old_allowed, n.allowed AS new_allowed,
            array_to_string(o.reasons, ',') AS old_reasons, array_to_string(n.reasons, ',') AS new_reasons, o.include_in_world_state AS old_include, n.include_in_world_state AS new_include
            FROM simrun n JOIN simrun o ON o.base_item = n.base_item AND o.base_project = n.base_project AND o.scenario = '' AND n.scenario <> ''
            WHERE o.confidence IS DISTINCT FROM n.confidence OR o.allowed IS DISTINCT FROM n.allowed OR o.reasons IS DISTINCT FROM n.reasons OR o.include_in_world_state IS DISTINCT FROM n.include_in_world_state""",
        "laxhits": """SELECT DISTINCT scenario, base_project AS project_id, base_item AS subject FROM laxrun WHERE allowed AND item_id IN (SELECT item_a FROM laxrun_found WHERE severity >= 80 UNION SELECT item_b FROM laxrun_found WHERE severity >= 80)""",
        "entering": "SELECT *, NOT EXISTS (SELECT 1 FROM laxhits b WHERE b.scenario = '' AND b.project_id = h.project_id AND b.subject = h.subject) AS entered FROM laxhits h WHERE scenario <> ''",
        "utt_cl": clause_cte("utt", "project_id, source_id, source_type"),
        "utt_structured": structure_cte("utt_cl"),
    }
)

ORACLE: dict[str, str] = {}


def need(body: str) -> list[str]:
    """The CTEs a statement uses, in definition order."""
    names, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in names and re.search(rf"(?<![\w'.]){name}(?![\w'(])", text):
                names.add(name)
                todo.append(CTES[name])
    return [n for n in CTES if n in names]


def add(name: str, body: str, **own: str) -> None:
    used = need(" ".join([body, *own.values()]))
    ctes = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in used] + [f"{n} AS ({q})" for n, q in own.items()]
    ORACLE[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + body


# ---------------------------------------------------------------- sources
add("transcript_scan", "SELECT project_id, session_id, turn, role, length(content) AS content_chars, sha256(content) AS content_sha FROM conv")
add("route_user", "SELECT project_id, session_id, turn, content AS text FROM conv WHERE role = 'user'")
add("route_assistant_log", "SELECT project_id, session_id, count(*) AS logged_turns, CAST(sum(length(content)) AS BIGINT) AS logged_chars FROM conv WHERE role = 'assistant' GROUP BY 1, 2")
add(
    "ingest_counts",
    """SELECT project_id, session_id, count(*) FILTER (role = 'user') AS "user", count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'tool') AS tool, count(*) FILTER (role = 'tool') AS tool_evidence,
    CAST(coalesce(sum(n) FILTER (role NOT IN ('user', 'assistant', 'tool')), 0) AS BIGINT) AS ignored, CAST(coalesce(sum(n - 1) FILTER (role IN ('user', 'assistant', 'tool')), 0) AS BIGINT) AS duplicates
    FROM (SELECT project_id, session_id, role, name, content, count(*) AS n FROM (SELECT project_id, session_id, role, '' AS name, content FROM conv UNION ALL SELECT project_id, session_id, 'tool', name, content FROM tools) GROUP BY ALL) GROUP BY 1, 2""",
)
add("ingest_dedup", f"SELECT project_id, arg_min(source_id, doc_id) AS source_id, sha256(project_id || '|' || {TEXT_KEY}) AS record_id FROM docs GROUP BY project_id, {TEXT_KEY}")
RAW = """SELECT project_id, 'conv #' || conv_id AS session_id, turn, role, CASE turn % 3 WHEN 0 THEN '[PROJECT_STATE]' || chr(10) || 'rules of ' || project_id || chr(10) || '</PROJECT_STATE>' || chr(10) || content
    WHEN 1 THEN content || chr(10) || '<!-- HOST_USER_PROFILE_BEGIN -->' || chr(10) || 'likes ' || role || chr(10) || '<!-- HOST_USER_PROFILE_END -->' || chr(10) ELSE content END AS content, content AS bare FROM conv"""
CLEAN = """SELECT project_id, 'conv_' || substring(session_id, 7) AS session_id, turn, role, regexp_replace(bare, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g') AS clean_content, turn % 3 < 2 AS injected_removed FROM raw_lines"""
add(
    "clean_evidence",
    """SELECT project_id, session_id, turn, substring(sha1(session_id || '|' || role || '|' || clean_content), 1, 10) AS turn_id, clean_content,
    CASE WHEN length(clean_content) <= 400 THEN clean_content ELSE substring(clean_content, 1, 400 - 12) || chr(10) || '[truncated]' END AS log_content, injected_removed, length(clean_content) > 400 AS field_capped, true AS session_rewritten FROM cleaned""",
    raw_lines=RAW,
    cleaned=CLEAN,
)
add(
    "clean_report",
    """SELECT project_id, 'injected_removed' AS rule, count(*) FILTER (injected_removed) AS rows_changed, count(*) AS rows_seen FROM cleaned GROUP BY 1
    UNION ALL SELECT project_id, 'field_capped', count(*) FILTER (length(clean_content) > 400), count(*) FROM cleaned GROUP BY 1 UNION ALL SELECT project_id, 'session_rewritten', count(*), count(*) FROM cleaned GROUP BY 1""",
    raw_lines=RAW,
    cleaned=CLEAN,
)
add(
    "run_summary",
    """SELECT 'r' || user_id || '_' || event_type AS run_id, CASE event_type WHEN 'error' THEN 'text' WHEN 'click' THEN 'list' ELSE 'object' END AS kind, CASE WHEN obj THEN 'post' END AS hook, CASE WHEN obj THEN 'u' || user_id END AS session_id,
    CASE WHEN obj THEN n END AS step_count, CASE WHEN obj THEN m END AS total_conflicts, CASE WHEN obj THEN m % 7 END AS cluster_count, CASE WHEN obj THEN n * 2 END AS segment_count, CASE WHEN obj THEN false END AS skipped, CASE WHEN obj THEN true END AS drift_ok,
    length(raw) AS raw_stdout_chars, CASE WHEN event_type = 'error' THEN right(raw, 40) END AS stdout_tail, CASE WHEN event_type = 'click' THEN 'list' END AS stdout_type
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 'Traceback: run of user ' || user_id || ' stopped after ' || n || ' steps' WHEN 'click' THEN '[1, 2]'
        ELSE '{"hook": "post", "session_id": "u' || user_id || '", "ingested": true, "step_count": ' || n || ', "conflict_clusters": {"total_conflicts": ' || m || ', "cluster_count": ' || (m % 7) || ', "clusters": [{"id": "c1"}]}, "evidence_index": {"segment_count": ' || (n * 2) || ', "source_fingerprint": {"files": []}, "skipped": false}, "drift": {"ok": true, "hard_failures": []}}' END AS raw
        FROM (SELECT user_id, event_type, count(*) AS n, max(event_id) AS m, event_type NOT IN ('error', 'click') AS obj FROM events GROUP BY user_id, event_type))""",
)
add(
    "backfill_ingest",
    """SELECT project_id, role, count(*) AS records_added, count(DISTINCT session_id) AS sessions FROM (SELECT project_id, session_id, role, content FROM conv GROUP BY ALL) c
    WHERE NOT EXISTS (SELECT 1 FROM conv s WHERE s.turn = 0 AND s.project_id = c.project_id AND s.session_id = c.session_id AND s.role = c.role AND s.content = c.content) GROUP BY 1, 2""",
)
# ---------------------------------------------------------- normalisation
add("tool_evidence_kind", "SELECT project_id, source_id, source_log_id, evidence_kind, deterministic, outcome, content_summary FROM tools")


def known(columns: str, rows: list[tuple]) -> str:
    """Labels written by hand, for every supplier."""
    values = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "NULL" if v is None else s(v) for v in row) + ")" for row in rows)
    return f"SELECT s_suppkey, k.* FROM supplier, (VALUES {values}) k({columns})"


add("default_labels", known("number, pos, predicate, modality, object_key", [(i, 0, *c[1:]) for i, c in enumerate(sentences.CLAUSES)]))
add("default_intents", known("number, utterance_intent", [(i, c[1]) for i, c in enumerate(sentences.UTTERANCES)]))
add("default_outcomes", known("number, evidence_kind, outcome", [(i, *c[2:]) for i, c in enumerate(sentences.OUTPUTS)]))
add("utterance_intent", "SELECT project_id, source_id, utterance_intent FROM utti")
add(
    "utterance_signals",
    """SELECT u.project_id, u.source_id, long_form, repeated, explicit_preference, explicit_rejection, strong_emphasis, CAST(least(100, 50 + CASE WHEN long_form THEN 5 ELSE 0 END + CASE WHEN repeated THEN 15 ELSE 0 END
    + CASE WHEN explicit_preference THEN 10 ELSE 0 END + CASE WHEN explicit_rejection THEN 15 ELSE 0 END + CASE WHEN strong_emphasis THEN 10 ELSE 0 END) AS INTEGER) AS importance_score FROM utti u JOIN reps r ON u.project_id = r.project_id AND u.source_id = r.source_id""",
)
add("topic_links", f"SELECT project_id, source_id, array_to_string({array([f'CASE WHEN {has(chr(119), t)} THEN {s(n)} END' for n, t in sorted(R.topics)])}, ',') AS linked_topics FROM utti")
add(
    "intent_filter_counts",
    "SELECT utterance_intent, count(*) AS utterances, CASE WHEN utterance_intent = 'direct_user_intent' THEN (SELECT count(*) FROM cl WHERE source_type = 'user_utterance') ELSE 0 END AS clauses FROM utti GROUP BY 1",
)
add("agent_only_blocked", "SELECT project_id, count(*) AS agent_items, count(*) FILTER (allowed) AS allowed, count(*) FILTER (list_contains(reasons, 'agent_only_evidence')) AS agent_only, max(confidence) AS max_confidence FROM decisions WHERE source_type = 'agent_interpretation' GROUP BY 1")
PIECES = f"unnest(string_split_regex(text, '{SPLIT}'))"
SEQUENCE, SENTENCE = word_sequence("text"), word_sequence("piece")
add(
    "external_overlap",
    f"""SELECT project_id, source_id, count(*) AS shared_sentences FROM (
        SELECT project_id, source_id, k.words FROM (SELECT project_id, source_id, ' ' || array_to_string({SEQUENCE}, ' ') || ' ' AS held FROM utt) u,
            (SELECT DISTINCT {SENTENCE} AS words FROM (SELECT {PIECES} AS piece FROM benchmark)) k WHERE len(k.words) >= 5 AND contains(u.held, ' ' || array_to_string(k.words, ' ') || ' ')
        UNION SELECT project_id, source_id, words FROM (SELECT project_id, source_id, {SENTENCE} AS words FROM (SELECT project_id, source_id, {PIECES} AS piece FROM utt))
            WHERE len(words) BETWEEN 1 AND 4 AND words IN (SELECT {SENTENCE} FROM (SELECT {PIECES} AS piece FROM benchmark))) GROUP BY 1, 2""",
)
# ------------------------------------------------------------- extraction
add("clause_split", "SELECT source_id, CAST(pos AS INTEGER) AS pos, clause FROM utt_cl")
add("predicate_label", "SELECT source_id, CAST(pos AS INTEGER) AS pos, predicate FROM utt_structured")
add("object_key", "SELECT source_id, CAST(pos AS INTEGER) AS pos, object, object_key FROM utt_structured")
add("modality_counts", f"SELECT project_id, scope, subject, {CATEGORY} AS category, modality, count(*) AS clauses FROM utt_structured GROUP BY ALL")
add("structured_claims", "SELECT project_id, item_id, slot_id, scope, subject, predicate, object, object_key, modality, category, claim, source_type, status, evidence_count, mention_count, CAST(floor(epoch(valid_from)) AS BIGINT) AS valid_from, CAST(floor(epoch(last_verified)) AS BIGINT) AS last_verified, confidence_reason FROM claims0")
add("claim_evidence", "SELECT item_id, source_id, session_id, mention_count, repeated FROM bridge")
add("candidate_upsert", "SELECT project_id, CAST(sum(mention_count) AS BIGINT) AS candidate_count, count(*) AS claims, count(*) FILTER (item_id NOT IN (SELECT item_id FROM reviews)) AS candidates_added FROM claims0 GROUP BY 1")
add("tool_candidates", "SELECT project_id, item_id, scope, subject, predicate, object_key, modality, evidence_count, deterministic FROM claims0 WHERE source_type = 'tool_evidence'")
# ---------------------------------------------------------------- scoring
add("score_candidates", "SELECT project_id, item_id, source_type, confidence, array_to_string(score_signals, ',') AS score_signals FROM candidates")
add("inclusion_flags", "SELECT project_id, item_id, status, confidence, include_in_world_state FROM superseded")
add("tool_only_gate", "SELECT project_id, source_type, count(*) AS items, count(*) FILTER (source_type = 'tool_evidence') AS requires_gate FROM items GROUP BY 1, 2")
add("weight_shadow", "SELECT * FROM shadow")
add(
    "weight_shadow_summary",
    """SELECT (SELECT count(*) FROM sfb) AS feedback_total, (SELECT count(*) FROM sfb WHERE NOT applied_to_weights) AS pending, (SELECT count(*) FROM sfb WHERE NOT applied_to_weights) AS would_apply,
    count(*) FILTER (changed) AS changed_signal_count, count(*) FILTER (ignored) AS ignored_signals, count(*) FILTER (bounds_hit) AS bounds_hits, 'shadow' AS mode, false AS writes_weights FROM shadow""",
)
add("weight_apply", "SELECT signal, new_weight AS weight, (SELECT count(*) FROM sfb) AS feedback_applied FROM shadow WHERE NOT ignored")
add("confidence_rollup", "SELECT source_type, status, count(*) AS items, count(*) FILTER (include_in_world_state) AS included, min(confidence) AS min_confidence, max(confidence) AS max_confidence, CAST(sum(confidence) AS BIGINT) AS sum_confidence FROM superseded GROUP BY ROLLUP (source_type, status)")
# -------------------------------------------------------------- conflicts
add("detect_conflicts", "SELECT * FROM found")
add("new_conflicts", "SELECT f.project_id, count(*) FILTER (a.source_type = 'proposed_update' OR b.source_type = 'proposed_update') AS new_conflicts, count(*) AS total_conflicts FROM found f JOIN items a ON a.item_id = f.item_a JOIN items b ON b.item_id = f.item_b GROUP BY 1")
add("conflict_sides", "SELECT type, severity, count(*) AS conflicts, count(*) FILTER (chosen_side <> '') AS suggested FROM found GROUP BY 1, 2")
add("unresolved_conflicts", "SELECT project_id, type, CASE WHEN severity >= 90 THEN 'critical' WHEN severity >= 80 THEN 'high' ELSE 'low' END AS band, count(*) AS conflicts FROM resolved WHERE resolution = 'unresolved' GROUP BY 1, 2, 3")
add("resolve_conflicts", "SELECT project_id, conflict_id, resolution, resolution_type, chosen_side, loser, condition, blocks_world_state, reason FROM resolved")
add("apply_supersession", "SELECT project_id, item_id, status, superseded_by, array_to_string(supersedes, ',') AS supersedes FROM superseded")
add("deferred_blocked", "SELECT project_id, item_id, status, include_in_world_state FROM superseded WHERE item_id IN (SELECT item_a FROM resolved WHERE resolution = 'deferred' UNION SELECT item_b FROM resolved WHERE resolution = 'deferred')")
add(
    "conditional_coexist",
    "SELECT i.project_id, i.item_id, i.status, min(c.conflict_id) AS conflict_id, 'only_when_asked' AS condition, true AS blocks_world_state FROM items i JOIN resolved c ON c.blocks_world_state AND i.item_id IN (c.item_a, c.item_b) GROUP BY 1, 2, 3",
)
add(
    "conflict_audit",
    """SELECT conflict_id, resolution_type AS action, chosen_side AS chosen, loser, condition, CASE WHEN superseding THEN loser ELSE '' END AS supersedes,
    blocks_world_state OR resolution = 'deferred' OR item_a = loser AS blocked_a, blocks_world_state OR resolution = 'deferred' OR item_b = loser AS blocked_b FROM resolved WHERE resolution_type <> ''""",
)
add(
    "cluster_conflicts",
    f"""SELECT project_id, cluster_id, count(DISTINCT conflict_id) AS member_count, count(DISTINCT conflict_id) FILTER (chosen_side <> '') AS suggested_count, max(severity) AS max_severity, array_to_string(list_sort(list(DISTINCT id)), ',') AS cognition_ids
    FROM (SELECT *, sha256('conflict_cluster|' || concat_ws('|', {SLOT})) AS cluster_id, unnest([item_a, item_b]) AS id FROM found) GROUP BY 1, 2""",
)
REVIEW = f"""SELECT *, CASE WHEN substring(cluster_id, 1, 1) < '8' THEN 'apply-suggested' ELSE 'defer' END AS cluster_action,
    CASE WHEN substring(cluster_id, 1, 1) >= '8' THEN 'defer' WHEN chosen_side = item_a THEN 'choose-a' WHEN chosen_side = item_b THEN 'choose-b' END AS todo FROM (SELECT *, sha256('conflict_cluster|' || concat_ws('|', {SLOT})) AS cluster_id FROM found)"""
add("review_clusters", "SELECT project_id, cluster_id, cluster_action, count(todo) AS reviewed_count, count(*) FILTER (todo IS NULL) AS skipped_count FROM review_rows GROUP BY 1, 2, 3", review_rows=REVIEW)
add(
    "cluster_review_result",
    "SELECT project_id, CASE WHEN todo = 'defer' THEN 'deferred' WHEN todo IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution, coalesce(replace(todo, '-', '_'), '') AS resolution_type, count(*) AS conflicts, count(*) FILTER (todo IN ('choose-a', 'choose-b')) AS losers FROM review_rows GROUP BY 1, 2, 3",
    review_rows=REVIEW,
)
add(
    "conflict_volume",
    f"""SELECT *, n_must_not * n_may + n_must_not * n_must + n_is_not * n_is AS pairs FROM (SELECT {SLOT}, {', '.join(f"CAST(coalesce(sum(mention_count) FILTER (modality = '{m}'), 0) AS BIGINT) AS n_{m}" for m in ('is', 'is_not', 'may', 'must', 'must_not'))} FROM bridge GROUP BY {SLOT})
    WHERE n_must_not * n_may + n_must_not * n_must + n_is_not * n_is > 0""",
)
add(
    "valid_as_of",
    "SELECT project_id, type, count(*) AS conflicts FROM timed GROUP BY 1, 2",
    lapsing="SELECT *, CASE WHEN status = 'accepted' THEN NULL ELSE last_verified + INTERVAL 1 DAY END AS valid_until FROM items",
    timed=conflicts_of("lapsing", "AND n.valid_from < coalesce(p.valid_until, TIMESTAMP '9999-12-31') AND p.valid_from < coalesce(n.valid_until, TIMESTAMP '9999-12-31')"),
)
# ------------------------------------------------------------- clustering
add("cluster_candidates", f"SELECT project_id, cluster_id, member_count, 'none_no_state_mutation' AS merge_mode, false AS updates_world_state, {ACTION} FROM members WHERE member_count > 1 AND item_id = representative_id")
add("cluster_representative", "SELECT project_id, cluster_id, representative_id, representative_source FROM members WHERE member_count > 1 AND item_id = representative_id")
add("cluster_duplicates", f"SELECT project_id, cluster_id, item_id, representative_id, member_count, {ACTION} FROM members WHERE member_count > 1 AND item_id <> representative_id")
add("duplicate_ratio", "SELECT project_id, count(*) AS active_items, count(*) FILTER (member_count > 1 AND item_id = representative_id) AS candidate_cluster_count, count(*) FILTER (item_id <> representative_id) AS duplicate_candidates, round(count(*) FILTER (item_id <> representative_id) / count(*), 6) AS duplicate_candidate_ratio FROM members GROUP BY 1")
# ------------------------------------------------------------------- gate
add("gate_thresholds", "SELECT source_type, CAST(t AS INTEGER) AS threshold, count(*) AS items, count(*) FILTER (confidence < t) AS below FROM (SELECT *, CASE source_type WHEN 'user_utterance' THEN 96 WHEN 'tool_evidence' THEN 88 ELSE 90 END AS t FROM items) GROUP BY 1, 2")
REASONS = "array_to_string(reasons, ',') AS reasons"
add("gate_decisions", f"SELECT project_id, item_id, constitutional_block, {REASONS} FROM decided")
add("gate_allowed", "SELECT project_id, source_type, status, count(*) AS allowed FROM decided WHERE len(reasons) = 0 GROUP BY 1, 2, 3")
add("gate_constitutional", f"SELECT project_id, item_id, confidence, {REASONS} FROM decided WHERE status = 'accepted' AND constitutional_block")
add("gate_budget", f"SELECT project_id, item_id, allowed, {REASONS} FROM decisions")
SUMMARY = "count(*) AS item_count, count(*) FILTER (allowed) AS allowed_count, count(*) FILTER (NOT allowed) AS blocked_count, count(*) FILTER (len(list_filter(reasons, lambda x: starts_with(x, 'blocked_by_gate_budget'))) > 0) AS budget_blocked_count"
add(
    "gate_by_policy",
    " UNION ALL ".join(f"SELECT CAST({p.version} AS INTEGER) AS policy_version, '{p.hash}' AS policy_hash, project_id, {SUMMARY} FROM {cte} GROUP BY project_id" for p, cte in ((Policy(), "decisions"), (STRICT, "strict"), (OPEN, "loose"))),
    strict_decided=decided_of("governed", "resolved", "gmembers", STRICT, conditional=True),
    **budget_ctes("strict", "strict_decided", STRICT),
    loose_decided=decided_of("governed", "resolved", "gmembers", OPEN, conditional=True),
    **budget_ctes("loose", "loose_decided", OPEN),
)
PERCENT = ("min_confidence", "min_confidence_user", "min_confidence_tool", "min_conflict_severity")
CAPS = ("max_allowed", "max_per_category", "max_per_predicate", "max_per_slot")
add(
    "policy_violations",
    "SELECT policy_id, unnest("
    + array(
        [f"CASE WHEN {c} IS NULL THEN '{c}_missing' END" for c in (*PERCENT, *CAPS)]
        + [f"CASE WHEN {c} NOT BETWEEN 0 AND 100 THEN '{c}_out_of_range' END" for c in PERCENT]
        + [f"CASE WHEN {c} < 0 THEN '{c}_negative' END" for c in CAPS]
        + ["CASE WHEN min_confidence_tool > 89 THEN 'min_confidence_tool_unreachable' END", "CASE WHEN max_allowed > 0 AND max_per_slot > max_allowed THEN 'max_per_slot_above_max_allowed' END"]
    )
    + """) AS rule FROM (SELECT policy_id, c % 120 AS min_confidence, CASE WHEN c % 5 = 0 THEN NULL ELSE c % 101 END AS min_confidence_user, c % 95 AS min_confidence_tool, c % 130 - 10 AS min_conflict_severity,
    c % 50 - 5 AS max_allowed, c % 20 AS max_per_category, c % 30 - 3 AS max_per_predicate, c % 40 AS max_per_slot FROM (SELECT project_id AS policy_id, sum(length(text)) AS c FROM docs GROUP BY 1))""",
)
add("gate_reason_counts", "SELECT project_id, reason, count(*) AS items FROM (SELECT project_id, unnest(reasons) AS reason FROM decisions WHERE NOT allowed) GROUP BY 1, 2")
# ------------------------------------------------------------------ state
add("state_items", "SELECT project_id, item_id, claim, confidence FROM decisions WHERE allowed")
add("state_fallback", "SELECT project_id, count(*) AS included FROM governed WHERE status = 'accepted' AND include_in_world_state GROUP BY 1")
add("compact_items", f"SELECT project_id, item_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {order_of(Policy())}) AS INTEGER) AS rank, confidence, modality FROM short_items")
add("compact_lines", "SELECT project_id, rank, line, CAST(running AS BIGINT) AS running FROM state_lines")
add("compact_state", "SELECT * FROM rendered")
# ----------------------------------------------------------------- lookup
add("evidence_index", "SELECT project_id, source_id, source_type, preview, len(terms) AS terms, true AS record_level, false AS chunked, CAST(0 AS INTEGER) AS segment_index FROM idx")
add("lookup_by_id", "SELECT project_id, source_id, source_type, preview FROM idx WHERE source_id IN (SELECT 'utt_' || doc_id FROM labels)")
add("lookup_terms", "SELECT query_id, source_id, score, shared_terms, rank FROM scored_hits WHERE rank <= 5")
add("ground_lookup", "SELECT h.query_id, h.source_id, r.project_id, r.source_type, length(r.text) AS full_chars, sha256(r.text) AS text_sha FROM scored_hits h JOIN recs r ON r.source_id = h.source_id WHERE h.rank = 1")
add("vector_index", "SELECT vec_id, len(unit) AS dims, round(norm, 6) AS norm, round(list_dot_product(unit, unit), 6) AS unit_norm, true AS record_level_no_split FROM units")
add(
    "vector_topk",
    "SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, round(list_dot_product(u.unit, c.unit), 6) AS similarity FROM units u, cents c)) WHERE rank <= 10",
)
FP = fingerprint("source_id, name, content")
add(
    "index_stale_projects",
    f"SELECT a.project_id, a.rows, a.content_sum FROM (SELECT project_id, count(*) AS rows, {FP} AS content_sum FROM tools GROUP BY 1) a LEFT JOIN (SELECT project_id, count(*) AS rows, {FP} AS content_sum FROM tools WHERE NOT (hour(ts) = 5 AND project_id < 'p5') GROUP BY 1) b ON a.project_id = b.project_id AND a.rows = b.rows AND a.content_sum = b.content_sum WHERE b.project_id IS NULL",
)
add(
    "index_refresh",
    """SELECT project_id, CASE WHEN a.n IS NULL THEN 'removed' WHEN b.n IS NULL THEN 'built' WHEN a.n = b.n THEN 'kept' ELSE 'rebuilt' END AS action, coalesce(a.n, 0) AS records,
    CASE WHEN a.n IS NULL THEN 0 WHEN a.n = b.n THEN 1 ELSE 2 END AS version FROM (SELECT project_id, count(*) AS n FROM tools GROUP BY 1) a
    FULL JOIN (SELECT project_id, count(*) AS n FROM (SELECT project_id FROM tools WHERE NOT (hour(ts) = 5 AND project_id < 'p5') AND project_id <> 'p9' UNION ALL SELECT 'gone' FROM tools WHERE project_id = 'p0') GROUP BY 1) b USING (project_id)""",
)
add("index_projects", "SELECT project_id, count(DISTINCT source_type) AS source_file_count, count(*) AS segment_count, CAST(sum(len(terms)) AS BIGINT) AS term_count, CAST(0 AS BIGINT) AS chunked_count FROM idx GROUP BY 1")
add("index_stats", "SELECT source_type, count(*) AS segment_count, CAST(sum(len(terms)) AS BIGINT) AS term_count, CAST(0 AS BIGINT) AS chunked_count FROM idx GROUP BY 1")
# ---------------------------------------------------------------- context
add("context_select", "SELECT project_id, session_id, item_id, overlap FROM relevance")
add("context_budget", "SELECT project_id, session_id, item_id, overlap, rank, cost FROM selected")
add("context_exclusions", "SELECT project_id, session_id, included, not_admitted, conditional_conflict_block, not_task_relevant, over_budget FROM excluded")
add(
    "context_manifest",
    f"""SELECT e.project_id, e.session_id, CAST(600 AS INTEGER) AS max_chars, included, not_admitted, over_budget, CAST(coalesce(s.chars, 0) AS BIGINT) AS output_characters, sha256(e.task) AS prompt_fingerprint, sha256(coalesce(s.ids, '')) AS selection_fingerprint,
    '{RULESET_HASH}' AS ruleset_hash, '{Policy().hash}' AS gate_policy_hash, f.content_sum AS source_manifest, false AS mutates_state, coalesce(s.ids, '') AS included_cognition_ids FROM excluded e
    LEFT JOIN (SELECT session_id, sum(cost) AS chars, array_to_string(list_sort(list(item_id)), ',') AS ids FROM selected GROUP BY 1) s ON s.session_id = e.session_id
    LEFT JOIN (SELECT project_id, {fingerprint("item_id, CAST(confidence AS VARCHAR), status")} AS content_sum FROM governed GROUP BY 1) f ON f.project_id = e.project_id""",
)
add("inject_once", "SELECT project_id, session_id, arg_min(event_id, (ts, event_id)) AS request_id, arg_min(event_name, (ts, event_id)) AS event_name FROM fb GROUP BY 1, 2")
# --------------------------------------------------------------- feedback
add(
    "feedback_valid",
    """SELECT event_id, CASE WHEN severity BETWEEN 0 AND 100 THEN 'fb_' || substring(sha256(concat_ws('|', session_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), event_family, event_name, target_type, target_id, outcome)), 1, 24) ELSE '' END AS feedback_id,
    CASE WHEN severity BETWEEN 0 AND 100 THEN '' ELSE 'severity_out_of_range' END AS refused FROM fb""",
)
add(
    "feedback_report",
    """SELECT project_id, count(*) AS total, count(*) FILTER (outcome = 'negative') AS negative, count(*) FILTER (outcome = 'negative' AND severity >= 80) AS high_severity_negative, count(*) FILTER (event_name = 'user_correction') AS user_corrections,
    count(*) FILTER (event_family = 'test' AND source_type = 'tool_evidence') AS deterministic_tool, count(*) FILTER (event_family = 'drift') AS drift, count(*) FILTER (event_name = 'gate_false_accept') AS gate_false_accept, count(*) FILTER (event_name = 'gate_false_reject') AS gate_false_reject FROM fbgood GROUP BY 1""",
)
add("feedback_cube", "SELECT event_family, outcome, count(*) AS events, max(severity) AS max_severity FROM fbgood GROUP BY CUBE (event_family, outcome)")
add("feedback_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_family, count(*) AS events, count(*) FILTER (outcome = 'negative') AS negative FROM fbgood GROUP BY 1, 2")
add(
    "drift_attribution",
    """SELECT event_id, session_id, item_id, coalesce(manifest_id, '') AS manifest_id, CASE WHEN manifest_id IS NULL THEN 'no_context_delivered' WHEN i >= 30 THEN 'not_admitted' WHEN i < 10 THEN 'selected_but_ignored' WHEN i < 16 THEN 'over_budget' WHEN i < 26 THEN 'not_selected' ELSE 'blocked_by_conditional_conflict' END AS cause
    FROM (SELECT d.event_id, d.session_id, d.target_id AS item_id, m.manifest_id, (d.k - m.k + 100) % 100 AS i FROM fb d LEFT JOIN LATERAL (SELECT manifest_id, k FROM manifests m WHERE m.session_id = d.session_id AND m.ts <= d.ts ORDER BY m.ts DESC, manifest_id DESC LIMIT 1) m ON true WHERE d.event_family = 'drift')""",
)
# ------------------------------------------------------------ rule change
add("rule_proposal", "SELECT * FROM proposals")
add("simulate_diff", "SELECT scenario, project_id, item_id, old_confidence, new_confidence, old_allowed, new_allowed, old_reasons, new_reasons FROM simdiff")
add(
    "simulate_summary",
    """SELECT scenario, project_id, count(*) FILTER (old_confidence IS DISTINCT FROM new_confidence) AS score_changes, count(*) FILTER (old_include IS DISTINCT FROM new_include) AS inclusion_changes, count(*) FILTER (NOT old_allowed AND new_allowed) AS newly_allowed,
    count(*) FILTER (old_allowed AND NOT new_allowed) AS newly_blocked, count(*) FILTER (old_reasons IS DISTINCT FROM new_reasons) AS reason_changes,
    coalesce(string_agg(item_id, ',' ORDER BY item_id) FILTER (NOT old_allowed AND new_allowed), '') AS entering_ids, coalesce(string_agg(item_id, ',' ORDER BY item_id) FILTER (old_allowed AND NOT new_allowed), '') AS leaving_ids FROM simdiff GROUP BY 1, 2""",
)
add(
    "forbidden_transitions",
    "SELECT scenario, project_id, 'unresolved_conflict_side_entered_world_state' AS rule, count(*) AS hits, count(*) FILTER (entered) AS entered, min(subject) AS first_subject FROM entering GROUP BY 1, 2",
)
add(
    "rule_apply",
    """SELECT w.signal, CAST(CASE WHEN refused = '' THEN p.new_weight ELSE w.weight END AS BIGINT) AS weight, coalesce(p.proposal_id, '') AS proposal_id, coalesce(CASE WHEN refused = '' THEN 'applied' ELSE p.status END, '') AS status, coalesce(refused, '') AS refused,
    CASE WHEN refused = '' THEN 'rule_log_' || substring(sha256(p.proposal_id || '|2024-02-01T00:00:00Z'), 1, 16) ELSE '' END AS log_id
    FROM weights w LEFT JOIN (SELECT *, CASE WHEN new_weight <= weight THEN 'not_simulated' WHEN proposal_id IN (SELECT scenario FROM entering WHERE entered) THEN 'hard_failures' ELSE '' END AS refused FROM proposals) p ON p.signal = w.signal""",
)
# -------------------------------------------------------------- integrity
add("dangling_refs", 'SELECT "table", row_id, field, missing_id FROM dangling')
add(
    "drift_report",
    """SELECT project_id, unnest(['items', 'evidence_mix_user', 'evidence_mix_tool', 'evidence_mix_agent']) AS metric, unnest([count(*), count(*) FILTER (source_type = 'user_utterance'), count(*) FILTER (source_type = 'tool_evidence'), count(*) FILTER (source_type = 'agent_interpretation')]) AS value FROM governed GROUP BY 1
    UNION ALL SELECT project_id, unnest(['stale_rule_revived', 'assistant_only_entered_core', 'ungoverned_candidate_entered_core']), unnest([count(*) FILTER (status IN ('superseded', 'rejected')), count(*) FILTER (source_type = 'agent_interpretation'), count(*) FILTER (status = 'candidate' AND source_type <> 'agent_interpretation')])
        FROM (SELECT * FROM governed WHERE include_in_world_state OR substring(item_id, 1, 2) = '00') WHERE status IN ('superseded', 'rejected', 'candidate') OR source_type = 'agent_interpretation' GROUP BY 1
    UNION ALL SELECT project_id, unnest(['governance_allowed_count', 'governance_blocked_count']), unnest([count(*) FILTER (allowed), count(*) FILTER (NOT allowed)]) FROM decisions GROUP BY 1
    UNION ALL SELECT project_id, 'candidate_cluster_count', count(*) FROM gmembers WHERE member_count > 1 AND item_id = representative_id GROUP BY 1
    UNION ALL SELECT project_id, 'unresolved_high_severity_conflicts', count(*) FILTER (resolution = 'unresolved' AND severity >= 90) FROM resolved GROUP BY 1
    UNION ALL SELECT project_id, 'compact_characters', compact_characters FROM rendered
    UNION ALL SELECT project_id, 'duplicate_candidate_ratio_permille', CAST(1000 * count(*) FILTER (item_id <> representative_id) // count(*) AS BIGINT) FROM gmembers GROUP BY 1
    UNION ALL SELECT project_id, 'governance_blocked_reason_counts.' || reason, count(*) FROM (SELECT project_id, unnest(reasons) AS reason FROM decisions WHERE NOT allowed) GROUP BY 1, 2
    UNION ALL SELECT project_id, 'dangling_reference_errors', count(*) FROM dangling WHERE project_id <> '' GROUP BY 1""",
)
add(
    "quarantine_orphans",
    "SELECT i.project_id, i.item_id, CASE WHEN o.item_id IS NOT NULL THEN 'quarantined' ELSE 'kept' END AS place FROM items i LEFT JOIN (SELECT item_id FROM bridge WHERE source_type = 'user_utterance' GROUP BY 1 HAVING count(*) FILTER (source_id NOT IN (SELECT source_id FROM lost)) = 0) o ON o.item_id = i.item_id",
)
QUOTED = "SELECT DISTINCT project_id, session_id FROM utti WHERE utterance_intent <> 'direct_user_intent'"
FOREIGN = "SELECT DISTINCT item_id FROM (SELECT b.item_id FROM bridge b JOIN quoted q ON q.project_id = b.project_id AND q.session_id = b.session_id UNION ALL SELECT sha256('accepted|' || b.item_id) FROM bridge b JOIN quoted q ON q.project_id = b.project_id AND q.session_id = b.session_id)"
UPGRADED = f"""SELECT *, predicate = 'render' AND {has('w', ("read", "this", "un", "the"))} AS predicate_fixed, include_in_world_state AND item_id IN (SELECT item_id FROM foreign_ids) AS core_cleared FROM (SELECT *, {words("claim || ' ' || object")} AS w FROM superseded)"""
add(
    "upgrade_report",
    """SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.n, 0) AS user_utterance_intents_backfilled, coalesce(b.p, 0) AS predicates_fixed, coalesce(b.c, 0) AS core_flags_cleared, coalesce(a.n, 0) + coalesce(b.p, 0) + coalesce(b.c, 0) > 0 AS needs_upgrade
    FROM (SELECT project_id, count(*) FILTER (length(session_id) % 2 = 1) AS n FROM utti GROUP BY 1) a FULL JOIN (SELECT project_id, count(*) FILTER (predicate_fixed) AS p, count(*) FILTER (core_cleared) AS c FROM upgraded GROUP BY 1) b ON a.project_id = b.project_id""",
    quoted=QUOTED,
    foreign_ids=FOREIGN,
    upgraded=UPGRADED,
)
add(
    "upgrade_apply",
    "SELECT project_id, item_id, CASE WHEN predicate_fixed THEN 'read_source' ELSE predicate END AS predicate, include_in_world_state AND NOT core_cleared AS include_in_world_state, '2' AS state_schema_version, predicate_fixed, core_cleared FROM upgraded",
    quoted=QUOTED,
    foreign_ids=FOREIGN,
    upgraded=UPGRADED,
)
add(
    "state_checksum",
    f"""SELECT 'items' AS "table", project_id, count(*) AS rows, {fingerprint("item_id, status, CAST(confidence AS VARCHAR), modality, array_to_string(supersedes, ',')")} AS content_sum FROM governed GROUP BY 2
    UNION ALL SELECT 'conflicts', project_id, count(*), {fingerprint('conflict_id, resolution, chosen_side')} FROM resolved GROUP BY 2 UNION ALL SELECT 'tool_evidence', project_id, count(*), {fingerprint('source_id, evidence_kind, outcome')} FROM tools GROUP BY 2""",
)
add(
    "state_changes",
    f"""SELECT 'items' AS "table", o.project_id, o.n AS old_rows, n.n AS new_rows, o.c AS old_sum, n.c AS new_sum FROM (SELECT project_id, count(*) AS n, {fingerprint('item_id, status')} AS c FROM items GROUP BY 1) o JOIN (SELECT project_id, count(*) AS n, {fingerprint('item_id, status')} AS c FROM governed GROUP BY 1) n ON n.project_id = o.project_id WHERE o.c <> n.c OR o.n <> n.n""",
)
add(
    "schema_violations",
    """SELECT 'transcript' AS "table", session_id || '_' || turn AS row_id, unnest(list_filter([CASE WHEN trim(coalesce(content, '')) = '' THEN 'content_missing' END, CASE WHEN role IS NULL OR role NOT IN ('user', 'assistant', 'tool') THEN 'role_not_in_enum' END], lambda x: x IS NOT NULL)) AS rule FROM conv
    UNION ALL SELECT 'feedback', CAST(event_id AS VARCHAR), 'severity_out_of_range' FROM fb WHERE severity NOT BETWEEN 0 AND 100
    UNION ALL SELECT 'utterance', CAST(doc_id AS VARCHAR), unnest(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'text_missing' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'source_missing' END, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es') THEN 'lang_not_in_enum' END,
        CASE WHEN n_chars NOT BETWEEN 1 AND 100000 THEN 'n_chars_out_of_range' END], lambda x: x IS NOT NULL)) FROM documents""",
)
# ------------------------------------------------- profile, update review
PROFILE_KEYS = "user_id, scope, subject, predicate, object_key, modality"


def profile_of(items: str, open_conflicts: str, minimum: int) -> str:
    return f"""SELECT *, CASE WHEN scope <> 'user_global' THEN 'project_only' WHEN all_stale THEN 'rejected_or_superseded' WHEN conflicted OR (modality IN ('must_not', 'may', 'must') AND bool_or(modality = 'must_not' AND NOT all_stale) OVER slot AND bool_or(modality IN ('may', 'must') AND NOT all_stale) OVER slot) OR (modality IN ('is_not', 'is') AND bool_or(modality = 'is_not' AND NOT all_stale) OVER slot AND bool_or(modality = 'is' AND NOT all_stale) OVER slot) THEN 'conflicted' WHEN confidence < {minimum} THEN 'low_confidence' WHEN sessions < 2 THEN 'single_weak_expression'
        WHEN predicate IN ('test_passed', 'score_evidence', 'render', 'call_llm', 'infers', 'observed') THEN 'implementation_detail' ELSE '' END AS rejected_reason
    FROM (SELECT {PROFILE_KEYS}, count(*) AS projects, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(records) AS BIGINT) AS records, max(confidence) AS confidence, max(conflicted) AS conflicted, min(status IN ('rejected', 'superseded')) AS all_stale, min(claim) AS claim
        FROM (SELECT b.user_id, i.*, b.sessions, b.records, i.item_id IN ({open_conflicts}) AS conflicted FROM (SELECT item_id, user_id, count(DISTINCT session_id) AS sessions, count(*) AS records FROM bridge WHERE source_type = 'user_utterance' GROUP BY 1, 2) b
            JOIN (SELECT * FROM {items} WHERE source_type = 'user_utterance') i ON i.item_id = b.item_id) GROUP BY {PROFILE_KEYS}) WINDOW slot AS (PARTITION BY user_id, scope, subject, predicate, object_key)"""


OPEN_SIDES = "SELECT item_a FROM resolved WHERE resolution IN ('unresolved', 'deferred') UNION SELECT item_b FROM resolved WHERE resolution IN ('unresolved', 'deferred')"
add("profile_candidates", "SELECT * FROM prof", prof=profile_of("superseded", OPEN_SIDES, 90))
add("profile_reasons", "SELECT user_id, rejected_reason, count(*) AS candidates FROM prof GROUP BY 1, 2", prof=profile_of("superseded", OPEN_SIDES, 90))
add(
    "profile_diff",
    f"""SELECT {', '.join(f'coalesce(n.{k}, o.{k}) AS {k}' for k in PROFILE_KEYS.split(', '))}, o.confidence AS old_confidence, n.confidence AS new_confidence, CASE WHEN o.user_id IS NULL THEN 'added' WHEN n.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM (SELECT * FROM oldprof WHERE rejected_reason = '' AND modality <> 'must') o FULL JOIN (SELECT * FROM prof WHERE rejected_reason = '') n ON {' AND '.join(f'n.{k} = o.{k}' for k in PROFILE_KEYS.split(', '))} WHERE o.user_id IS NULL OR n.user_id IS NULL OR o.confidence <> n.confidence""",
    prof=profile_of("superseded", OPEN_SIDES, 90),
    oldprof=profile_of("items", "SELECT item_a FROM resolved WHERE false", 85),
)
add("review_updates", "SELECT project_id, proposal_id, proposal_status, coalesce(reviews, 0) AS reviews, confidence FROM reviewed")
add("review_backlog", "SELECT project_id, count(*) AS proposals, count(*) FILTER (proposal_status = 'pending') AS pending, count(*) FILTER (proposal_status = 'accepted') AS accepted, count(*) FILTER (proposal_status = 'rejected') AS rejected FROM reviewed GROUP BY 1")
add(
    "review_feedback",
    "SELECT project_id, 'feedback_' || proposal_id AS feedback_id, CASE proposal_status WHEN 'accepted' THEN 'accept' ELSE 'reject' END AS action, confidence AS proposal_confidence, category, proposal_status = 'accepted' AS should_update_world_state, array_to_string(score_signals, ',') AS signals FROM reviewed WHERE proposal_status <> 'pending'",
)
add("admission", f"SELECT project_id, item_id, source_type, status, predicate, modality, object_key, confidence, allowed, {REASONS} FROM decisions")
