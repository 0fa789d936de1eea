"""Rule data: lexicons, weights, labels and the admission policy.

Everything here is an argument of the operators. The defaults read English
and Chinese; another language or domain brings its own ``Rules``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

Labelled = tuple[tuple[str, tuple[str, ...]], ...]

# The predicate labels.
PREDICATES = (
    "enter_core_memory", "store_log", "create", "render", "override", "require_review",
    "inject_context", "call_llm", "read_source", "update_world_state", "score_evidence",
    "resolve_conflict", "test_passed", "states", "requires", "observed", "infers",
)
# Intents of a user utterance.
INTENTS = ("direct_user_intent", "mixed_request_with_quote", "quoted_evaluation", "external_commentary")
# Kinds of tool evidence.
EVIDENCE_KINDS = ("test_result", "git_result", "filesystem_result", "web_result", "command_output")
# Modalities and scopes.
MODALITIES = ("must", "must_not", "may", "should", "is", "is_not")
SCOPES = ("project", "user_global", "test")
# Source types and their authority.
AUTHORITY = {"proposed_update": 4, "manual_initialization": 4, "user_utterance": 3, "tool_evidence": 2, "agent_interpretation": 1}
# Feedback families.
FEEDBACK_FAMILIES = ("correction", "test", "drift", "retrieval", "gate", "rule")


# Kinds of tools by whole segments of their names, tried in this order; outcomes by words of their output.
TOOL_SEGMENTS = (
    ("web_result", ("web", "http", "https", "browser", "browse", "fetch", "curl", "wget", "url", "download", "crawl", "scrape", "search")),
    ("test_result", ("test", "tests", "pytest", "unittest", "jest", "tox")),
    ("git_result", ("git",)),
    ("filesystem_result", ("file", "files", "ls", "cat", "read", "write", "edit", "glob", "mkdir")),
)
TOOL_OUTPUT = (("test_result", "(^|[^a-z])(pytest|[0-9]+ (passed|failed))"), ("git_result", "^(commit [0-9a-f]|on branch|diff --git)"))
FAIL_COUNT = "(^|[^0-9a-z.])[1-9][0-9]*( of [0-9]+)?( tests?| cases?| checks?)? (failed|failures?|errors?)"
NO_FAILURE = "(^|[^0-9a-z.])(no|0|zero|without)( of [0-9]+)?( tests?| cases?| checks?)? (failed|failures?|errors?|exceptions?)|(failed|failures?|errors?) ?[:=] ?0"
# Failures that are named, not reported: mended ones, and nouns of things about failures.
NAMED_FAILURE = (
    "(fix|fixes|fixed|fixing|mended|repaired|resolved|rerun|reran|retried|retry) (the |a |an |all |every )?(failed|failing|broken)"
    "|(error|exception|failure) (handling|handler|message|messages|code|codes|path|paths|page|budget|rate|mode|modes|log|logs|type|types)"
)
FAIL_WORD = "(^|[^a-z])(failed|failures?|errors?|exception|traceback|fatal)([^a-z]|$)|[a-z](error|exception):"
PASS_WORD = "(^|[^a-z])(passed|success|succeeded|ok|done|clean|committed|green)([^a-z]|$)"


@dataclass(frozen=True)
class Rules:
    predicate: Labelled
    modality: Labelled
    scope: Labelled
    subject: Labelled
    objects: Labelled
    topics: Labelled
    request_cues: tuple[str, ...]
    quote_cues: tuple[str, ...]
    preference: tuple[str, ...]
    rejection: tuple[str, ...]
    emphasis: tuple[str, ...]
    adversatives: tuple[str, ...] = ()
    # The object phrase where no alias matches, taken from the lower-cased clause.
    object_pattern: str = "(?s)^(.*)$"
    long_form_chars: int = 400
    narrative_lines: int = 6
    # Patterns over the lower-cased text that mark a request or a quoted judgement, beside the cues.
    request_pattern: str = ""
    quote_pattern: str = ""
    # Patterns over the words of a clause with its commas, tried in order before the terms of ``modality``.
    modality_patterns: Labelled = ()
    # Phrases that mean nothing of what their words say; taken out of the words first.
    idioms: str = ""

    @staticmethod
    def from_rows(rows: Iterable[tuple[str, str, str, int]], base: "Rules | None" = None) -> "Rules":
        """Rules from a lexicon table of (kind, term, label, priority) rows.

        Kinds are the field names. Labels of a kind are tried by their lowest
        priority; plain cue lists have an empty label. Kinds without rows keep
        those of ``base``.
        """
        grouped: dict[str, dict[str, list[tuple[int, str]]]] = {}
        for kind, term, label, priority in rows:
            if kind not in LABELLED_KINDS + CUE_KINDS:
                raise ValueError(f"unknown kind of rule: {kind}")
            grouped.setdefault(kind, {}).setdefault(label or "", []).append((priority, term))
        values: dict[str, tuple] = {}
        for kind, labels in grouped.items():
            ranked = sorted(labels.items(), key=lambda x: (min(x[1]), x[0]))
            if kind in LABELLED_KINDS:
                values[kind] = tuple((label, tuple(t for _, t in sorted(terms))) for label, terms in ranked)
            else:
                values[kind] = tuple(t for _, terms in ranked for _, t in sorted(terms))
        # Own terms stand for the patterns of the same kind as well.
        for kind, pattern, none in (("modality", "modality_patterns", ()), ("request_cues", "request_pattern", ""), ("quote_cues", "quote_pattern", "")):
            if kind in values:
                values[pattern] = none
        return replace(base or DEFAULT_RULES, **values)


LABELLED_KINDS = ("predicate", "modality", "scope", "subject", "objects", "topics")
CUE_KINDS = ("request_cues", "quote_cues", "preference", "rejection", "emphasis", "adversatives")

# Contradicting modalities: negative side, positive sides.
OPPOSITION = (("must_not", ("may", "must")), ("is_not", ("is",)))

CATEGORY_OF_MODALITY = {"must": "constraint", "must_not": "constraint", "should": "preference", "may": "permission", "is": "fact", "is_not": "fact"}

# Terms are chosen from what each label means: verbs with their inflections, nouns, and common ways to say the same.
DEFAULT_RULES = Rules(
    predicate=(
        ("enter_core_memory", ("core memory", "core fact", "core facts", "permanent memory", "long-term memory", "核心记忆", "核心事实", "长期记忆")),
        ("test_passed", ("test run", "test suite", "unit test", "unit tests", "pytest", "tests pass", "tests passed", "tests fail", "tests failed", "单元测试", "测试套件", "测试通过", "测试失败")),
        ("resolve_conflict", ("resolve", "resolves", "resolved", "settle the conflict", "conflict resolution", "消解冲突", "解决冲突", "冲突解决")),
        ("score_evidence", ("confidence score", "evidence weight", "weigh the evidence", "rate the evidence", "scoring", "置信度", "打分", "评分")),
        ("call_llm", ("call an llm", "call the llm", "calls an llm", "call llm", "calls llm", "calling an llm", "calling the llm", "calling llm", "invoke an llm", "invoke the llm", "invoke llm", "ask the model", "query the model", "llm summary", "调用模型", "调用大模型", "请求模型")),
        ("inject_context", ("inject", "injects", "injected", "injection", "prepend", "preload", "注入", "预先塞入")),
        ("create", ("create", "creates", "created", "generate a file", "add a new file", "创建", "新建", "生成文件")),
        ("require_review", ("review", "reviewed", "approve", "approval", "sign off", "审批", "审查", "审核")),
        ("override", ("override", "overrides", "overridden", "take precedence", "outrank", "outranks", "覆盖", "优先于")),
        ("read_source", ("read", "reads", "re-read", "consult", "original record", "查阅", "读取", "先读", "原文")),
        ("render", ("render", "renders", "rendered", "display", "displayed", "呈现", "渲染")),
        ("update_world_state", ("update the world state", "update world_state", "change the world state", "world state update", "更新世界观", "更新 world_state")),
        ("store_log", ("log", "logs", "logged", "logging", "日志")),
    ),
    modality=(
        ("may", ("不必", "无需", "不需要", "并不禁止")),
        ("must_not", ("不得", "不能", "不可", "不要", "不应", "严禁", "禁止")),
        ("is_not", ("不是", "并非", "失败")),
        ("must", ("必须", "务必", "一定要", "只能", "需要")),
        ("should", ("应该", "应当", "建议", "最好")),
        ("may", ("可以", "允许")),
    ),
    # A release from a duty or a ban comes before the negations that it is made of; a negation belongs to the verb beside it.
    modality_patterns=(
        ("may", (" (do|does|did|will|would) not (have|need) to ", " need not ", " no need ", " not (required|necessary|needed|obliged|mandatory|forbidden|prohibited|banned|disallowed) ")),
        (
            "must_not",
            (
                " (must|shall|should|may|can|could|will|ought) (not|never) ",
                " (do|does) not ",
                " (never|cannot) ",
                " (no|no one|nobody|none|neither)( [a-z0-9]+){0,4} (may|can|could|shall|should|must|will) ",
                " (not (allowed|permitted)|forbidden|prohibited|banned|disallowed) ",
            ),
        ),
        ("is_not", ("^((?! (must|shall|should|ought|may|can|could|has to|have to|needs to) ).)* (is|are|was|were|am|has|have|had|did) not ",)),
        ("must", (" (must|always|required|requires|shall) ", " (has|have|needs|need) to ")),
        ("should", (" (should|prefer|preferably|recommended) ", " ought to ")),
        ("may", (" (may|can|could|allowed|permitted) ",)),
        ("is_not", (" (is|are|was|were|am|has|have|had|did) not ", " (failed|fails)( ,| ?$| to | in | on | at | with | again | because | so | and )", " (tests?|suite|build|run|job|check|checks|it|they|this|that|which) (failed|fails|fail) ")),
    ),
    idioms=" (no|nope|yes) , | (no doubt|without doubt|no question|never mind|no problem|no worries|not only|of course not)( that)? | log (in|on|out|off) ",
    scope=(
        ("user_global", ("all my projects", "any project", "every project", "across projects", "globally", "全局", "每个项目", "所有项目", "用户级")),
        ("test", ("pytest", "test run", "test suite", "unit test", "unit tests", "tests", "测试")),
    ),
    subject=(
        ("assistant_output", ("assistant", "agent output", "agent reply", "final answer", "回答", "输出")),
        ("world_state", ("world_state.md", "world_state", "world state", "世界观")),
        ("test_result", ("pytest", "test run", "test suite", "unit test", "unit tests", "tests", "测试")),
        ("history_context", ("history", "context", "transcript", "上下文", "历史")),
        ("tool_result", ("tool", "tools", "工具")),
    ),
    objects=(
        ("assistant_output", ("assistant answer", "assistant reply", "assistant output", "assistant final output", "final answer", "agent output", "agent reply", "助手输出", "最终输出")),
        ("core_memory", ("core memory", "core fact", "core facts", "核心事实", "核心记忆")),
        ("world_state", ("world_state.md", "world_state", "world state", "世界观")),
        ("history_context", ("chat history", "full history", "whole history", "full context", "聊天历史", "历史上下文", "全部上下文")),
        # Names of files and folders.
        ("raw_logs", ("raw/logs", "raw log", "raw logs", "原始日志")),
        ("agents_md", ("agents.md",)),
        ("user_profile", ("user_profile.md", "user profile", "用户画像", "用户档案")),
        ("test_suite", ("pytest suite", "suite of tests", "test suite", "测试套件", "测试集")),
    ),
    topics=(
        ("memory", ("memory", "memories", "core fact", "核心事实", "记忆")),
        ("world_state", ("world_state.md", "world_state", "world state", "世界观")),
        ("review_flow", ("approval", "review", "reviews", "审查", "审核")),
        ("testing", ("pytest", "test", "tests", "测试")),
        ("retrieval", ("index", "lookup", "retrieval", "retrieve", "查找", "检索")),
    ),
    # Ways to address somebody or to ask; words of duty alone are no request. Bare verbs ask only where a sentence begins.
    request_cues=("please", "could you", "can you", "would you", "help me", "i need", "i want", "i would like", "your task", "go ahead", "帮我", "我想", "我要", "我需要你", "希望你"),
    request_pattern=(
        "(^|[.!?:;\n。！？：；]) *(then |now |and |so )?(continue|implement|fix|write|build|draft|refactor|add|remove|update|rename|check|look at|take a look|have a look|summari[sz]e)([^a-z]|$)"
        "|(^|[.!?:;,\n。！？：；，]) *(你|您)?(先|再|来)?(看一下|看下|看看|继续|请|麻烦)"
    ),
    quote_cues=("quoted from", "he wrote", "she wrote", "they wrote", "the reviewer says", "according to the review", "评语", "转述", "引用如下"),
    # A noun of judgement and a colon.
    quote_pattern="(assessment|evaluation|verdict|conclusion|judge?ment|appraisal|rating|review|progress)( score)? *[:：]|(评价|评语|结论|判断|评估|点评|意见|评分) *[:：]",
    preference=("prefer", "i like", "i want", "rather", "always", "偏好", "喜欢", "希望", "总是"),
    rejection=("must not", "do not", "cannot", "can not", "never", "refuse", "reject", "不得", "不能", "不要", "拒绝", "禁止"),
    emphasis=("must", "never", "absolutely", "critical", "crucial", "important", "必须", "务必", "绝不", "一定", "至关重要"),
    adversatives=("but", "however", "yet", "但", "但是", "不过", "然而"),
)

# Base confidence and ceiling by source, and the signal weights.
BASE_CONFIDENCE = {"proposed_update": 95, "manual_initialization": 96, "user_utterance": 82, "tool_evidence": 78, "agent_interpretation": 60}
CEILING = {"proposed_update": 100, "manual_initialization": 100, "user_utterance": 100, "tool_evidence": 89, "agent_interpretation": 74}
SIGNAL_WEIGHTS = {
    "user_explicit_preference": 6,
    "user_explicit_rejection": 8,
    "user_strong_emphasis": 5,
    "user_long_form": 2,
    "user_repeated": 6,
    "tool_evidence": 6,
    "tool_deterministic": 5,
    "agent_interpretation": 4,
}
WEIGHT_BOUNDS = (0, 20)
MIN_INCLUDE_CONFIDENCE = 90

# Labels of rendered state lines.
MODALITY_WORDS = {"must": "必须", "must_not": "不得", "may": "可以", "should": "应当", "is": "确认", "is_not": "否认"}
PREDICATE_WORDS = {
    "enter_core_memory": "进入核心记忆",
    "store_log": "写入日志",
    "create": "创建",
    "render": "渲染",
    "override": "覆盖",
    "require_review": "经过审查",
    "inject_context": "注入上下文",
    "call_llm": "调用模型",
    "read_source": "读取",
    "update_world_state": "更新状态",
    "score_evidence": "评分证据",
    "resolve_conflict": "解决冲突",
    "test_passed": "通过测试",
    "states": "陈述",
    "requires": "要求",
    "observed": "观察",
    "infers": "推断",
}
READ_CUES = ("read", "先读", "读取")
DOCTRINE = (
    "User evidence outranks tools, and tools outrank agents.",
    "Assistant output is a log, not a fact.",
    "Only admitted claims enter this state.",
    "Previews are not evidence: read the full record.",
)


@dataclass(frozen=True)
class Policy:
    """Admission policy. A budget cap of 0 means the cap is off."""

    version: int = 1
    path: str = "rules/governance_policy.json"
    min_confidence: int = 90
    min_confidence_user: int = 90
    min_confidence_tool: int = 88
    min_conflict_severity: int = 80
    max_per_slot: int = 2
    max_per_predicate: int = 12
    max_per_category: int = 30
    max_allowed: int = 50
    source_priority: tuple[str, ...] = ("manual_initialization", "proposed_update", "user_utterance", "tool_evidence", "agent_interpretation")
    predicate_priority: tuple[str, ...] = PREDICATES
    modality_priority: tuple[str, ...] = ("must_not", "must", "should", "may", "is_not", "is")
    allowed_accepted_sources: tuple[str, ...] = ("manual_initialization", "proposed_update", "user_utterance")
    constitutional_blocks: tuple[str, ...] = (
        "stale_or_rejected",
        "unresolved_high_severity_conflict",
        "conditional_conflict_block",
        "quoted_or_external_material",
        "assistant_output_claim",
        "agent_only_evidence",
    )

    @property
    def hash(self) -> str:
        """Fingerprint of the policy content; the path is not content."""
        body = asdict(self)
        body.pop("path")
        return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def overridden(self, **values) -> "Policy":
        return replace(self, **values)

    @staticmethod
    def from_json(text: str) -> "Policy":
        """Read a policy document with its sections."""
        doc = json.loads(text)
        flat = {k: doc[k] for k in ("version", "path") if k in doc}
        flat.update(doc.get("thresholds", {}))
        flat.update(doc.get("admission_budget", {}))
        for name, key in (("source", "source_priority"), ("predicate", "predicate_priority"), ("modality", "modality_priority")):
            if name in doc.get("priority", {}):
                ranked = doc["priority"][name]
                flat[key] = tuple(sorted(ranked, key=ranked.get)) if isinstance(ranked, dict) else tuple(ranked)
        for key in ("allowed_accepted_sources", "constitutional_blocks"):
            if key in doc:
                flat[key] = tuple(doc[key])
        return Policy(**flat)


@dataclass(frozen=True)
class Scoring:
    base: dict = field(default_factory=lambda: dict(BASE_CONFIDENCE))
    ceiling: dict = field(default_factory=lambda: dict(CEILING))
    weights: dict = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))
