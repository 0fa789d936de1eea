"""The driver's tables read as evidence tables.

The prose of the driver tables is invented and has no directive words, so
``PROSE_RULES`` is a lexicon of words that do occur in it.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.functions.scale import among, checkpoint_root, cut
from testimony.functions.text import digest
from testimony.operators import cluster, conflicts, extract, gate, index_store, normalize, review, rulechange, score
from testimony.plans import govern
from testimony.rules import Policy, Rules, Scoring

PROSE_RULES = Rules(
    predicate=(
        ("enter_core_memory", ("thon", "eau")),
        ("store_log", ("than", "ment")),
        ("create", ("then", "oi")),
        ("render", ("ther", "ou")),
        ("override", ("thin", "elle")),
        ("require_review", ("erin", "un")),
        ("inject_context", ("this", "ein")),
        ("call_llm", ("are", "une")),
        ("read_source", ("that", "les")),
        ("update_world_state", ("to", "el")),
        ("score_evidence", ("and", "et")),
        ("resolve_conflict", ("of", "de", "und")),
        ("test_passed", ("the", "la", "der")),
    ),
    modality=(
        ("must_not", ("for", "nicht", "pas", "para")),
        ("is_not", ("was", "ne")),
        ("must", ("with", "mit", "pour")),
        ("should", ("by", "avec")),
        ("may", ("from", "von", "que")),
    ),
    scope=(("user_global", ("it", "ai")), ("test", ("ing", "aux"))),
    subject=(("world_state", ("as", "le")),),
    objects=(
        ("core_memory", ("of the", "de la")),
        ("world_state", ("to the", "et la")),
        ("history_context", ("in the", "of and", "en la")),
        ("raw_logs", ("on the", "et le")),
        ("user_profile", ("is the", "la de")),
    ),
    topics=(
        ("memory", ("thon", "pas", "eau")),
        ("review_flow", ("erin", "nicht")),
        ("retrieval", ("ther", "von", "elle")),
        ("testing", ("ing", "aux")),
        ("world_state", ("that", "les")),
    ),
    request_cues=("the", "la", "de", "der", "und", "el"),
    quote_cues=("thsh", "erwh", "auxment", "schlich"),
    preference=("this", "avec", "ein"),
    rejection=("thing", "nicht", "pas"),
    emphasis=("erst", "onth", "eau"),
    adversatives=("and", "et"),
    long_form_chars=400,
    narrative_lines=6,
)

STRICT = Policy(version=2, min_confidence_user=95, max_per_slot=1, max_per_predicate=4, max_allowed=20)
OPEN = Policy(version=3, max_per_slot=0, max_per_predicate=0, max_per_category=0, max_allowed=0)
LAX = Policy(version=5, min_conflict_severity=101, constitutional_blocks=(), max_per_slot=0, max_per_predicate=0, max_per_category=0, max_allowed=0)
SIM_POLICY = Policy(version=4, max_per_slot=0, max_per_predicate=0, max_per_category=0, max_allowed=40)


def stamp(offset_seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + offset_seconds)


def text_of(col: str, *parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias(col)


class Lift:
    """Evidence tables of one scale-factor folder. Each property is built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def conversations(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(
            text_of("project_id", "p", (F.col("conv_id") % 10).cast("string")),
            text_of("session_id", "c", F.col("conv_id").cast("string")),
            F.col("turn"),
            stamp(F.col("conv_id") * 1000 + F.col("turn")).alias("ts"),
            "role",
            F.lit(None).cast("string").alias("name"),
            F.col("text").alias("content"),
            "conv_id",
        )

    @cached_property
    def documents(self) -> DataFrame:
        d = self.table("documents")
        kind = F.when(F.floor(F.col("doc_id") / 20) % 5 == 4, "agent_interpretation").otherwise("user_utterance")
        return d.select(
            F.col("source").alias("project_id"),
            text_of("source_id", "utt_", F.col("doc_id").cast("string")),
            text_of("session_id", "s", F.floor(F.col("doc_id") / 10).cast("string")),
            F.col("lang").alias("user_id"),
            kind.alias("source_type"),
            stamp(F.col("doc_id") * 60).alias("ts"),
            "text",
            "doc_id",
        )

    @cached_property
    def utterances(self) -> DataFrame:
        turns = self.conversations.where(F.col("role") == "user").select(
            "project_id",
            text_of("source_id", "utt_", F.col("session_id"), "_", F.col("turn").cast("string")),
            "session_id",
            text_of("user_id", "u", (F.col("conv_id") % 7).cast("string")),
            F.lit("user_utterance").alias("source_type"),
            "ts",
            F.col("content").alias("text"),
        )
        docs = self.documents.where(F.col("source_type") == "user_utterance").select(*govern.EVIDENCE)
        return docs.unionByName(turns)

    @cached_property
    def interpretations(self) -> DataFrame:
        return self.documents.where(F.col("source_type") == "agent_interpretation").select(*govern.EVIDENCE)

    @cached_property
    def tool_calls(self) -> DataFrame:
        e = self.table("events")
        k = F.get_json_object("props", "$.k")
        kind = F.col("event_type")
        name = F.when(kind == "error", "pytest").when(kind == "purchase", "git_commit").when(kind == "view", "read_file").when(kind == "click", "web_search").otherwise("shell")
        verb = F.when(kind == "error", "failed").when(kind == "purchase", "passed").otherwise("seen")
        return e.select(
            text_of("project_id", "p", (F.col("user_id") % 10).cast("string")),
            text_of("source_id", "tev_", F.col("event_id").cast("string")),
            text_of("source_log_id", "tlog_", F.col("event_id").cast("string")),
            text_of("session_id", "u", F.col("user_id").cast("string")),
            text_of("user_id", "u", F.col("user_id").cast("string")),
            F.col("ts"),
            name.alias("name"),
            text_of("content", "suite ", k, " ", verb, "  after ", kind),
            text_of("object", "suite ", k),
        )

    @cached_property
    def tool_evidence(self) -> DataFrame:
        return normalize.classify_tools(self.tool_calls)

    @cached_property
    def lines(self) -> DataFrame:
        cols = ("project_id", "session_id", "role", "name", "content")
        return self.conversations.select(*cols).unionByName(self.tool_calls.withColumn("role", F.lit("tool")).select(*cols))

    @cached_property
    def records(self) -> DataFrame:
        """Everything that can be looked up: utterances, tool evidence and tool calls."""
        tools, cols = self.tool_evidence, ("project_id", "source_id", "source_type", "text")
        seen = tools.select("project_id", "source_id", F.lit("tool_evidence").alias("source_type"), F.col("content").alias("text"))
        called = tools.select("project_id", F.col("source_log_id").alias("source_id"), F.lit("tool_call").alias("source_type"), F.col("content").alias("text"))
        return self.utterances.select(*cols).unionByName(seen).unionByName(called)

    @cached_property
    def index(self) -> str:
        """Where the evidence index of all records is."""
        path = f"{checkpoint_root(self.spark)}/evidence-index-{uuid.uuid4().hex}"
        index_store.refresh_index(self.records, path)
        return path

    @cached_property
    def bridge(self) -> DataFrame:
        made = govern.evidence_bridge(self.utterances, PROSE_RULES, self.tool_evidence, self.interpretations)
        written = cut(extract.packed(made.drop("slot_id"), "clause", PROSE_RULES), "bridge")
        return extract.unpacked(written, "clause", PROSE_RULES).withColumn("slot_id", digest(*extract.SLOT))

    @cached_property
    def candidates(self) -> DataFrame:
        return govern.scored_claims(self.bridge)

    @cached_property
    def reviews(self) -> DataFrame:
        """One review per (labelled document, claim of its text)."""
        labels = self.table("labels").select(text_of("source_id", "utt_", F.col("doc_id").cast("string")), F.col("doc_id").alias("seq"), "quality")
        said = self.bridge.where(F.col("source_type") == "user_utterance").where(among(labels, "source_id")).select("source_id", "item_id")
        action = F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("action")
        return cut(said.join(labels, "source_id").select(text_of("proposal_id", "prop_", F.col("item_id")), "seq", action), "reviews")

    @cached_property
    def reviewed(self) -> DataFrame:
        return review.review_updates(review.propose(self.candidates), self.reviews)

    def claims(self, weights: Column | None = None, scoring: Scoring = Scoring()) -> DataFrame:
        """Candidates, rejected candidates and accepted updates, scored."""
        reviewed = self.reviews.select(F.expr("substring(proposal_id, 6)").alias("item_id"))
        several, single = extract.claims_apart(self.bridge, reviewed)
        every = review.after_review(several, self.reviews).unionByName(single)
        return score.tool_only(score.score(every, scoring, weights))

    @cached_property
    def items(self) -> DataFrame:
        written = cut(extract.packed(self.claims().drop("slot_id"), "claim", PROSE_RULES, keys=False), "items")
        return extract.unpacked(written, "claim", PROSE_RULES).withColumn("slot_id", digest(*extract.SLOT))

    @cached_property
    def found(self) -> DataFrame:
        return cut(conflicts.detect_conflicts(self.items), "found")

    @cached_property
    def actions(self) -> DataFrame:
        """Review actions on most conflicts, some of them revised, by conflict id."""
        digit = F.substring("conflict_id", 1, 1)
        last = (
            F.when(digit.isin("0", "1", "2", "3"), "choose-a")
            .when(digit.isin("4", "5"), "choose-b")
            .when(digit.isin("6", "7"), "defer")
            .when(digit == "8", "mark-resolved")
            .when(digit.isin("9", "a"), "coexist-by-condition")
        )
        first = F.when(F.substring("conflict_id", 2, 1) < "8", F.lit("defer"))
        rows = F.array(F.struct(F.lit(1).alias("seq"), first.alias("action")), F.struct(F.lit(2).alias("seq"), last.alias("action")))
        out = self.found.select("conflict_id", F.explode(rows).alias("x")).where(F.col("x.action").isNotNull())
        condition = F.when(F.col("x.action") == "coexist-by-condition", "only_when_asked").otherwise("")
        return out.select("conflict_id", F.col("x.seq").alias("seq"), F.col("x.action").alias("action"), condition.alias("condition"), F.lit("reviewed").alias("reason"))

    @cached_property
    def resolved(self) -> DataFrame:
        return cut(conflicts.resolve(self.found, self.actions), "resolved")

    @cached_property
    def superseded(self) -> DataFrame:
        """Claims after the review of their conflicts."""
        return govern.settled(self.items, self.resolved)

    @cached_property
    def governed(self) -> DataFrame:
        return self.superseded

    @cached_property
    def duplicates(self) -> DataFrame:
        return cluster.duplicates(self.governed)

    @cached_property
    def decided(self) -> DataFrame:
        return gate.decide(self.governed, Policy(), self.resolved, self.duplicates)

    @cached_property
    def decisions(self) -> DataFrame:
        return gate.budget(self.decided, Policy())

    @cached_property
    def admitted(self) -> DataFrame:
        return cut(self.decisions.where(F.col("allowed")), "admitted")

    @cached_property
    def tasks(self) -> DataFrame:
        """The opening user turn of every conversation as its task, in a project of its own choice."""
        user = self.conversations.where(F.col("role") == "user")
        first = user.groupBy("conv_id", "session_id").agg(F.min(F.struct("turn", "content")).alias("t"))
        return first.select(text_of("project_id", "src", (F.col("conv_id") % 20).cast("string")), "session_id", F.col("t.content").alias("task"))

    @cached_property
    def context_pool(self) -> DataFrame:
        """Admitted claims for tasks, some of them under a conditional block."""
        return self.admitted.withColumn("conditional_block", F.substring("item_id", 1, 1) == "0")

    @cached_property
    def feedback(self) -> DataFrame:
        e = self.table("events")
        kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
        family = F.when(kind == "error", "drift").when(kind == "click", "correction").when(kind == "view", "retrieval").when(kind == "purchase", "test").otherwise("gate")
        name = (
            F.when(kind == "error", "drift_incident")
            .when(kind == "click", "user_correction")
            .when(kind == "view", "lookup_used")
            .when(kind == "purchase", "suite_passed")
            .when(F.col("value") >= 10, "gate_false_accept")
            .otherwise("gate_false_reject")
        )
        outcome = F.when(kind.isin("error", "click", "signup"), "negative").when(kind == "purchase", "positive").otherwise("neutral")
        source = F.when(kind == "click", "user_utterance").when(kind.isin("error", "purchase"), "tool_evidence").otherwise("manual_review")
        return e.select(
            "event_id",
            text_of("project_id", "p", (F.col("user_id") % 10).cast("string")),
            text_of("session_id", "u", F.col("user_id").cast("string")),
            F.col("ts"),
            family.alias("event_family"),
            name.alias("event_name"),
            F.lit("cognition").alias("target_type"),
            text_of("target_id", "item_", k),
            outcome.alias("outcome"),
            F.floor(F.col("value")).cast("int").alias("severity"),
            source.alias("source_type"),
            k.cast("int").alias("k"),
        )

    @cached_property
    def manifests(self) -> DataFrame:
        """Every view event delivers ten claims, in the order of their numbers."""
        return self.feedback.where(F.col("event_family") == "retrieval").select(text_of("manifest_id", "m", F.col("event_id").cast("string")), "session_id", "ts", "k")

    @cached_property
    def manifest_outcomes(self) -> DataFrame:
        rows = self.manifests.select("manifest_id", "k", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"))
        outcome = F.when(F.col("i") < 10, "included").when(F.col("i") < 16, "over_budget").when(F.col("i") < 26, "not_task_relevant").otherwise("conditional_conflict_block")
        return rows.select("manifest_id", text_of("item_id", "item_", ((F.col("k") + F.col("i")) % 100).cast("string")), outcome.alias("outcome"))

    @cached_property
    def scoring_feedback(self) -> DataFrame:
        """Labels as scoring feedback on the signals of their document; toxic ones name a signal without weight."""
        labels = self.table("labels").select("doc_id", "quality", "toxic")
        docs = normalize.with_cue_signals(self.documents, PROSE_RULES)
        agent = F.col("source_type") == "agent_interpretation"
        signals = F.array_compact(
            F.array(
                F.when(agent, F.lit("agent_interpretation")),
                F.when(~agent & F.col("explicit_preference"), F.lit("user_explicit_preference")),
                F.when(~agent & F.col("explicit_rejection"), F.lit("user_explicit_rejection")),
                F.when(~agent & F.col("strong_emphasis"), F.lit("user_strong_emphasis")),
                F.when(~agent & F.col("long_form"), F.lit("user_long_form")),
                F.when(F.col("toxic") == 1, F.lit("hostile_tone")),
            )
        )
        out = docs.select("doc_id", "project_id", *normalize_flags(), "source_type").join(labels, "doc_id")
        return out.select(
            "project_id",
            text_of("feedback_id", "fb_", F.col("doc_id").cast("string")),
            F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("action"),
            signals.alias("signals"),
            (F.col("doc_id") % 11 == 0).alias("applied_to_weights"),
        )

    @cached_property
    def weights(self) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("signal"), F.lit(v).alias("weight")) for k, v in sorted(Scoring().weights.items())])
        return self.spark.range(1).select(F.explode(pairs).alias("w")).select("w.signal", "w.weight")

    @cached_property
    def proposals(self) -> DataFrame:
        """A proposal for each signal whose weight the pending feedback would change."""
        fb = self.scoring_feedback
        evidence = fb.where(~F.col("applied_to_weights")).select(F.explode("signals").alias("signal"), "feedback_id")
        return cut(rulechange.propose(score.weight_shadow(fb, self.weights), fb, evidence), "proposals")

    @cached_property
    def simulation(self) -> rulechange.Simulation:
        return rulechange.simulate(self.items, self.found, self.proposals, self.weights, SIM_POLICY)

    @cached_property
    def lax_simulation(self) -> rulechange.Simulation:
        return rulechange.simulate(self.items, self.found, self.proposals, self.weights, LAX)

    @cached_property
    def run_logs(self) -> DataFrame:
        """Run events per (user, event type): JSON summaries, some of them plain text."""
        e = self.table("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("m"))
        body = F.concat(
            F.lit('{"hook": "post", "session_id": "u'),
            F.col("user_id").cast("string"),
            F.lit('", "ingested": true, "step_count": '),
            F.col("n").cast("string"),
            F.lit(', "conflict_clusters": {"total_conflicts": '),
            F.col("m").cast("string"),
            F.lit(', "cluster_count": '),
            (F.col("m") % 7).cast("string"),
            F.lit(', "clusters": [{"id": "c1"}]}, "evidence_index": {"segment_count": '),
            (F.col("n") * 2).cast("string"),
            F.lit(', "source_fingerprint": {"files": []}, "skipped": false}, "drift": {"ok": true, "hard_failures": []}}'),
        )
        plain = F.concat(F.lit("Traceback: run of user "), F.col("user_id").cast("string"), F.lit(" stopped after "), F.col("n").cast("string"), F.lit(" steps"))
        raw = F.when(F.col("event_type") == "error", plain).when(F.col("event_type") == "click", F.lit("[1, 2]")).otherwise(body)
        return e.select(text_of("run_id", "r", F.col("user_id").cast("string"), "_", F.col("event_type")), text_of("project_id", "p", (F.col("user_id") % 10).cast("string")), raw.alias("raw"))


def normalize_flags() -> tuple[str, ...]:
    return ("long_form", "explicit_preference", "explicit_rejection", "strong_emphasis")


