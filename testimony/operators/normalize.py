"""Evidence normalisation: routing, counting, cleaning and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import attach_group, cut, once
from testimony.functions.text import Forms, all_labels, any_term, drop_forms, with_forms, word_sequence
from testimony.operators.extract import SENTENCE_END
from testimony.rules import FAIL_COUNT, FAIL_WORD, NAMED_FAILURE, NO_FAILURE, PASS_WORD, TOOL_OUTPUT, TOOL_SEGMENTS, Rules

#: Words that a record and a sentence must share in a row to meet.
RUN = 5
SIGNALS = ("long_form", "repeated", "explicit_preference", "explicit_rejection", "strong_emphasis")

# The names of blocks that a host puts into a prompt, as comments with BEGIN and END, and the opening and
# closing lines of the state block.
COMMENT_BLOCKS = ("USER_PROFILE", "WORLD_STATE")
STATE_BLOCK = ("[PROJECT_STATE]", "</PROJECT_STATE>")


def route_by_role(lines: DataFrame) -> dict[str, DataFrame]:
    """Users feed extraction, tools feed evidence, assistant turns are a log only."""
    return {
        "user": lines.where(F.col("role") == "user"),
        "assistant_log": lines.where(F.col("role") == "assistant"),
        "tool": lines.where(F.col("role") == "tool"),
        "ignored": lines.where(~F.col("role").isin("user", "assistant", "tool") | F.col("role").isNull()),
    }


def dedup_records(records: DataFrame, stored: DataFrame | None = None, id_col: str = "record_id", order: str = "ts") -> DataFrame:
    """First copy of each record that is not stored yet.

    Copies collapse in the aggregate's map side, so a record repeated very
    often never gathers in one task.
    """
    rest = [c for c in records.columns if c != id_col]
    first = records.groupBy(id_col).agg(F.min(F.struct(F.col(order), *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])).alias("row"))
    out = first.select(id_col, *[F.col(f"row._{i}").alias(c) for i, c in enumerate(rest)])
    if stored is not None:
        out = out.join(stored.select(id_col), id_col, "left_anti")
    return out.select(*records.columns)


def ingest_counts(lines: DataFrame, keys: tuple[str, ...] = ("project_id", "session_id")) -> DataFrame:
    """Per session: records by role, and repeats of a (role, name, content) record."""
    record = F.sha2(F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("content", F.lit(""))), 256)
    unique = lines.groupBy(*keys, "role", record.alias("record")).agg(F.count(F.lit(1)).alias("n"))
    role = F.col("role")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return unique.groupBy(*keys).agg(
        total(role == "user").alias("user"),
        total(role == "assistant").alias("assistant"),
        total(role == "tool").alias("tool"),
        total(role == "tool").alias("tool_evidence"),
        F.sum(F.when(~role.isin("user", "assistant", "tool") | role.isNull(), F.col("n")).otherwise(0)).cast("long").alias("ignored"),
        F.sum(F.when(role.isin("user", "assistant", "tool"), F.col("n") - 1).otherwise(0)).cast("long").alias("duplicates"),
    )


def safe_id(col: Column, fallback: str = "default", limit: int = 120) -> Column:
    """Session or turn id restricted to file-safe characters."""
    safe = F.regexp_replace(col, "[^0-9A-Za-z_.-]+", "_")
    safe = F.regexp_replace(safe, "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(safe, 1, limit), F.lit("")), F.lit(fallback))


def strip_injected(text: Column) -> Column:
    """Text without context blocks that the system itself injected.

    A comment block ends at the END of its own name and prefix; one that never ends is left as it is."""
    opening, closing = STATE_BLOCK
    text = F.regexp_replace(text, rf"(?s)^\s*\Q{opening}\E.*?\Q{closing}\E\s*", "")
    for name in COMMENT_BLOCKS:
        text = F.regexp_replace(text, rf"(?s)<!-- ([A-Z_]*)\Q{name}\E_BEGIN -->.*?<!-- \1\Q{name}\E_END -->\s*", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cap_field(text: Column, limit: int, suffix: str = "\n[truncated]") -> Column:
    """Log field bounded to ``limit`` characters including the suffix."""
    keep = max(limit - len(suffix), 0)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, keep), F.lit(suffix)))


def clean_evidence(lines: DataFrame, field_limit: int = 2000) -> DataFrame:
    """One narrow pass over transcript lines, with a flag per rule that changed the row."""
    text = F.coalesce("content", F.lit(""))
    out = lines.withColumn("clean_content", strip_injected(text)).withColumn("clean_session_id", safe_id(F.col("session_id")))
    out = out.withColumn("log_content", cap_field(F.col("clean_content"), field_limit))
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        out.withColumn("turn_id", F.substring(F.sha1(F.concat_ws("|", "clean_session_id", "role", "clean_content")), 1, 10))
        .withColumn("injected_removed", F.col("clean_content") != trimmed)
        .withColumn("field_capped", F.col("log_content") != F.col("clean_content"))
        .withColumn("session_rewritten", ~F.col("clean_session_id").eqNullSafe(F.col("session_id")))
    )


def clean_report(cleaned: DataFrame) -> DataFrame:
    rules = ("injected_removed", "field_capped", "session_rewritten")
    flagged = cleaned.select("project_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("hit")) for r in rules])).alias("x"))
    return flagged.groupBy("project_id", F.col("x.rule").alias("rule")).agg(F.count_if("x.hit").alias("rows_changed"), F.count(F.lit(1)).alias("rows_seen"))


def classify_tools(calls: DataFrame, name: str = "name", content: str = "content", summary_chars: int = 200) -> DataFrame:
    """Evidence kind, determinism, outcome and a bounded summary of tool calls.

    Calls that do not say what they are about (``object``) are about the tool itself, by its name."""
    if "object" not in calls.columns:
        calls = calls.withColumn("object", F.lower(F.trim(F.col(name))))
    body = F.lower(F.coalesce(F.col(content), F.lit("")))
    # Each pattern looks at a text once, however many rules ask.
    out = once(calls, {"__told": F.regexp_replace(body, NAMED_FAILURE, " "), "__segments": F.split(F.lower(F.coalesce(F.col(name), F.lit(""))), "[^a-z0-9]+")})
    out = once(out, {"__rest": F.regexp_replace("__told", NO_FAILURE, " ")})
    segments, told, rest = F.col("__segments"), F.col("__told"), F.col("__rest")
    named = {k: F.arrays_overlap(segments, F.array(*[F.lit(t) for t in terms])) for k, terms in TOOL_SEGMENTS}
    said = {k: body.rlike(pattern) for k, pattern in TOOL_OUTPUT}
    # A search is one of the web unless the name says that it is one of files.
    web = named["web_result"] & ~(F.array_contains(segments, "search") & named["filesystem_result"])
    kind = F.when(web, "web_result")
    for label in ("test_result", "git_result", "filesystem_result"):
        kind = kind.when(named[label] | said.get(label, F.lit(False)), label)
    kind = kind.otherwise("command_output")
    about = F.coalesce(F.nullif(F.col("object"), F.lit("")), F.col("evidence_kind"))
    outcome = F.when(rest.rlike(FAIL_COUNT) | rest.rlike(FAIL_WORD), "failed").when(rest.rlike(PASS_WORD) | told.rlike(NO_FAILURE), "passed").otherwise("unknown")
    out = once(out, {"__kind": kind, "__outcome": outcome})
    return (
        out.withColumn("evidence_kind", F.col("__kind"))
        .withColumn("object", about)
        .withColumn("deterministic", F.col("evidence_kind").isin("test_result", "git_result", "filesystem_result"))
        .withColumn("outcome", F.col("__outcome"))
        .withColumn("content_summary", F.substring(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "[ \\t\\r\\n]+", " "), 1, summary_chars))
        .drop("__told", "__segments", "__rest", "__kind", "__outcome")
    )


def utterance_intent(text: Column, forms: Forms, rules: Rules) -> Column:
    """Direct request, request around a quote, quote alone, or foreign commentary."""
    lines = F.size(F.split(text, "\n"))
    low = F.lower(text)
    quoted = any_term(forms, rules.quote_cues) | (low.rlike(rules.quote_pattern) if rules.quote_pattern else F.lit(False))
    asked = any_term(forms, rules.request_cues) | (low.rlike(rules.request_pattern) if rules.request_pattern else F.lit(False))
    return (
        F.when(quoted & asked, "mixed_request_with_quote")
        .when(quoted, "quoted_evaluation")
        .when(asked, "direct_user_intent")
        .when(lines >= rules.narrative_lines, "external_commentary")
        .otherwise("direct_user_intent")
    )


def with_intent(utterances: DataFrame, rules: Rules) -> DataFrame:
    out, forms = with_forms(utterances, "text")
    return drop_forms(out.withColumn("utterance_intent", utterance_intent(F.col("text"), forms, rules)))


def cue_signals(forms: Forms, rules: Rules) -> dict[str, Column]:
    return {
        "long_form": F.length("text") >= rules.long_form_chars,
        "explicit_preference": any_term(forms, rules.preference),
        "explicit_rejection": any_term(forms, rules.rejection),
        "strong_emphasis": any_term(forms, rules.emphasis),
    }


def with_cue_signals(utterances: DataFrame, rules: Rules) -> DataFrame:
    """The four signals that need only the text itself."""
    out, forms = with_forms(utterances, "text")
    return drop_forms(out.withColumns(cue_signals(forms, rules)))


def direct_with_signals(utterances: DataFrame, rules: Rules) -> DataFrame:
    """Direct utterances with their signals, from one normalisation of the text."""
    out, forms = with_forms(utterances, "text")
    out = out.where(utterance_intent(F.col("text"), forms, rules) == "direct_user_intent")
    return drop_forms(out.withColumns(cue_signals(forms, rules)))


def text_key(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), "[ \\t\\r\\n]+", " ")), 256)


def repeated_sources(utterances: DataFrame) -> DataFrame:
    """(project_id, source_id, repeated) by normalised text, without moving the text.

    The keys are written once: the count and the join back both read them.
    """
    keyed = cut(utterances.select("project_id", "source_id", text_key(F.col("text")).alias("text_key")), "text-keys")
    out = attach_group(keyed, ["project_id", "text_key"], [F.count(F.lit(1)).alias("copies")])
    return out.select("project_id", "source_id", (F.col("copies") > 1).alias("repeated"))


def importance(base: int = 50) -> Column:
    def points(flag: str, n: int) -> Column:
        return F.when(F.col(flag), n).otherwise(0)

    total = F.lit(base) + points("long_form", 5) + points("repeated", 15) + points("explicit_preference", 10) + points("explicit_rejection", 15) + points("strong_emphasis", 10)
    return F.least(total, F.lit(100))


def with_signals(utterances: DataFrame, rules: Rules) -> DataFrame:
    rep = repeated_sources(utterances)
    out = with_cue_signals(utterances, rules).join(rep, ["project_id", "source_id"], "left")
    out = out.withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    return out.withColumn("importance_score", importance())


def with_topics(utterances: DataFrame, rules: Rules) -> DataFrame:
    out, forms = with_forms(utterances, "text")
    return drop_forms(out.withColumn("linked_topics", all_labels(forms, rules.topics)))


def _runs(words: Column, places: Column) -> Column:
    """Array of (place, run): hashes of RUN words from the given places on."""
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice(words, i + 1, RUN)).alias("run")))


def _sentences(df: DataFrame, *cols: str) -> DataFrame:
    """(cols, words) of the sentences of a text that have words."""
    pieces = df.select(*cols, F.explode(F.split(F.col("text"), SENTENCE_END)).alias("piece"))
    return pieces.select(*cols, word_sequence(F.col("piece")).alias("words")).where(F.size("words") > 0)


def external_overlap(evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """(project_id, source_id, shared_sentences): how many different sentences of ``passages`` (text) a record contains.

    A sentence of RUN words or more is contained where its words follow each other, in whatever sentences of the record they
    stand; a shorter one only as a whole sentence. Sentences meet records at their rarest run of words: all runs that
    cover sentences are counted in the records by an aggregate first, and the others are looked for only there.
    """
    known = _sentences(passages).groupBy("words").agg(F.count(F.lit(1))).select(F.xxhash64("words").alias("sentence"), "words")
    known = cut(known, "overlap-sentences")
    last = F.size("words") - RUN
    cover = known.where(last >= 0).withColumn("places", F.array_union(F.sequence(F.lit(0), last, F.lit(RUN)), F.array(last)))
    cover = cover.select("sentence", F.size("places").alias("parts"), F.explode(_runs(F.col("words"), F.col("places"))).alias("r")).select("sentence", "parts", "r.place", "r.run")
    told = evidence.select("project_id", "source_id", word_sequence(F.col("text")).alias("words")).where(last >= 0)
    told = told.select("project_id", "source_id", F.explode(_runs(F.col("words"), F.sequence(F.lit(0), last))).alias("r")).select("project_id", "source_id", F.col("r.place").alias("at"), "r.run")
    hits = cut(told.join(cover.select("run").distinct(), "run", "left_semi"), "overlap-hits")
    often = hits.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    least = cover.join(often, "run", "left").groupBy("sentence", "parts").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "run")).alias("rarest"))
    least = least.where("rarest.n > 0").select("sentence", "parts", F.col("rarest.place").alias("place"), F.col("rarest.run").alias("run"))
    tried = hits.join(least, "run").select("project_id", "source_id", "sentence", "parts", (F.col("at") - F.col("place")).alias("start")).where("start >= 0")
    wanted = tried.join(cover.drop("parts"), "sentence").withColumn("at", F.col("start") + F.col("place")).drop("place")
    met = wanted.join(hits, ["project_id", "source_id", "at", "run"]).groupBy("project_id", "source_id", "sentence", "parts", "start").agg(F.count(F.lit(1)).alias("n"))
    long = met.where("n = parts").select("project_id", "source_id", "sentence")
    short = known.where(last < 0).select("sentence")
    brief = _sentences(evidence, "project_id", "source_id").where(last < 0).select("project_id", "source_id", F.xxhash64("words").alias("sentence")).join(short, "sentence", "left_semi")
    return long.unionByName(brief).distinct().groupBy("project_id", "source_id").agg(F.count(F.lit(1)).alias("shared_sentences"))


def mark_external(utterances: DataFrame, overlap: DataFrame) -> DataFrame:
    """Utterances with foreign sentences count as quotes, so nothing is extracted from them."""
    out = utterances.join(overlap.select("project_id", "source_id", F.lit(True).alias("__ext")), ["project_id", "source_id"], "left")
    return out.withColumn("utterance_intent", F.when(F.col("__ext"), "quoted_evaluation").otherwise(F.col("utterance_intent"))).drop("__ext")


def direct_only(utterances: DataFrame) -> DataFrame:
    return utterances.where(F.col("utterance_intent") == "direct_user_intent")
