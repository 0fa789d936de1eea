"""From evidence text to structured claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import apart, crowd, key_filter, once
from testimony.functions.text import Forms, digest, drop_forms, escape, first_label, label_case, pattern_case, quoted, with_forms
from testimony.rules import CATEGORY_OF_MODALITY, Rules

SLOT = ("project_id", "scope", "subject", "predicate", "object_key")
SENTENCE_END = "[.;!?\n。；！？]+"
KEEP = ("project_id", "source_id", "session_id", "user_id", "source_type", "ts")
FLAGS = ("long_form", "explicit_preference", "explicit_rejection", "strong_emphasis")


def protect(text: Column, rules: Rules) -> Column:
    """Text prepared for splitting: a line break before an adversative."""
    # a full stop inside a file name or number ends no sentence
    text = F.regexp_replace(text, "([A-Za-z0-9_])[.]([A-Za-z0-9])", "$1\u0001$2")
    if rules.adversatives:
        terms = "|".join(escape(t) for t in rules.adversatives)
        text = F.regexp_replace(text, f"[,，][ ]*({terms})", "\n$1")
    return text


def clauses(evidence: DataFrame, rules: Rules) -> DataFrame:
    """One row per clause of a text, with its position."""
    kept = [c for c in evidence.columns if c != "text"]
    split = evidence.select(*kept, F.posexplode(F.split(protect(F.col("text"), rules), SENTENCE_END)).alias("pos", "clause"))
    split = split.withColumn("clause", F.trim(F.regexp_replace("clause", "\u0001", ".")))
    return split.where("clause <> ''")


def predicate(forms: Forms, rules: Rules) -> Column:
    """Specific label, or a fallback by source and modality."""
    fallback = (
        "CASE WHEN source_type = 'agent_interpretation' THEN 'infers' WHEN source_type = 'tool_evidence' THEN 'observed'"
        " WHEN modality IN ('must', 'must_not') THEN 'requires' ELSE 'states' END"
    )
    return F.expr(label_case(forms, rules.predicate, fallback))


def object_label(forms: Forms, rules: Rules) -> Column:
    """Key of the longest alias in the text; null where none matches."""
    aliases = sorted(((a, key) for key, names in rules.objects for a in names), key=lambda x: (-len(x[0]), x[0]))
    return F.expr(label_case(forms, [(key, [alias]) for alias, key in aliases], "CAST(NULL AS STRING)"))


def slug(text: Column) -> Column:
    ascii_slug = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    # text without Latin letters keeps its own form as key
    return F.when(ascii_slug != "", ascii_slug).otherwise(F.lower(F.trim(text)))


def object_phrase(clause: Column, rules: Rules) -> Column:
    return F.trim(F.regexp_extract(F.lower(clause), rules.object_pattern, 1))


def modality(forms: Forms, rules: Rules) -> Column:
    """The first modality with a pattern or a cue."""
    return F.expr(pattern_case(forms, rules.modality_patterns, label_case(forms, rules.modality, quoted("is"))))


def structure(clause_rows: DataFrame, rules: Rules) -> DataFrame:
    """Adds modality, predicate, scope, subject, object and object_key."""
    out, forms = with_forms(clause_rows, "clause", rules.idioms)
    out = once(
        out,
        {
            "modality": modality(forms, rules),
            "scope": first_label(forms, rules.scope, "project"),
            "subject": first_label(forms, rules.subject, "project"),
            "object": object_phrase(F.col("clause"), rules),
            "object_alias": object_label(forms, rules),
        },
    )
    out = once(out, {"predicate": predicate(forms, rules), "object_key": F.coalesce("object_alias", slug(F.col("object")))})
    return drop_forms(out).drop("object_alias").where(F.col("object_key") != "")


def category() -> Column:
    whens = " ".join(f"WHEN {quoted(m)} THEN {quoted(label)}" for m, label in CATEGORY_OF_MODALITY.items())
    return F.expr(f"CASE modality {whens} END")


def with_ids(claims: DataFrame) -> DataFrame:
    """A claim is what one kind of source says, in one modality, about one slot."""
    return once(once(claims, {"slot_id": digest(*SLOT)}), {"item_id": digest("slot_id", "modality", "source_type")})


def packed(rows: DataFrame, text: str, rules: Rules, keys: bool = True) -> DataFrame:
    """The rows to write: without the objects that are the phrase of ``text`` and, with ``keys``, without the keys that are
    the slug of their object."""
    told = {"object_told": F.col("object").eqNullSafe(object_phrase(F.col(text), rules))}
    if keys:
        told["key_told"] = F.col("object_key").eqNullSafe(slug(F.col("object")))
    rows = once(rows, told)
    left = {"object": F.when(~F.col("object_told"), F.col("object"))}
    return rows.withColumns(left | ({"object_key": F.when(~F.col("key_told"), F.col("object_key"))} if keys else {}))


def unpacked(rows: DataFrame, text: str, rules: Rules) -> DataFrame:
    """Written rows with the objects and keys that their texts tell."""
    rows = rows.withColumn("object", F.when(F.col("object_told"), object_phrase(F.col(text), rules)).otherwise(F.col("object")))
    if "key_told" in rows.columns:
        rows = rows.withColumn("object_key", F.when(F.col("key_told"), slug(F.col("object"))).otherwise(F.col("object_key")))
    return rows.drop("object_told", "key_told")


def mentions(structured: DataFrame) -> DataFrame:
    """One row per (claim, evidence record): the evidence bridge.

    The combine before its shuffle folds the clauses of a record, and the
    record id in the key spreads claims that very many records repeat.
    """
    keyed = with_ids(structured)
    flags = [F.max(f).alias(f) if f in structured.columns else F.lit(False).alias(f) for f in FLAGS]
    extra = [F.max("deterministic").alias("deterministic")] if "deterministic" in structured.columns else [F.lit(False).alias("deterministic")]
    return keyed.groupBy("item_id", "slot_id", *SLOT, "modality", "source_type", "source_id", "session_id", "user_id", "ts").agg(
        F.min("clause").alias("clause"), F.min("object").alias("object"), F.count(F.lit(1)).alias("mention_count"), *flags, *extra
    )


def claims(bridge: DataFrame) -> DataFrame:
    """Upsert by stable id: evidence counts add up, flags merge, the first wording is kept.

    The evidence ids themselves stay in the bridge; a claim that a third of
    all records repeat is still one small row here. The id alone is the key, and an object key that is the slug
    of its object is made again after the shuffle.
    """
    flags = [F.max(f).alias(f) for f in (*FLAGS, "repeated", "deterministic")]
    same = [F.max(c).alias(c) for c in (*SLOT[:-1], "modality", "source_type")]
    other_key = F.when(~F.col("object_key").eqNullSafe(slug(F.col("object"))), F.col("object_key"))
    grouped = bridge.groupBy("item_id").agg(
        *same,
        F.max(other_key).alias("__key"),
        F.min("clause").alias("claim"),
        F.min("object").alias("object"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.sum("mention_count").alias("mention_count"),
        F.min("ts").alias("valid_from"),
        F.max("ts").alias("last_verified"),
        *flags,
    )
    return _described(grouped.withColumn("object_key", F.coalesce("__key", slug(F.col("object")))))


def _described(grouped: DataFrame) -> DataFrame:
    return grouped.withColumn("slot_id", digest(*SLOT)).select(
        "project_id",
        "item_id",
        "slot_id",
        "scope",
        "subject",
        "predicate",
        "object",
        "object_key",
        "modality",
        category().alias("category"),
        "claim",
        "source_type",
        F.lit("candidate").alias("status"),
        "evidence_count",
        "mention_count",
        "valid_from",
        "last_verified",
        F.concat(F.lit("Extracted by rule from "), "source_type").alias("confidence_reason"),
        *FLAGS,
        "repeated",
        "deterministic",
    )


def claims_apart(bridge: DataFrame, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The claims of a written bridge in two parts: those that several records may support, and those of ``also`` (item_id),
    are folded by id; claims of one record are made where it stands, and their texts are not shuffled."""
    filters = [crowd(bridge, ["item_id"])]
    if also is not None:
        filters.append((key_filter(also, "item_id"), F.col("item_id")))
    several, one = apart(bridge, *filters)
    one = one.withColumnsRenamed({"clause": "claim", "ts": "valid_from"})
    one = one.withColumns({"evidence_count": F.lit(1).cast("long"), "mention_count": F.col("mention_count").cast("long"), "last_verified": F.col("valid_from")})
    return claims(several), _described(one)


def with_repeats(bridge: DataFrame, repeats: DataFrame) -> DataFrame:
    out = bridge.join(repeats, ["project_id", "source_id"], "left")
    return out.withColumn("repeated", F.coalesce("repeated", F.lit(False)))


def new_claims(extracted: DataFrame, stored: DataFrame) -> DataFrame:
    return extracted.join(stored.select("item_id"), "item_id", "left_anti")


def tool_claims(evidence: DataFrame) -> DataFrame:
    """Passed or failed tool outcomes as structured claims about a test."""
    decided = evidence.where(F.col("outcome").isin("passed", "failed"))
    return decided.select(
        "project_id",
        "source_id",
        "session_id",
        "user_id",
        F.lit("tool_evidence").alias("source_type"),
        "ts",
        F.concat_ws(" ", "object", "outcome").alias("clause"),
        F.when(F.col("outcome") == "passed", "is").otherwise("is_not").alias("modality"),
        F.lit("test").alias("scope"),
        F.lit("test_result").alias("subject"),
        "object",
        F.lit("test_passed").alias("predicate"),
        slug(F.col("object")).alias("object_key"),
        "deterministic",
    )
