"""Rendered project state: admitted claims as bounded text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import fit_budget, top_k
from testimony.functions.text import any_term, forms_of, rank_of
from testimony.operators.gate import priority
from testimony.rules import DOCTRINE, MODALITY_WORDS, PREDICATE_WORDS, READ_CUES, Policy

COMPACT_MIN_CONFIDENCE = 95
COMPACT_ITEMS = 5
BUDGET = 1600
MIN_LINE = 3


def state_items(items: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """What the gate allows; without any gate output, accepted and included claims."""
    if decisions is None:
        return items.where((F.col("status") == "accepted") & F.col("include_in_world_state"))
    return items.join(decisions.where(F.col("allowed")).select("item_id"), "item_id", "left_semi")


def compact_items(admitted: DataFrame, policy: Policy = Policy(), limit: int = COMPACT_ITEMS, minimum: int = COMPACT_MIN_CONFIDENCE) -> DataFrame:
    fit = admitted.where((F.col("scope") == "project") & F.col("modality").isin("must", "must_not") & (F.col("confidence") >= minimum))
    return top_k(fit, ["project_id"], priority(policy), limit)


def _word(col: Column, words: Mapping[str, str]) -> Column:
    names = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.element_at(names, col), col)


def render_line(modality_words: Mapping[str, str] = MODALITY_WORDS, predicate_words: Mapping[str, str] = PREDICATE_WORDS) -> Column:
    """Natural-language bullet of a claim. A render claim about reading gets the read label."""
    read = (F.col("predicate") == "render") & any_term(forms_of("object"), READ_CUES)
    effective = F.when(read, "read_source").otherwise(F.col("predicate"))
    return F.concat(F.lit("- "), _word(F.col("modality"), modality_words), _word(effective, predicate_words), F.lit("："), F.col("object"))


def doctrine_lines(projects: DataFrame, doctrine: Sequence[str] = DOCTRINE) -> DataFrame:
    """The fixed lines that open every project's state, ranked before any claim."""
    lines = F.array(*[F.struct(F.lit(i - len(doctrine)).alias("priority"), F.lit(f"- {text}").alias("line")) for i, text in enumerate(doctrine)])
    return projects.select("project_id").distinct().select("project_id", F.explode(lines).alias("d")).select("project_id", "d.priority", F.lit("").alias("item_id"), "d.line")


def fitted_lines(claims: DataFrame, projects: DataFrame, policy: Policy = Policy(), budget: int = BUDGET, doctrine: Sequence[str] = DOCTRINE) -> DataFrame:
    """The lines of each project that fit the character budget, in order.

    A line has at least its bullet of two characters and a line break, so a
    budget of 1600 characters holds 533 lines at most.
    """
    levels = (
        rank_of("source_type", policy.source_priority) * 1_000_000
        + rank_of("predicate", policy.predicate_priority) * 10_000
        + rank_of("modality", policy.modality_priority) * 1_000
        + (F.lit(100) - F.col("confidence"))
    )
    bullets = claims.select("project_id", levels.cast("int").alias("priority"), "item_id", render_line().alias("line"))
    lines = doctrine_lines(projects, doctrine).unionByName(bullets)
    fitted = fit_budget(lines, ["project_id"], [F.asc("priority"), F.asc("item_id")], F.length("line") + 1, budget, MIN_LINE)
    return fitted.select("project_id", "rank", "item_id", "line", "cost", "running")


def assemble(lines: DataFrame) -> DataFrame:
    """One text per project from its fitted lines."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return lines.groupBy("project_id").agg(
        F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("state"),
        F.count_if(F.col("item_id") != "").alias("structured_count"),
        F.sum("cost").cast("long").alias("characters"),
    )


def build_state(items: DataFrame, decisions: DataFrame | None, policy: Policy = Policy(), budget: int = BUDGET, admitted: DataFrame | None = None) -> DataFrame:
    """Full and compact state of every project with its counts. ``admitted`` are the state items, where they are at hand."""
    admitted = state_items(items, decisions) if admitted is None else admitted
    projects = items.select("project_id")
    full = assemble(fitted_lines(admitted, projects, policy, budget))
    short = assemble(fitted_lines(compact_items(admitted, policy).drop("rank"), projects, policy, budget))
    short = short.select("project_id", F.col("state").alias("compact_state"), F.col("structured_count").alias("compact_structured_count"), F.col("characters").alias("compact_characters"))
    counts = admitted.groupBy("project_id").agg(F.count(F.lit(1)).alias("included_count"))
    out = full.join(short, "project_id").join(counts, "project_id", "left")
    return out.withColumn("included_count", F.coalesce("included_count", F.lit(0)))
