"""Task context: which admitted claims go into which task, and why others do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import fit_budget
from testimony.functions.text import tokens
from testimony.operators.state import MIN_LINE, render_line

TASK = ("project_id", "session_id", "task")


def relevance(admitted: DataFrame, tasks: DataFrame) -> DataFrame:
    """Shared terms of every task with the admitted claims of its project.

    Admission bounds the claims of a project, so the term join grows with the
    tasks only. Blocked claims take no part.
    """
    words = admitted.where(~F.col("conditional_block")).select("project_id", "item_id", F.explode(tokens(F.concat_ws(" ", "claim", "object_key"))).alias("term"))
    asked = tasks.select(*TASK, F.explode(tokens(F.col("task"))).alias("term"))
    return asked.join(words, ["project_id", "term"]).groupBy(*TASK, "item_id").agg(F.count(F.lit(1)).alias("overlap"))


def select_context(admitted: DataFrame, tasks: DataFrame, max_chars: int = 1600) -> DataFrame:
    """Most relevant claims of each task within the character budget."""
    lines = admitted.select("item_id", "confidence", render_line().alias("line"))
    rows = relevance(admitted, tasks).join(lines, "item_id")
    out = fit_budget(rows, list(TASK), [F.desc("overlap"), F.desc("confidence"), F.asc("item_id")], F.length("line") + 1, max_chars, MIN_LINE)
    return out.select(*TASK, "item_id", "overlap", "rank", "line", "cost")


def exclusions(items: DataFrame, tasks: DataFrame, admitted: DataFrame, relevant: DataFrame, selected: DataFrame) -> DataFrame:
    """First-match exclusion counts per task.

    Claims that were not admitted or are blocked count the same for all tasks
    of a project, so they are counted once per project instead of per task.
    """
    per_project = items.groupBy("project_id").agg(F.count(F.lit(1)).alias("items"))
    adm = admitted.groupBy("project_id").agg(F.count(F.lit(1)).alias("admitted"), F.count_if("conditional_block").alias("blocked"))
    base = per_project.join(adm, "project_id", "left").na.fill(0, ["admitted", "blocked"])
    rel = relevant.groupBy(*TASK).agg(F.count(F.lit(1)).alias("relevant"))
    sel = selected.groupBy(*TASK).agg(F.count(F.lit(1)).alias("included"))
    out = tasks.select(*TASK).join(base, "project_id", "left").join(rel, list(TASK), "left").join(sel, list(TASK), "left")
    out = out.na.fill(0, ["items", "admitted", "blocked", "relevant", "included"])
    return out.select(
        *TASK,
        "included",
        (F.col("items") - F.col("admitted")).alias("not_admitted"),
        F.col("blocked").alias("conditional_conflict_block"),
        (F.col("admitted") - F.col("blocked") - F.col("relevant")).alias("not_task_relevant"),
        (F.col("relevant") - F.col("included")).alias("over_budget"),
    )


def manifests(selected: DataFrame, excluded: DataFrame, ruleset_hash: str, policy_hash: str, source_manifest: DataFrame, max_chars: int = 1600) -> DataFrame:
    """One read-only manifest per task. The id list is bounded by the budget.

    ``source_manifest`` has project_id and content_sum of the inputs.
    """
    picked = selected.groupBy(*TASK).agg(F.array_sort(F.collect_list("item_id")).alias("included_cognition_ids"), F.sum("cost").cast("long").alias("output_characters"))
    out = excluded.join(picked, list(TASK), "left").join(source_manifest.select("project_id", F.col("content_sum").cast("string").alias("source_manifest")), "project_id", "left")
    ids = F.coalesce("included_cognition_ids", F.array().cast("array<string>"))
    return (
        out.withColumn("included_cognition_ids", ids)
        .withColumn("output_characters", F.coalesce("output_characters", F.lit(0)))
        .withColumn("max_chars", F.lit(max_chars))
        .withColumn("prompt_fingerprint", F.sha2("task", 256))
        .withColumn("selection_fingerprint", F.sha2(F.array_join("included_cognition_ids", ","), 256))
        .withColumn("ruleset_hash", F.lit(ruleset_hash))
        .withColumn("gate_policy_hash", F.lit(policy_hash))
        .withColumn("mutates_state", F.lit(False))
    )


def inject_once(requests: DataFrame, ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """First request of each (session, project): the one that gets the context."""
    rest = [c for c in requests.columns if c not in ("session_id", "project_id")]
    first = F.min(F.struct(F.col(ts).alias("_t"), F.col(tie).alias("_i"), *[F.col(c).alias(f"c_{c}") for c in rest])).alias("row")
    out = requests.groupBy("session_id", "project_id").agg(first)
    return out.select("session_id", "project_id", *[F.col(f"row.c_{c}").alias(c) for c in rest])
