"""Governing the projects a micro-batch touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.operators.normalize import classify_tools
from testimony.plans.govern import govern
from testimony.rules import DEFAULT_RULES, Policy, Rules
from testimony.sources.sinks import replace_derived
from testimony.streaming.ingest import stored_records, tools_of, utterances_of


def govern_touched(store: str, out: str, rules: Rules = DEFAULT_RULES, policy: Policy = Policy()) -> Callable[[DataFrame, int], None]:
    """A step for ``ingest_stream``: new decisions for the projects of the batch, others stay as they are.

    A project's decisions depend on all of its records, through repeats,
    conflicts and budgets, so its stored records are read again. Writing
    replaces the project's partition, and a replay writes the same rows.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("project_id").distinct()
        seen = stored_records(batch.sparkSession, store).where(F.col("batch_id") <= batch_id)
        records = seen.join(touched, "project_id", "left_semi")
        run = govern(utterances_of(records), classify_tools(tools_of(records)), rules=rules, policy=policy)
        replace_derived(run.decisions, out)

    return step
