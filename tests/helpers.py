"""Small claim tables for the scenario tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.text import digest

ITEM = (
    "project_id string, item_id string, scope string, subject string, predicate string, object string, object_key string, modality string, category string, claim string,"
    " source_type string, status string, confidence int, evidence_count bigint, deterministic boolean, utterance_intent string, include_in_world_state boolean"
)


def item(item_id, **kw):
    base = dict(
        project_id="p", scope="project", subject="assistant_output", predicate="enter_core_memory", object="final answer", object_key="assistant_output", modality="must_not",
        category="constraint", claim=f"claim {item_id}", source_type="user_utterance", status="candidate", confidence=98, evidence_count=1, deterministic=False,
        utterance_intent=None, include_in_world_state=False,
    )
    base.update(kw, item_id=item_id)
    return base


def items(spark, *rows) -> DataFrame:
    names = [f.split()[0] for f in ITEM.split(", ")]
    df = spark.createDataFrame([tuple(r[n.strip()] for n in names) for r in rows], ITEM)
    df = df.withColumn("slot_id", digest("project_id", "scope", "subject", "predicate", "object_key"))
    return df.withColumn("evidence_types", F.array("source_type"))


def agent(item_id, **kw):
    return item(item_id, **{"source_type": "agent_interpretation", "confidence": 74, "modality": "may", **kw})


def by(df: DataFrame, key: str = "item_id") -> dict:
    return {r[key]: r for r in df.collect()}
