"""Evidence tables as JSON lines, and claims between their nested and flat form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.functions.text import digest
from testimony.operators.extract import SLOT
from testimony.operators.integrity import dangling_refs, references
from testimony.schemas import EVIDENCE_TABLES, REFERENCES, TABLES


def read_table(spark: SparkSession, table: str, paths: str | Sequence[str], project_id: str) -> DataFrame:
    """One table of a project; a missing file is an empty table."""
    wanted = [paths] if isinstance(paths, str) else list(paths)
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    there = [p for p in wanted if (path := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(path)]
    df = spark.read.schema(TABLES[table]).json(there) if there else spark.createDataFrame([], TABLES[table])
    return df.withColumn("project_id", F.lit(project_id))


def read_item_document(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """Claims of one ``{"items": [...]}`` document, as a single project keeps them."""
    doc = spark.read.schema(f"items array<struct<{_nested(TABLES['items'])}>>").option("multiLine", True).json(path)
    return doc.select(F.inline("items")).withColumn("project_id", F.lit(project_id))


def _nested(columns: str) -> str:
    """Top-level ``name type`` pairs as ``name:type`` fields of a struct."""
    fields = [f.strip() for f in columns.split(", ")]
    return ",".join(f.replace(" ", ":", 1) for f in fields)


def flat_items(records: DataFrame) -> DataFrame:
    """Nested claim records in the flat form the operators take."""
    s = "structured."
    out = records.select(
        "project_id",
        F.col("id").alias("item_id"),
        *[F.col(s + c) for c in ("scope", "subject", "predicate", "object", "object_key", "modality", "valid_from", "valid_until", "confidence_reason")],
        F.coalesce(F.col(s + "supersedes"), F.array().cast("array<string>")).alias("supersedes"),
        "category",
        "claim",
        "source_type",
        "status",
        "confidence",
        F.size(F.coalesce("evidence", F.array())).cast("long").alias("evidence_count"),
        F.coalesce("evidence_types", F.array("source_type")).alias("evidence_types"),
        F.coalesce("score_signals", F.array().cast("array<string>")).alias("score_signals"),
        F.array_contains(F.coalesce("score_signals", F.array().cast("array<string>")), "tool_deterministic").alias("deterministic"),
        F.coalesce(F.element_at(F.filter("utterance_intents", lambda x: x != "direct_user_intent"), 1), F.get("utterance_intents", F.lit(0))).alias("utterance_intent"),
        F.coalesce("include_in_world_state", F.lit(False)).alias("include_in_world_state"),
        "conditional_conflict_block",
        "last_verified",
    )
    return out.withColumn("slot_id", digest(*SLOT))


def item_evidence(records: DataFrame) -> DataFrame:
    """The evidence arrays of claim records as bridge rows."""
    return records.select("project_id", F.col("id").alias("item_id"), F.explode("evidence").alias("source_id"))


def validate_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Dangling references over all tables at hand, naming the missing id.

    A table that is not given counts as empty, so references into it dangle.
    """
    spark = next(iter(tables.values())).sparkSession
    ids = {name: df.select("id") for name, df in tables.items()}
    ids["evidence"] = reduce(DataFrame.unionByName, [ids[t] for t in EVIDENCE_TABLES if t in ids] or [spark.createDataFrame([], "id string")])
    refs = []
    for table, field, target in REFERENCES:
        if table in tables:
            df = tables[table]
            if field == "supersedes":
                df = df.withColumn("supersedes", F.col("structured.supersedes"))
            refs.append(references(df, table, "id", field, target))
    return dangling_refs(refs, ids)
