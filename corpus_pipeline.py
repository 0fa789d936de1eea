"""From raw documents to encoded training text: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from testimony.functions.scale import checkpoint_root
from testimony.llm import crf_quality, fm_decontam, near_copies, piece_scan, skipchain_pii
from testimony.llm.queries import PIECES, on_workers


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, learned from ``labels``, predicts to be good."""
    on_workers(spark)
    return crf_quality.keep_good(docs, crf_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles alike to 0.8 or more: the one with the smallest doc_id."""
    on_workers(spark)
    return near_copies.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark windows."""
    on_workers(spark)
    return fm_decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked in their texts."""
    on_workers(spark)
    return skipchain_pii.mask_personal_data(docs, skipchain_pii.train(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    """(doc_id, text, n_tokens, ids): ids of every text, and the text that they decode to."""
    on_workers(spark)
    return piece_scan.encode_decoded(docs, piece_scan.Vocabulary.load(pieces), lists=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: A trained model, fingerprints by a hash that SQL lacks and a tokenizer's pieces are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
