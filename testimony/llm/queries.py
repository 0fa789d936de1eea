"""One query per operator over its whole table, with production settings, and SQL where SQL can express it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.functions.scale import checkpoint_root
from testimony.llm import arc_convert, bucket_shuffle, chat_collapse, cover_dedup, covering_simhash, crf_quality, fm_decontam, piece_scan, repetition, skipchain_pii, spelling_groups, token_alignment, url_equivalence
from testimony.llm.oracle import ORACLE  # noqa: F401


#: Bytes of rows that travel between the JVM and a worker together. Operators take texts a megabyte at a time, so larger
#: batches are held for nothing, on both sides and by every task.
BATCH_BYTES = 8 << 20


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder they start in, and bounds
    what is sent to them at once."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.render(_table(spark, sf_dir, "conversations"))


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition_quality(_table(spark, sf_dir, "documents"))
    chars = [F.col("gram_chars")[i].alias(f"chars_{n}") for i, n in enumerate(sorted(repetition.Limits().gram_percent))]
    return found.select(*[c for c in found.columns if c != "gram_chars"], *chars)


#: The vocabulary that texts are encoded with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op3_piece_scan(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    found = piece_scan.encode_decoded(_table(spark, sf_dir, "documents"), piece_scan.Vocabulary.load(pieces))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("text_sha256"))


URL_RULES = [
    url_equivalence.Rule("allow", "com", "/"),
    url_equivalence.Rule("block", "example.com", "/en/"),
    url_equivalence.Rule("allow", "www.example.com", "/en/"),
    url_equivalence.Rule("block", "net", "/es/"),
    url_equivalence.Rule("block", "net", "/fr/"),
]


def op4_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_equivalence.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return arc_convert.archive_pages(spark, pages, f"{checkpoint_root(spark)}/archives-{uuid.uuid4().hex}")


def op6_fm_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = crf_quality.train(docs, _table(spark, sf_dir, "labels"))
    return crf_quality.score_quality(docs, field).select("doc_id", crf_quality.held_out().alias("held_out"), "score", "predicted")


def op8_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.dedup_substrings(_table(spark, sf_dir, "documents"), digest=True)


def op9_skipchain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = skipchain_pii.find_personal_data(docs, skipchain_pii.train(docs))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rank = F.create_map(*[x for i, kind in enumerate(skipchain_pii.KINDS) for x in (F.lit(kind), F.lit(i))])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as long) as n_{kind}") for kind in skipchain_pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering_simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(_table(spark, sf_dir, "documents"))


def op12_bucket_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = bucket_shuffle.shuffle_shards(_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return shuffled.select(
        "doc_id",
        bucket_shuffle.text_size().alias("size"),
        crc.alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The byte-level vocabulary that PIECES is aligned with.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def op13_token_alignment(spark: SparkSession, sf_dir: str, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    pair = token_alignment.Pair.load(byte_level, pieces)
    texts, pairs = token_alignment.align(_table(spark, sf_dir, "documents"), pair)
    return token_alignment.summarise(texts, pairs, pair)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_collapse": op1_chat_collapse,
    "op2_repetition": op2_repetition,
    "op3_piece_scan": op3_piece_scan,
    "op4_url_equivalence": op4_url_equivalence,
    "op5_arc_convert": op5_arc_convert,
    "op6_fm_decontam": op6_fm_decontam,
    "op7_crf_quality": op7_crf_quality,
    "op8_cover_dedup": op8_cover_dedup,
    "op9_skipchain_pii": op9_skipchain_pii,
    "op10_covering_simhash": op10_covering_simhash,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_bucket_shuffle": op12_bucket_shuffle,
    "op13_token_alignment": op13_token_alignment,
}

