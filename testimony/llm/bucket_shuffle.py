"""A random order of whole records in two passes, and shards cut from it.

Pass one scatters the records by a seeded hash into buckets that fit in memory. Pass two shuffles each bucket by Fisher
and Yates and writes it. Buckets in their order, each in its new order, are a random permutation of the corpus; shard i
of n holds the i-th of n equal parts of it, so shards differ by one record at most. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testimony.functions.scale import cut

#: Bytes of text of one bucket.
BUCKET_BYTES = 16 << 20
#: Buckets whose sizes are summed together.
RUN = 1024


def text_size() -> Column:
    """UTF-8 bytes of the text, and one for its end; a null text has none."""
    return (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long")


def _first_places(buckets: DataFrame) -> DataFrame:
    """(bucket, first): how many records stand in the buckets before, of (bucket, n). Summed by runs of buckets."""
    run = F.floor(F.col("bucket") / RUN)
    runs = buckets.groupBy(run.alias("run")).agg(F.sum("n").alias("held"))
    ahead = runs.withColumn("ahead", F.coalesce(F.sum("held").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("run", run).withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return placed.join(ahead.select("run", "ahead"), "run").select("bucket", (F.col("ahead") + F.col("within")).alias("first"))


def shuffle_shards(docs: DataFrame, shards: int = 16, seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text), with ``shard`` (0 to shards - 1, counts one apart at most) and ``slot`` (gapless from 0).

    A record's bucket hangs on the seed, its doc_id, its text and the task that reads it, so that rows that are all alike
    scatter as well; a bucket is larger than asked for only by chance or by one text that is. Null ids and texts, empty
    texts and repeated rows are records like others. Columns of ``docs`` called shard or slot are replaced. An empty table
    gives no rows. The order depends on the seed and on how the table is split into tasks.
    """
    held = docs.agg(F.sum(text_size()).alias("bytes")).first()["bytes"] or 0
    n_buckets = held // bucket_bytes + 1
    record = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in ("shard", "slot")])
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.spark_partition_id())
    # Not bucket = key mod n_buckets and order = key: both would hang together.
    scattered = docs.select(key.alias("key"), record.alias("record")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n_buckets)))
    buckets = scattered.repartition("bucket").sortWithinPartitions("bucket", "key").groupBy("bucket").agg(F.collect_list("record").alias("records"))
    shuffled = buckets.select("bucket", F.posexplode(F.shuffle("records", seed)).alias("place", "record"))
    written = cut(shuffled, "shuffled-buckets")
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    counts = cut(counts, "bucket-counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 1
    at = F.col("first") + F.col("place")
    shard = F.expr(f"cast((first + place + 1) * {shards} - 1 as long) div {total}")
    begins = F.expr(f"(shard * {total}) div {shards}")
    placed = written.join(_first_places(counts), "bucket").withColumn("shard", shard)
    return placed.select("record.*", F.col("shard").cast("int").alias("shard"), (at - begins).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder ``shard=i`` for each shard. Each task holds a stretch of one or two shards in their order; slots name the order."""
    shuffled.write.partitionBy("shard").parquet(path)
