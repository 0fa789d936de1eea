"""The evidence index on files: records, postings and term counts by project, version and hash bucket.

A manifest names the version of each project that is current, with the fingerprint of the inputs it was built from. A
refresh writes new partitions for the projects that changed and a new manifest; readers see what the manifest names, so a
project that vanished is no longer read and a refresh that fails half way changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from testimony.functions.scale import among, cut, once, top_k
from testimony.operators.lookup import evidence_index, fingerprints, query_terms

#: Hash buckets of each project's records (by id) and of its postings and counts (by term).
BUCKETS = 8
#: Records that are scored in full for a first guess at a query's best ones, as a multiple of k, and postings read for it at least.
FIRST = 32

SCHEMAS = {
    "records": "source_id string, source_type string, text string, preview string, terms array<string>, record_level boolean, chunked boolean, segment_index int, project_id string, version int, bucket int",
    "postings": "term string, source_id string, project_id string, version int, bucket int",
    "counts": "term string, records long, project_id string, version int, bucket int",
    "manifest": "project_id string, version int, rows long, content_sum decimal(38,0), edition int",
}


def bucket_of(col: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def _append(df: DataFrame, path: str, table: str, version: int, key: str) -> None:
    """Files of one (project, bucket) are ranges of the key, as many as its rows need."""
    placed = df.withColumn("version", F.lit(version)).withColumn("bucket", bucket_of(key))
    columns = [f.split(" ")[0] for f in SCHEMAS[table].split(", ")]
    ordered = placed.select(*columns).repartitionByRange("project_id", "bucket", key).sortWithinPartitions("project_id", "bucket", key)
    ordered.write.mode("append").partitionBy("project_id", "version", "bucket").parquet(f"{path}/{table}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, version, rows, content_sum) of the current edition; empty before the first refresh."""
    try:
        every = spark.read.schema(SCHEMAS["manifest"]).parquet(f"{path}/manifest")
        last = every.agg(F.max("edition").alias("e")).first()["e"]
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "project_id string, version int, rows long, content_sum decimal(38,0), edition int")
    return every.where(F.col("edition") == (last if last is not None else -1))


def refresh_index(records: DataFrame, path: str, cols: tuple[str, ...] = ("source_id", "source_type", "text")) -> DataFrame:
    """Brings the index under ``path`` up to date: (project_id, action) with action built, rebuilt, kept or removed.

    ``records`` has project_id, source_id, source_type, text. Only projects whose fingerprint changed are read again and
    written; the rest costs its fingerprint. Nothing is written where nothing changed.
    """
    spark = records.sparkSession
    records = records.where("project_id is not null")
    now, built = cut(fingerprints(records, cols), "index-now"), cut(manifest(spark, path), "index-built")
    known = built.select("project_id", F.col("rows").alias("old_rows"), F.col("content_sum").alias("old_sum"), "version")
    both = now.join(known, "project_id", "full_outer")
    action = (
        F.when(F.col("rows").isNull(), "removed")
        .when(F.col("version").isNull(), "built")
        .when((F.col("rows") == F.col("old_rows")) & (F.col("content_sum") == F.col("old_sum")), "kept")
        .otherwise("rebuilt")
    )
    report = cut(both.withColumn("action", action), "index-report")
    if report.where("action <> 'kept'").isEmpty():
        return report.select("project_id", "action")
    edition = (built.agg(F.max("edition").alias("e")).first()["e"] or 0) + 1
    stale = report.where("action in ('built', 'rebuilt')").select("project_id")
    fresh = cut(evidence_index(records.join(stale, "project_id", "left_semi")), "index-fresh")
    words = fresh.select("project_id", "source_id", F.explode("terms").alias("term"))
    _append(fresh, path, "records", edition, "source_id")
    _append(words, path, "postings", edition, "term")
    _append(words.groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("records")), path, "counts", edition, "term")
    version = F.when(F.col("action") == "kept", F.col("version")).otherwise(edition)
    rows = report.where("action <> 'removed'").select("project_id", version.cast("int").alias("version"), "rows", "content_sum", F.lit(edition).alias("edition"))
    rows.write.mode("append").partitionBy("edition").parquet(f"{path}/manifest")
    return report.select("project_id", "action")


def stored(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the index as the manifest names it."""
    current = manifest(spark, path).select("project_id", "version")
    return spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}").join(current, ["project_id", "version"], "left_semi")


def _buckets_of(df: DataFrame, key: str) -> list[int]:
    """The buckets that a lookup reads; BUCKETS numbers at most."""
    return [r.b for r in df.select(bucket_of(key).alias("b")).distinct().collect()]


def lookup_by_id(spark: SparkSession, path: str, requested: DataFrame) -> DataFrame:
    """The records of the ids asked for, from their buckets alone."""
    asked = cut(requested.select("source_id").distinct(), "index-asked")
    held = stored(spark, path, "records").where(F.col("bucket").isin(_buckets_of(asked, "source_id")))
    return held.join(asked, "source_id", "left_semi").drop("version", "bucket")


def lookup_terms(spark: SparkSession, path: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k records of each query (query_id, text) with the rarest shared terms: (query_id, source_id, score, shared_terms, rank).

    A term weighs floor(1000 * ln(1 + N / n)) where n of the N records have it. The rarest terms are read first: the
    k-th best of what they find, scored in full, bounds the result from below, and common terms whose weights together stay
    under that bound can bring in no further record. Their postings are not read; the few records found are asked whether they
    hold them. Result and order are those of scoring everything.
    """
    wanted = cut(query_terms(queries), "lookup-wanted")
    here = _buckets_of(wanted, "term")
    total = manifest(spark, path).agg(F.sum("rows").cast("double").alias("n")).first()["n"] or 0.0
    counts = stored(spark, path, "counts").where(F.col("bucket").isin(here)).join(wanted.select("term").distinct(), "term", "left_semi")
    counts = counts.groupBy("term").agg(F.sum("records").alias("records"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(1.0) + F.lit(total) / F.col("records"))).cast("long")
    rare = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    ahead = F.coalesce(F.sum("records").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(rare.rowsBetween(0, Window.unboundedFollowing))
    terms = cut(wanted.join(counts, "term").withColumn("weight", weight).withColumns({"ahead": ahead, "rest": rest}), "lookup-terms")
    postings = stored(spark, path, "postings").where(F.col("bucket").isin(here)).select("term", "source_id")

    def scored(some: DataFrame) -> DataFrame:
        found = postings.join(some.select("term", "query_id", "weight"), "term")
        return found.groupBy("query_id", "source_id").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("shared_terms"))

    def whole(pairs: DataFrame, rest: DataFrame) -> DataFrame:
        """Scores of some records with what else they hold of ``rest`` (query_id, tail): only their terms are read and moved."""
        held = stored(spark, path, "records").where(among(pairs, "source_id")).select("source_id", "terms")
        asked = pairs.join(rest.select("query_id", "tail"), "query_id").join(held, "source_id")
        asked = once(asked, {"also": F.expr("array_intersect(transform(tail, x -> x.term), terms)")})
        more = F.expr("aggregate(filter(tail, x -> array_contains(also, x.term)), 0L, (acc, x) -> acc + x.weight)")
        return asked.select("query_id", "source_id", (F.col("score") + more).alias("score"), (F.col("shared_terms") + F.size("also")).alias("shared_terms"))

    order = [F.desc("score"), F.asc("source_id")]
    tried = top_k(scored(terms.where(F.col("ahead") < FIRST * k)), ["query_id"], order, FIRST * k)
    tried = cut(tried.select("query_id", "source_id", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("shared_terms")), "lookup-tried")
    first = top_k(whole(tried, terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("tail"))), ["query_id"], order, k)
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(0)).alias("bound"))
    bounded = cut(terms.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0))), "lookup-bounded")
    tails = bounded.where("rest < bound").groupBy("query_id", "bound").agg(F.collect_list(F.struct("term", "weight")).alias("tail"), F.sum("weight").alias("most"))
    limits = tails.select("query_id", "bound", "most")
    found = scored(bounded.where("rest >= bound")).join(limits, "query_id", "left").where("most is null or score + most >= bound")
    found = cut(found.select("query_id", "source_id", "score", "shared_terms", F.col("most").isNull().alias("done")), "lookup-found")
    every = whole(found.where("not done").drop("done"), tails).unionByName(found.where("done").drop("done"))
    return top_k(every, ["query_id"], order, k)


def index_report(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, source_file_count, segment_count, term_count, chunked_count): sources are the different source types of a project's inputs."""
    records = stored(spark, path, "records")
    return records.groupBy("project_id").agg(
        F.count_distinct("source_type").alias("source_file_count"),
        F.count(F.lit(1)).alias("segment_count"),
        F.sum(F.size("terms")).cast("long").alias("term_count"),
        F.count_if("chunked").alias("chunked_count"),
    )
