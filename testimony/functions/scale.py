"""Helpers that keep per-group work spread over the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bits of a filter of keys: 2 MB.
BITS = 1 << 24
#: Up to so many rows of a group a task goes without lanes.
FEW = 128


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="testimony-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    Used where a table feeds several branches of a plan: the branches then
    read columns from files instead of recomputing the text work, and a lost
    executor costs a re-read only.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later expressions look at many times: they come out of a one-row generator, as the optimizer would
    otherwise copy their expressions into everything above."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def key_filter(few: DataFrame, *keys: str) -> DataFrame:
    """BITS bits of key hashes of ``few`` as one row (bits: 64 to a long), folded by an aggregate.

    It is written, so that a plan that asks it in many places holds a read of one row there and not ``few`` again.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    word = few.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    # As many words as there are at most: their table is bounded and may be broadcast.
    every = few.sparkSession.range(0, BITS // 64, 1, 1).withColumnRenamed("id", "word").join(F.broadcast(word), "word", "left")
    words = every.select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    dense = words.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bits"))
    return cut(dense, "filter")


def _asked(bits: Column, hashed: Column) -> Column:
    bit = F.pmod(hashed, F.lit(BITS))
    return F.getbit(F.element_at(bits, F.floor(bit / 64).cast("int") + 1), (bit % 64).cast("int")) == 1


def among(few: DataFrame, *keys: str, of: Column | None = None) -> Column:
    """Whether the keys of a row may be among those of ``few``: false means that they are not, so that rows that meet nothing
    need not be shuffled for a join. ``of`` is what stands for the key in the rows, where that is not a column of its name.

    The bits go with every task of each stage that asks. Where a plan asks more than once, ``apart`` sends them once.
    """
    return _asked(key_filter(few, *keys).scalar(), F.xxhash64(*(keys if of is None else [of])))


def apart(df: DataFrame, *filters: tuple[DataFrame, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in one of ``filters`` (of ``key_filter``, and the key in the rows), and all others. The bits
    are broadcast, once for all places of a plan, and no row carries them."""
    named = [bits.select(F.col("bits").alias(f"__bits{i}")) for i, (bits, _) in enumerate(filters)]
    hits = [_asked(F.col(f"__bits{i}"), F.xxhash64(key)) for i, (_, key) in enumerate(filters)]
    row, hit = F.broadcast(reduce(DataFrame.crossJoin, named)), reduce(lambda a, b: a | b, hits)
    return df.join(row, hit, "left_semi"), df.join(row, hit, "left_anti")


def join_few(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Left join of a written or cheap ``df`` with a table of few keys: only rows that may have a partner are shuffled."""
    near, far = apart(df, (key_filter(few, key), F.col(key)))
    return near.join(few, key, "left").unionByName(far, allowMissingColumns=True)


def without_few(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is not among those of ``few``; only rows that may be are shuffled."""
    near, far = apart(df, (key_filter(few, key), F.col(key)))
    return near.join(few.select(key), key, "left_anti").unionByName(far)


def crowd(df: DataFrame, keys: Sequence[str], least: int = 2) -> tuple[DataFrame, Column]:
    """For ``apart``: the rows whose group may have ``least`` rows or more. Groups are counted by a hash."""
    hashed = F.xxhash64(*keys)
    counted = df.groupBy(hashed.alias("__hash")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return key_filter(counted, "__hash"), hashed


def crowded(df: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """The rows of groups of ``least`` rows or more, and some others; rows stay where they are."""
    return apart(df, crowd(df, keys, least))[0]


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank.

    Each task keeps at most ``k`` rows of a group before the shuffle, where ``k`` is within Spark's own group limit. Where
    ``k`` is above FEW, rows are first ranked in lanes of the group, by a hash of the row, so a group that holds most of the
    table is spread over the tasks and reaches the last ranking with at most ``k`` rows a lane.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if k <= FEW:
        return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    lanes = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    whole = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    lane = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in whole]), F.lit(lanes))
    sub = Window.partitionBy(*keys, "__lane").orderBy(*order)
    head = df.withColumn("__lane", lane).withColumn("__r", F.row_number().over(sub)).where(F.col("__r") <= k).drop("__lane", "__r")
    return head.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def fit_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: Column, budget: int, min_cost: int = 1) -> DataFrame:
    """Rows of each group in order, each taken if its cost fits what is left of ``budget``, with rank and running cost.

    A row that does not fit is passed over and the next ones are tried. What is left only shrinks, so of rows with one cost
    that come after a rejected one none is taken, and of one cost at most ``budget // cost`` are: only so many rows of each
    (group, cost) are looked at one by one, in a group the harmonic sum of the budget at most.
    """
    keys = list(keys)
    priced = df.withColumn("cost", F.greatest(cost.cast("long"), F.lit(min_cost).cast("long"))).where(F.col("cost") <= budget)
    few = top_k(priced, [*keys, "cost"], order, max(budget // min_cost, 1), "__same").where(F.expr(f"__same <= {budget} div cost")).drop("__same")
    numbered = few.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rest = [c for c in numbered.columns if c not in keys]
    grouped = numbered.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("__rows"))
    costs = F.array_sort(F.transform("__rows", lambda r: F.struct(r["__n"].alias("n"), r["cost"].alias("cost"))))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<int>").alias("taken"))
    filled = F.aggregate(
        costs,
        start,
        lambda acc, x: F.when(x["cost"] <= acc["left"], F.struct((acc["left"] - x["cost"]).alias("left"), F.concat(acc["taken"], F.array(x["n"])).alias("taken"))).otherwise(acc),
    )
    taken = grouped.withColumn("__taken", filled["taken"]).select(*keys, F.explode(F.filter("__rows", lambda r: F.array_contains(F.col("__taken"), r["__n"]))).alias("__row"))
    window = Window.partitionBy(*keys).orderBy("__n")
    rows = taken.select(*keys, "__row.*").withColumn("rank", F.row_number().over(window))
    rows = rows.withColumn("running", F.sum("cost").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(*df.columns, *[c for c in ("cost", "rank", "running") if c not in df.columns])


def attach_group(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Join per-group aggregates back to the rows.

    The aggregate combines before its shuffle and is written, so that both sides of the join are shuffled for it
    alone and AQE can split the rows of a hot group. Groups with a null key keep their aggregates as well.
    """
    keys = list(keys)
    grouped = df.groupBy(*keys).agg(*aggs)
    side = cut(grouped, "groups").select(*[F.col(k).alias(f"__g_{k}") for k in keys], *[c for c in grouped.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys])
    return df.join(side, on).drop(*[f"__g_{k}" for k in keys])


def as_of_last(
    events: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    ts: str,
    state_cols: Sequence[str],
    event_id: str,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """For each event the latest state row at or before it, per key.

    Rows are ordered within (key, time bucket) only, and what a bucket
    inherits from earlier ones is carried over one summary row per bucket, so
    a key with most of the rows is still spread over its buckets.
    """
    keys = list(keys)
    bucket = F.floor(F.unix_timestamp(ts) / bucket_seconds).alias("__bucket")
    packed = F.struct(*[F.col(c) for c in state_cols])
    ev = events.withColumn("__bucket", bucket).withColumn("__state", F.lit(None)).withColumn("__kind", F.lit(1))
    st = states.select(*keys, ts, *state_cols).withColumn("__state", packed).withColumn("__bucket", bucket).withColumn("__kind", F.lit(0))
    st = st.select(*keys, ts, "__bucket", "__state", "__kind")

    last = st.groupBy(*keys, "__bucket").agg(F.max_by("__state", F.struct(F.col(ts), F.col("__state"))).alias("__last"))
    marks = last.unionByName(ev.select(*keys, "__bucket").distinct(), allowMissingColumns=True).groupBy(*keys, "__bucket").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("__carry", F.last("__last", ignorenulls=True).over(before)).select(*keys, "__bucket", "__carry")

    both = ev.withColumn("__state", F.lit(None).cast(st.schema["__state"].dataType)).unionByName(st, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "__bucket").orderBy(ts, "__kind", "__state", event_id).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__state", ignorenulls=True).over(within)).where(F.col("__kind") == 1)
    out = seen.join(carried, [*keys, "__bucket"], "left").withColumn("__found", F.coalesce("__seen", "__carry"))
    return out.select(*events.columns, *[F.col(f"__found.{c}").alias(c) for c in state_cols])
