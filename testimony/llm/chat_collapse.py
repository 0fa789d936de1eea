"""Chat formatting of logs that hold cumulative snapshots.

A client that logs the whole conversation after every turn leaves each conversation many times, every time a little
longer. Rolling hashes of turn prefixes tell which logged conversations are only the beginning of a longer one; an
anti-join keeps the maximal ones, and those are rendered turn by turn.

Turns are dealt by ranges of (conversation, turn), so a conversation with a third of all rows lies in many tasks; what
a task must know of the turns before it is one row for each task that a conversation crosses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut

#: Two odd multipliers: a prefix's hash is the pair of sums of turn hash times multiplier to the turn's place, modulo 2**64.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")

_LOCAL = "conv_id long, part int, place long, role string, text string, p0 long, p1 long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and prefix sums of each turn among its conversation's turns in this task."""
    part = TaskContext.get().partitionId()
    last, place, sums, power = None, 0, [0, 0], [1, 1]
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        hashes = [np.asarray(batch.column(k)).view(np.uint64).tolist() for k in ("h0", "h1")]
        places, out = [], ([], [])
        for i, conv in enumerate(ids):
            if conv != last or not place:
                last, place, sums, power = conv, 0, [0, 0], [1, 1]
            for k in (0, 1):
                sums[k] = (sums[k] + hashes[k][i] * power[k]) % 2**64
                power[k] = power[k] * BASES[k] % 2**64
                out[k].append(sums[k])
            place += 1
            places.append(place)
        sums_ = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in out]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), batch.column("role"), batch.column("text"), *sums_], ["conv_id", "part", "place", "role", "text", "p0", "p1"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what earlier tasks hold of the conversation: sums there, and own sums times the power of the turns there."""
    for batch in batches:
        before = np.asarray(batch.column("before"))
        columns = {n: batch.column(n) for n in ("conv_id", "role", "text")}
        columns["place"] = pa.array(np.asarray(batch.column("place")) + before)
        for k in (0, 1):
            steps, inverse = np.unique(before, return_inverse=True)
            power = np.array([pow(BASES[k], int(s), 1 << 64) for s in steps], np.uint64)[inverse]
            own, there = (np.asarray(batch.column(f"{n}{k}")).view(np.uint64) for n in ("p", "b"))
            columns[f"p{k}"] = pa.array((there + own * power).view(np.int64))
        yield pa.RecordBatch.from_arrays([columns[n] for n in ("conv_id", "place", "role", "text", "p0", "p1")], ["conv_id", "place", "role", "text", "p0", "p1"])


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, p0, p1): each turn's place in its conversation and the hash of the turns up to it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.where("conv_id is not null").distinct()
    rows = rows.withColumn("h0", F.xxhash64("role", F.lit("\x1f"), "text")).withColumn("h1", F.xxhash64(F.lit(1), "text", "role"))
    order = (F.col("conv_id").asc(), F.col("turn").asc_nulls_last(), F.col("h0").asc(), F.col("h1").asc())
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = cut(ordered.select("conv_id", "role", "text", "h0", "h1").mapInArrow(_running, _LOCAL), "chat-local")
    # One row for each task a conversation lies in. Sums of earlier tasks are put together in their order.
    ends = local.groupBy("conv_id", "part").agg(F.max(F.struct("place", "p0", "p1")).alias("last"))
    crossing = ends.groupBy("conv_id").agg(F.collect_list(F.struct("part", "last")).alias("parts")).where("size(parts) > 1")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                before, sums = 0, [0, 0]
                for p in sorted(parts, key=lambda x: x["part"]):
                    out.append((conv, p["part"], before, *np.array(sums, np.uint64).view(np.int64).tolist()))
                    for k in (0, 1):
                        sums[k] = (sums[k] + p["last"][f"p{k}"] % 2**64 * pow(BASES[k], before, 2**64)) % 2**64
                    before += p["last"]["place"]
            names = ("conv_id", "part", "before", "b0", "b1")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], list(names))

    carried = cut(crossing.mapInArrow(carry, "conv_id long, part int, before long, b0 long, b1 long"), "chat-carried")
    whole = local.join(carried, ["conv_id", "part"], "left").fillna(0, ["before", "b0", "b1"])
    return whole.mapInArrow(_shifted, "conv_id long, place long, role string, text string, p0 long, p1 long")


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hashed turns, and (conv_id, n_turns, n_copies) of the maximal conversations.

    A conversation goes where another one begins with all its turns, role and text alike, and is longer. Of equal
    conversations that with the smallest conv_id stays; n_copies counts them. Rows without a conv_id are not used, and
    repeated rows count once. Within a conversation turns are in the order of ``turn``, null last, then of a hash of
    role and text. A null role or text is empty.
    """
    hashed = cut(prefix_hashes(turns), "chat-prefixes")
    ends = cut(hashed.groupBy("conv_id").agg(F.max(F.struct("place", "p0", "p1")).alias("e")), "chat-ends")
    # One row for each different prefix, so a first turn that all conversations share is one row.
    longest = ends.select("conv_id", F.col("e.place").alias("n_turns"))
    finals = ends.groupBy(F.col("e.place").alias("place"), F.col("e.p0").alias("p0"), F.col("e.p1").alias("p1")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = hashed.join(longest, "conv_id").where("place < n_turns").select("place", "p0", "p1").distinct()
    kept = finals.join(proper, ["place", "p0", "p1"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_copies")
    return hashed, cut(kept, "chat-kept")


def render(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, place, n_turns, n_copies, rendered): the turns of every maximal conversation in the chat template.

    One row a turn, in order of place, so that a conversation of any length is written by many tasks; its text is
    their concatenation. Markers of the template inside a text are broken by a space, so no turn can open another.
    """
    hashed, kept = collapse(turns)
    before, between, after = template

    def safe(c: str) -> Column:
        return F.replace(F.col(c), F.lit("<|im_"), F.lit("<| im_"))

    rows = hashed.select("conv_id", "place", "role", "text").join(kept, "conv_id")
    return rows.select("conv_id", "place", "n_turns", "n_copies", F.concat(F.lit(before), safe("role"), F.lit(between), safe("text"), F.lit(after)).alias("rendered"))
