"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position of the 64-bit fingerprint gets a code of radius + 1 bits. A table exists for each non-zero
vector of that many bits and keeps the positions whose code has an odd product with the vector. For any set of at
most ``radius`` differing positions some vector is orthogonal to all their codes, so in that table both
fingerprints read the same: no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.llm.components import connected_components
from testimony.llm.textbatch import groups

BITS = 64
RADIUS = 3
SHINGLE = 3
#: Larger buckets are dealt out further, exactly, by blocks of the bits that their key leaves free.
BUCKET = 512
#: So often at most. After two splits a key holds at least 46 bits, so no bucket has over 2**18 different fingerprints.
SPLITS = 2

_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of all word shingles, repeats included; a bit is set where over half the shingle hashes set it."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)][size - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=False)], dtype="<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256
    tally = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE
    return int.from_bytes(np.packbits((2 * tally > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                values = np.array([fingerprint((x.as_py() or "").encode()) for x in rows.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(sign, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the 2**(radius + 1) - 1 tables. Codes cycle through all vectors but zero, so tables keep about half the bits."""
    codes = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def split_masks(mask: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Finer masks for a full bucket: its free bits in radius + 1 blocks, of which close pairs share at least one whole."""
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1) if free[k :: radius + 1]]


def _links_within(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of links between distinct fingerprints of one bucket that differ in at most ``radius`` bits.

    A search that drops what it has reached: one pass over the rest for each member, and close crowds fall at once."""
    rest = fps.view(np.uint64)  # of signed numbers numpy counts the bits of the absolute value
    links = []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                front.extend(rest[near])
                found = rest[near].view(np.int64).tolist()
                links.extend(zip([int(at.view(np.int64))] * len(found), found, strict=True))
                rest = rest[~near]
    return links


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of full buckets under the finer masks of theirs."""
    for batch in batches:
        masks, fps = (np.asarray(batch.column(c)).view(np.uint64) for c in ("mask", "fp"))
        for mask in np.unique(masks):
            own = fps[masks == mask]
            for fine in split_masks(int(mask)):
                m = np.full(len(own), fine, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (own, m, own & m)], ["fp", "mask", "key"])


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links among distinct fingerprints ``fp`` that span every group connected within ``radius`` bits.

    Buckets hold distinct fingerprints only, and those above ``bucket`` are split, SPLITS times at most; a bucket
    yields at most one link less than it has members.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    open_rows = distinct.select("fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    ready = None
    for level in range(SPLITS + 1):
        counted = cut(open_rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-counts")
        rows = cut(open_rows.join(counted, ["mask", "key"]), "simhash-buckets")
        full = (F.col("n") > bucket) & F.lit(level < SPLITS)
        small = rows.where(~full).select("mask", "key", "fp")
        ready = small if ready is None else ready.union(small)
        if level == SPLITS or counted.where(full).isEmpty():
            break
        open_rows = rows.where(full).select("mask", "fp").mapInArrow(_finer, "fp long, mask long, key long").distinct()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def out(parts: list[np.ndarray]) -> list[tuple[int, int]]:
            return _links_within(np.unique(np.concatenate(parts)), radius)

        for batch in batches:
            mask, key, fp = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            links: list[tuple[int, int]] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                if s == e:
                    continue
                now = (mask[s], key[s])
                if now != last and held:
                    links += out(held)
                    held = []
                last = now
                held.append(fp[s:e])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
        if held and (links := out(held)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return ready.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(link, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    Texts meet only as distinct fingerprints, each with the smallest doc_id that has it, so thousands of copies
    are one node. component_id is the smallest doc_id reachable over links. A null or empty text has fingerprint zero
    and is linked like any other; a text shorter than a shingle is one shingle. Rows that repeat a doc_id, or have
    none, are fingerprinted alone; where all of a component have none, component_id is null. Other columns are not read.
    """
    signed = cut(fingerprints(docs), "simhash-signed")
    distinct = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    links = cut(near_links(distinct, radius), "simhash-links")
    parts = connected_components(links)
    grouped = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = cut(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-least")
    named = grouped.join(least, "component").select("fp", "component_id")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their group; all columns. Rows without a doc_id stay.
    Of rows that repeat a kept doc_id all stay where they are in the same group."""
    groups_ = simhash_groups(docs.select("doc_id", "text"), radius)
    gone = groups_.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
