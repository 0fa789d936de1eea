"""Substring dedup with difference-cover anchors.

A difference cover modulo PERIOD holds, for any two positions, a shift below PERIOD that takes both onto cover
positions. So two equal windows of WINDOW words share an equal anchor of WINDOW - PERIOD + 1 words that stands on a
cover position in both, and hashing 4 of 13 positions is enough to find every window that may be repeated. Each
repeated anchor is extended to the windows around it, and those are compared whole.

Hashes travel packed: each group of texts sends one row to each bucket of the hash range, with one entry for each
different hash, so a passage in a third of all texts is one entry a group. Buckets answer with the places that are
repeated. Groups are numbered by partition and place within it, so both passes read written tables or files.

There are as many buckets as it takes for each to hold the hashes of ``BUCKET_TEXT`` bytes of text, so that a bucket is
one task's table however much text there is, and so that 32 bits of an anchor, beside the bucket, are as telling in any
corpus: an anchor that only looks repeated has its text read once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.llm.textbatch import PLAIN_WORD, Texts, gram_sums, grams, groups, mix

WINDOW = 20
PERIOD = 13
#: A perfect difference set: every difference modulo 13 occurs between two of its members.
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose hashes are sent together, and of text whose hashes meet in one bucket. A group sends each bucket one
#: row, so both go up together: with 256 MB each, 100 TB are 400 000 groups and as many buckets.
GROUP_TEXT = 16 << 20
BUCKET_TEXT = 16 << 20

_COVER = np.array(COVER, np.int64)
_ON_COVER = np.isin(np.arange(PERIOD), _COVER)
_SECOND = 0xA0761D6478BD642F | 1
_PACKED = "bucket int, grp long, n int, data binary"


def _buckets(docs: DataFrame) -> int:
    held = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()["bytes"] or 0
    return max(64, -(-held // BUCKET_TEXT))


def _planes(values: np.ndarray) -> bytes:
    """Rising numbers as gaps, low and high halves apart, which Spark's codec shrinks well."""
    gaps = np.diff(values, prepend=0).astype(np.uint32)
    return (gaps & 0xFFFF).astype("<u2").tobytes() + (gaps >> 16).astype("<u2").tobytes()


def _unplanes(data: bytes, n: int) -> np.ndarray:
    low, high = np.frombuffer(data, "<u2", n), np.frombuffer(data, "<u2", n, 2 * n)
    return np.cumsum(low.astype(np.int64) + (high.astype(np.int64) << 16))


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, ["bucket", "grp", "n", "data"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()])


def _first_in(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are the first with their key, and which keys occur more than once."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    same = np.ones(max(n - 1, 0), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    first, multi = np.ones(n, bool), np.zeros(n, bool)
    first[order[1:][same]] = False
    multi[order[1:][same]] = True
    multi[order[:-1][same]] = True
    return first, multi


class _Group:
    """Entries of some texts, in order, until they are sent."""

    def __init__(self) -> None:
        self.size = 0
        self.keys: list[list[np.ndarray]] = []
        self.counts: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.places: list[np.ndarray] = []

    def add(self, size: int, ids: np.ndarray, counts: np.ndarray, keys: list[np.ndarray], places: np.ndarray | None = None) -> None:
        self.size += size
        self.ids.append(ids)
        self.counts.append(counts)
        self.keys.append(keys)
        if places is not None:
            self.places.append(places)

    def send(self, number: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """One row for each bucket with entries: keys, gaps of their ordinals, and with anchors a bit for keys met again
        in the group. A row of bucket -1 - x tells the texts and the ordinals that need no answer."""
        grp = (TaskContext.get().partitionId() << 32) + number
        keys = [np.concatenate(k) for k in zip(*self.keys, strict=True)]
        windows = bool(self.places)
        first, multi = _first_in(*keys)
        known = np.flatnonzero(~first if windows else multi)
        sent = np.flatnonzero(first)
        where = ((keys[-1][sent] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        sent, where = sent[order], where[order]
        edges = np.flatnonzero(np.diff(where, prepend=-1, append=buckets))
        rows = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = sent[s:e]
            last = keys[-1][at].astype(np.uint32).tobytes()
            head = keys[0][at].astype("<u8").tobytes() + last if windows else last
            tail = b"" if windows else np.packbits(multi[at]).tobytes()
            rows.append((int(where[s]), grp, e - s, head + _planes(at) + tail))
        counts = np.concatenate(self.counts).astype("<u4")
        told = np.array([len(counts), len(known), len(keys[0])], "<u4").tobytes() + np.concatenate(self.ids, axis=1).astype("<i8").tobytes() + counts.tobytes() + _planes(known)
        if windows:
            told += np.diff(np.concatenate(self.places), prepend=0).astype("<i4").tobytes()
        rows.append((-1 - grp % buckets, grp, 0, told))
        yield _packed(rows)


def _read_group(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text ids (2, n), entries of each text, ordinals known without an answer, places of the entries."""
    n, known, entries = np.frombuffer(data, "<u4", 3).tolist()
    at = 12
    ids = np.frombuffer(data, "<i8", 2 * n, at).reshape(2, n)
    at += 16 * n
    counts = np.frombuffer(data, "<u4", n, at).astype(np.int64)
    at += 4 * n
    own = _unplanes(data[at : at + 4 * known], known)
    at += 4 * known
    places = np.cumsum(np.frombuffer(data, "<i4", entries, at)) if at < len(data) else np.zeros(0, np.int64)
    return ids, counts, own, places


def _answers(table: pa.Table, windows: bool) -> pa.Table:
    """For one bucket: of each group the ordinals that are repeated (anchors) or also stand earlier (windows)."""
    bucket, grp = table.column("bucket")[0].as_py(), np.asarray(table.column("grp"))
    sizes, data = np.asarray(table.column("n")), table.column("data").to_pylist()
    if bucket < 0:
        return pa.table({"grp": pa.array(grp), "told": pa.array(data, pa.binary()), "hits": pa.nulls(len(data), pa.binary())})
    order = np.argsort(grp, kind="stable")
    width = 12 if windows else 4
    keys, ordinals, again, owner = [], [], [], []
    for row in order.tolist():
        d, n = data[row], int(sizes[row])
        keys.append((np.frombuffer(d, "<u8", n), np.frombuffer(d, "<u4", n, 8 * n)) if windows else (np.frombuffer(d, "<u4", n),))
        ordinals.append(_unplanes(d[width * n : (width + 4) * n], n))
        owner.append(np.full(n, row))
        if not windows:
            again.append(np.unpackbits(np.frombuffer(d, np.uint8, offset=8 * n), count=n).astype(bool))
    first, multi = _first_in(*[np.concatenate(k) for k in zip(*keys, strict=True)])
    if windows:
        hit = ~first
    else:
        seen = np.concatenate(again)
        one = np.concatenate([k[0] for k in keys])
        hit = ~seen & (multi | np.isin(one, one[seen]))
    ordinal, row = np.concatenate(ordinals)[hit], np.concatenate(owner)[hit]
    edges = np.flatnonzero(np.diff(row, prepend=-1, append=-2)) if len(row) else np.zeros(1, np.int64)
    found = [(int(grp[row[s]]), None, ordinal[s:e].astype("<u4").tobytes()) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return pa.Table.from_batches([_rows(found, ["grp", "told", "hits"], [pa.int64(), pa.binary(), pa.binary()])]) if found else pa.table({"grp": pa.array([], pa.int64()), "told": pa.array([], pa.binary()), "hits": pa.array([], pa.binary())})


def _by_text(table: pa.Table, windows: bool) -> pa.Table:
    """For one group: of each text with repeats its anchors' ordinals, or the spans of words to remove."""
    told = next((x for x in table.column("told").to_pylist() if x is not None), None)
    hits = [np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("hits").to_pylist() if x is not None]
    ids, counts, own, places = _read_group(told)
    every = np.sort(np.concatenate([own, *hits]))
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, every, side="right")
    edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-2)) if len(doc) else np.zeros(1, np.int64)
    did, th, out = [], [], []
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        d = int(doc[s])
        did.append(int(ids[0, d]))
        th.append(int(ids[1, d]))
        if windows:
            starts = places[every[s:e]]
            gap = np.flatnonzero(np.diff(starts) > WINDOW)
            spans = np.stack([starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + WINDOW])
            out.append(spans.T.astype("<u4").tobytes())
        else:
            out.append((every[s:e] - (ends[d] - counts[d])).astype("<u4").tobytes())
    return pa.table({"did": pa.array(did, pa.int64()), "th": pa.array(th, pa.int64()), "found": pa.array(out, pa.binary())})


def _meet(packed: DataFrame, windows: bool) -> DataFrame:
    """(did, th, found) of the texts with repeats, from the rows that the groups have sent."""
    answered = packed.groupBy("bucket").applyInArrow(lambda t: _answers(t, windows), "grp long, told binary, hits binary")
    return answered.groupBy("grp").applyInArrow(lambda t: _by_text(t, windows), "did long, th long, found binary")


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(rows.column("did")), np.asarray(rows.column("th"))])


def _anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    group, number = _Group(), 0
    for batch in batches:
        for rows in groups(batch):
            texts = Texts(rows.column("text"))
            texts.find_words(PLAIN_WORD)
            words = np.diff(texts.first)
            local = np.arange(len(texts.starts)) - texts.first[:-1][texts.doc]
            at = np.flatnonzero(_ON_COVER[local % PERIOD] & (local + ANCHOR <= words[texts.doc]) & (words[texts.doc] >= WINDOW))
            if len(at):
                group.add(len(texts.bytes), _ids(rows), np.bincount(texts.doc[at], minlength=texts.n), [grams(gram_sums(texts.word_hash()), ANCHOR, at)])
            if group.size >= GROUP_TEXT:
                yield from group.send(number, buckets)
                group, number = _Group(), number + 1
    if group.keys:
        yield from group.send(number, buckets)


def _windows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    group, number, last = _Group(), 0, None
    for batch in batches:
        for rows in groups(batch):
            ids = _ids(rows)
            new = np.ones(len(rows), bool)
            new[1:] = (ids[:, 1:] != ids[:, :-1]).any(axis=0)
            new[0] = last is None or bool((ids[:, 0] != last).any())
            last = ids[:, -1]
            if not new.all():
                rows, ids = rows.filter(pa.array(new)), ids[:, new]
            if not rows.num_rows:
                continue
            texts = Texts(rows.column("text"))
            texts.find_words(PLAIN_WORD)
            found = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows.column("found").to_pylist()]
            k, doc = np.concatenate(found), np.repeat(np.arange(texts.n), [len(x) for x in found])
            anchor = PERIOD * (k // len(COVER)) + _COVER[k % len(COVER)]
            begin = np.maximum(anchor - (PERIOD - 1), 0) + texts.first[doc]
            end = np.minimum(anchor, np.diff(texts.first)[doc] - WINDOW) + texts.first[doc] + 1
            step = np.bincount(begin, minlength=len(texts.starts) + 1) - np.bincount(end, minlength=len(texts.starts) + 1)
            at = np.flatnonzero(np.cumsum(step) > 0)
            hashes = texts.word_hash()
            keys = [grams(gram_sums(hashes), WINDOW, at), grams(gram_sums(mix(hashes + np.uint64(_SECOND)), _SECOND), WINDOW, at, _SECOND)]
            group.add(len(texts.bytes), ids, np.bincount(texts.doc[at], minlength=texts.n), keys, at - texts.first[:-1][texts.doc[at]])
            if group.size >= GROUP_TEXT:
                yield from group.send(number, buckets)
                group, number = _Group(), number + 1
    if group.keys:
        yield from group.send(number, buckets)


def kept_words(text: str | None, spans: bytes) -> tuple[int, int, str]:
    """Word count, removed count and the kept words joined by one space."""
    words = (text or "").encode().split()
    keep, at, gone = [], 0, 0
    for s, e in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
        keep += words[at:s]
        at = e
        gone += e - s
    return len(words), gone, b" ".join(keep + words[at:]).decode()


def substring_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables about ``docs`` (doc_id, text): every row with all its words, and the documents that lose some.

    The first is (doc_id, did, th, n_words, whole), the second (did, th, n_removed, rest, spans), unique in
    (did, th) but for repeated rows. A word goes where a window of WINDOW words covers it whose word sequence also
    starts earlier: in a document with a smaller doc_id or earlier in the same one. ``whole`` and ``rest`` are words
    joined by one space; spans holds the removed word ranges as pairs of unsigned 32-bit little-endian numbers. A
    document is a doc_id with a text: rows that repeat both are one document and get the same result; with a doc_id
    that several texts share, the order of a hash of the text decides. A null doc_id comes after all others. A null or
    empty text has no words, one shorter than the window keeps all. Other columns are not read.
    """
    buckets = _buckets(docs)
    keyed = docs.selectExpr(
        "cast(doc_id as long) as doc_id",
        "coalesce(cast(doc_id as long), 9223372036854775807) as did",
        "xxhash64(cast(text as string)) as th",
        "cast(text as string) as text",
    )
    suspect = _meet(keyed.select("did", "th", "text").mapInArrow(lambda it: _anchors(it, buckets), _PACKED), windows=False)
    nominated = cut(keyed.select("did", "th", "text").join(suspect, ["did", "th"]), "cover-nominated")
    ordered = nominated.repartitionByRange("did", "th").sortWithinPartitions("did", "th")
    spans = _meet(ordered.mapInArrow(lambda it: _windows(it, buckets), _PACKED), windows=True)
    cuts = nominated.select("did", "th", "text").join(spans.withColumnRenamed("found", "spans"), ["did", "th"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                done = [kept_words(t.as_py(), s.as_py()) for t, s in zip(rows.column("text"), rows.column("spans"), strict=True)]
                n, gone, kept = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([rows.column("did"), rows.column("th"), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), rows.column("spans")], ["did", "th", "n_removed", "rest", "spans"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                words = [(t.as_py() or "").encode().split() for t in rows.column("text")]
                kept = [b" ".join(w).decode() for w in words]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("did"), rows.column("th"), pa.array(map(len, words), pa.int64()), pa.array(kept, pa.string())], ["doc_id", "did", "th", "n_words", "whole"])

    changed = cuts.mapInArrow(remove, "did long, th long, n_removed long, rest string, spans binary")
    return keyed.mapInArrow(whole, "doc_id long, did long, th long, n_words long, whole string"), changed


def dedup_substrings(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of ``docs``; see substring_repeats. With ``digest``, kept_sha256
    in place of kept, so that no text is shuffled for the final join."""
    whole, changed = substring_repeats(docs)
    name = "kept_sha256" if digest else "kept"
    say = (lambda c: F.sha2(c, 256)) if digest else F.col
    changed = changed.select("did", "th", "n_removed", say("rest").alias("rest")).dropDuplicates(["did", "th"])
    rows = whole.select("doc_id", "did", "th", "n_words", say("whole").alias("whole")).join(changed, ["did", "th"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("rest", "whole").alias(name))
