"""Benchmark decontamination through an FM-index of every training shard.

Documents are indexed once, shard by shard, into a written table. Test phrases (13-word windows of the benchmark)
come in blocks; a block is broadcast, searched backwards in every index, located through sampled suffix positions,
and the words it covers are merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testimony.functions.scale import cut
from testimony.llm.fm_index import FMIndex
from testimony.llm.textbatch import ALNUM_WORD, Texts, groups

WINDOW = 13
#: Words of one index. A longer text is indexed in pieces that overlap by WINDOW - 1 words.
SHARD_WORDS = 1 << 20
#: Phrases searched at once; so many are collected and broadcast (8 * WINDOW bytes each).
BLOCK = 200_000

_PIECE = pa.struct([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])
_INDEX = "pieces array<struct<uid: long, doc_id: long, n_words: long, at: long, start: long, size: long>>, index binary"


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard: its index, and of each piece the row, where in the index's text it stands (at), the first
    word's number in the document (start) and its words (size)."""
    base = TaskContext.get().partitionId() << 40
    count = 0
    pieces: list[dict] = []
    hashes: list[np.ndarray] = []
    size = 0

    def shard() -> pa.RecordBatch:
        at = np.cumsum([0] + [p["size"] for p in pieces])
        for i, p in enumerate(pieces):
            p["at"] = int(at[i]) + i
        index = FMIndex.build(np.concatenate(hashes), at[1:])
        return pa.RecordBatch.from_arrays([pa.array([pieces], pa.list_(_PIECE)), pa.array([index.to_bytes()], pa.binary())], ["pieces", "index"])

    for batch in batches:
        for rows in groups(batch):
            texts = Texts(rows.column("text"), lower=True)
            texts.find_words(ALNUM_WORD)
            words = texts.word_hash()
            for row, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                lo, hi = int(texts.first[row]), int(texts.first[row + 1])
                start = 0
                while True:
                    if pieces and size + hi - lo - start > SHARD_WORDS:
                        yield shard()
                        pieces, hashes, size = [], [], 0
                    take = min(hi - lo - start, SHARD_WORDS)
                    pieces.append({"uid": base + count, "doc_id": doc_id, "n_words": hi - lo, "at": 0, "start": start, "size": take})
                    hashes.append(words[lo + start : lo + start + take])
                    size += take
                    if lo + start + take >= hi:
                        break
                    start += take - (WINDOW - 1)
                count += 1
    if pieces:
        yield shard()


def build_index(docs: DataFrame) -> DataFrame:
    """The written table of shard indexes of ``docs`` (doc_id, text)."""
    narrow = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return cut(narrow.mapInArrow(_index_rows, _INDEX), "fm-index")


def phrases_of(benchmark: DataFrame) -> DataFrame:
    """(item, words): every window of every item; words are the packed hashes of up to WINDOW words. Rows that share an
    item_id are one item; a null item_id is an item whose name is empty; a text without words has no window."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in groups(batch):
                texts = Texts(rows.column("text"), lower=True)
                texts.find_words(ALNUM_WORD)
                words = texts.word_hash()
                items, out = [], []
                for row, item in enumerate(rows.column("item").to_pylist()):
                    own = words[texts.first[row] : texts.first[row + 1]]
                    for k in range(max(len(own) - WINDOW, 0) + 1 if len(own) else 0):
                        items.append(item)
                        out.append(own[k : k + WINDOW].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, pa.binary())], ["item", "words"])

    narrow = benchmark.selectExpr("coalesce(cast(item_id as string), '') as item", "cast(text as string) as text")
    return narrow.mapInArrow(cut_up, "item string, words binary").distinct()


def search(index: DataFrame, phrases: DataFrame, block: int = BLOCK) -> DataFrame:
    """(uid, spans, phrases) for each text piece with occurrences, a written table: merged word ranges, and the phrases found.

    ``phrases`` is (phrase, words), one row a phrase, a written table. Every block of them is searched in every index. One
    block at a time is held by the driver and the workers: its hits are written before the next one is read.
    """
    spark = index.sparkSession
    found = None
    blocks = phrases.count() // block + 1
    for number in range(blocks):
        part = phrases.where(F.pmod("phrase", F.lit(blocks)) == number).select("phrase", "words").toArrow()
        ids = np.asarray(part.column("phrase")).astype(np.int64)
        words = part.column("words").to_pylist()
        lengths = np.array([len(w) // 8 for w in words], np.int64)
        table = np.zeros((len(words), WINDOW), np.uint64)
        for i, w in enumerate(words):
            table[i, : lengths[i]] = np.frombuffer(w, "<u8")
        shared = spark.sparkContext.broadcast((ids, lengths, table))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, lengths, table = shared.value
            for batch in batches:
                for data, pieces in zip(batch.column("index"), batch.column("pieces"), strict=True):
                    fm = FMIndex.from_bytes(data.as_buffer())
                    low, high = fm.find(table, lengths)
                    some = np.flatnonzero(high > low)
                    if not len(some):
                        continue
                    times = high[some] - low[some]
                    rows = np.repeat(low[some] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    phrase = np.repeat(some, times)
                    where = fm.locate(rows)
                    fields = pieces.values.flatten()
                    uid, at, start = (np.asarray(fields[i]) for i in (0, 3, 4))
                    piece = np.searchsorted(at, where, side="right") - 1
                    begin = where - at[piece] + start[piece]
                    order = np.lexsort((begin, uid[piece]))
                    yield _by_piece(uid[piece][order], begin[order], begin[order] + lengths[phrase][order], ids[phrase][order])

        rows = cut(index.mapInArrow(look, "uid long, spans array<struct<s: long, e: long>>, phrases array<long>"), "fm-hits")
        shared.unpersist()
        found = rows if found is None else found.union(rows)
    return found


def _by_piece(uid: np.ndarray, begin: np.ndarray, end: np.ndarray, phrase: np.ndarray) -> pa.RecordBatch:
    edges = np.flatnonzero(np.diff(uid, prepend=-1, append=-1))
    spans, phrases = [], []
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        reach = np.maximum.accumulate(end[s:e])
        new = np.flatnonzero(begin[s + 1 : e] > reach[:-1]) + 1
        firsts = np.concatenate([[0], new])
        lasts = np.concatenate([new, [e - s]]) - 1
        spans.append([{"s": a, "e": b} for a, b in zip(begin[s:e][firsts].tolist(), reach[lasts].tolist(), strict=True)])
        phrases.append(np.unique(phrase[s:e]).tolist())
    kinds = (pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((uid[edges[:-1]], spans, phrases), kinds, strict=True)], ["uid", "spans", "phrases"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans, n_hit, items, contaminated) for each row of ``docs`` (doc_id, text) against
    ``benchmark`` (item_id, text).

    Words are runs of ASCII letters, digits and anything beyond ASCII, with A-Z lower-cased. spans are the merged word
    ranges of benchmark windows, ends exclusive; items the item_ids with occurring windows, sorted as strings. A
    document is contaminated where at least a twentieth of its words is hit. Null and empty texts have no words; rows
    that repeat a doc_id, or have none, are judged alone; an empty table on either side gives no hits. Other columns are
    not read.
    """
    index = build_index(docs)
    windows = phrases_of(benchmark).select("item", "words", F.xxhash64("words").alias("phrase"))
    items = cut(windows, "fm-phrases")
    hits = search(index, cut(items.dropDuplicates(["phrase"]), "fm-searched"))
    texts = index.select(F.explode("pieces").alias("p")).where("p.start = 0").select("p.uid", "p.doc_id", "p.n_words")
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.expr("cast(array() as array<struct<s: long, e: long>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x))),
    )
    spans = hits.groupBy("uid").agg(merged.alias("spans"))
    named = hits.select("uid", F.explode("phrases").alias("phrase")).join(items.select("phrase", "item"), "phrase")
    named = named.groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = texts.join(spans, "uid", "left").join(named, "uid", "left")
    none = F.expr("cast(array() as array<struct<s: long, e: long>>)")
    rows = rows.withColumn("spans", F.coalesce("spans", none)).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    rows = rows.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"]))
    return rows.select("uid", "doc_id", "n_words", "spans", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")).drop("uid")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose doc_id has a contaminated text; all columns. A row without a doc_id stays."""
    gone = decontaminate(docs.select("doc_id", "text"), benchmark).where("contaminated").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
