"""Bounds of samples and blocks, and what they must not change."""

from __future__ import annotations

from pyspark.sql import functions as F

from testimony.llm import cover_dedup, fm_decontam
from testimony.llm.sample import within


def test_a_sample_is_cut_in_the_order_of_its_ids_hash(llm):
    rows = llm.range(50).selectExpr("id as doc_id", "10 + id % 7 as n")
    order = [(r.doc_id, r.n) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want, total = set(), 0
    for doc_id, n in order:
        total += n
        if total <= 200:
            want.add(doc_id)
    assert {r.doc_id for r in within(rows, F.col("n"), 200).collect()} == want
    assert within(rows.limit(0), F.col("n"), 200).collect() == []


def test_blocks_of_phrases_find_what_one_block_finds(docs_of, llm, monkeypatch):
    items = [(f"i{k}", " ".join(f"p{k}w{j}" for j in range(20))) for k in range(9)]
    texts = [f"x {items[k][1]} y {items[(k + 1) % 9][1]}" for k in range(9)] + ["nothing of it"]
    bench = llm.createDataFrame(items, "item_id string, text string")

    def run():
        return sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in fm_decontam.decontaminate(docs_of(*texts, extra=False), bench).collect())

    whole = run()
    search = fm_decontam.search
    monkeypatch.setattr(fm_decontam, "search", lambda index, phrases: search(index, phrases, block=10))
    assert run() == whole and [r[2] for r in whole] == [40] * 9 + [0]


def test_buckets_grow_with_the_text(docs_of, monkeypatch):
    texts = ["word " * 50_000, "other words " * 9000]
    frame = docs_of(*texts, extra=False)
    few = [tuple(r) for r in cover_dedup.dedup_substrings(frame).collect()]
    monkeypatch.setattr(cover_dedup, "BUCKET_TEXT", 1000)
    assert cover_dedup._buckets(frame) == 358
    assert sorted(tuple(r) for r in cover_dedup.dedup_substrings(frame).collect()) == sorted(few)
