"""Bytes 1C to 1F belong to words, also where a text is ASCII."""

from __future__ import annotations

from testimony.llm import cover_dedup


def test_dedup_keeps_separator_bytes_in_words(docs_of):
    passage = " ".join(f"p{i}\x1dq" for i in range(24))
    texts = ["a\x1fb", "one\x1c two\x1d\x1ethree\t four", passage, "head\x1c " + passage]
    rows = {r.doc_id: r for r in cover_dedup.dedup_substrings(docs_of(*texts)).collect() if r.doc_id is not None}
    assert [(rows[i].n_words, rows[i].n_removed) for i in range(4)] == [(1, 0), (3, 0), (24, 0), (25, 24)]
    assert [rows[i].kept for i in range(4)] == ["a\x1fb", "one\x1c two\x1d\x1ethree four", passage, "head\x1c"]
