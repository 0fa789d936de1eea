"""Different texts that sums of letters and places confuse: the order of Thue and Morse against its mirror."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from testimony.llm import cover_dedup, fm_decontam, near_copies, repetition
from testimony.llm.textbatch import PLAIN_WORD, Texts

SWAP = str.maketrans("ab", "ba")
ONE = "a"
while len(ONE) < 4096:
    ONE += ONE.translate(SWAP)
TWO = ONE.translate(SWAP)


def test_words_of_any_length_have_hashes_of_their_own():
    words = sorted({ONE[:n] for n in range(1, 200)} | {TWO[:n] for n in range(1, 200)} | {ONE, TWO, ONE[:1024], TWO[:1024], "é" * 5, "é" * 6, "\x00", "\x00\x00"})
    texts = Texts(pa.array([" ".join(words) + " " + " ".join(words)]))
    texts.find_words(PLAIN_WORD)
    hashes = texts.word_hash()
    assert len(np.unique(hashes)) == len(words) and (hashes[: len(words)] == hashes[len(words) :]).all()


def test_mirrored_lines_and_words_are_no_repeats(docs_of, llm):
    row = repetition.repetition_quality(docs_of(f"{ONE}\n{TWO}", extra=False)).first()
    assert (row.n_dup_lines, row.dup_line_chars) == (0, 0)
    tail = [f"w{i}" for i in range(19)]
    texts = [" ".join([ONE[:1024], *tail]), " ".join([TWO[:1024], *tail])]
    assert [r.n_removed for r in cover_dedup.dedup_substrings(docs_of(*texts, extra=False)).collect()] == [0, 0]
    bench = llm.createDataFrame([("x", " ".join([ONE[:1024], *tail[:12]]))], "item_id string, text string")
    assert sorted((r.doc_id, r.n_hit) for r in fm_decontam.decontaminate(docs_of(*texts, extra=False), bench).collect()) == [(0, 13), (1, 0)]
    short = [ONE[:1024], TWO[:1024]]
    assert {r.doc_id for r in near_copies.keep_first(docs_of(*short, extra=False)).collect()} == {0, 1}


def test_a_common_shingle_is_dealt_out_and_found(docs_of, monkeypatch):
    """A third of all texts hold one passage; near copies of each other only by what else they say."""
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [f"{passage} " + " ".join(f"u{n}x{i}" for i in range(30)) if n % 3 == 0 else " ".join(f"v{n}x{i}" for i in range(40)) for n in range(60)]
    texts += [texts[0] + " more", texts[3].replace("u3x29", "other"), f"{passage} a b", f"{passage} a c", passage]
    monkeypatch.setattr(near_copies, "COMMON", 9)
    from tests.llm.test_near_copies import firsts

    assert {r.doc_id for r in near_copies.keep_first(docs_of(*texts, extra=False)).collect()} == firsts(texts)
