"""Per-text operators against plain Python: repetition, fingerprints, pieces, personal data."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from testimony.llm import piece_scan, queries, repetition, skipchain_pii
from testimony.llm.covering_simhash import covering_masks, fingerprint, simhash_groups, split_masks
from testimony.llm.textbatch import PLAIN_WORD, Texts
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def noise(seed: int, words: int, vocabulary: int = 6) -> str:
    r = random.Random(seed)
    return "".join(r.choice(["ab", "c", "dé", "###", "the", "Q|"][:vocabulary]) + r.choice([" ", " ", "\n", "\t", "  "]) for _ in range(words))


# repetition


def plain_counts(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines))}
    twice = {x for x, n in Counter(lines).items() if n > 1}
    out["dup_line_chars"] = sum(len("".join(WORD.findall(x))) for x in lines if x in twice)
    for n in (3, 5, 7, 10):
        seen = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        inside = {k + j for k in range(len(words) - n + 1) if seen[tuple(words[k : k + n])] > 1 for j in range(n)}
        out[f"words_{n}"], out[f"chars_{n}"] = len(inside), sum(len(words[k]) for k in inside)
    return out


def test_repetition_counts_match_plain_python():
    texts = [*ODD, *(noise(i, i * 7) for i in range(40))]
    found = repetition.measure(Texts(pa.array(texts)), [3, 5, 7, 10])
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in found.items()} == plain_counts(text)


def test_repetition_rows(docs_of):
    clean = " ".join(f"w{i}" for i in range(80))
    rows = {r.doc_id: r for r in repetition.repetition_quality(docs_of(*ODD, clean, "same line of words here\n" * 30)).collect()}
    assert rows[len(ODD)].kept and not rows[len(ODD)].base_failed
    assert rows[len(ODD) + 1].base_failed and not rows[len(ODD) + 1].kept
    assert rows[0].n_words == 0 and rows[0].base_failed
    assert rows[None] is not None


def test_words_do_not_cross_texts():
    texts = Texts(pa.array(["a b", "c", "", None, "d"]))
    texts.find_words(PLAIN_WORD)
    assert texts.first.tolist() == [0, 2, 3, 3, 3, 4] and len(texts.starts) == 4


def test_sliced_columns_are_read_from_their_offset():
    texts = Texts(pa.array(["one", "two three", "four"]).slice(1))
    texts.find_words(PLAIN_WORD)
    assert [texts.bytes[s:e].tobytes() for s, e in zip(texts.starts, texts.ends, strict=True)] == [b"two", b"three", b"four"]


# fingerprints


def plain_fingerprint(text: str | None) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_plain_python():
    for text in [*ODD, "ÀB É", *(noise(i, i) for i in range(30))]:
        assert fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_some_mask_covers_every_small_difference():
    r = random.Random(4)
    masks = covering_masks()
    assert len(masks) == 15
    for _ in range(5000):
        difference = sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
        assert any(not difference & m for m in masks)
        for m in masks:
            if not difference & m:
                assert any(not difference & s for s in split_masks(m))


@pytest.mark.parametrize("bucket", [512, 2])
def test_near_groups_match_brute_force(llm, bucket):
    """Random fingerprints with planted neighbours; a tiny bucket size forces the exact splitting of full buckets."""
    from testimony.llm.covering_simhash import near_links

    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(12)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = near_links(llm.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket).collect()
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        parent[root(a)] = root(b)
    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                assert root(a) == root(b)


def test_simhash_rows(docs_of):
    base = " ".join(f"word{i}" for i in range(400))
    rows = simhash_groups(docs_of(base, base, base.upper(), *ODD)).collect()
    assert len(rows) == len(ODD) + 5
    component = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert component[0] == component[1] == component[2] == 0
    empty = [i + 3 for i, t in enumerate(ODD) if not WORD.search(t or "")]
    assert {component[i] for i in empty} == {min(empty)}
    assert simhash_groups(docs_of(extra=False)).collect() == []


# pieces


@pytest.fixture(scope="module")
def vocabulary():
    return piece_scan.Vocabulary.load(queries.PIECES)


def test_pieces_match_the_library(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    lattice = piece_scan.Lattice(vocabulary)
    r = random.Random(2)
    bits = ["s.", ",x", "'s", "www.", "#", "***", "(a)", "-", "don't", "e.g.", "...", "▁.", "the", "ing", "er", "aaaa", "  ", "   ", " ", "é", "中", "\n", "\t", "x", "0", "ment", ".", "aa", "b", "tion", "▁", "\U0001f600", "ll"]
    for case in range(400):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 40)))
        text = text.replace(" ", "").replace("▁", "") if case % 3 == 0 else text
        want = model.encode(text)
        assert np.frombuffer(lattice.encode(text), "<i4").tolist() == want
        chunks = piece_scan.cut_up(text, vocabulary, r.randint(17, 40))
        steps = piece_scan.path([c.transfer(lattice) for c in chunks])
        ids = b"".join(c.trace(lattice, a, b) for c, (a, b) in zip(chunks, steps, strict=True))
        assert np.frombuffer(ids, "<i4").tolist() == want
        assert piece_scan.decode(np.array(want, int), vocabulary) == text.replace("▁", " ")


def test_products_of_transfer_matrices_are_associative(vocabulary):
    lattice = piece_scan.Lattice(vocabulary)
    chunks = piece_scan.cut_up("abcdefghijklmnopqrstuvwxyz" * 8, vocabulary, 40)
    m = [c.transfer(lattice) for c in chunks]
    assert len(m) >= 4 and any(x.size > 1 for x in m)
    left = piece_scan.product(piece_scan.product(m[0], m[1]), m[2])
    assert (left == piece_scan.product(m[0], piece_scan.product(m[1], m[2]))).all()


def test_encoding_rows(llm, docs_of, vocabulary):
    texts = [*ODD, "long text without end " * 40, "q" * 700]
    rows = piece_scan.decoded(piece_scan.encode(docs_of(*texts), vocabulary, chunk=128), vocabulary, lists=True).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            assert r.text == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
    assert piece_scan.encode(docs_of(extra=False), vocabulary).collect() == []


@pytest.mark.parametrize("lists", [False, True])
def test_encoding_and_decoding_in_one_worker_gives_the_same_rows(docs_of, vocabulary, lists):
    texts = [*ODD, "long text without end " * 40, "q" * 700]
    plain = piece_scan.decoded(piece_scan.encode(docs_of(*texts), vocabulary, chunk=128), vocabulary, lists)
    both = piece_scan.encode_decoded(docs_of(*texts), vocabulary, chunk=128, lists=lists)
    assert both.schema == plain.schema
    assert sorted(map(repr, both.collect())) == sorted(map(repr, plain.collect()))
    assert piece_scan.encode_decoded(docs_of(extra=False), vocabulary, lists=lists).collect() == []


def test_a_task_of_the_encoding_stage_holds_one_worker(llm, docs_of):
    """Executors keep every worker that their tasks ever held at once, with all its memory."""
    import corpus_pipeline

    def held(node) -> int:
        below = [held(node.children().apply(i)) for i in range(node.children().size())]
        if "Exchange" in node.nodeName():
            most.extend(below)
            return 0
        return max(below, default=0) + (node.nodeName() in ("MapInArrow", "PythonMapInArrow", "FlatMapGroupsInArrow"))

    most: list[int] = []
    encoded = corpus_pipeline.encoding(llm, docs_of("a text", "q" * 9000), "")
    most.append(held(encoded._jdf.queryExecution().executedPlan().initialPlan()))
    assert max(most) == 1


# personal data


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and skipchain_pii.luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_patterns_match_plain_python():
    r = random.Random(6)
    for _ in range(4000):
        text = "".join(r.choice("0123456789.@@ab-+ ()é%1112") for _ in range(r.randint(0, 45)))
        assert skipchain_pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("number, right", [("79927398713", True), ("79927398710", False), ("0", True), ("18", True), ("81", False)])
def test_luhn(number, right):
    assert skipchain_pii.luhn(number) is right


def test_field_labels_other_forms_of_what_the_patterns_found(docs_of):
    said = "ring +1 (202) 555-0143 at noon, later 202-555-0143 or 2025550143; 999888 stays a number"
    corpus = docs_of(*[f"write to user{i}@mail.example or +1 (303) 555-{1000 + i} from 10.0.0.{i % 200} about {i * 7919}" for i in range(300)], said, *ODD)
    field = skipchain_pii.train(corpus)
    rows = {r.doc_id: r for r in skipchain_pii.find_personal_data(corpus, field).collect()}
    found = rows[300]
    assert [said[s.start : s.end] for s in found.base] == ["+1 (202) 555-0143"]
    assert [(s.kind, said[s.start : s.end]) for s in found.added] == [("phone", "202-555-0143"), ("phone", "2025550143")]
    assert rows[301].base == rows[301].added == []
    masked = {r.doc_id: r for r in skipchain_pii.mask_personal_data(corpus, field).collect()}
    assert masked[300].text == "ring [PHONE] at noon, later [PHONE] or [PHONE]; 999888 stays a number"
    assert masked[303].text == ODD[2] and masked[301].text is None and masked[300].th == "did"


def test_field_without_training_adds_nothing(docs_of):
    field = skipchain_pii.train(docs_of("no data here", extra=False))
    rows = skipchain_pii.find_personal_data(docs_of("call 5551234567 or 5551234567", extra=False), field).collect()
    assert rows[0].added == []


def test_long_runs_take_linear_time():
    assert skipchain_pii.base_spans("1" * 200_000 + " " + "a" * 200_000 + "@ " + "+1" + "(" * 100_000) == []
