"""Near copies against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import pytest

from testimony.llm import near_copies
from tests.llm.conftest import ODD


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def firsts(texts: list[str | None]) -> set[int]:
    """Documents that are the smallest of their component."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) > 0:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if root(i) == i}


def planted(r: random.Random) -> list[str | None]:
    """Copies with some words changed, most of them changed again, and a passage that a third of all texts hold."""
    passage = " ".join(f"shared{i}" for i in range(30))
    texts: list[str | None] = list(ODD)
    for base in range(12):
        words = [f"w{r.randrange(4000)}" for _ in range(r.choice([3, 40, 120, 400]))]
        for copy in range(8):
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                words[r.randrange(len(words))] = f"x{r.randrange(4000)}"
            texts.append(" ".join(words) + (" " + passage if (base + copy) % 3 == 0 else ""))
    return texts + [texts[20].upper(), texts[21].replace(" ", "\n")]


@pytest.mark.parametrize("seed", [5, 6])
def test_near_copies_match_brute_force(docs_of, seed):
    texts = planted(random.Random(seed))
    rows = near_copies.keep_first(docs_of(*texts)).collect()
    assert {r.doc_id for r in rows if r.doc_id is not None} == firsts(texts)
    assert sum(r.doc_id is None for r in rows) == 2 and set(rows[0].asDict()) == {"doc_id", "text", "th", "n_words", "uid"}
    assert near_copies.keep_first(docs_of(extra=False)).collect() == []


def test_stage_drops_a_copy_beyond_three_bits(llm, docs_of):
    """A copy with two words changed differs in more fingerprint bits than the covering tables reach."""
    import corpus_pipeline
    from testimony.llm.covering_simhash import fingerprint

    r = random.Random(3)
    words = [f"w{r.randrange(9000)}" for _ in range(120)]
    other = [*words[:30], "changed", *words[31:90], "again", *words[91:]]
    texts = [" ".join(words), " ".join(other), " ".join(f"v{r.randrange(9000)}" for _ in range(120))]
    assert (fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode())).bit_count() > 3
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(llm, docs_of(*texts, extra=False), "").collect()} == {0, 2}


def test_covering_tables_come_first(llm, docs_of, monkeypatch):
    """What is linked in the covering tables is compared before anything else is; it need not meet in a bucket's first text."""
    import corpus_pipeline

    met, meet = [], near_copies._met_by_simhash
    monkeypatch.setattr(near_copies, "_met_by_simhash", lambda nodes: met.append(meet(nodes).collect()) or meet(nodes))
    r = random.Random(8)
    words = [f"w{r.randrange(9000)}" for _ in range(900)]
    texts = [" ".join(words), " ".join([*words[:-1], "last"]), " ".join(f"v{r.randrange(9000)}" for _ in range(900))]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(llm, docs_of(*texts, extra=False), "").collect()} == {0, 2}
    assert [len(x) for x in met] == [1]


def test_a_large_group_is_not_compared_pair_by_pair(docs_of, monkeypatch):
    """Copies of one text with changes of their own: most pairs are near 0.8, some below it and some above."""
    r = random.Random(9)
    words = [f"w{r.randrange(9000)}" for _ in range(150)]
    texts = []
    for _ in range(240):
        changed = list(words)
        for _ in range(r.choice([1, 1, 2, 2, 3])):
            changed[r.randrange(len(words))] = f"x{r.randrange(9000)}"
        texts.append(" ".join(changed))
    written, cut = {}, near_copies.cut

    def counted(frame, name):
        out = cut(frame, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "cut", counted)
    assert {r.doc_id for r in near_copies.keep_first(docs_of(*texts, extra=False)).collect()} == firsts(texts)
    assert written["near-rest"] < 240 * 8  # of 28680


def test_sketches_rule_out_no_near_copy(llm):
    """Sizes on both sides of a sketch's growth; distances that brute force gives for the sets."""
    import numpy as np

    r = np.random.default_rng(4)
    rows = []
    for size in (1, 5, 60, 500, 513, 1030, 4090):
        base = r.integers(0, 1 << 63, size, dtype=np.uint64)
        for more in (0, size // 30, size // 4, size):
            x, y = np.unique(base), np.unique(np.concatenate([base[more // 2 :], r.integers(0, 1 << 63, more, dtype=np.uint64)]))
            longs = [max(near_copies.BRIEF, 1 << (-(-max(len(s), 1) // 64) - 1).bit_length()) for s in (x, y)]
            one, brief = ([near_copies._sketches(np.zeros(len(s), np.int64), s, np.array([n])).to_pylist()[0] for s, n in zip((x, y), ns, strict=True)] for ns in (longs, [near_copies.BRIEF] * 2))
            both = len(np.intersect1d(x, y))
            rows.append((len(x), len(y), *one, *brief, 5 * both >= 4 * (len(x) + len(y) - both), len(x) + len(y) - 2 * both))
    frame = llm.createDataFrame(rows, "m int, n int, p array<long>, q array<long>, s array<long>, t array<long>, near boolean, apart int")
    frame = frame.where(near_copies._SIZED.format("m", "n"))
    kept = frame.selectExpr("near", "apart", "m + n as size", f"{near_copies._ALIKE.format('m', 'n', 'p', 'q')} as alike", f"{near_copies._BRIEFLY.format('m', 'n', 's', 't')} as briefly").collect()
    assert all(x.alike and x.briefly for x in kept if x.near) and sum(x.near for x in kept) >= 10
    assert not any(x.alike for x in kept if 2 * x.apart > x.size and x.size > 100)
