"""Spelling variants, shuffled shards and aligned tokens against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contract.check import compare, duck
from testimony.llm import bucket_shuffle, queries, spelling_groups, token_alignment
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


# spelling


def plain_groups(rows: list[tuple]) -> dict[str, tuple]:
    """(form, root, n, n_near, form_n) of each word, by sets of shortened and holed words."""
    counts: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    held = {w: n for w, n in counts.items() if n >= 3}
    holes, near = defaultdict(set), defaultdict(set)
    for w in held:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            less = w[:i] + w[i + 1 :]
            if less in held:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in held:
        best = min(near[w], key=lambda x: (-held[x], x), default=None)
        if best is not None and held[best] >= 2 * held[w]:
            form[w] = best

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), held[w], len(near[w]), held.get(form.get(w))) for w in held}


def planted_words(r: random.Random) -> list[str | None]:
    letters = "abcdexyzéÿ×"
    bases = ["".join(r.choice(letters) for _ in range(r.randint(4, 12))) for _ in range(25)] + ["aaaaaa", "ababababab", "z" * 300, "é" * 70]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(60):
            w = r.choice(bases)
            if r.random() < 0.4:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        texts.append(r.choice([" ", "-", "1", "\n"]).join(words))
    chain = " ".join(["brighten"] * 20 + ["brightens"] * 8 + ["brightenss"] * 3)
    return [*texts, *ODD, texts[0], " ".join(bases * 4), chain]


@pytest.mark.parametrize(("seed", "full"), [(1, 256), (2, 1)])
def test_spelling_groups_match_brute_force(docs_of, seed, full):
    texts = planted_words(random.Random(seed))
    got = {r.word: tuple(r)[1:] for r in spelling_groups.spelling_groups(docs_of(*texts), full=full).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_groups([*enumerate(texts), (None, None), (None, "no id at all")])
    assert got == want and any(v[0] for v in want.values()) and any(v[0] != v[1] for v in want.values() if v[0])
    assert spelling_groups.spelling_groups(docs_of(extra=False)).collect() == []


def test_neighbourhood_is_full_and_names_each_string_once(monkeypatch):
    r = random.Random(3)
    for k in (2, 3):
        for n in (1, 4, 7):
            rows = np.array([[r.randrange(k) for _ in range(n)] for _ in range(6)])
            for stretch in (1 << 20, 1):
                monkeypatch.setattr(spelling_groups, "KEYS", stretch)
                found = defaultdict(list)
                for row, key in spelling_groups.neighbourhood(rows, k, k, True, True, True):
                    for i, x in zip(row.tolist(), key.tolist(), strict=True):
                        found[i].append(x)
                for i, word in enumerate(rows.tolist()):
                    near = {tuple(word)} | {tuple(word[:j] + word[j + 1 :]) for j in range(n)} | {tuple(word[:j] + [t] + word[j + 1 :]) for j in range(n) for t in range(k)} | {tuple(word[:j] + [t] + word[j:]) for j in range(n + 1) for t in range(k)}
                    keys = sorted(int(spelling_groups._hash(np.array([x], np.int64).reshape(1, -1), k)[0]) for x in near)
                    assert sorted(found[i]) == keys


def test_giant_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling_groups, "PIECE", 7)
    for text in ["", "abc", "abcdefghijklmnop", "ab cd ef gh ij kl", "abcdefg hijklmn", "é1" * 20, "     " * 5]:
        pieces = list(spelling_groups._pieces(text))
        assert "".join(pieces) == text and [x for p in pieces for x in spelling_groups.RUN.findall(p)] == spelling_groups.RUN.findall(text)


def test_spelling_query_agrees_with_sql(llm):
    assert compare(queries.op11_spelling_groups(llm, SF), duck(SF), queries.ORACLE["op11_spelling_groups"]) == ""


# shards


def test_shards_are_a_permutation(llm, docs_of):
    texts = [*ODD, *["copy"] * 100, *[f"text {i} " * (i % 40) for i in range(150)]]
    docs = docs_of(*texts).withColumns({"slot": F.lit("own"), "extra": F.create_map(F.lit("a"), F.col("did") if "did" in docs_of(extra=False).columns else F.col("th"))})
    rows = bucket_shuffle.shuffle_shards(docs, shards=7, bucket_bytes=3000).collect()
    assert len(rows) == len(texts) + 2 and set(rows[0].asDict()) == {"doc_id", "text", "th", "n_words", "uid", "extra", "shard", "slot"}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == sorted([(False, i, t or "") for i, t in enumerate(texts)] + [(True, 0, ""), (True, 0, "no id at all")])
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    order = lambda rows: [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order(rows) == order(bucket_shuffle.shuffle_shards(docs, shards=7, bucket_bytes=3000).collect())
    assert order(rows) != order(bucket_shuffle.shuffle_shards(docs, shards=7, bucket_bytes=3000, seed=12).collect())


def test_shards_mix_what_came_together(llm):
    """Neighbours in the input end up anywhere: the mean rank of every tenth of the input is near the middle."""
    rows = bucket_shuffle.shuffle_shards(llm.range(4000).selectExpr("id as doc_id", "'same text' as text"), shards=4, bucket_bytes=2000).collect()
    at = {r.doc_id: i for i, r in enumerate(sorted(rows, key=lambda r: (r.shard, r.slot)))}
    for tenth in range(10):
        assert abs(np.mean([at[i] for i in range(400 * tenth, 400 * (tenth + 1))]) - 2000) < 250


def test_rows_that_are_all_alike_scatter(llm):
    alike = llm.createDataFrame([(1, "x" * 50)] * 600, "doc_id long, text string").repartition(12)
    rows = bucket_shuffle.shuffle_shards(alike, shards=16, bucket_bytes=4000).collect()
    assert Counter(r.shard for r in rows) == Counter({i: 37 + (i % 2) for i in range(16)}) or max(Counter(r.shard for r in rows).values()) == 38
    assert bucket_shuffle.shuffle_shards(alike.limit(0)).collect() == []
    few = bucket_shuffle.shuffle_shards(alike.limit(3), shards=16).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_written_shards_read_back(llm, tmp_path, docs_of):
    docs = docs_of(*[f"t{i}" for i in range(40)], extra=False)
    bucket_shuffle.write_shards(bucket_shuffle.shuffle_shards(docs, shards=4, bucket_bytes=20), str(tmp_path / "out"))
    back = llm.read.parquet(str(tmp_path / "out"))
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 10, 1: 10, 2: 10, 3: 10}


def test_shard_query_columns(llm):
    rows = queries.op12_bucket_shuffle(llm, SF).collect()
    text = {r.doc_id: r.text for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "rows" and r.grown_shard is None for r in rows)
    assert {r.doc_id for r in rows} == set(text) and len(rows) == len(text)


# tokens


@pytest.fixture(scope="module")
def pair():
    return token_alignment.Pair.load(queries.BYTE_LEVEL, queries.PIECES)


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    """By the libraries and sets of ends, a text at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(queries.BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    a_model.encode_special_tokens = True
    byte_of = {c: b for b, c in token_alignment._byte_characters().items()}
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        held = [[bytes(byte_of[c] for c in a_model.id_to_token(i)) for i in a], [b_bytes(i) for i in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in held):
            out.append(None)
            continue
        ends = [{int(e): i for i, e in enumerate(np.cumsum([len(t) for t in x]))} for x in held]
        groups, links, at = [], [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(map(str, a[at[0] : to[0]])) + "|" + ",".join(map(str, b[at[1] : to[1]])))
            links.append((a[to[0] - 1], b[to[1] - 1]))
            at = to
        counts.update(links)
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [none if x is None else (*x[:3], len(x[4]), sum(counts[p] == most[p[1]] for p in x[4]), sum(counts[p] for p in x[4]), x[3]) for x in out]


HARD = [
    "<|endoftext|> and </s> <unk> are plain text",
    "a ▁ mark of its own",
    "two  blanks, tabs\t and \n lines \n\n end ",
    " leading and trailing ",
    "don't we'll THEY'RE 'tis",
    "日本語 と english 混ぜた、文章。 🙂🙃",
    "a" * 400 + " " + "ab" * 300,
    "nbsp\xa0here   and\x1f there \x00",
    " ",
    "x",
]


@pytest.mark.parametrize("piece", [1 << 18, 40])
def test_alignment_matches_the_libraries(llm, docs_of, pair, monkeypatch, piece):
    r = random.Random(7)
    texts = [*HARD, *ODD, *[" ".join(r.choice(["the", "naïve", "re-run,", "x=1;", "über", "日本", "I'm", "3.14", "\n"]) for _ in range(60)) for _ in range(12)], HARD[0]]
    docs = docs_of(*texts)
    aligner = token_alignment.Aligner(pair)
    monkeypatch.setattr(token_alignment, "PIECE", piece)
    want = plain_alignment(texts)
    # The pieces of a text are cut in the worker, which has its own setting; here they are cut as set.
    for text, (n_a, n_b, n_groups, n_links, *_, digest) in zip(texts, want, strict=True):
        found = aligner.align(text)
        assert (*found[:3], found[3], int(found[5].sum())) == (n_a, n_b, n_groups, digest, n_links)
    rows = token_alignment.summarise(*token_alignment.align(docs, pair), pair)
    rows = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    got = {x.doc_id: tuple(x)[1:] for x in rows if x.doc_id is not None}
    # The two rows without an id count with the corpus.
    whole = plain_alignment([*texts, None, "no id at all"])
    assert [got[i] for i in range(len(texts))] == whole[: len(texts)] and len(rows) == len(texts) + 2
    assert token_alignment.summarise(*token_alignment.align(docs_of(extra=False), pair), pair).collect() == []


def test_galloping_finds_lower_bounds():
    r = np.random.default_rng(2)
    for n, m in [(0, 5), (5, 0), (1, 1), (40, 400), (300, 310), (257, 5000)]:
        short, long = (np.unique(r.integers(0, 3 * max(n, m) + 1, size)) for size in (n, m))
        assert (token_alignment.gallop(short, long) == np.searchsorted(long, short)).all()
        a, b = token_alignment.common_ends(short, long)
        assert (short[a] == long[b]).all() and set(short[a]) == set(short) & set(long)
        b, a = token_alignment.common_ends(long, short)
        assert (short[a] == long[b]).all() and len(a) == len(set(short) & set(long))


def test_a_worker_that_forgets_gives_the_same(pair, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(80)) for i in range(6)]
    whole = [token_alignment.Aligner(pair).align(t)[:4] for t in texts]
    monkeypatch.setattr(token_alignment, "REMEMBER", 10)
    aligner = token_alignment.Aligner(pair)
    assert [aligner.align(t)[:4] for t in texts] == whole


def test_the_fast_encoder_has_the_same_merges(pair):
    slow, fast = token_alignment._merged(pair), token_alignment._ranked(pair)
    for text in [*HARD, *[t for t in ODD if t], "aaaaaaaab" * 200, "thethethe" * 100]:
        assert (slow(text) == fast(text)).all()
