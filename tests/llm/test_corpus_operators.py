"""Operators over whole corpora against plain Python and SQL: dedup, decontamination, quality, chat, urls, archives."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from contract.check import compare, duck
from testimony.llm import arc_convert, chat_collapse, components, cover_dedup, crf_quality, fm_decontam, queries, url_equivalence
from testimony.llm.fm_index import FMIndex, suffix_order
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_agrees_with_sql(llm, con, name):
    assert compare(queries.REGISTRY[name](llm, SF), con, queries.ORACLE[name]) == ""


# substring dedup


def plain_dedup(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words, gone = WORD.findall(text or ""), set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        out[doc_id] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def test_every_pair_of_places_meets_on_the_cover():
    on = set(cover_dedup.COVER)
    for i in range(13):
        for j in range(13):
            assert any((i + d) % 13 in on and (j + d) % 13 in on for d in range(13))


def test_dedup_matches_brute_force(docs_of):
    r = random.Random(3)
    shared = [" ".join(f"s{k}w{i}" for i in range(r.randint(20, 60))) for k in range(6)]
    texts = [" ".join(r.choice([f"u{n}x{r.randint(0, 10**6)} " * r.randint(1, 30), r.choice(shared)]) for _ in range(6)) for n in range(40)]
    texts += [texts[0], texts[1] + " tail", "loop around " * 40, *ODD]
    rows = cover_dedup.dedup_substrings(docs_of(*texts)).collect()
    assert len(rows) == len(texts) + 2
    want = plain_dedup(enumerate(texts))
    for row in rows:
        if row.doc_id is not None:
            assert (row.n_words, row.n_removed, row.kept) == want[row.doc_id]


def test_repeated_rows_are_one_document(llm):
    text = " ".join(f"w{i}" for i in range(30))
    rows = cover_dedup.dedup_substrings(llm.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 9, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 30), (9, 30)]
    assert cover_dedup.dedup_substrings(llm.createDataFrame([], "doc_id long, text string")).collect() == []


# index


def test_suffix_order_is_right():
    r = np.random.default_rng(1)
    for size in (1, 2, 5, 50, 400):
        codes = np.append(r.integers(1, 4, size), 0)
        assert suffix_order(codes, 4).tolist() == sorted(range(size + 1), key=lambda i: codes[i:].tolist())


def test_building_an_index_holds_six_longs_a_word_at_most():
    import tracemalloc

    r = np.random.default_rng(4)
    words = r.zipf(1.2, 1 << 18).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words[70_000:120_000] = words[:50_000]
    FMIndex.build(words[:100], np.array([100]))
    tracemalloc.start()
    FMIndex.build(words, np.array([1000, len(words)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * 8 * len(words)


def test_index_finds_all_occurrences():
    r = np.random.default_rng(2)
    for _ in range(20):
        texts = [r.integers(1, 4, r.integers(0, 50)).astype(np.uint64) for _ in range(r.integers(1, 6))]
        words, breaks = np.concatenate(texts), np.cumsum([len(t) for t in texts])
        index = FMIndex.from_bytes(FMIndex.build(words, breaks).to_bytes())
        begin = np.concatenate([[0], breaks[:-1]]) + np.arange(len(texts))
        phrases = r.integers(1, 6, (20, 4)).astype(np.uint64)
        lengths = r.integers(0, 5, 20)
        low, high = index.find(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
            want = [int(s) + k for s, t in zip(begin, texts, strict=True) for k in range(len(t) - n + 1) if n and (t[k : k + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == sorted(want)


def test_decontamination_rows(llm, docs_of, monkeypatch):
    """Small shards, so that long texts are cut into overlapping pieces, and small blocks."""
    item = " ".join(f"q{i}" for i in range(20))
    texts = [f"before {item} after", f"{'pad ' * 900}{item}", "short item here", item.upper() + "!", *ODD]
    bench = llm.createDataFrame([(7, item, 1), (10, "Short item", 1), (10, "short item", 2), (8, None, 1), (None, "pad pad", 1)], "item_id long, text string, doc_id int")
    for words, block in ((1 << 20, 200_000), (40, 3)):
        monkeypatch.setattr(fm_decontam, "SHARD_WORDS", words)
        monkeypatch.setattr(fm_decontam.search, "__defaults__", (block,))
        rows = {r.doc_id: r for r in fm_decontam.decontaminate(docs_of(*texts), bench).collect()}
        assert (rows[0].n_hit, rows[0].items, rows[0].contaminated) == (20, ["7"], True)
        assert (rows[1].n_hit, rows[1].items, rows[1].contaminated) == (920, ["", "7"], True)
        assert [tuple(s) for s in rows[1].spans] == [(0, 920)]
        assert (rows[2].n_hit, rows[2].items) == (2, ["10"])
        assert rows[3].n_hit == 20 and rows[4].n_hit == 0 and not rows[4].contaminated
    kept = {r.doc_id for r in fm_decontam.keep_clean(docs_of(*texts), bench).collect()}
    assert kept == {4 + i for i in range(len(ODD))} | {None}
    assert fm_decontam.decontaminate(docs_of(*texts), bench.limit(0)).where("contaminated").count() == 0
    assert fm_decontam.decontaminate(docs_of(extra=False), bench).collect() == []


# quality


def test_messages_match_enumeration():
    """Marginals of a chain of four lines against the sum over all labellings; and of a chain that ends early."""
    r = np.random.default_rng(5)
    features, first = r.normal(size=(6, 3)), np.array([True, False, False, False, True, False])
    field = crf_quality.LineField(r.normal(size=3), r.normal(size=(2, 2)), np.zeros(3), np.ones(3))
    good, _ = field.marginals(features, first)
    for begin, end in ((0, 4), (4, 6)):
        total, sums = 0.0, np.zeros(end - begin)
        for labels in np.ndindex(*[2] * (end - begin)):
            score = sum((features[begin + i] @ field.weights) * (y - 0.5) for i, y in enumerate(labels))
            score += sum(field.pair[a, b] for a, b in zip(labels, labels[1:]))  # noqa: B905
            total += np.exp(score)
            sums += np.exp(score) * np.array(labels)
        assert np.allclose(good[begin:end], sums / total)


def test_quality_is_learned_and_held_out_documents_are_not(llm):
    docs, labels = (llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = crf_quality.train(docs, labels)
    rows = crf_quality.score_quality(docs, field).withColumn("held_out", crf_quality.held_out()).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 40 and sum(r.predicted == r.quality for r in unseen) >= 0.95 * len(unseen)
    again = labels.withColumn("quality", labels.quality * 0 + 1).where(crf_quality.held_out()).unionByName(labels.where(~crf_quality.held_out()))
    assert np.array_equal(crf_quality.train(docs, again).weights, field.weights)


def test_quality_rows(docs_of, llm):
    labels = llm.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    field = crf_quality.train(docs_of(*ODD), labels)
    rows = crf_quality.score_quality(docs_of(*ODD), field).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    blank = crf_quality.train(docs_of(*ODD), labels.limit(0))
    assert {r.score for r in crf_quality.score_quality(docs_of(*ODD), blank).collect()} == {0.5}
    kept = crf_quality.keep_good(docs_of(*ODD), blank)
    assert kept.count() == len(ODD) + 2 and kept.columns == docs_of("x").columns
    assert crf_quality.score_quality(docs_of(extra=False), field).collect() == []


# chat


def test_snapshots_collapse(llm):
    log = [("user", "hi"), ("assistant", "hello"), ("user", "bye <|im_end|>"), ("assistant", None)]
    rows = [(c, t, role, text, "x") for c, n in ((5, 1), (6, 2), (7, 4), (9, 4)) for t, (role, text) in enumerate(log[:n])]
    rows += [(8, 0, "user", "hi"[:2] + "!", "x"), (None, 0, "user", "hi", "x"), (7, 1, "assistant", "hello", "x"), (3, None, None, None, "x")]
    out = chat_collapse.render(llm.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")).collect()
    convs = {r.conv_id: (r.n_turns, r.n_copies) for r in out}
    assert convs == {7: (4, 2), 8: (1, 1), 3: (1, 1)}
    text = "".join(r.rendered for r in sorted(out, key=lambda r: r.place) if r.conv_id == 7)
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye <| im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert chat_collapse.render(llm.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_long_conversations_cross_tasks(llm):
    rows = [(1, t, "user", f"m{t}") for t in range(3000)] + [(2, t, "user", f"m{t}") for t in range(1500)] + [(3, t, "user", f"m{t + (t > 700)}") for t in range(900)]
    hashed, kept = chat_collapse.collapse(llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    assert {(r.conv_id, r.n_turns) for r in kept.collect()} == {(1, 3000), (3, 900)}
    assert hashed.where("conv_id = 1").select("place").distinct().count() == 3000


# components and urls


def test_components_match_union_find(llm):
    r = random.Random(8)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(100)] + [(1000, 2000 + i) for i in range(300)] + [(i, i + 1) for i in range(3000, 3100)] + [(5000, 5000), (None, 3), (3, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = components.connected_components(llm.createDataFrame(edges, "a long, b long")).collect()
    assert {(x.node, x.component) for x in found} == {(x, root(x)) for x in list(parent)}


def test_blocks_reach_aliases(llm):
    rules = queries.URL_RULES
    pages = [
        (1, "http://a.org/x", '<link href="http://blog.example.com/en/1" rel=canonical>'),
        (2, "https://b.org/y?q=1#f", '<META HTTP-EQUIV="Refresh" content="0; URL=http://a.org/x">'),
        (3, "http://c.com/z", '<link rel="canonical" href="//b.org/y?q=1">'),
        (4, "http://d.org/dir/page", '<link rel="canonical" href="other">'),
        (5, "http://d.org/dir/other", None),
        (6, "HTTP://WWW.Example.COM/en/", ""),
        (7, "ftp://x.net/es/a?b", "<p>"),
        (8, None, None),
        (9, "no scheme", "<link rel=canonical href=http://a.org/x>"),
        (10, "http://example.com", None),
        (2, "http://b.org/y?q=1", None),
        (11, "http://e.org/a/b/c", '<link rel=alternate href="http://blog.example.com/en/canonical">'),
        (12, "http://f.org/a", '<!-- <link rel="canonical" href="http://blog.example.com/en/1"> --><p>'),
        (13, "http://g.org/a/b/c", '<link rel="canonical" href="../../x/./1?a=1&amp;b=2#top">'),
        (14, "http://g.org/x/1?a=1&b=2", "<meta http-equiv=refresh content='3;url=http://h.net/a/../fr/1'>"),
        (15, "http://i.org/q", '<link rel="nofollow Canonical" href="?v=1">'),
        (16, "http://i.org/q?v=1", '<link href="http://h.net/fr/2" rel="canonical"/>'),
        (17, "http://j.org", '<link rel="canonical" href="mailto:a@blog.example.com/en/">'),
        (18, "http://k.org", "<link rel=canonical href=http://net/es/><link rel=canonical href=http://k.org/z>"),
        (19, "http://k.org/", "<!-- <link rel=canonical"),
    ]
    frame = llm.createDataFrame([(*p, "n") for p in pages], "page_id long, url string, html string, node string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_equivalence.judge_urls(frame, rules).collect())
    assert got == sorted(
        [
            (1, "a.org", "/x", None, "block"),
            (2, "b.org", "/y", None, "block"),
            (2, "b.org", "/y", None, "block"),
            (3, "c.com", "/z", "com/", "allow"),
            (4, "d.org", "/dir/page", None, "allow"),
            (5, "d.org", "/dir/other", None, "allow"),
            (6, "www.example.com", "/en/", "www.example.com/en/", "allow"),
            (7, "x.net", "/es/a", "net/es/", "block"),
            (8, "", "", None, "allow"),
            (9, "", "", None, "allow"),
            (10, "example.com", "", None, "allow"),
            (11, "e.org", "/a/b/c", None, "allow"),
            (12, "f.org", "/a", None, "allow"),
            (13, "g.org", "/a/b/c", None, "block"),
            (14, "g.org", "/x/1", None, "block"),
            (15, "i.org", "/q", None, "block"),
            (16, "i.org", "/q", None, "block"),
            (17, "j.org", "", None, "allow"),
            (18, "k.org", "", None, "block"),
            (19, "k.org", "/", None, "block"),
        ],
        key=lambda x: (x[0], x[1]),
    )
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    assert sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE['op4_url_equivalence']})").fetchall(), key=str) == sorted(got, key=str)
    assert url_equivalence.judge_urls(frame.limit(0), rules).collect() == []
    assert {r.verdict for r in url_equivalence.judge_urls(frame, []).collect()} == {"allow"}


def test_many_rules_are_a_table(llm):
    """A block list of a hundred thousand hosts is joined, not written into the plan."""
    rules = llm.range(100_000).selectExpr("if(id % 3 = 0, 'allow', 'block') as verdict", "concat('h', id, '.org') as host", "if(id % 2 = 0, '/', '/x/') as path")
    rules = rules.union(llm.createDataFrame([("block", "org", "/x/y/")] * 2 + [("allow", "h1.org", "/x/"), (None, "org", "/"), ("block", None, "/")], "verdict string, host string, path string"))
    pages = llm.createDataFrame([(1, "http://h1.org/x/1"), (2, "http://a.h2.org/"), (3, "http://h3.org/y"), (4, "http://h3.org/x/y/z"), (5, "http://h5.org/x/y/z")], "page_id long, url string").selectExpr("*", "cast(null as string) as html")
    got = {r.page_id: (r.rule, r.verdict) for r in url_equivalence.judge_urls(pages, rules).collect()}
    assert got == {1: ("h1.org/x/", "allow"), 2: ("h2.org/", "block"), 3: (None, "allow"), 4: ("h3.org/x/", "allow"), 5: ("h5.org/x/", "block")}


# archives


def test_pages_go_through_both_archive_formats(llm, tmp_path):
    odd = ["a" * 100, "a" * 100, "b" * 99, "b" * 99, None, "", "WARC/1.1\r\n\r\n\r\n\r\nfiledesc://x\n" * 9, "é\n" * 200, "é\n" * 200, "x" * 300_000, "\n" * 150]
    rows = [(i, f"http://h/{i} \n", t, "d") for i, t in enumerate(odd)] + [(None, None, "a" * 100, "d"), (5, "u", "a" * 100, "d"), (20, "filedesc://x", "c" * 100, "d"), (21, "filedesc://y", "c" * 100, "d")]
    found = arc_convert.archive_pages(llm, llm.createDataFrame(rows, "page_id long, url string, html string, digest string"), str(tmp_path / "one")).collect()
    want = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in rows if p is not None and h == html] if len(payload) >= 100 else []
        again = bool(same) and min(same) != page
        want.append((-1 if page is None else page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", min(same) if again else -1))
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in found) == sorted(want)
    none = llm.createDataFrame([], "page_id long, url string, html string")
    assert arc_convert.archive_pages(llm, none, str(tmp_path / "two")).collect() == []


def test_version_one_headers_and_cut_off_records(llm, tmp_path):
    body = b"1 0 Test\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://f 0.0.0.0 19970101000000 text/plain %d\n" % len(body) + body
    data += b"\nhttp://a/ 1.2.3.4 19970203040506 text/html; charset=x 6\nab\ncd\n\nhttp://b/ 1.2.3.4 bad text/plain 0\n\n\nrubbish\nhttp://c/ 1.2.3.4 19970203040507 text/plain 50\ntoo short"
    (tmp_path / "arc").mkdir()
    with gzip.open(tmp_path / "arc" / "old.arc.gz", "wb") as f:
        f.write(data)
    rows = sorted(arc_convert.read_arc(llm, str(tmp_path / "arc")).collect(), key=lambda r: r.number)
    assert [(r.url, r.content_type, bytes(r.block), r.truncated) for r in rows] == [("http://a/", "text/html; charset=x", b"ab\ncd\n", False), ("http://b/", "text/plain", b"", False), ("http://c/", "text/plain", b"too short", True)]
    arc_convert.convert_arc(llm, str(tmp_path / "arc"), str(tmp_path / "warc"))
    warc = sorted((r for r in arc_convert.read_warc(llm, str(tmp_path / "warc")).collect() if r.type != "warcinfo"), key=lambda r: r.url)
    assert [(r.url, r.date, bytes(r.block)) for r in warc] == [("http://a/", "1997-02-03T04:05:06Z", b"ab\ncd\n"), ("http://b/", "1970-01-01T00:00:00Z", b""), ("http://c/", "1997-02-03T04:05:07Z", b"too short")]
    assert all(r.payload_digest == f"sha256:{hashlib.sha256(bytes(r.block)).hexdigest()}" and r.id.startswith("<urn:uuid:") for r in warc)


# pipeline


def test_pipeline_keeps_what_each_stage_alone_would(llm):
    """Every stage on what its predecessor kept, against sets worked out by the operators' own brute-force twins."""
    import corpus_pipeline
    import sentencepiece

    docs = llm.read.parquet(f"{SF}/documents.parquet")
    labels = llm.read.parquet(f"{SF}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in crf_quality.score_quality(docs, crf_quality.train(docs, labels)).where("predicted = 1").collect()}
    from tests.llm.test_near_copies import firsts
    from tests.llm.test_text_operators import plain_spans

    ids = sorted(good)
    first = {ids[i] for i in firsts([text[d] for d in ids])}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    windows = {tuple(w[i : i + 13]) for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words(r.text)) for i in range(max(len(w) - 13, 0) + 1)}
    clean = set()
    for d in first:
        w = words(text[d])
        hit = {k + j for k in range(len(w)) for n in {len(x) for x in windows} if tuple(w[k : k + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(d)
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    rows = corpus_pipeline.run(llm, SF).collect()
    assert {r.doc_id for r in rows} == clean and len(rows) == len(clean)
    for r in rows:
        assert r.ids == model.encode(r.text) and r.n_tokens == len(r.ids)
        if not plain_spans(text[r.doc_id]):
            assert r.text == text[r.doc_id]
        else:
            assert not plain_spans(r.text)
